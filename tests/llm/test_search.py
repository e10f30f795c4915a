"""Ranked search, hard negatives and embedding near-duplicates against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logveil.llm import embedding_dedup, hard_negatives, lexical_search

UPPER = str.maketrans(lexical_search.UPPER, lexical_search.LOWER)
VECTORS = "vec_id long, embedding array<float>, label int, h1 string, node string, `a.b` int"


def terms(text):
    return re.findall(lexical_search.TERM, (text or "").translate(UPPER))


def plain_search(rows, items, top):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    big_n, big_l = len(bags), sum(n for *_, n in bags)
    queries = defaultdict(set)
    for item, text in items:
        queries[item].update(terms(text))
    out = []
    for item, wanted in queries.items():
        scored = []
        for i, bag, n in bags:
            m = 50 + 50 * n * big_n // big_l
            score = 0
            for t in wanted & set(bag):
                w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * sum(t in b for _, b, _ in bags) + 1)))
                score += w * (10**9 * bag[t] // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, -(1 << 63) if i is None else i, i))
        for rank, (score, _, i) in enumerate(sorted(scored, key=lambda s: s[:2])[:top], 1):
            out.append((item, rank, i, -score))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_terms", [1 << 16, 7])
def test_lexical_search(spark, block_terms):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(30)] + ["Été", "ß", "中文", "x"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 40)))) for i in range(60)]
    rows += [(None, "w1 w2, W3"), (7, rows[7][1]), (7, rows[7][1]), (70, None), (71, ""), (72, "..."), (73, "w5 " * 30000)]
    items = [(f"q{i}", " ".join(rng.choices(pool, k=12))) for i in range(9)]
    items += [("q1", "w1 ÉTÉ"), (None, "w2-w3 X"), ("none", None), ("empty", "?!"), ("new", "unheard words")]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, score string")
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, rank int")
    got = lexical_search.search(docs, asked, top=8, block_terms=block_terms)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(rows, items, 8)
    assert lexical_search.search(docs.limit(0), asked).collect() == [] == lexical_search.search(docs, asked.limit(0)).collect()


@pytest.mark.parametrize("width", [64, 2])
def test_shared_sums_equal_plain_sums_with_fewer_additions(width):
    rng = np.random.default_rng(6)
    core = [set(rng.choice(90, 12, replace=False).tolist()) for _ in range(4)]
    items = [core[i % 4] | set(rng.choice(90, 5).tolist()) for i in range(40)] + [{3}, set(range(90))]
    sums = lexical_search.share(items, 90, width)
    leaves = rng.integers(0, 1000, (90, 7))
    expected = np.array([leaves[sorted(s)].sum(axis=0) for s in items])
    assert (sums.scores(leaves) == expected).all()
    assert len(sums.left) + len(sums.roots) < 0.6 * sum(map(len, items))


def test_words_of_one_hash_are_told_apart():
    lexicon = lexical_search.Lexicon(["alpha", "beta"])
    lexicon.hash[:] = lexicon.hash[0]
    lexicon.most = 2
    w = next(lexical_search.iter_whole(["alpha", "beta", "gamma"]))
    w.hash[:] = lexicon.hash[0]
    word, term = lexicon.find(w)
    assert sorted(zip(word.tolist(), term.tolist())) == [(0, 0), (1, 1)]


# ------------------------------------------------------------------ vectors


def awkward():
    """Clusters, exact copies, nulls, zeros, odd lengths and repeated ids."""
    rng = np.random.default_rng(8)
    rows, centres = [], rng.normal(size=(6, 12))
    for i in range(260):
        v = centres[i % 6] + rng.normal(size=12) * (0.05 if i % 3 else 1.0)
        rows.append((i, v.astype(np.float32).tolist(), int(i % 4)))
    rows += [(300 + i, rows[5][1], 1) for i in range(20)]
    rows += [
        (400, None, 1), (401, rows[5][1], None), (402, [0.0] * 12, 1), (403, [None, *rows[5][1][1:]], 1),
        (404, [float("nan")] * 12, 1), (405, [float("inf")] * 12, 1), (406, [], 1), (407, rows[5][1][:7], 1),
        (408, rows[5][1][:7], 1), (None, rows[5][1], 1), (5, rows[5][1], 1), (5, rows[9][1], 1), (5, rows[5][1], 2),
        (409, [3e38] * 12, 2), (410, [3e38] * 12, 2), (411, [1e-40] * 12, 2),
    ]
    return [(*r, "h", "n", 1) for r in rows]


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("tile, few", [(1 << 23, 2048), (12 * 20, 16)])
def test_embedding_dedup(spark, tile, few):
    rows = awkward()
    low = [-(1 << 63) if r[0] is None else r[0] for r in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if rows[a][2] is None or rows[a][2] != rows[b][2] or not (sound(x) and sound(y)) or len(x) != len(y):
                continue
            if not any(x) or not any(y):
                continue
            u, v = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
            if u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v)) >= 0.98:
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    least = defaultdict(lambda: 1 << 62)
    for i in range(len(rows)):
        least[top(i)] = min(least[top(i)], low[i])
    expected = [(r[0], links[i], least[top(i)], low[i] == least[top(i)]) for i, r in enumerate(rows)]
    table = spark.createDataFrame(rows, VECTORS)
    got = embedding_dedup.near_duplicates(table, tile=tile, few=few)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert embedding_dedup.near_duplicates(table.limit(0)).collect() == []


def test_error_bounds_hold_and_spare_most_pairs():
    rng = np.random.default_rng(3)
    given = rng.normal(size=(400, 64)) * rng.choice([1e-30, 1.0, 1e30], (400, 1))
    given[200:300] = given[:100] * 1.5 + rng.normal(size=(100, 64)) * np.abs(given[:100]).mean(axis=1, keepdims=True) * 0.2
    a = embedding_dedup.Coded(given)
    unit = given / np.linalg.norm(given, axis=1, keepdims=True)
    about = a.products(a) * a.scale[:, None] * a.scale[None, :]
    bound = a.error[:, None] + (1 + a.error[:, None]) * a.error[None, :]
    assert (np.abs(about - unit @ unit.T) <= bound).all()
    i, j, again = embedding_dedup.linked(a, a, 0.98)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*map(np.ndarray.tolist, np.nonzero(unit @ unit.T >= 0.98))))
    assert again < 400 * 400 / 20


def plain_negatives(rows, is_anchor):
    kept = []
    for i, v, label, *_ in rows:
        if i is None or label is None or not sound(v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        whole = [max(-(1 << 27), min(1 << 27, math.floor(256 * float(np.float32(x))))) for x in v]
        kept.append((i, label, whole, v))
    anchors = {}
    for i, label, whole, v in sorted(kept, key=lambda r: (r[0], r[1], r[3])):
        if is_anchor(i):
            anchors.setdefault(i, (label, whole))
    out = []
    for a, (label, own) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(own, w)), i, k == label) for i, k, w, _ in kept if i != a)
        for p, pid, _ in [s for s in scored if s[2]][:5]:
            inside = [s for s in scored if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(a, pid, rank, n, -p, -s) for rank, (s, n, _) in enumerate(inside[:3], 1)]
    return out


@pytest.mark.parametrize("block, sample", [(1 << 21, 2048), (80, 9)])
def test_hard_negatives(spark, block, sample):
    rows = awkward()
    expected = plain_negatives(rows, lambda i: i % 5 == 0)
    table = spark.createDataFrame(rows, VECTORS)
    got = hard_negatives.mine(table, F.col("vec_id") % 5 == 0, block=block, sample=sample)
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 300
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives.mine(table, F.lit(False)).collect() == []


def test_postings_leave_components_out_and_lose_no_pair():
    rng = np.random.default_rng(5)
    scale = 0.9 ** np.arange(64)
    sizes = rng.uniform(0.1, 1.0, (500, 1))
    x, y = (np.floor(256 * rng.normal(size=(n, 64)) * scale) for n in (30, 500))
    y = np.floor(y * sizes)
    score = (x @ y.T).astype(np.int64)
    low = np.sort(score, axis=1)[:, -5]
    found = list(hard_negatives.survivors(x, y, low))
    got = {(a, b, s) for i, j, k in found for a, b, s in zip(i.tolist(), j.tolist(), k.tolist())}
    assert got == {(a, b, int(score[a, b])) for a, b in zip(*np.nonzero(score >= low[:, None]))}
    assert len(found) > 1  # several postings: rows whose last components are not in the index
