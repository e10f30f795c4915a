"""The training-data operators on small cases: plain versions, and inputs that break things."""

import hashlib
import os
import random
import re
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from logveil.llm import bpe, chat_format, decontamination, html_text, language_id, line_dedup
from logveil.llm import quality, simhash_dedup, substring_dedup, token_counts
from logveil.llm.pretokens import Vocabulary

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, row string, block string, "
    "spans string, n_lines string, `a.b` string"
)
PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def passage(rng, n):
    return [rng.choice(["alpha", "beta", "Gamma", "delta,", "été", "x"]) + str(rng.randint(0, 40)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty, short and long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(3)
    shared, other = passage(rng, 30), passage(rng, 400)
    near = [*other[:200], "changed", *other[201:]]
    texts = {
        1: None, 2: "", 3: " \n\t ", 4: "one", 5: "two words", 6: " ".join(shared),
        7: " ".join([*passage(rng, 25), *shared, *passage(rng, 9)]), 8: " ".join(other), 9: " ".join(near),
        10: " ".join(other), 11: " ".join(passage(rng, 20000)), 12: "\n".join(["a b", "c", "d e", "f"] * 3),
        13: "\n".join(["x", "c", "d e", "f", "", "", "", ""]), 14: "é ß ñ " * 60, 15: "1234 " * 70,
    }
    made = [(i, t) for i, t in texts.items()] + [(8, " ".join(other)), (None, " ".join(shared))]
    return [(i, t, "en" if i and i % 2 else None, None, None, "k", "f", "r", "b", "s", "l", "d") for i, t in made]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(PATH)


def low(i):
    return -(1 << 63) if i is None else i


# ------------------------------------------------------------------ repeats


def test_substring_dedup(docs, rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in words:
        for at in range(len(w) - 19):
            k = tuple(w[at : at + 20])
            first[k] = min(first.get(k, (low(i), at)), (low(i), at))
    expected = []
    for i, w in words:
        gone = set()
        for at in range(len(w) - 19):
            if first[tuple(w[at : at + 20])] < (low(i), at):
                gone.update(range(at, at + 20))
        expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(r) for r in substring_dedup.remove_repeats(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert dict((r[0], r[2]) for r in got)[7] == 30 and dict((r[0], r[2]) for r in got)[10] == 400


def test_line_dedup(docs):
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_lines(docs).collect()}
    assert got[12]["text"] == "a b\nc\nd e\nf" and got[12]["n_removed_lines"] == 8
    assert got[13]["text"] == "x\n\n\n\n" and got[13]["n_lines"] == 8  # three blank lines are no window
    assert got[1]["text"] is None and got[2]["text"] == "" and got[8]["source"] is None
    assert got[8]["spans"] == "s" and got[8]["a.b"] == "d" and got[8]["n_lines"] == 1


def test_simhash(docs, rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        shingles = [w[i : i + 3] for i in range(len(w) - 2)] if len(w) > 2 else [w] if w else []
        h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(low(i), fingerprint(t)) for i, t, *_ in rows]
    group = {f: f for _, f in prints}

    def top(f):
        while group[f] != f:
            f = group[f]
        return f

    for a in list(group):
        for b in list(group):
            if (a ^ b).bit_count() <= 3:
                group[top(a)] = top(b)
    least = defaultdict(lambda: 1 << 62)
    for i, f in prints:
        least[top(f)] = min(least[top(f)], i)
    expected = sorted((i, f, least[top(f)]) for i, f in prints)
    got = simhash_dedup.near_duplicates(docs).collect()
    assert sorted((low(r[0]), r[1] & (1 << 64) - 1, r[2]) for r in got) == expected
    kept = simhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id in (1, 2, 3)").count() == 1 and kept.where("doc_id in (8, 10)").count() == 1


def test_large_shards_are_cut_without_losing_links(spark):
    rng = random.Random(1)
    values = sorted({sum(1 << b for b in rng.sample(range(20), 3)) for _ in range(300)})
    table = spark.createDataFrame([(v, n) for n, v in enumerate(values)], "fp long, node long")
    pairs = {tuple(r) for r in simhash_dedup.links(table, shard=16).collect()}

    def roots(edges):
        up = list(range(len(values)))
        for a, b in edges:
            x, y = a, b
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        out = []
        for n in range(len(values)):
            while up[n] != n:
                n = up[n]
            out.append(n)
        return out

    true = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3]
    assert roots(pairs) == roots(true)


# ------------------------------------------------------------------ tokens


def test_tokens(spark, docs, vocabulary):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    signs = list("aabt's'll \n\n\t \x85  　éß٣²中😀​́_!?€͸\x00") + ["<|endoftext|>", "'re", " the"]
    odd = [(1000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 50)))) for i in range(300)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    true = {r[0]: library.encode(r[1] or "", add_special_tokens=False).ids for r in table.collect()}
    for r in bpe.decode(bpe.encode(table, vocabulary), vocabulary).collect():
        assert r["ids"] == true[r["doc_id"]]
        assert r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    for r in bpe.round_trip(table, vocabulary).collect():
        assert r["decoded_sha256"] == sha(library.decode(true[r["doc_id"]], skip_special_tokens=False))
    counts = token_counts.count_tokens(table, vocabulary).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in counts} == {i: len(t) for i, t in true.items()}


def test_overlapping_pairs_merge_from_the_left(vocabulary):
    m = bpe.Merges(vocabulary)
    library = Tokenizer.from_file(PATH)
    pieces = ["a" * n for n in range(1, 40)] + ["", " " * 33, "\n" * 7]
    ids, cut = bpe.encode_pieces(pieces, m)
    assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [library.encode(p).ids for p in pieces]


# ------------------------------------------------------------------ benchmark


@pytest.mark.parametrize("block", [1 << 20, 10])
def test_decontamination(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    items = [("7", rows[6][1]), ("b", "two words"), ("b", "ONE"), ("c", None), ("d", ""), (None, "x1"), ("e", " ".join(rows[5][1].split()[:13]))]
    expected = []
    for i, text, *_ in rows:
        w, hit, names = find(text), set(), set()
        for name, item in items:
            q = find(item)
            n = min(13, len(q))
            for p in {tuple(q[k : k + n]) for k in range(len(q) - n + 1)} if n else ():
                for at in range(len(w) - n + 1):
                    if tuple(w[at : at + n]) == p:
                        hit.update(range(at, at + n))
                        names.add(name or "")
        expected.append((i, len(w), len(hit), sorted(names)))
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    got = [(r[0], r[1], r[2], r[3]) for r in decontamination.find_benchmark(docs, benchmark).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert decontamination.find_benchmark(docs, benchmark.limit(0)).where("n_hit > 0").isEmpty()
    kept = decontamination.retained(docs, benchmark)
    assert kept.columns == docs.columns and {r["a.b"] for r in kept.collect()} == {"d"}


def test_a_very_long_item_is_cut_without_losing_windows(spark, docs, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 1 << 19)
    rng = random.Random(2)
    long = [f"w{rng.randint(0, 10**7)}" for _ in range(2_000_000)]
    edge = decontamination.PIECE
    texts = [(1, " ".join(long[edge - 6 : edge + 7])), (2, " ".join(long[-13:])), (3, " ".join(long[7:19]))]
    benchmark = spark.createDataFrame([("long", " ".join(long))], "item_id string, text string")
    table = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r[0]: r[2] for r in decontamination.find_benchmark(table, benchmark).collect()}
    assert got == {1: 13, 2: 13, 3: 0}
    sizes = [sum(len(p.split()) for _, p in b) for b in decontamination._item_blocks(benchmark)]
    assert len(sizes) > 3 and max(sizes) <= 1 << 19


def test_tasks_need_no_package_on_the_workers(tmp_path):
    """Workers start without the package in reach: driver code alone must be enough."""
    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {str(root)!r})
from logveil.llm import decontamination, lexical_search
docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
items = spark.createDataFrame([("a", "two three")], "item_id string, text string")
assert [r[0] for r in decontamination.retained(docs, items).collect()] == [2]
assert [r[2] for r in lexical_search.search(docs, items).collect()] == [1]
"""
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


# ------------------------------------------------------------------ quality


def test_quality(spark, docs, small):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    field = quality.fit(docs, empty)
    got = {r["doc_id"]: r for r in quality.verdicts(docs, field).collect()}
    assert not got[1]["kept"] and got[8]["kept"] and got[14]["base_failed"] and got[12]["n_dup_lines"] == 8
    assert quality.retained(docs, field).columns == docs.columns
    given = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    judged = quality.verdicts(given, quality.fit(given, labels)).where("not base_failed").join(labels, "doc_id")
    right = judged.where("kept = (quality = 1)").count()
    assert right >= 0.95 * judged.count()


def test_lines_of_one_text_get_both_labels(spark):
    larger = "/root/testdata/sf0.01"
    given, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    found = quality.verdicts(given, quality.fit(given, labels))
    mixed = found.where("content_share > 0 and content_share < 1").count()
    assert mixed >= 0.03 * found.count()


def test_quality_figures(docs, rows):
    expected = {}
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        spots = defaultdict(list)
        for at in range(len(w) - 2):
            spots[tuple(w[at : at + 3])].append(at)
        again = {at + k for places in spots.values() if len(places) > 1 for at in places for k in range(3)}
        seen, copies = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                copies += line in seen
                seen.add(line)
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        expected[i] = (len(w), sum(map(len, w)), symbols, copies, len(again), failed)
    field = quality.Field(np.zeros((12, 2)), np.zeros((2, 2)))
    for r in quality.verdicts(docs, field).collect():
        assert (r[1], r[2], r[3], r[4], r[5], r["base_failed"]) == expected[r["doc_id"]]


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(2)
    field = quality.Field(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    cut, x = np.array([0, 4, 4, 5, 11]), rng.normal(size=(11, 3))
    got = field.content(cut, x)
    for a, b in zip(cut, cut[1:]):
        def score(s):
            return sum((x[a + k] @ field.emit)[v] for k, v in enumerate(s)) + sum(field.move[p, q] for p, q in zip(s, s[1:]))
        best = max((tuple(n >> k & 1 for k in range(b - a)) for n in range(1 << (b - a))), key=score)
        assert tuple(got[a:b].astype(int)) == best


# ------------------------------------------------------------------ language


def test_language_gradients():
    net = language_id.train([b"abc def", b"xyz uvw ddd"], ["a", "b"])
    net = language_id.Network(net.languages, *(p.astype(float) for p in (net.into, net.again, net.out)))
    length, label = np.array([5, 4]), np.array([0, 1])
    symbols = language_id._symbols(np.frombuffer(b"hello wor", np.uint8), np.array([0, 5]), length)
    _, *slopes = language_id.gradients(net, symbols, length, label)
    for p, g, at in ((net.into, slopes[0], (0, 1, 108, 3)), (net.again, slopes[1], (1, 2, 2, 4)), (net.out, slopes[2], (9, 1))):
        p[at] += 1e-5
        up = language_id.gradients(net, symbols, length, label)[0]
        p[at] -= 2e-5
        down = language_id.gradients(net, symbols, length, label)[0]
        p[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_language(spark, docs, small):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(given)
    held = language_id.predict(given, net).join(given.select("doc_id", "lang"), "doc_id").where(language_id.fold("doc_id") == 0)
    assert held.where("lang = lang_pred").count() >= 0.93 * held.count()
    got = {r["doc_id"]: r for r in language_id.predict(docs, net).collect()}
    assert got[1]["lang_pred"] == got[2]["lang_pred"] == got[15]["lang_pred"] == "und" and got[15]["score"] == 0
    assert 0 < got[11]["score"] <= 1
    assert language_id.fit(docs.where("lang is null")) is None
    assert language_id.predict(docs, None).where("lang_pred <> 'und'").isEmpty()


# ------------------------------------------------------------------ chat and pages


def test_chat_escapes_can_be_undone():
    rng = random.Random(1)
    parts = ["<", "|", "[", "\\", "/", "s>", "INST]", "<SYS>>", "turn|>", "end|>", "\n", "x"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        piece, _ = chat_format.render(text, text)
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert list(chat_format.turns(piece * 2)) == [(text, text)] * 2


def test_chat_events(spark):
    log = [
        (1, 0, 1, "open", "user", None), (1, 1, 1, "delta", None, "hi"), (1, 2, 2, "open", "assistant", ""),
        (1, 3, 2, "delta", None, "wrong"), (1, 4, 2, "regenerate", None, None), (1, 5, 2, "delta", None, "ri"),
        (1, 7, 2, "delta", None, "ght"), (1, 6, 3, "open", "user", "gone"), (1, 8, 3, "delete", None, None),
        (1, 9, 1, "edit", None, "hello"), (None, 0, 9, "open", None, "no id"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_events(events, ["seq"]), ["seq"]).collect()}
    assert got[1]["n_turns"] == 2 and got[1]["turns_sha256"] == sha("user\nhello\nassistant\nright\n")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (5, sha("right"))
    assert got[None]["turns_sha256"] == sha("\nno id\n")


def test_pages(spark):
    menu = "<div>start here for all the latest news and offers today</div>"
    html = [
        (1, "http://A.b/1", f"{menu}<div>first  story\n of its own &amp; more</div>"),
        (2, "http://a.b/2", f"{menu}<p>second<br>story<p>goes on<script>var x='</p>'</script>"),
        (3, "http://c.d/3", "<header>top</header><article><h1>T</h1><p>body<section class='comments'>no</section></article>x"),
        (4, "http://c.d/4", None), (5, None, ""), (6, "http://c.d/5", "<div class=ad>buy</div>cut &am"),
        (7, "http://e.f/1", "<p>the same page of one host stands here two times"),
        (8, "http://e.f/2", "<p>the same page of one host stands here two times"),
    ]
    table = spark.createDataFrame(html, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(table).collect()}
    same = "the same page of one host stands here two times"
    assert got == {
        1: "first story of its own & more", 2: "second story\n\ngoes on", 3: "T\n\nbody", 4: "", 5: "",
        6: "cut &am", 7: same, 8: same,
    }
    rng = np.random.default_rng(4)
    tokens, page = rng.integers(0, 3, 300).astype(np.uint64), np.repeat(np.arange(6), 50)
    found = html_text.repeated(tokens, page, (page + 1) * 50, 5)
    grams = defaultdict(set)
    for i in range(300):
        if i % 50 <= 45:
            grams[tuple(tokens[i : i + 5])].add(page[i])
    true = np.zeros(300, bool)
    for i in range(300):
        if i % 50 <= 45 and len(grams[tuple(tokens[i : i + 5])]) > 1:
            true[i : i + 5] = True
    assert (found == true).all()


def texts_of(html):
    return [t for t, _ in html_text.blocks(html)]


def test_articles_are_kept_whole():
    long = "word " * 40
    assert texts_of('<main class="content has-sidebar"><p>Real article text here') == ["Real article text here"]
    assert texts_of('<article><p>One</p><p class="ad">Buy<p>Two<p>Three</article>') == ["One", "Two", "Three"]
    assert texts_of(f"<form><article><p>{long}</article><input><input></form>") == [long.strip()]
    assert texts_of(f"<form><p>{long}</p><input></form>") == [long.strip()]
    assert texts_of("<form><label>Mail</label><p>subscribe now<input></form>x") == ["x"]
    assert texts_of('<p hidden>no</p><p style="display : none">no<p aria-hidden=true>no<p>yes') == ["yes"]
    assert texts_of("<div class=share-price>1</div><div class=no-sidebar>2</div><div class=social-history>3</div>") == ["1", "2", "3"]
    assert texts_of("<div class=site-footer>f</div><div class=comment-list>c</div><div id=ad_slot>a</div>y") == ["y"]
    assert texts_of("<ul><li class=ad>a<li>b</ul><table><tr><td class=ad>x<td>y</table>") == ["b", "y"]
    assert texts_of('<div class="modal"><article class="ad">text</article>') == ["text"]
    assert texts_of('<article>a</article><section class="comments"><article>no</article></section>') == ["a"]


def plain_pages(rows):
    """`main_text` by counting runs of the whole host in a dictionary."""
    hosts = defaultdict(list)
    for page_id, url, html in rows:
        match = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
        hosts[match.group(1).lower() if match else ""].append((page_id, url, html_text.blocks(html)))
    out = []
    for pages in hosts.values():
        standing, ids = defaultdict(set), {i for i, *_ in pages}
        for page_id, _, own in pages:
            w = " ".join(t for t, _ in own).split(" ")
            for k in range(len(w) - 7):
                standing[tuple(w[k : k + 8])].add(page_id)
        for page_id, url, own in pages:
            w = " ".join(t for t, _ in own).split(" ")
            again, common = set(), set()
            for k in range(len(w) - 7):
                n = len(standing[tuple(w[k : k + 8])])
                again.update(range(k, k + 8) if n > 1 else ())
                common.update(range(k, k + 8) if n >= max(5, 0.5 * len(ids)) else ())
            kept, at, declares = [], 0, any(d for _, d in own)
            for text, declared in own:
                parts = text.split(" ")
                here = range(at, at + len(parts))
                at += len(parts)
                left = [p for p, k in zip(parts, here) if k not in again]
                if declares:
                    left = parts if declared and not set(here) <= common else []
                if left:
                    kept.append(" ".join(left))
            out.append((page_id, url, "\n\n".join(kept or [t for t, d in own if d or not declares])))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [1 << 22, 900])
def test_pages_equal_brute_force(spark, shard):
    """Hosts with and without declared articles, with notices, footers, quotes, copies and odd pages."""
    rng = random.Random(21)
    rows = []
    for host in range(4):
        notice, footer, quote = (" ".join(passage(rng, n)) for n in (11, 9, 14))
        for i in range(30):
            parts = [" ".join(passage(rng, rng.randint(2, 40))) for _ in range(rng.randint(1, 3))]
            if rng.random() < 0.7:
                parts.insert(rng.randint(0, len(parts)), notice)
            if rng.random() < 0.1:
                parts.append(quote)
            body = "".join(f"<p>{p}" for p in parts)
            declared = host == 0 or host < 3 and rng.random() < 0.5
            page = f"<article>{body}</article>" if declared else f"<div>{body}</div>"
            rows.append((100 * host + i, f"https://h{host}.x/{i}", f"<nav>menu</nav>{page}<p>{footer}</p>"))
    rows += [(7, "https://h0.x/7", rows[7][2]), (None, "https://h3.x/", rows[100][2]), (900, None, None), (901, "https://h1.x", "a b c")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.main_text(table, shard)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_pages(rows)


def notice_pages():
    """Forty declared pages of one host: a notice in each, a passage quoted on three, and their own words."""
    rng = random.Random(9)
    notice, quoted = " ".join(passage(rng, 12)), " ".join(passage(rng, 15))
    rows, texts = [], {}
    for i in range(40):
        own = " ".join(passage(rng, 30)) + f" page{i}"
        parts = [own, quoted] if i < 3 else [own]
        inside = "".join(f"<p>{x}</p>" for x in [parts[0], notice, *parts[1:]])
        rows.append((i, "http://h.i/x", f"<main>{inside}</main>"))
        texts[i] = "\n\n".join(parts)
    return rows, texts


def test_notices_inside_declared_articles_go_and_quotes_stay(spark):
    rows, texts = notice_pages()
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.main_text(table).collect()} == texts


def test_a_cut_host_gives_the_texts_of_a_whole_one(spark):
    rng = random.Random(10)
    footer = " ".join(passage(rng, 10))
    rows, _ = notice_pages()
    for i in range(40, 80):  # no declared article; a footer on two pages only
        rows.append((i, "http://h.j/x", f"<p>{' '.join(passage(rng, 30))}</p>" + f"<p>{footer}</p>" * (i in (41, 77))))
    rows.append((None, "http://h.j/x", f"<p>no id</p><p>{footer}</p>"))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, cut = (sorted(map(tuple, html_text.main_text(table, n).collect()), key=repr) for n in (1 << 20, 300))
    assert whole == cut and not any(footer in text for *_, text in cut)


# ------------------------------------------------------------------ all of them


def test_empty_tables(spark, none, vocabulary):
    items = spark.createDataFrame([("a", "b c")], "item_id string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pieces = chat_format.format_events(chat_format.logged(talk), ["turn", "tie", "step"])
    for empty in (
        substring_dedup.remove_repeats(none), line_dedup.remove_repeated_lines(none),
        simhash_dedup.near_duplicates(none), simhash_dedup.one_of_each(none), token_counts.count_tokens(none, vocabulary),
        bpe.decode(bpe.encode(none, vocabulary), vocabulary), decontamination.find_benchmark(none, items),
        decontamination.retained(none, items), bpe.round_trip(none, vocabulary),
        quality.verdicts(none, quality.fit(none, labels)), language_id.predict(none, language_id.fit(none)),
        html_text.main_text(pages), chat_format.read_back(pieces, ["turn", "tie"]),
    ):
        assert empty.collect() == []


def test_pipeline_stages_keep_their_columns_and_clean_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = []
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, small), "tested")
        counts.append(docs.count())
        if name != "encoding":
            assert docs.columns == corpus_pipeline.COLUMNS
    assert counts[0] == counts[1] >= counts[2] >= counts[3] == counts[4] > 0
