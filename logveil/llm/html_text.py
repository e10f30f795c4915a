"""Main text of web pages, by a suffix array over the pages of a host.

Each page is parsed to visible blocks; what markup names as something else than the article (menus,
site headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) is left out
there, once, and the blocks are written. The token streams of a host's pages are then concatenated, and suffixes
are ranked by prefix doubling until ranks tell their first `RUN` tokens apart: equal ranks on distinct pages are the
repeated runs of at least `RUN` tokens, and the tokens they cover are boilerplate.

Where a page declares its article (`article`, `main` or the like), that declaration is checked
against the runs last: blocks outside it go, and so do blocks inside it that are wholly covered by runs on
`COMMON` of the host's pages or more (notices set into every article; `COMMON_PAGES` at least). Its other blocks stay,
also where another page repeats them (copies and quoted passages are main text). On other pages the covered tokens go and
the unique runs stay; a page of which nothing would be left is a copy and keeps its blocks.

Hosts of more than `SHARD` bytes of text are cut into shards by a hash of page_id, so one task never holds a
host, however large. A run that stands on half of a host's pages stands on half of the pages of
at least one of its shards, so the suffix arrays of the shards name all candidates, and these few are counted
exactly over all pages. Only on hosts with pages that declare no article all runs matter; there their hashes are grouped over the whole
host, and those that stand on several pages go back to the pages as lists.

Defined cases: null or empty html gives an empty text; pages without a host share the empty
one; markup cut off in the middle counts as far as it goes; repeated rows are distinct pages only
if their page_id differs (null is an id of its own, equal to the least long); an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logveil.llm.words import Words, covered, released, windows, words
from logveil.scratch import stage

RUN, SHARD = 8, 4 << 20
COMMON, COMMON_PAGES = 0.5, 5  # the share of a host's pages, and how many at least, of a notice inside articles

# Element names and the usual names of page parts.
_DROPPED = frozenset(
    "aside button canvas dialog footer head iframe input menu nav noscript object script select style svg "
    "template textarea title".split()
)
_FIELDS = frozenset("button input select textarea".split())
_DECLARED = frozenset("article main".split())
_BREAKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PARTS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer login masthead menu modal nav navbar navigation newsletter notice notices popup "
    "promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor "
    "sponsored subscribe toolbar widget".split()
)
_ROLES = frozenset("banner navigation complementary contentinfo search form dialog alert menu menubar".split())
# Words that only say where a part is or that it is not there, and what ends an open element.
_PLACES = frozenset("area bar block bottom box container inner left list outer panel right section slot top wrap wrapper".split())
_VETO = frozenset("has no not with without".split())
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_PARAGRAPH_BARS = frozenset("button table td th caption object template".split())
WORDS_A_FIELD = 15  # a form with fewer words a field than this is no text


def named_part(name: str) -> bool:
    """Whether a class or id names a page part: as a whole, at its end, or before words of place only."""
    parts = [p for p in re.split(r"[^a-z]+", name.lower()) if p]
    if not parts or _VETO & set(parts):
        return False
    return parts[-1] in _PARTS or parts[0] in _PARTS and set(parts[1:]) <= _PLACES


def _hidden(attrs: dict) -> bool:
    style = re.sub(r"\s", "", attrs.get("style") or "").lower()
    return "hidden" in attrs or "display:none" in style or attrs.get("aria-hidden") == "true"


class _Page(HTMLParser):
    """Collects (text, inside declared content) blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, bool]] = []
        self.open: list[str] = []
        self.dropped = -1  # depth of the element being left out
        self.why_comment = False
        self.declared: list[int] = []
        self.seen = False
        self.parts: list[str] = []
        self.forms: list[tuple[int, int, int]] = []  # depth, blocks before, fields before
        self.fields = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.blocks.append((text, bool(self.declared)))

    def close_implied(self, tag: str) -> None:
        """End what `tag` may not stand in: an open item or cell, or the paragraph before a block."""
        closed, bars = _CLOSED_BY.get(tag, (set(), set()))
        if tag in _BREAKS:
            closed, bars = closed | {"p"}, bars | _PARAGRAPH_BARS
        if not closed:
            return
        for name in reversed(self.open):
            if name in closed:
                self.handle_endtag(name)
                return
            if name in bars:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.close_implied(tag)
        if tag in _BREAKS:
            self.flush()
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        given = dict(attrs)
        self.fields += tag in _FIELDS and given.get("type") != "hidden"
        if tag in _VOID:
            return
        names = f"{given.get('class') or ''} {given.get('id') or ''}".split()
        role = (given.get("role") or "").strip().lower()
        declares = tag in _DECLARED or role in ("main", "article") or "articlebody" in (n.lower() for n in names)
        first = declares and not self.seen  # the article itself goes by no name
        unfit = tag in _DROPPED or role in _ROLES or _hidden(given) or (tag == "header" and not self.declared)
        unfit = unfit or tag == "label" and bool(self.forms) or not first and any(map(named_part, names))
        if self.dropped >= 0 and declares and not unfit and not self.seen and not self.why_comment:
            self.dropped = -1  # left open by mistake before the article
        self.open.append(tag)
        if self.dropped < 0:
            if unfit and tag not in ("html", "body"):
                self.flush()
                self.dropped = len(self.open) - 1
                parts = {p for n in names for p in re.split(r"[^a-z]+", n.lower())}
                self.why_comment = bool(parts & {"comment", "comments", "reply", "replies", "respond"})
            elif declares:
                self.seen = True
                self.declared.append(len(self.open) - 1)
            elif tag == "form":
                self.forms.append((len(self.open) - 1, len(self.blocks), self.fields))

    def end_form(self) -> None:
        """Take back a form that is mostly fields; one that holds the page stays."""
        _, before, fields = self.forms.pop()
        self.flush()
        words = sum(len(t.split(" ")) for t, _ in self.blocks[before:])
        if words < WORDS_A_FIELD * max(1, self.fields - fields):
            del self.blocks[before:]

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BREAKS:
            self.flush()
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            depth = len(self.open)
            if self.dropped == depth:
                self.parts = []
                self.dropped = -1
            if self.declared and self.declared[-1] == depth:
                self.flush()
                self.declared.pop()
            if self.forms and self.forms[-1][0] == depth:
                self.end_form()
            if last == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.dropped < 0:
            self.parts.append(data)


def blocks(html: str | None) -> list[tuple[str, bool]]:
    """(text, declared) of the visible blocks of a page."""
    page = _Page()
    page.feed(html or "")
    page.close()
    while page.forms:
        page.end_form()
    page.flush()
    return page.blocks


# ------------------------------------------------------------------ repeated runs


def standing(tokens: np.ndarray, page: np.ndarray, end: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(place, number of distinct pages) of the runs of `run` tokens.

    tokens: of all pages, one after another; page: the page of each; end: where that page ends.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < run:  # ranks tell the first `step` tokens apart; now twice as many
        far = min(step, run - step)
        after = np.full(n, -1, np.int64)
        after[: max(n - far, 0)] = rank[far:]
        rank = np.unique((rank << 32) | (after + 1), return_inverse=True)[1].astype(np.int64)
        step += far
    place = np.flatnonzero(end - np.arange(n) >= run)
    order = place[np.lexsort((page[place], rank[place]))]
    if not len(order):
        return order, order
    new = np.diff(rank[order], prepend=-1) != 0
    head = np.flatnonzero(new)
    new[1:] |= np.diff(page[order]) != 0
    several = np.add.reduceat(new.astype(np.int64), head)
    return order, np.repeat(several, np.diff(np.append(head, len(order))))


def repeated(tokens: np.ndarray, page: np.ndarray, end: np.ndarray, run: int = RUN) -> np.ndarray:
    """Mask of the tokens in runs of `run` or more that occur on distinct pages."""
    place, pages = standing(tokens, page, end, run)
    return covered(place[pages > 1], run, len(tokens))


def _kept(own: list[tuple[str, bool]], mask: np.ndarray, often: np.ndarray) -> str:
    """The text of one page whose tokens `mask` marks as repeated, and `often` as common on its host."""
    kept, at = [], 0
    declares = any(declared for _, declared in own)
    for text, declared in own:
        parts = text.split(" ")
        here = slice(at, at + len(parts))
        at += len(parts)
        if declares:
            left = parts if declared and not often[here].all() else []
        else:
            left = [t for t, gone in zip(parts, mask[here].tolist()) if not gone]
        if left:
            kept.append(" ".join(left))
    return "\n\n".join(kept or [t for t, declared in own if declared or not declares])


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
_PARSED = "host string, page bigint, page_id bigint, url string, texts array<string>, declared array<boolean>"
_NO_ID = -(1 << 63)


def _lines() -> Column:
    """The blocks of a page as lines of one string, which is shorter to send than an array; blocks hold no newline."""
    return F.array_join("texts", "\n").alias("lines")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as their blocks; a slice of whole pages at a time."""
    for batch in batches:
        for a in range(0, len(batch), 256):
            part = batch.slice(a, 256)
            found = [blocks(h) for h in part["html"].to_pylist()]
            texts = pa.array([[t for t, _ in own] for own in found], pa.list_(pa.string()))
            declared = pa.array([[d for _, d in own] for own in found], pa.list_(pa.bool_()))
            names = ["host", "page", "page_id", "url"]
            yield pa.RecordBatch.from_arrays([*(part[c] for c in names), texts, declared], [*names, "texts", "declared"])


def _streams(batch: pa.RecordBatch) -> Iterator[Words]:
    return words(pa.array([" ".join(t) for t in batch["texts"].to_pylist()], pa.string()))


def _page_runs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(page, hash) of the distinct runs of each page of a slice."""
    place, h = windows(w, RUN)
    owner = np.searchsorted(w.cut, place, "right") - 1
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return owner[new] + w.first, h[new].view(np.int64)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, run): the distinct runs of each page, by hash."""
    for batch in batches:
        for w in _streams(batch):
            owner, h = _page_runs(w)
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([batch["host"].take(at), batch["page"].take(at), pa.array(h)], ["host", "page", "run"])


def _marked(w: Words, lists: list) -> np.ndarray:
    """Mask of the tokens in those runs of each page that its list names."""
    place, h = windows(w, RUN)
    owner = np.searchsorted(w.cut, place, "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(w) + 1))
    hit = np.zeros(len(h), bool)
    known: dict[int, np.ndarray] = {}
    for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:])):
        named = lists[w.first + i]
        if named is not None and len(named) and y > x:
            values = known.setdefault(id(named), np.asarray(named, np.int64))
            hit[x:y] = np.isin(h[x:y].view(np.int64), values)
    return covered(place[hit], RUN, len(w.hash))


# ------------------------------------------------------------------ hosts in one task


def _hosts(batches: Iterator[pa.RecordBatch], handle: Callable) -> Iterator[pa.RecordBatch]:
    """Reads pages sorted by shard, and handles a shard as soon as it is complete."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["host"], row["shard"]) != key and rows:
                yield handle(rows)
                rows = []
            key = (row["host"], row["shard"])
            row["texts"] = row["lines"].split("\n") if row["lines"] else []
            rows.append(row)
    if rows:
        yield handle(rows)


def _standing_of(rows: list[dict]) -> tuple[list[Words], np.ndarray, np.ndarray, np.ndarray, int]:
    """Streams of a shard, their counts, the runs with the number of pages each stands on, and all pages."""
    found = list(words(pa.array([" ".join(r["texts"]) for r in rows], pa.string())))
    counts = np.concatenate([w.counts for w in found])
    number = np.unique([r["page"] for r in rows], return_inverse=True)[1]
    tokens = np.concatenate([w.hash for w in found])
    place, pages = standing(tokens, np.repeat(number, counts), np.repeat(np.cumsum(counts), counts))
    return found, counts, place, pages, int(number.max()) + 1


def _whole_host(rows: list[dict]) -> pa.RecordBatch:
    found, counts, place, pages, n = _standing_of(rows)
    total = int(counts.sum())
    mask = covered(place[pages > 1], RUN, total)
    often = covered(place[pages >= max(COMMON_PAGES, COMMON * n)], RUN, total)
    return _finished(rows, counts, mask, often)


def _finished(rows: list[dict], counts: np.ndarray, mask: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    end = np.cumsum(counts)
    texts = [
        _kept(list(zip(r["texts"], r["declared"])), mask[e - n : e], often[e - n : e]) for r, n, e in zip(rows, counts, end)
    ]
    ids, urls = (pa.array([r[c] for r in rows], t) for c, t in (("page_id", pa.int64()), ("url", pa.string())))
    return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string())], schema=_OUT)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _hosts(batches, _whole_host)


# ------------------------------------------------------------------ hosts cut into shards


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, run): the runs on `COMMON` of the pages of a shard."""

    def handle(rows: list[dict]) -> pa.RecordBatch:
        found, _, place, pages, n = _standing_of(rows)
        hashes = []
        base = 0
        frequent = np.sort(place[pages >= COMMON * n])
        for w in found:
            at, h = windows(w, RUN)
            hashes.append(h[np.isin(at + base, frequent)])
            base += len(w.hash)
        run = np.unique(np.concatenate(hashes)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([rows[0]["host"]] * len(run), pa.string()), pa.array(run)], ["host", "run"])

    yield from _hosts(batches, handle)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, run): which candidates of its host stand on a page."""
    for batch in batches:
        lists = [np.asarray(x or [], np.int64) for x in batch["candidates"].to_pylist()]
        for w in _streams(batch):
            owner, h = _page_runs(w)
            cut = np.searchsorted(owner, np.arange(w.first, w.first + len(w) + 1))
            good = np.zeros(len(h), bool)
            for i, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
                good[x:y] = np.isin(h[x:y], lists[w.first + i])
            at = pa.array(owner[good])
            yield pa.RecordBatch.from_arrays([batch["host"].take(at), batch["page"].take(at), pa.array(h[good])], ["host", "page", "run"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        again, common = batch["again"].to_pylist(), batch["common"].to_pylist()
        rows = batch.select(["page_id", "url", "texts", "declared"]).to_pylist()
        for w in _streams(batch):
            yield _finished(rows[w.first : w.first + len(w)], w.counts, _marked(w, again), _marked(w, common))


def _cut_hosts(parsed: DataFrame, large: DataFrame) -> DataFrame:
    """(page_id, url, text) of the pages of hosts that are cut."""
    cut = parsed.join(large, "host")
    shards = (
        cut.withColumn("shard", F.pmod(F.xxhash64("page"), F.col("parts")).cast("int"))
        .select("host", "shard", "page", _lines())
        .repartition("host", "shard")
        .sortWithinPartitions("host", "shard")
    )
    candidates = stage(
        shards.mapInArrow(released(_candidates), "host string, run bigint")
        .distinct()
        .groupBy("host")
        .agg(F.collect_list("run").alias("candidates")),
        "candidates",
    )
    standing_on = cut.select("host", "page", "texts").join(candidates, "host").mapInArrow(
        released(_count), "host string, page bigint, run bigint"
    )
    counts = standing_on.distinct().groupBy("host", "run").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(float(COMMON_PAGES)), F.col("pages") * F.lit(COMMON))
    common = stage(
        counts.join(large, "host").where(F.col("n") >= least).groupBy("host").agg(F.collect_list("run").alias("common")),
        "common",
    )
    again = stage(_again(cut.where("bare > 0")), "again")
    return (
        cut.join(common, "host", "left")
        .join(again, ["host", "page"], "left")
        .select("page_id", "url", "texts", "declared", "again", "common")
        .mapInArrow(released(_finish), "page_id bigint, url string, text string")
    )


def _again(pages: DataFrame) -> DataFrame:
    """(host, page, again): the runs of each page that stand on several pages of the host."""
    runs = pages.select("host", "page", "texts").mapInArrow(released(_runs), "host string, page bigint, run bigint")
    runs = runs.repartition("host", "run").distinct()
    several = runs.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return runs.join(several, ["host", "run"]).groupBy("host", "page").agg(F.collect_list("run").alias("again"))


def main_text(pages: DataFrame, shard: int = SHARD) -> DataFrame:
    """(page_id, url, text) per page."""
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    page_id = F.col("page_id").cast("long")
    rows = pages.select(
        host.alias("host"),
        F.coalesce(page_id, F.lit(_NO_ID)).alias("page"),
        page_id.alias("page_id"),
        url.alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    parsed = stage(rows.mapInArrow(released(_parse), _PARSED), "blocks", "zstd")
    size = F.aggregate("texts", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t) + 1)
    large = stage(
        parsed.groupBy("host")
        .agg(
            F.sum(size).alias("size"),
            F.count_distinct("page").alias("pages"),
            F.count_if(~F.exists("declared", lambda d: d) & (F.size("texts") > 0)).alias("bare"),
        )
        .where(F.col("size") > shard)
        .select("host", F.ceil(F.col("size") / shard).cast("int").alias("parts"), "pages", "bare"),
        "hosts",
    )
    whole = (
        parsed.join(large, "host", "left_anti")
        .select("host", F.lit(0).alias("shard"), "page", "page_id", "url", "declared", _lines())
        .repartition("host")
        .sortWithinPartitions("host")
        .mapInArrow(released(_extract), "page_id bigint, url string, text string")
    )
    return whole.unionByName(_cut_hosts(parsed, large))
