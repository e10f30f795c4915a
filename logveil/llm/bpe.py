"""BPE encoding by a pair occurrence index, and decoding.

The distinct pieces of a batch lie in one array of symbols. An index maps each mergeable pair to all
its positions there. The lowest active rank is taken from a heap, its pair is merged at all
positions at once, and the pairs that this makes at their neighbours are added to the lists of their
ranks. A merged symbol only takes part in merges of higher rank (its own merge came first when
the vocabulary was learned), so ascending order gives each piece what merging it alone
would. Pairs that a merge has broken stay in their lists and are passed over.

Documents are never shuffled. Memory follows one slice of whole texts, and the ids of at most `KNOWN`
pieces that a task has met before and does not encode again.

Defined cases: a null text is empty and has no ids; an empty table gives an empty result; repeated
rows each get their row; special strings in a text become their id, and ids decode to them. Ids
that are no whole characters decode to replacement characters. Ids outside the vocabulary raise.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.pretokens import Vocabulary, folded, per_worker, slices, with_pieces
from logveil.llm.words import released


SLICE, KNOWN = 1 << 17, 1 << 16


def _printed_bytes() -> dict[str, int]:
    """How vocabularies of this kind print bytes: the visible Latin-1 ones as themselves, others above 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """The vocabulary as arrays: symbols of bytes, and pairs in ascending order of a joint key."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        model = json.loads(vocabulary.definition)["model"]
        ids, printed = model["vocab"], _printed_bytes()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = vocabulary.specials
        self.byte = np.zeros(256, np.int64)
        for shown, value in printed.items():
            self.byte[value] = ids[shown]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        if len(np.unique(self.made)) < len(self.made):
            raise ValueError("two merges make the same symbol")
        key = self.left << 32 | self.right
        self.rank = np.argsort(key)
        self.key = key[self.rank]
        spelled = {i: bytes(printed[c] for c in s) for s, i in ids.items() if s not in self.special}
        spelled |= {i: s.encode() for s, i in self.special.items()}
        self.spelled = [spelled.get(i) for i in range(max(spelled) + 1)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], -1)


def merges(vocabulary: Vocabulary) -> Merges:
    return per_worker(f"merges {hash(vocabulary.definition)}", lambda: Merges(vocabulary))


class _Index:
    """Positions by rank, and the active ranks in a heap."""

    def __init__(self) -> None:
        self.positions: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, rank: np.ndarray, position: np.ndarray) -> None:
        use = rank >= 0
        rank, position = rank[use], position[use]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, position = rank[order], position[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        begin = [0, *cut.tolist()]
        for r, a, b in zip(rank[begin].tolist(), begin, [*begin[1:], len(rank)]):
            if r not in self.positions:
                self.positions[r] = []
                heapq.heappush(self.active, r)
            self.positions[r].append(position[a:b])

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        found = self.positions.pop(rank)
        return rank, found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def encode_pieces(pieces: list[str], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces in order, first id of each piece and the end)."""
    raw = [b"\0" if p in m.special else p.encode() for p in pieces]
    cut = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    symbol = m.byte[np.frombuffer(b"".join(raw), np.uint8)]
    place = np.arange(len(symbol), dtype=np.int64)
    after, before = place + 1, place - 1
    filled = cut[:-1] < cut[1:]
    after[cut[1:][filled] - 1] = -1
    before[cut[:-1][filled]] = -1
    index = _Index()
    begins = place[after >= 0]
    index.add(m.ranks(symbol[begins], symbol[begins + 1]), begins)
    while index.active:
        rank, at = index.pop()
        left, right, made = m.left[rank], m.right[rank], m.made[rank]
        nxt = after[at]
        good = (symbol[at] == left) & (nxt >= 0)
        good &= symbol[nxt] == right
        at, nxt = at[good], nxt[good]
        if left == right and len(at) > 1:  # of overlapping pairs every other one, from the left
            head = np.append(True, nxt[:-1] != at[1:])
            number = np.arange(len(at))
            begin = np.maximum.accumulate(np.where(head, number, 0))
            keep = (number - begin) % 2 == 0
            at, nxt = at[keep], nxt[keep]
        if not len(at):
            continue
        symbol[at], symbol[nxt] = made, -1
        far = after[nxt]
        after[at] = far
        going = far >= 0
        before[far[going]] = at[going]
        prior = before[at]
        prior = prior[prior >= 0]
        on = at[going]
        position = np.concatenate([prior, on])
        index.add(m.ranks(symbol[position], symbol[after[position]]), position)
    alive = symbol >= 0
    for i, piece in enumerate(pieces):
        if piece in m.special:
            symbol[cut[i]] = m.special[piece]
    sums = np.concatenate([[0], np.cumsum(alive)])
    return symbol[alive], sums[cut]


def gather(values: np.ndarray, cut: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges `rows` of `values`, one after another, and where each begins."""
    n = (cut[1:] - cut[:-1])[rows]
    begin = np.concatenate([[0], np.cumsum(n)])
    return values[np.repeat(cut[:-1][rows] - begin[:-1], n) + np.arange(begin[-1])], begin


class _Known:
    """The ids of the pieces that a task has met; forgotten as a whole when they get too many."""

    def __init__(self, m: Merges) -> None:
        self.merges = m
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def places(self, pieces: list[str]) -> np.ndarray:
        """Where each piece stands; new ones are encoded together."""
        if max(len(self.number), len(self.ids) >> 4) > KNOWN:
            self.forget()
        new = [p for p in pieces if p not in self.number]
        if new:
            ids, begin = encode_pieces(new, self.merges)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.begin = np.concatenate([self.begin, self.begin[-1] + begin[1:]])
            self.ids = np.concatenate([self.ids, ids])
        return np.array([self.number[p] for p in pieces], np.int64)


def _encoder(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(merges(vocabulary))
        for batch in (part for whole in batches for part in slices(whole, "pieces", SLICE)):
            distinct, places, cut = folded(batch, vocabulary)
            number = known.places(distinct)[places]
            flat, at = gather(known.ids, known.begin, number)
            lists = pa.ListArray.from_arrays(pa.array(at[cut].astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "ids"])

    return run


def encode(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids array<int>) per document."""
    pieces = with_pieces(documents, vocabulary)
    return pieces.mapInArrow(released(_encoder(vocabulary)), "doc_id bigint, ids array<int>")


def _decoder(vocabulary: Vocabulary, keep: list[str], digest: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = merges(vocabulary).spelled
        for batch in (part for whole in batches for part in slices(whole, "ids", SLICE)):
            lists = batch["ids"]
            flat = lists.flatten().to_numpy(zero_copy_only=False).tolist()
            texts, at = [], 0
            for size in pc.list_value_length(lists).fill_null(0).to_pylist():
                text = b"".join([spelled[i] for i in flat[at : at + size]]).decode("utf-8", "replace")
                texts.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
                at += size
            name = "decoded_sha256" if digest else "decoded"
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(texts, pa.string())], [*keep, name])

    return run


def round_trip(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, decoded_sha256): both ways in one task; of the decoded text only a digest leaves it."""
    there, back = _encoder(vocabulary), _decoder(vocabulary, ["doc_id", "ids"], digest=True)
    ddl = "doc_id bigint, ids array<int>, decoded_sha256 string"
    return with_pieces(documents, vocabulary).mapInArrow(released(lambda batches: back(there(batches))), ddl)


def decode(tokens: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) with the decoded text added; null ids decode to an empty text."""
    ddl = "doc_id bigint, ids array<int>, decoded string"
    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(
        _decoder(vocabulary, ["doc_id", "ids"]), ddl
    )
