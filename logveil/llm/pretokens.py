"""Splitting whole texts into the pieces that a byte-level BPE vocabulary merges within.

The split runs in the JVM as a regular expression; pieces then reach Python tasks as Arrow lists,
where equal pieces of a batch are folded by dictionary encoding. Texts with characters that the
JVM's Unicode tables do not know are marked, and split in the task by the library's own rule.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the published split pattern of byte-level BPE, its white-space class written out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)


def per_worker(name: str, build: Callable[[], Any]) -> Any:
    """Something that is built once in each Python worker and kept for its later tasks."""
    kept = sys.__dict__.setdefault("_logveil_worker", {})
    if name not in kept:
        kept[name] = build()
    return kept[name]


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file as text (a few megabytes, whatever the corpus), read on the driver."""

    definition: str

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return Vocabulary(f.read())

    @property
    def specials(self) -> dict[str, int]:
        return {t["content"]: t["id"] for t in json.loads(self.definition).get("added_tokens") or []}

    def library(self):
        """The tokenizers library's object for it, one per worker."""
        from tokenizers import Tokenizer

        return per_worker(f"tokenizer {hash(self.definition)}", lambda: Tokenizer.from_str(self.definition))


def _pieces(text: Column, specials: list[str]) -> Column:
    cut = lambda t: F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))
    if not specials:
        return cut(text)
    if len(specials) > 1:
        raise ValueError("vocabularies with one special token are split here")
    quoted = "\\Q" + specials[0] + "\\E"
    parts = F.transform(
        F.split(text, quoted, -1),
        lambda p, i: F.when(i > 0, F.concat(F.array(F.lit(specials[0])), cut(p))).otherwise(cut(p)),
    )
    return F.flatten(parts)


def with_pieces(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_bytes, pieces, odd): `odd` holds the text itself where the JVM cannot split it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    odd = text.rlike(r"\p{Cn}")
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.when(~odd, _pieces(text, list(vocabulary.specials))).alias("pieces"),
        F.when(odd, text).alias("odd"),
    )


def slices(batch: pa.RecordBatch, lists: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with about `most` list elements; a longer row is one of its own."""
    n = pc.list_value_length(batch[lists]).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(n, dtype=np.int64) - 1) // most
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(n)]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _split_by_library(text: str, vocabulary: Vocabulary) -> list[str]:
    cut = vocabulary.library().pre_tokenizer.pre_tokenize_str
    parts = [text]
    for special in vocabulary.specials:
        parts = [x for p in parts for x in _interleave(p.split(special), special)]
    return [
        x
        for p in parts
        for x in ([p] if p in vocabulary.specials else [p[a:b] for _, (a, b) in cut(p)] if p else [])
    ]


def _interleave(parts: list[str], mark: str) -> list[str]:
    return [x for p in parts for x in (p, mark)][:-1]


def folded(batch: pa.RecordBatch, vocabulary: Vocabulary) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pieces, piece of each place, first place of each document and the end)."""
    lists = batch["pieces"]
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    encoded = pc.list_flatten(lists).cast(pa.large_string()).dictionary_encode()
    distinct, places = encoded.dictionary.to_pylist(), encoded.indices.to_numpy().astype(np.int64)
    cut = np.concatenate([[0], np.cumsum(n)])
    odd = [(i, t.as_py()) for i, t in enumerate(batch["odd"]) if t.is_valid] if batch["odd"].null_count < len(batch) else []
    if odd:
        number = {p: i for i, p in enumerate(distinct)}
        rows = np.split(places, cut[1:-1])
        for i, text in odd:
            rows[i] = np.array(
                [number.setdefault(p, len(number)) for p in _split_by_library(text, vocabulary)], np.int64
            )
        distinct, places = list(number), np.concatenate(rows)
        cut = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return distinct, places, cut
