"""Token counts by a two-tier lookup of piece lengths, without any shuffle.

The length of a text in tokens is the sum over its pieces (words with their space, numbers, runs of
marks or blanks). Tier one is a broadcast hash table of frequent pieces: the pieces that the
vocabulary spells as one token (its merges were learned by frequency) and frequent longer
ones, `FREQUENT` at most, so its size is bounded by the vocabulary and that parameter. The longer ones
are found over all documents: each task keeps a Misra-Gries summary of bounded size, and only the
summaries are added up. Tier two are the pieces missing there: each worker encodes them once with
the tokenizer library and keeps their lengths, `CACHE` at most, for its later tasks.

Neither tier decides a result: both hold what the library gives for the piece.

Defined cases: a null text is empty and has no tokens; an empty table gives an empty result;
repeated rows each get their row. Special strings in a text are one token, as in the library. Other
columns are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logveil.llm.pretokens import Vocabulary, folded, per_worker, slices, with_pieces
from logveil.llm.words import released

FREQUENT, SUMMARY, CACHE, CHUNK = 20_000, 4_000, 1 << 18, 4096


def _lengths(pieces: list[str], vocabulary: Vocabulary) -> list[int]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
    encode = vocabulary.library().encode_batch_fast
    return [
        len(e.ids)
        for a in range(0, len(pieces), CHUNK)  # encodings are large
        for e in encode(pieces[a : a + CHUNK], add_special_tokens=False)
    ]


def _summaries(vocabulary: Vocabulary, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter[str] = Counter()
        for batch in (part for whole in batches for part in slices(whole, "pieces")):
            distinct, places, _ = folded(batch, vocabulary)
            count = np.bincount(places, minlength=len(distinct)).tolist()
            for piece, n in zip(distinct, count):
                if piece not in known.value:
                    kept[piece] += n
            if len(kept) > SUMMARY:  # take the first count that goes from all, as Misra and Gries do
                top = kept.most_common(SUMMARY + 1)
                kept = Counter({p: n - top[-1][1] for p, n in top[:-1] if n > top[-1][1]})
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["piece", "n"]
        )

    return run


def frequent_lengths(pieces: DataFrame, vocabulary: Vocabulary) -> dict[str, int]:
    """Tier one: piece -> tokens."""
    library = vocabulary.library()
    spelled = library.decode_batch([[i] for i in range(library.get_vocab_size())], skip_special_tokens=False)
    whole = sorted({p for p in spelled if p and "�" not in p})
    table = {p: n for p, n in zip(whole, _lengths(whole, vocabulary)) if n == 1}
    known = pieces.sparkSession.sparkContext.broadcast(frozenset(table))
    rows = (
        pieces.mapInArrow(released(_summaries(vocabulary, known)), "piece string, n bigint")
        .groupBy("piece")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(FREQUENT)
        .collect()
    )
    longer = [r.piece for r in rows]
    return table | dict(zip(longer, _lengths(longer, vocabulary)))


def _counter(vocabulary: Vocabulary, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = table.value
        cache: dict[str, int] = per_worker(f"lengths {hash(vocabulary.definition)}", dict)
        for batch in (part for whole in batches for part in slices(whole, "pieces")):
            distinct, places, cut = folded(batch, vocabulary)
            missing = [p for p in distinct if p not in frequent and p not in cache]
            found = dict(zip(missing, _lengths(missing, vocabulary)))
            length = np.array(
                [frequent[p] if p in frequent else found[p] if p in found else cache[p] for p in distinct],
                np.int64,
            )
            if len(cache) + len(found) > CACHE:
                cache.clear()
            cache.update(found)
            sums = np.concatenate([[0], np.cumsum(length[places])])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["n_bytes"], pa.array(sums[cut[1:]] - sums[cut[:-1]], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per document."""
    pieces = with_pieces(documents, vocabulary)
    table = documents.sparkSession.sparkContext.broadcast(frequent_lengths(pieces, vocabulary))
    return pieces.mapInArrow(released(_counter(vocabulary, table)), "doc_id bigint, n_bytes bigint, n_tokens bigint")
