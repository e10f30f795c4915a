"""Text columns: whitespace, tokens, shingles, set overlap, truncation and display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logveil.functions.columns import let

# Fixed value: Unicode white space plus the four ASCII separators. Spelled with \\p{Z} because
# Java's Unicode-aware `\\s` is several times slower.
SPACE_RUN = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
# Marks put where text was cut.
MIDDLE_MARK = "\n…[middle truncated]…\n"
MISSING = "—"


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def token_count(text: Column) -> Column:
    """Whitespace tokens of raw or normalized text; null counts as empty."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), ""))


def lower_words(clean: Column) -> Column:
    """Lower-cased words of normalized text; none for an empty text."""
    return F.array_remove(F.split(F.lower(clean), " "), "")


def _grams(text: Column, k: int, gram) -> Column:
    return let(
        lower_words(text),
        lambda words: F.array_distinct(
            F.slice(
                F.transform(words, lambda w, i: gram(words, w, i)),
                1,
                F.greatest(F.size(words) - (k - 1), F.lit(0)),
            )
        ),
    )


def word_shingles(text: Column, k: int = 3) -> Column:
    """Distinct lower-cased runs of `k` words; empty when there are fewer than `k` words."""
    return _grams(text, k, lambda words, w, i: F.concat_ws(" ", F.slice(words, i + 1, k)))


def shingle_hashes(text: Column, k: int = 3) -> Column:
    """The same sets with every shingle as a 64-bit hash, for joins."""
    return _grams(
        text, k, lambda words, w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)])
    )


def word_hashes(text: Column) -> Column:
    """The set of lower-cased words, as 64-bit hashes."""
    return F.array_distinct(F.transform(lower_words(text), lambda w: F.xxhash64(w)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets without repeats; 0 when either is empty."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda shared: F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
            shared / (F.size(a) + F.size(b) - shared)
        ),
    )


def head_tail(text: Column, limit: int = 1200) -> Column:
    half = limit // 2 - 15
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.left(text, F.lit(half)), F.lit(MIDDLE_MARK), F.right(text, F.lit(half)))
    )


def was_truncated(text: Column, limit: int = 1200) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) > limit


def decimals(value: Column, places: int) -> Column:
    """A number with fixed decimals; exact ties go to the even digit."""
    return F.regexp_replace(F.format_number(value, places), ",", "")


def percent(part: Column, whole: Column) -> Column:
    """Share with one decimal; a dash when there is nothing to divide by."""
    share = (part / F.nullif(whole, F.lit(0))) * F.lit(100.0)
    return F.when(whole == 0, F.lit(MISSING)).otherwise(F.concat(decimals(share, 1), F.lit("%")))


def matches_any(needle: str, *texts: Column, words: Column | None = None) -> Column:
    """Case-insensitive substring test over some texts and, if given, an array of words."""
    wanted = F.lit(needle.lower())
    found = F.lit(needle == "")
    for text in texts:
        found = found | F.contains(F.lower(F.coalesce(text, F.lit(""))), wanted)
    if words is not None:
        found = found | F.coalesce(
            F.exists(words, lambda w: F.contains(F.lower(w), wanted)), F.lit(False)
        )
    return found


def display_cut(text: Column, width: int) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(width))
