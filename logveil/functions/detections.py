"""Columns over one detection of the log."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logveil.config import Settings

# Spellings of the detector kinds.
CONTEXTUAL_SPELLINGS = ("contextual", "semantic", "model", "ml")
# Entity shapes and bonuses of the suspicion score.
ADDRESS_START = "^[^@]+@[^@]+"
DOTLESS_ADDRESS = r"(?U)^[\w.-]+@[\w-]+$"
PAYMENT_WORD = "upi"
PAYMENT_BONUS, ADDRESS_BONUS, SHORT_TEXT_BONUS, REPEAT_BONUS = 0.35, 0.2, 0.15, 0.15
SHORT_TEXT_TOKENS, REPEAT_ABOVE, REPEAT_DISTINCT = 20, 3, 2


def detector_kind(raw: Column) -> Column:
    kind = F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"(?U)^\s+|\s+$", "")
    return (
        F.when(kind == "pattern", F.lit("pattern"))
        .when(kind.isin(*CONTEXTUAL_SPELLINGS), F.lit("contextual"))
        .when(kind == "edm", F.lit("edm"))
        .otherwise(F.lit("unknown"))
    )


def category_name(name: Column, code_name: Column) -> Column:
    return F.coalesce(
        F.nullif(name, F.lit("")), F.nullif(code_name, F.lit("")), F.lit("Unknown")
    )


def prior(kind: Column, settings: Settings = Settings()) -> Column:
    return F.when(kind == "pattern", F.lit(settings.pattern_prior)).otherwise(
        F.lit(settings.other_prior)
    )


def distinct_entities(entities: Column) -> Column:
    return F.size(F.array_distinct(F.coalesce(entities, F.array().cast("array<string>"))))


def total_entities(entities: Column) -> Column:
    return F.size(F.coalesce(entities, F.array().cast("array<string>")))


def _entries_matching(entity_map: Column, test) -> Column:
    pairs = F.map_entries(F.coalesce(entity_map, F.create_map().cast("map<string,string>")))
    return F.size(F.filter(pairs, test))


def suspicion_score(
    kind: Column,
    tokens: Column,
    entities: Column,
    entity_map: Column,
    settings: Settings = Settings(),
) -> Column:
    """Chance-of-false-positive heuristic in [0, 1], three decimals.

    All bonuses are positive, so capping the sum once equals capping after each of them.
    """
    payment = _entries_matching(
        entity_map,
        lambda e: e["key"].rlike(ADDRESS_START)
        & F.contains(F.lower(F.coalesce(e["value"], F.lit(""))), F.lit(PAYMENT_WORD)),
    )
    address = _entries_matching(entity_map, lambda e: e["key"].rlike(DOTLESS_ADDRESS))
    short = F.when(tokens < SHORT_TEXT_TOKENS, F.lit(SHORT_TEXT_BONUS)).otherwise(F.lit(0.0))
    repeats = F.when(
        (total_entities(entities) > REPEAT_ABOVE)
        & (distinct_entities(entities) <= REPEAT_DISTINCT),
        F.lit(REPEAT_BONUS),
    ).otherwise(F.lit(0.0))
    total = (
        prior(kind, settings) + payment * PAYMENT_BONUS + address * ADDRESS_BONUS + short + repeats
    )
    return F.round(F.least(F.lit(1.0), total), 3)


def detection_view(det: Column) -> Column:
    """The part of a detection that is shown to a judge."""
    return F.struct(
        det["id"].alias("id"),
        det["name"].alias("name"),
        det["type"].alias("type"),
        det["detection_type"].alias("detection_type"),
        det["reason"].alias("reason"),
        det["sensitive_entities"].alias("sensitive_entities_positive_examples"),
        det["entity_texts_with_subcategories"].alias("entity_texts_with_subcategories"),
    )
