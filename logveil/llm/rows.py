"""Whole rows carried through an operator, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(rows: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns as one struct `row`, so that none can clash with an operator's own."""
    names = [c for c in rows.columns if c not in without]
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in names]).alias("row")
