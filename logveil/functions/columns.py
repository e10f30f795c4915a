"""Small helpers for composing columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# How an empty value is spelled in JSON.
EMPTY_JSON = ("", "[]", "{}", "false", "0", "0.0", "-0.0", "null")


def falsy(value: Column) -> Column:
    """True for null and for the JSON spellings of an empty value."""
    return value.isNull() | value.isin(*EMPTY_JSON)
