"""Numbers as results show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column | str) -> Column:
    """Six digits, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def long_count(condition: Column | None = None) -> Column:
    return (F.count(F.lit(1)) if condition is None else F.count_if(condition)).cast("bigint")
