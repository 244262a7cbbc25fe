"""Numeric helpers shared by operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(c: Column, digits: int) -> Column:
    """Round a double half away from zero at ``digits`` places, computed as
    ``round(x * 10^d) / 10^d`` in doubles (the rule used by Postgres/DuckDB
    numeric rounding of floats), so both engines give identical values."""
    m = float(10 ** digits)
    return F.round(c * F.lit(m)) / F.lit(m)


def exact_mean(c: Column | str) -> Column:
    """Mean as (sum / count): exact summation when ``c`` is a decimal."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c).cast("double") / F.count(c)
