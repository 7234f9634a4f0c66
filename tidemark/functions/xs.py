"""Cross-sectional Column builders: ranks among the assets of a day or a peer group."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def pct_rank(x: Column | str, by: list[str]) -> Column:
    """Average-tie rank over the count of non-null values; null stays null.

    Nulls sort last, so that the ranks of values are those among values.
    """
    x = F.col(x) if isinstance(x, str) else x
    order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), (F.rank().over(order) + (ties - 1) / 2) / F.count(x).over(Window.partitionBy(*by)))


def peer_score(x: Column | str, by: list[str]) -> Column:
    """Rank among peers as (rank - .5) * 2; 0 for a group of under two values and for a missing value."""
    c = F.col(x) if isinstance(x, str) else x
    n = F.count(c).over(Window.partitionBy(*by))
    return F.when((n < 2) | c.isNull(), 0.0).otherwise((pct_rank(c, by) - 0.5) * 2)
