"""Sorted, picked and pivoted tables as the pages of a dashboard show them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ensemble import top_and_bottom


def earnings_by(rows: DataFrame, order: str = "mktcap") -> DataFrame:
    """Reports by market capitalisation, largest first and unknown last, or by date."""
    return rows.orderBy(F.desc_nulls_last("mktcap"), "ticker") if order == "mktcap" else rows.orderBy("date", "ticker")


def by_segment(signals: DataFrame) -> DataFrame:
    """An asset's signals by segment, the strongest buy of each first."""
    return signals.orderBy("segment", F.desc("signal"), "family")


def strongest(signals: DataFrame, family: str = "relative_strength", k: int = 25, keep: tuple[str, ...] = ()) -> DataFrame:
    """Signals of the ``k`` assets with the largest absolute signal of one family; of the families ``keep`` where given."""
    top = signals.where(F.col("family") == family).orderBy(F.desc(F.abs("signal")), "asset").limit(k).select("asset")
    rows = signals.where(F.col("family").isin(*keep)) if keep else signals
    return rows.join(F.broadcast(top.distinct()), "asset", "left_semi")


def mean_strength(signals: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` assets with the largest mean absolute signal: the picks where there is no consensus."""
    return signals.groupBy("asset").agg(F.avg(F.abs("signal")).alias("strength")).orderBy(F.desc("strength"), "asset").limit(k)


def top_bottom_or_all(df: DataFrame, by: str, group: str, k: int = 15, most: int = 30, tie: str = "asset") -> DataFrame:
    """All rows of a group of at most ``most``; of a larger one its ``k`` largest and ``k`` smallest."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    small = df.join(sizes.where(F.col("_n") <= most), group, "left_semi")
    large = df.join(sizes.where(F.col("_n") > most), group, "left_semi")
    return small.unionByName(top_and_bottom(large, by, k, [group], tie))


def pivot(df: DataFrame, row: str, column: str, values: list[str], value: str = "signal", how=F.avg) -> DataFrame:
    """One row for each ``row``, a column for each of ``values``, which are given so that no pass is spent to find them."""
    return df.groupBy(row).pivot(column, values).agg(how(value))
