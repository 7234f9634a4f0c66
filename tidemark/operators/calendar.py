"""Market-structure dates as a generated table, and their proximity signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.dates import last_business_day, last_friday, third_friday


def events(spark: SparkSession, today: str, *, horizon: int = 120, months: int = 6) -> DataFrame:
    """date, event, kind, note, days_until of the next ``horizon`` days; one row for each (date, event)."""
    base = spark.range(1).select(F.to_date(F.lit(today)).alias("today"))
    m = base.select("today", F.explode(F.sequence(F.trunc("today", "month"), F.add_months(F.trunc("today", "month"), months - 1), F.expr("interval 1 month"))).alias("m"))
    q = F.month("m") % 3 == 0
    row = lambda when, event, kind, note: F.struct(when.alias("date"), event.alias("event"), F.lit(kind).alias("kind"), note.alias("note"))
    monthly = m.select("today", F.explode(F.array_compact(F.array(
        row(third_friday(F.col("m")), F.when(q, "Triple witching").otherwise("Monthly OPEX"), "opex", F.when(q, "Quarterly index/futures/options expiry").otherwise("Monthly options expiration")),
        F.when(q, row(third_friday(F.col("m")), F.lit("S&P quarterly rebalance"), "index_rebal", F.lit("S&P index changes effective after the close"))),
        row(last_business_day(F.col("m")), F.when(q, "Quarter-end").otherwise("Month-end"), "period_end", F.lit("Pension/40-act rebalancing window")),
    ))).alias("e"))
    june = base.select("today", F.explode(F.array(F.year("today"), F.year("today") + 1)).alias("y")).select("today", row(last_friday(F.make_date("y", F.lit(6), F.lit(1))), F.lit("Russell reconstitution"), "index_rebal", F.lit("Annual Russell index rebuild")).alias("e"))
    all_ = monthly.unionByName(june).select("today", "e.*").withColumn("days_until", F.date_diff("date", "today").cast("long"))
    return all_.where(F.col("days_until").between(0, horizon)).drop("today").dropDuplicates(["date", "event"])


def proximity(calendar: DataFrame, within: int = 21) -> DataFrame:
    """Attention signals: the nearer, the larger, .5 at most."""
    return calendar.where(F.col("days_until") <= within).select(F.col("event").alias("asset"), F.col("kind").alias("family"), (F.greatest(F.lit(0.0), 1 - F.col("days_until") / float(within)) * 0.5).alias("signal"))


def earnings_window(rows: DataFrame, moves: DataFrame, today: str, back: int = 5, ahead: int = 8) -> DataFrame:
    """Weekday reports around ``today`` with the asset's move; ``recent`` tells past from coming."""
    t = F.to_date(F.lit(today))
    near = rows.where(F.col("d").between(F.date_sub(t, back), F.date_add(t, ahead)) & ~F.dayofweek("d").isin(1, 7))
    return near.join(moves, "asset", "left").withColumn("recent", F.col("d") < t)


def next_meetings(dates: DataFrame, today: str, k: int = 4) -> DataFrame:
    return dates.where(F.col("d") >= F.to_date(F.lit(today))).orderBy("d").limit(k)
