"""The common signal record as Column projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ts import clean, clip

# The enumerations of the record.
SEGMENTS = ("strategies", "flows", "themes", "rebalance", "regime", "factor_rotation")
STATES = ("buy", "neutral", "sell")
HORIZONS = ("intraday", "days", "weeks", "months")
CONFIDENCES = ("low", "medium", "high")
FIELDS = "asof asset asset_class segment family horizon signal state score percentile rationale source confidence".split()


def state_of(x: Column, band: float = 0.15) -> Column:
    return F.when(x >= band, "buy").when(x <= -band, "sell").otherwise("neutral")


def confidence_of(signal: Column, percentile: Column) -> Column:
    """By strength; a medium one with an extreme percentile is high."""
    a = F.abs(signal)
    extreme = F.coalesce((percentile >= 0.9) | (percentile <= 0.1), F.lit(False))
    return F.when(a >= 0.6, "high").when(a >= 0.3, F.when(extreme, "high").otherwise("medium")).otherwise("low")


def make_signal(df: DataFrame, *, segment: str, signal: Column, family: Column, horizon: Column, asof: Column, asset: Column, asset_class: Column, source: str, percentile: Column | None = None, rationale: Column | None = None, confidence: str | None = None) -> DataFrame:
    """Clamp and round to four places; derive state and confidence from the clamped value."""
    if segment not in SEGMENTS:
        raise ValueError(f"bad segment: {segment}")
    pct = percentile if percentile is not None else F.lit(None).cast("double")
    raw = clip(signal)
    value = F.round(raw, 4)
    return df.select(
        asof.alias("asof"), asset.alias("asset"), asset_class.alias("asset_class"), F.lit(segment).alias("segment"), family.alias("family"), horizon.alias("horizon"),
        value.alias("signal"), state_of(raw).alias("state"), value.alias("score"), F.round(clean(pct), 4).alias("percentile"),
        (rationale if rationale is not None else F.lit("")).alias("rationale"), F.lit(source).alias("source"),
        (F.lit(confidence) if confidence else confidence_of(raw, pct)).alias("confidence"),
    )


def is_valid() -> Column:
    """The record keeps to its schema."""
    return F.coalesce(F.col("segment").isin(*SEGMENTS) & F.col("state").isin(*STATES) & F.col("horizon").isin(*HORIZONS) & F.col("confidence").isin(*CONFIDENCES) & F.col("signal").between(-1, 1) & F.col("asset").isNotNull() & F.col("family").isNotNull(), F.lit(False))
