"""Tag dimensions: core assets with labels and classes, peer groups, market names.

Larger lists (industry funds, strategic beta, the master list) are tables that
the caller passes in; they merge first-wins with what is here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The core assets by class, in display order.
SECTORS = {"XLK": "Technology", "XLF": "Financials", "XLE": "Energy", "XLV": "Health Care", "XLI": "Industrials", "XLY": "Cons. Discretionary", "XLP": "Cons. Staples", "XLU": "Utilities", "XLB": "Materials", "XLRE": "Real Estate", "XLC": "Communication"}
THEMES = {
    "SMH": "Semiconductors", "SOXX": "Semiconductors", "XSD": "Semis (equal-wt)", "GLD": "Gold", "SLV": "Silver", "GDX": "Gold Miners", "XME": "Metals & Mining", "LIT": "Lithium/Battery", "URA": "Uranium", "EEM": "EM Equity", "FXI": "China", "EWZ": "Brazil", "INDA": "India",
    "IBB": "Biotech", "XBI": "Biotech (equal-wt)", "ITB": "Homebuilders", "KRE": "Regional Banks", "JETS": "Airlines", "TAN": "Solar", "ARKK": "Disruptive Growth", "IGV": "Software", "SKYY": "Cloud",
}
FACTORS = {"SPY": "US Large Cap", "QQQ": "Nasdaq 100", "IWM": "US Small Cap", "MTUM": "Momentum", "VLUE": "Value", "QUAL": "Quality", "USMV": "Min Volatility", "SPHB": "High Beta", "RSP": "Equal-Weight S&P", "VEA": "Dev. ex-US", "VWO": "EM (broad)"}
MACRO = {"TLT": "20y Treasuries", "IEF": "7-10y Treasuries", "HYG": "High Yield", "LQD": "IG Credit", "UUP": "US Dollar", "DBC": "Commodities", "USO": "Crude Oil", "UNG": "Nat Gas", "BITO": "Bitcoin (futures)"}
STYLE_GRID = {
    "Value": {"US": "VLUE", "DEV": "IVLU", "EM": "FNDE"}, "Momentum": {"US": "MTUM", "DEV": "IMTM", "EM": "PIE"}, "Quality": {"US": "QUAL", "DEV": "IQLT", "EM": "XSOE"}, "LowVol": {"US": "USMV", "DEV": "EFAV", "EM": "EEMV"}, "Size": {"US": "SIZE", "DEV": "ISCF", "EM": "DGS"},
    "Dividend": {"US": "VYM", "DEV": "IDV", "EM": "DEM"}, "Growth": {"US": "IWF", "DEV": "EFG", "EM": None}, "Buyback": {"US": "PKW", "DEV": "IPKW", "EM": "EYLD"}, "Multifactor": {"US": "LRGF", "DEV": "INTF", "EM": "EMGF"},
}
REGION_SECTORS = {"EUFN": ("Europe Financials", "EU"), "EUAD": ("Europe Aerospace & Defense", "EU"), "KWEB": ("China Internet", "CN"), "CQQQ": ("China Technology", "CN"), "CHIQ": ("China Consumer", "CN")}
COT_MARKETS = {"SPY": "E-MINI S&P 500", "QQQ": "NASDAQ-100 E-MINI", "IWM": "RUSSELL 2000 E-MINI", "GLD": "GOLD", "SLV": "SILVER", "USO": "CRUDE OIL, LIGHT SWEET", "UNG": "NATURAL GAS", "TLT": "ULTRA U.S. TREASURY BOND", "UUP": "U.S. DOLLAR INDEX", "DBC": "BLOOMBERG COMMODITY INDEX", "BITO": "BITCOIN"}

CLASSES = {"sector": SECTORS, "theme": THEMES, "factor": FACTORS, "macro": MACRO}
_TAGS = "asset string, grp string, label string, region string"


def core(spark: SparkSession) -> DataFrame:
    """asset, label, asset_class; the first class that lists an asset wins, the last label."""
    labels = {a: x for d in CLASSES.values() for a, x in d.items()}
    cls = {a: c for c, d in reversed(CLASSES.items()) for a in d}
    return spark.createDataFrame([(a, labels[a], cls[a]) for a in labels], "asset string, label string, asset_class string")


def peer_tags(spark: SparkSession, *more: DataFrame) -> DataFrame:
    """asset, grp, label, region of the style grid and region sectors, then of ``more`` (same columns) first-wins."""
    styles = [(a, "style", s, r) for s, row in STYLE_GRID.items() for r, a in row.items() if a]
    sectors = [(a, "region_sector", label, r) for a, (label, r) in REGION_SECTORS.items()]
    return first_wins([spark.createDataFrame(styles, _TAGS), *more, spark.createDataFrame(sectors, _TAGS)], "asset")


def first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first frame that has a key."""
    tagged = [f.withColumn("_o", F.lit(i)) for i, f in enumerate(frames)]
    every = reduce(DataFrame.unionByName, tagged)
    cols = [c for c in every.columns if c not in (key, "_o")]
    return every.groupBy(key).agg(F.min_by(F.struct(*cols), "_o").alias("x")).select(key, "x.*")


def labelled(df: DataFrame, dim: DataFrame) -> DataFrame:
    """``df`` with label and asset_class; an unknown asset is its own label, an equity."""
    return df.join(dim, "asset", "left").withColumn("label", F.coalesce("label", F.col("asset").cast("string"))).withColumn("asset_class", F.coalesce("asset_class", F.lit("equity")))


def market_assets(spark: SparkSession) -> DataFrame:
    """market, asset of the positioning reports."""
    return spark.createDataFrame([(m, a) for a, m in COT_MARKETS.items()], "market string, asset string")
