"""Pieces of DuckDB SQL that state the same results as the Column builders."""

from __future__ import annotations

W = "PARTITION BY asset ORDER BY d"

BARS = """bars AS (
  SELECT l_suppkey AS asset, CAST(l_shipdate AS DATE) AS d,
         first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open, max(p) AS high, min(p) AS low,
         last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close, sum(l_quantity) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem WHERE l_quantity > 0) GROUP BY 1, 2
)"""

PREP = f"""step AS (SELECT *, lag(close) OVER ({W}) AS prev, row_number() OVER ({W}) AS n FROM bars),
prep AS (
  SELECT asset, d, open, high, low, close, volume, n, close / nullif(prev, 0) - 1 AS ret,
    CASE WHEN prev IS NOT NULL THEN greatest(close - prev, 0.0) END AS up, CASE WHEN prev IS NOT NULL THEN greatest(prev - close, 0.0) END AS down,
    greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
    lead(d) OVER ({W}) IS NULL AS is_last
  FROM step
)"""

TAGS = """tags AS (
  SELECT s_suppkey AS asset, n_name AS label, r_name AS region, CASE WHEN s_acctbal >= 0 THEN 'style' ELSE 'industry' END AS grp
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

MACRO = "macro AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS d, avg(value) AS value FROM events GROUP BY 1, 2)"

FACTORS = """monthly AS (
  SELECT c_mktsegment AS factor, date_trunc('month', CAST(o_orderdate AS DATE))::DATE AS m, sum(o_totalprice) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
), factors AS (
  SELECT factor, substr(factor, 1, 1) AS region, m, r FROM (SELECT *, v / nullif(lag(v) OVER (PARTITION BY factor ORDER BY m), 0) - 1 AS r FROM monthly) WHERE r IS NOT NULL
)"""


def lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER ({W})" if k else x


def change(x: str, k: int) -> str:
    return f"({x} / nullif({lag(x, k)}, 0) - 1)"


def roll(f: str, x: str, n: int) -> str:
    w = f"OVER ({W} ROWS {n - 1} PRECEDING)"
    return f"(CASE WHEN count({x}) {w} = {n} THEN {f}({x}) {w} END)"


def sma(x: str, n: int) -> str:
    return roll("avg", x, n)


def sd(x: str, n: int) -> str:
    return roll("stddev_samp", x, n)


def frame(x: str, n: int) -> str:
    w = f"OVER ({W} ROWS {n - 1} PRECEDING)"
    return f"(CASE WHEN count({x}) {w} = {n} THEN list({x}) {w} END)"


def clip(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) THEN 0.0 ELSE least(1.0, greatest(-1.0, {x})) END)"


def sign(x: str) -> str:
    return f"CAST(sign({x}) AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0))"


def zscore(x: str, n: int) -> str:
    return f"(({x} - {sma(x, n)}) / ({sd(x, n)} + 1e-9))"


def rsi() -> str:
    return f"(100 - 100 / (1 + {sma('up', 14)} / ({sma('down', 14)} + 1e-9)))"


def vol(n: int) -> str:
    return f"({sd('ret', n)} * sqrt(252.0))"


def pct_rank(x: str, by: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} ASC NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END)"


def peer(x: str, by: str) -> str:
    return f"(CASE WHEN count({x}) OVER (PARTITION BY {by}) < 2 OR {x} IS NULL THEN 0.0 ELSE ({pct_rank(x, by)} - 0.5) * 2 END)"


def _mean_of(legs: list[str]) -> str:
    total = " + ".join(f"coalesce({x}, 0.0)" for x in legs)
    n = " + ".join(f"(CASE WHEN ({x}) IS NULL THEN 0 ELSE 1 END)" for x in legs)
    return f"(({total}) / nullif({n}, 0))"


def channel(n: int, centred: bool = True) -> str:
    hi, lo = roll("max", "high", n), roll("min", "low", n)
    pos = f"((close - {lo}) / nullif({hi} - {lo}, 0))"
    body = f"2 * ({pos} - 0.5)" if centred else f"(50 - 100 * {pos}) / 35"
    return f"(CASE WHEN {hi} = {lo} THEN 0.0 ELSE {body} END)"


def trend() -> str:
    return _mean_of([f"(CASE WHEN n > {k} THEN {sign(change('close', k - 1))} END)" for k in (21, 63, 126, 252)])


def multi_ma() -> str:
    return _mean_of([f"(CASE WHEN {sma('close', k)} IS NOT NULL THEN CASE WHEN close > {sma('close', k)} THEN 1.0 ELSE -1.0 END END)" for k in (20, 50, 100, 200)])


def ts_mom() -> str:
    v = f"(CASE WHEN {vol(63)} IS NULL OR {vol(63)} <= 0 THEN 0.10 ELSE {vol(63)} END)"
    total, weight = [], []
    for back, skip, w in ((21, 0, 0.15), (63, 0, 0.25), (126, 0, 0.25), (252, 21, 0.35)):
        r = f"({lag('close', skip)} / nullif({lag('close', back)}, 0) - 1)"
        ok = f"n > {back + 1} AND {r} IS NOT NULL"
        total.append(f"(CASE WHEN {ok} THEN {w} * {r} / ({v} * {((back - skip) / 252) ** 0.5!r} + 1e-9) ELSE 0.0 END)")
        weight.append(f"(CASE WHEN {ok} THEN {w}::DOUBLE ELSE 0.0 END)")
    s, t = " + ".join(total), " + ".join(weight)
    return f"(CASE WHEN ({t}) > 0 THEN tanh(0.6 * (({s}) / nullif({t}, 0))) END)"


def bollinger() -> str:
    m, s = sma("close", 20), sd("close", 20)
    return f"(CASE WHEN {s} = 0 THEN 0.0 ELSE (0.5 - (close - ({m} - 2 * {s})) / (({m} + 2 * {s}) - ({m} - 2 * {s}) + 1e-9)) * 2 END)"


def volume_flow() -> str:
    return f"(({ratio(sma('volume', 20), sma('volume', 100))} - 1) * (CASE WHEN n > 21 THEN {sign(change('close', 20))} ELSE 0.0 END))"


RAW: dict[str, str] = {
    "momentum": f"(CASE WHEN n >= 131 THEN tanh(3 * {change('close', 125)}) END)",
    "ma_single_200": f"(({ratio('close', sma('close', 200))} - 1) * 8)",
    "ma_cross_50_200": f"(({ratio(sma('close', 50), sma('close', 200))} - 1) * 12)",
    "multi_ma": multi_ma(),
    "mean_reversion": f"(-{zscore('close', 20)} / 2)",
    "donchian_breakout": channel(20),
    "rsi_reversion": f"((50 - {rsi()}) / 30)",
    "vol_regime": f"(-({ratio(vol(20), vol(100))} - 1))",
    "trend_following": trend(),
    "s151_sma_cross_20_50": f"(({ratio(sma('close', 20), sma('close', 50))} - 1) * 12)",
    "s151_sma_cross_50_200": f"(({ratio(sma('close', 50), sma('close', 200))} - 1) * 12)",
    "s151_roc_63": f"(CASE WHEN n >= 65 THEN tanh(3 * {change('close', 62)}) END)",
    "s151_tsmom": trend(),
    "s151_price_vs_sma200": f"(({ratio('close', sma('close', 200))} - 1) * 8)",
    "s151_zscore_reversion": f"(-{zscore('close', 20)} / 2)",
    "s151_rsi_reversion": f"((50 - {rsi()}) / 30)",
    "s151_bollinger_pctb": bollinger(),
    "s151_stochastic": channel(14, False),
    "s151_donchian_breakout": channel(20),
    "s151_vol_regime": f"(-({ratio(vol(20), vol(100))} - 1))",
}

HORIZON = {
    "momentum": "months", "ma_single_200": "months", "ma_cross_50_200": "months", "multi_ma": "weeks", "mean_reversion": "days", "donchian_breakout": "weeks", "rsi_reversion": "days", "vol_regime": "weeks", "trend_following": "months",
    "s151_sma_cross_20_50": "weeks", "s151_sma_cross_50_200": "months", "s151_roc_63": "months", "s151_tsmom": "months", "s151_price_vs_sma200": "months", "s151_zscore_reversion": "days", "s151_rsi_reversion": "days", "s151_bollinger_pctb": "days", "s151_stochastic": "days", "s151_donchian_breakout": "weeks", "s151_vol_regime": "weeks",
}

MODEL_SQL = {"frm_ts_mom": ts_mom(), "strat_trend": trend(), "strat_momentum": RAW["momentum"], "strat_ma_cross": RAW["ma_cross_50_200"], "strat_ma_200": RAW["ma_single_200"]}


def on_bars(select: str, *more: str) -> str:
    return "WITH " + ",\n".join([BARS, PREP, *more]) + "\n" + select


def _ema(span: int) -> str:
    return f"list_reduce(c, lambda a, v: v * {2.0 / (span + 1)!r} + a * {1 - 2.0 / (span + 1)!r})"


_FAST, _SLOW = "x.v * (2.0 / 13) + a.e12 * (11.0 / 13)", "x.v * (2.0 / 27) + a.e26 * (25.0 / 27)"
#: The exponential models at the last bar, folded over an asset's closes.
EXPONENTIAL = f"""folds AS (
  SELECT asset, max(d) AS d, list(close ORDER BY d) AS c, list_reduce(list({{'v': close, 'e12': close, 'e26': close, 'sig': 0.0::DOUBLE}} ORDER BY d), lambda a, x: {{'v': x.v, 'e12': {_FAST}, 'e26': {_SLOW}, 'sig': (({_FAST}) - ({_SLOW})) * 0.2 + a.sig * 0.8}}) AS m FROM bars GROUP BY asset
), expo AS (
  SELECT f.asset, f.d, (m.e12 / nullif(m.e26, 0) - 1) * 12 AS s151_ema_cross_12_26, (m.e12 - m.e26 - m.sig) / (0.01 * close + 1e-9) AS s151_macd, (close - {_ema(20)}) / nullif(2 * atr, 0) AS s151_keltner
  FROM folds f JOIN (SELECT asset, is_last, close, {sma("tr", 20)} AS atr FROM prep) p ON f.asset = p.asset AND p.is_last
)"""


def signals_cte() -> str:
    """sig: asset, asset_class, segment, family, horizon, signal (4 places), state, confidence of all models."""
    wide = "wide AS (SELECT asset, d, is_last, " + ", ".join(f"{clip(x)} AS {k}" for k, x in RAW.items()) + " FROM prep)"
    rows = " UNION ALL ".join(f"SELECT asset, d, '{k}' AS family, '{HORIZON[k]}' AS horizon, {k} AS x FROM wide WHERE is_last" for k in RAW)
    rows += " UNION ALL " + " UNION ALL ".join(f"SELECT asset, d, '{k}' AS family, 'weeks' AS horizon, {clip(k)} AS x FROM expo" for k in ("s151_ema_cross_12_26", "s151_macd", "s151_keltner"))
    sig = f"""sig AS (
  SELECT r.asset, r.d AS "asof", coalesce(t.grp, 'equity') AS asset_class, 'strategies' AS segment, family, horizon, round(x, 4) AS signal,
    CASE WHEN x >= 0.15 THEN 'buy' WHEN x <= -0.15 THEN 'sell' ELSE 'neutral' END AS state,
    CASE WHEN starts_with(family, 's151_') THEN 'low' WHEN abs(x) >= 0.6 THEN 'high' WHEN abs(x) >= 0.3 THEN 'medium' ELSE 'low' END AS confidence
  FROM ({rows}) r LEFT JOIN tags t ON r.asset = t.asset)"""
    return ",\n".join([TAGS, wide, EXPONENTIAL, sig])
