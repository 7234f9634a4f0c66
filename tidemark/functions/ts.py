"""Time-series Column builders over one window specification: partition by asset, order by day.

All of them share ``series()``, so that any number of indicators costs one
exchange and one sort. A rolling value needs ``n`` non-null observations. NaN is
mapped to null on the way in (``clean``); division never raises.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ASSET, DAY = "asset", "d"


def series() -> WindowSpec:
    return Window.partitionBy(ASSET).orderBy(DAY)


def rows(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def roll(f: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    x = col(x)
    return F.when(F.count(x).over(rows(n)) == n, f(x).over(rows(n)))


def lag(x: Column | str, k: int) -> Column:
    return F.lag(col(x), k).over(series())


def change(x: Column | str, k: int) -> Column:
    """x over its value ``k`` rows ago, less one."""
    return F.try_divide(col(x), lag(x, k)) - 1


def clip(x: Column) -> Column:
    """Into [-1, 1]; undefined is 0. The null test comes first, as least and greatest skip nulls."""
    y = clean(x)
    return F.when(y.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), y)))


def returns(x: Column | str = "close") -> Column:
    return change(x, 1)


def delta(x: Column | str, k: int) -> Column:
    return col(x) - lag(x, k)


def delay(x: Column | str, k: int) -> Column:
    return lag(x, k)


def _frame(x: Column | str, n: int) -> Column:
    """The last ``n`` values as an array; null while there are fewer."""
    x = col(x)
    return F.when(F.count(x).over(rows(n)) == n, F.collect_list(x).over(rows(n)))


def ts_rank(x: Column | str, n: int) -> Column:
    """Average rank of the last value within its frame, over ``n``."""
    a = _frame(x, n)
    last = F.element_at(a, -1)
    below, same = F.size(F.filter(a, lambda v: v < last)), F.size(F.filter(a, lambda v: v == last))
    return F.when(a.isNotNull(), (below + (same + 1) / 2) / n)


def ts_min(x: Column | str, n: int) -> Column:
    return roll(F.min, x, n)


def ts_max(x: Column | str, n: int) -> Column:
    return roll(F.max, x, n)


def ts_argmax(x: Column | str, n: int) -> Column:
    """Position of the first maximum in the frame, from 0."""
    a = _frame(x, n)
    return F.when(a.isNotNull(), F.array_position(a, F.array_max(a)) - 1)


def stddev(x: Column | str, n: int) -> Column:
    return roll(F.stddev_samp, x, n)


def sma(x: Column | str, n: int) -> Column:
    return roll(F.avg, x, n)


def correlation(a: Column | str, b: Column | str, n: int) -> Column:
    """Sample correlation; undefined where either side doesn't vary."""
    a, b = col(a), col(b)
    both = F.when(a.isNotNull() & b.isNotNull(), 1)
    cov = F.covar_samp(a, b).over(rows(n))
    return F.when(F.count(both).over(rows(n)) == n, F.try_divide(cov, F.stddev_samp(a).over(rows(n)) * F.stddev_samp(b).over(rows(n))))


def decay_linear(x: Column | str, n: int) -> Column:
    """Mean with weights 1..n, the last value weighing most."""
    a = _frame(x, n)
    total = F.aggregate(F.zip_with(a, F.sequence(F.lit(1), F.lit(n)), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return total / (n * (n + 1) / 2)


def signedpower(x: Column | str, a: float) -> Column:
    return F.signum(col(x)) * F.pow(F.abs(col(x)), F.lit(a))


def scale(x: Column | str, a: float = 1.0, by: str = ASSET) -> Column:
    """Scaled so that absolute values sum to ``a``; unchanged if they sum to 0."""
    total = F.sum(F.abs(col(x))).over(Window.partitionBy(by))
    return F.when(total == 0, col(x)).otherwise(F.try_divide(col(x) * a, total))


def zscore(x: Column | str, n: int) -> Column:
    return (col(x) - sma(x, n)) / (stddev(x, n) + 1e-9)


def rsi(up: Column | str = "up", down: Column | str = "down", n: int = 14) -> Column:
    """From the averages of gains and losses (columns of ``prepared``)."""
    return 100 - 100 / (1 + sma(up, n) / (sma(down, n) + 1e-9))


def donchian(high: Column | str = "high", low: Column | str = "low", n: int = 20) -> tuple[Column, Column]:
    return roll(F.max, high, n), roll(F.min, low, n)


def atr(n: int = 14) -> Column:
    """Average of the true range (column of ``prepared``)."""
    return sma("tr", n)


def realized_vol(n: int) -> Column:
    return stddev("ret", n) * F.sqrt(F.lit(252.0))


def last_value(x: Column | str) -> Column:
    """Last non-null value up to the row."""
    return F.last(col(x), ignorenulls=True).over(series())


def prepared(bars):
    """``bars`` with what indicators build on: n (row number), ret, up, down, tr."""
    previous = F.lag("close").over(series())
    diff = F.col("close") - F.col("prev")
    step = bars.withColumn("prev", previous).withColumn("n", F.row_number().over(series()))
    return step.select(
        *bars.columns, "n",
        (F.try_divide("close", "prev") - 1).alias("ret"),
        F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0))).alias("up"),
        F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0))).alias("down"),
        F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev")), F.abs(F.col("low") - F.col("prev"))).alias("tr"),
    )


#: Rolling columns that several models share: name -> (aggregate, column, rows).
ROLLING: dict[str, tuple[Callable[[Column], Column], str, int]] = {
    **{f"sma_{n}": (F.avg, "close", n) for n in (20, 50, 100, 200)},
    "sd_20": (F.stddev_samp, "close", 20),
    **{f"rv_{n}": (F.stddev_samp, "ret", n) for n in (20, 63, 100)},
    **{f"vsma_{n}": (F.avg, "volume", n) for n in (20, 100)},
    **{f"hi_{n}": (F.max, "high", n) for n in (14, 20)},
    **{f"lo_{n}": (F.min, "low", n) for n in (14, 20)},
    "up_14": (F.avg, "up", 14),
    "down_14": (F.avg, "down", 14),
}
LAGS = (5, 20, 21, 62, 63, 125, 126, 251, 252)


def _annual(name: str, x: Column) -> Column:
    return x * F.sqrt(F.lit(252.0)) if name.startswith("rv_") else x


def featured(bars):
    """``prepared`` with the shared columns on every row, each computed once however many models read it.

    The optimizer prunes those that nothing reads.
    """
    return prepared(bars).select("*", *[_annual(k, roll(f, c, n)).alias(k) for k, (f, c, n) in ROLLING.items()], *[lag("close", k).alias(f"lag_{k}") for k in LAGS], is_last().alias("_last"))


def running(bars):
    """``prepared`` with the rolling means and volatilities as differences of running sums, and the lags.

    Each running sum is one step a row, whatever the window's length: for queries
    that need every row's value, or that of many rows. What nothing reads is pruned.
    """
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    sums = {"close": F.col("close"), "ret": F.col("ret"), "ret2": F.col("ret") * F.col("ret")}
    step = prepared(bars)
    step = step.select("*", *[F.coalesce(F.sum(x).over(so_far), F.lit(0.0)).alias(f"_s_{k}") for k, x in sums.items()], *[F.count(x).over(so_far).alias(f"_c_{k}") for k, x in sums.items()])
    over = lambda c, n: F.col(c) - F.coalesce(lag(c, n), F.lit(0))
    means = {f"sma_{n}": F.when(over("_c_close", n) == n, over("_s_close", n) / n) for n in (20, 50, 100, 200)}
    var = lambda n: (over("_s_ret2", n) - over("_s_ret", n) * over("_s_ret", n) / n) / (n - 1)
    vols = {f"rv_{n}": F.when(over("_c_ret", n) == n, F.sqrt(F.greatest(var(n), F.lit(0.0)) * 252.0)) for n in (20, 63, 100)}
    return step.select(*bars.columns, "n", "ret", *[x.alias(k) for k, x in (means | vols).items()], *[lag("close", k).alias(f"lag_{k}") for k in LAGS])


def tail(bars, rows_: int):
    """``prepared`` rows of the last ``rows_`` bars of each asset; ``rk`` counts back from 1. No further exchange."""
    back = F.count(F.lit(1)).over(Window.partitionBy(ASSET)) - F.col("n") + 1
    return prepared(bars).withColumn("rk", back).where(F.col("rk") <= rows_)


def featured_last(bars):
    """The shared columns at each asset's last bar only, by conditional sums over its last rows.

    A window would fold a frame for every row; here each row is folded once.
    """
    rows_ = tail(bars, max(LAGS) + 1)
    within = lambda c, n: F.when(F.col("rk") <= n, F.col(c))
    rolled = [F.when(F.count(within(c, n)) == n, _annual(k, f(within(c, n)))).alias(k) for k, (f, c, n) in ROLLING.items()]
    now = [F.max(F.when(F.col("rk") == 1, F.col(c))).alias(c) for c in ("d", "n", "close", "high", "low", "volume", "ret", "tr")]
    return rows_.groupBy(ASSET).agg(*now, *rolled, *[F.max(F.when(F.col("rk") == k + 1, F.col("close"))).alias(f"lag_{k}") for k in LAGS])


def is_last() -> Column:
    """Marks the last row of each asset on the shared window; filter on it after a select."""
    return F.lead(DAY).over(series()).isNull()


def ema_fold(values: Column, spans: tuple[int, ...]) -> Column:
    """Last exponential averages of an array in time order, one struct field (e<span>) each.

    Seeded by the first value; one pass over the array for all spans.
    """
    seed = F.struct(*[F.element_at(values, 1).alias(f"e{n}") for n in spans])
    step = lambda acc, v: F.struct(*[(v * (2.0 / (n + 1)) + acc[f"e{n}"] * (1 - 2.0 / (n + 1))).alias(f"e{n}") for n in spans])
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), seed, step)


def ema_columns(bars, spans: tuple[int, ...] = (12, 20, 26), column: str = "close"):
    """asset, d, ``column`` and on every row the exponential averages e<span>, seeded by the first value.

    An average depends on all rows before, so an asset's series is worked on as a
    whole; nulls keep the average as it is.
    """
    names = [ASSET, DAY, column]

    def run(t):
        t = t.sort_by(DAY)
        x = t.column(column).to_numpy(zero_copy_only=False).astype(float)
        out = {f"e{n}": np.full(len(x), np.nan) for n in spans}
        for n, e in zip(spans, out.values()):
            a, last = 2.0 / (n + 1), np.nan
            for k, v in enumerate(x.tolist()):
                last = last if v != v else v if last != last else v * a + last * (1 - a)
                e[k] = last
        return pa.table({**{c: t.column(c) for c in names}, **{k: pa.array(v, pa.float64(), from_pandas=True) for k, v in out.items()}})

    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}
    return bars.select(*names).groupBy(ASSET).applyInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in names] + [f"e{n} double" for n in spans]))


def macd_fold(values: Column) -> Column:
    """Struct of e12, e26 and sig: the 9-span average of their difference, in one pass."""
    first = F.element_at(values, 1)
    seed = F.struct(first.alias("e12"), first.alias("e26"), F.lit(0.0).alias("sig"))

    def step(acc, v):
        fast, slow = v * (2 / 13) + acc["e12"] * (11 / 13), v * (2 / 27) + acc["e26"] * (25 / 27)
        return F.struct(fast.alias("e12"), slow.alias("e26"), ((fast - slow) * 0.2 + acc["sig"] * 0.8).alias("sig"))

    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), seed, step)
