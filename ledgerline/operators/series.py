"""Time-series operators over many assets: returns, volatility, recurrences, indices, z-scores."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import INDICATORS

ASSET, TS = "asset_id", "ts"
#: Rows that one block of a recurrence holds, fewer for alpha near 1.
BLOCK = 256


def by_time(asset: str = ASSET, ts: str = TS):
    return Window.partitionBy(asset).orderBy(ts)


def next_log_return(df: DataFrame, price: str = "close", name: str = "target_return", window=None) -> DataFrame:
    """Null where a price is missing, zero or of another sign than the next one."""
    ratio = F.try_divide(F.lead(price).over(window or by_time()), F.col(price))
    return df.withColumn(name, F.when(ratio > 0, F.ln(ratio)))


def percent_change(df: DataFrame, value: str = "close", name: str = "change", window=None) -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(value), F.lag(value).over(window or by_time())) - 1)


def rolling_std(df: DataFrame, value: str, name: str, rows: int = 20, window=None) -> DataFrame:
    """Sample deviation of the last `rows` values; null until there are as many."""
    w = (window or by_time()).rowsBetween(1 - rows, 0)
    return df.withColumn(name, F.when(F.count(value).over(w) == rows, F.stddev_samp(value).over(w)))


def time_index(df: DataFrame, name: str = "time_idx") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(by_time()) - 1).cast("long"))


def duplicate_times(df: DataFrame) -> DataFrame:
    """Times that an asset has more than once: must be empty before windows by time."""
    return df.groupBy(ASSET, TS).count().filter("count > 1")


def rising_times(df: DataFrame) -> DataFrame:
    """df that fails when a row is computed whose asset has another one at its time, or that has no time."""
    w = by_time()
    fine = F.col(TS).isNotNull() & F.coalesce(F.lag(TS).over(w) < F.col(TS), F.row_number().over(w) == 1)
    checked = df.withColumn("__fine", fine)
    stop = F.raise_error(F.concat(F.lit("several bars at one time: "), F.coalesce(F.col(ASSET), F.lit("")), F.lit(" "), F.coalesce(F.col(TS).cast("string"), F.lit("none"))))
    return checked.filter(F.when(F.col("__fine"), F.lit(True)).otherwise(stop)).drop("__fine")


def sequence_blocks(df: DataFrame, keys: list[str], pos: str, n: int, value: str = "value", head: int = 0, tail: int = 0) -> DataFrame:
    """Consecutive rows in blocks of n as arrays, after trimming; an incomplete block is dropped."""
    total = F.count("*").over(Window.partitionBy(*keys))
    rows = df.withColumn("__total", total).filter((F.col(pos) >= head) & (F.col(pos) < F.col("__total") - tail))
    block = F.floor((F.col(pos) - head) / n).alias("block")
    grouped = rows.groupBy(*keys, block).agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("items"))
    return grouped.filter(F.size("items") == n).withColumn("items", F.col(f"items.{value}"))


@dataclass(frozen=True)
class Ema:
    """v = alpha * x + (1 - alpha) * v, from the mean of the first `length` values on; `first` is the row of the first value."""

    name: str
    value: str
    length: int
    alpha: float
    first: int = 0

    @staticmethod
    def of(name: str, value: str, length: int, first: int = 0) -> Ema:
        return Ema(name, value, length, 2 / (length + 1), first)


def block_of(alpha: float) -> int:
    """Rows of a block, so that (1 - alpha) to their power stays far within the range of doubles."""
    return BLOCK if alpha >= 1 else max(1, min(BLOCK, int(600 / -math.log1p(-alpha))))


def reach(r: float, rows: int) -> int:
    """How many runs of so many rows back a value can matter in double precision, decaying by r a row."""
    return max(1, math.ceil(40 / (-math.log(r) * rows)))


def carried(rows: DataFrame, ends: dict[str, tuple[str, float, int]], window, distance: int) -> DataFrame:
    """rows with the sum, for each name: (column, decay, steps), of the column one row back and then every `distance` rows, fading by decay.

    A few steps are added up at once; many by doubling, each sum with the one that ends where it begins.
    """
    few = {n: e for n, e in ends.items() if e[2] <= 32}
    sums = {n: reduce(lambda a, b: a + b, [F.coalesce(F.lag(c, 1 + k * distance).over(window), F.lit(0.0)) * decay**k for k in range(steps)]) for n, (c, decay, steps) in few.items()}
    sums |= {n: F.coalesce(F.lag(c, 1).over(window), F.lit(0.0)) for n, (c, _, _) in ends.items() if n not in few}
    rows = rows.withColumns(sums) if sums else rows
    reached = 1
    while longer := {n: e for n, e in ends.items() if n not in few and reached < e[2]}:
        before = lambda n: F.coalesce(F.lag(n, reached * distance).over(window), F.lit(0.0))  # noqa: B023, E731
        rows = rows.withColumns({n: F.col(n) + before(n) * e[1] ** reached for n, e in longer.items()})
        reached *= 2
    return rows


def ema_family(df: DataFrame, specs: list[Ema]) -> DataFrame:
    """All recurrences in one blocked scan; df keeps its rows and columns.

    Within a block the recurrence from zero is a windowed weighted sum.  Across blocks the carry
    is the weighted sum of earlier blocks' last values, of as many as can matter in double
    precision: at a block's first row they stand at fixed distances.  All windows are by asset, so
    the rows are shuffled once and joined with nothing.  Values are null before their seed's row,
    and from the first null value on, as in the recurrence itself.  Any alpha in (0, 1] will do; with 1 the
    value stands for itself.
    """
    if not all(0 < s.alpha <= 1 for s in specs):
        raise ValueError("alpha must be above 0 and at most 1")
    size = min(block_of(s.alpha) for s in specs)
    order = Window.partitionBy(ASSET).orderBy("__rn")
    rows = df.withColumn("__rn", F.row_number().over(by_time()) - 1)
    rows = rows.withColumn("__block", F.floor(F.col("__rn") / size)).withColumn("__j", F.col("__rn") % size)
    put, z, ends, carry, out = {}, {}, {}, {}, {}
    inner = Window.partitionBy(ASSET, "__block").orderBy("__j").rowsBetween(Window.unboundedPreceding, 0)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    for s in specs:
        seed, r = s.first + s.length - 1, 1 - s.alpha
        absent = F.count_if(F.col(s.value).isNull() & (F.col("__rn") >= s.first)).over(upto)
        fine = (F.col("__rn") >= seed) & (F.col(f"__a_{s.name}") == 0)
        put[f"__a_{s.name}"] = absent
        if not r:
            out[s.name] = F.when(fine, F.col(s.value).cast("double"))
            continue
        mean = F.avg(s.value).over(order.rowsBetween(1 - s.length, 0))
        put[f"__b_{s.name}"] = F.when(F.col("__rn") < seed, 0.0).when(F.col("__rn") == seed, mean).otherwise(s.alpha * F.col(s.value))
        scaled = F.col(f"__b_{s.name}") * F.pow(F.lit(r), -F.col("__j"))
        z[f"__z_{s.name}"] = F.pow(F.lit(r), F.col("__j")) * F.coalesce(F.sum(scaled).over(inner), F.lit(0.0))
        ends[f"__f_{s.name}"] = (f"__z_{s.name}", r**size, reach(r, size))
        carry[f"__c_{s.name}"] = F.first(F.when(F.col("__j") == 0, F.col(f"__f_{s.name}")), ignorenulls=True).over(inner)
        out[s.name] = F.when(fine, F.pow(F.lit(r), F.col("__j") + 1) * F.col(f"__c_{s.name}") + F.col(f"__z_{s.name}"))
    for columns in (put, z):
        rows = rows.withColumns(columns) if columns else rows
    rows = carried(rows, ends, order, size)
    for columns in (carry, out):
        rows = rows.withColumns(columns) if columns else rows
    return rows.select(*df.columns, *(s.name for s in specs))


def indicators(candles: DataFrame) -> DataFrame:
    """Technical indicators of candles: RSI, MACD and signal, EMAs, volatility, range and body.

    Rows before all of them exist are dropped, and so are rows where a flat series leaves one undefined.
    """
    c = candles.select(ASSET, TS, *(F.col(x).cast("double").alias(x) for x in ("open", "high", "low", "close")))
    c = first_differences(c, by_time())
    c = ema_family(c, INDICATOR_SPECS).withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    c = ema_family(c, [SIGNAL_SPEC])
    return finished(c).select(ASSET, TS, *INDICATORS).na.drop("any")


INDICATOR_SPECS = [Ema.of(f"ema_{n}", "close", n) for n in (10, 12, 26, 50, 100, 200)]
INDICATOR_SPECS += [Ema("__g", "__gain", 14, 1 / 14, 1), Ema("__l", "__loss", 14, 1 / 14, 1)]
SIGNAL_SPEC = Ema.of("macd_signal", "macd", 9, 25)


def first_differences(c: DataFrame, window) -> DataFrame:
    """What needs frames of prices: gains, losses and volatility."""
    delta = F.col("close") - F.lag("close").over(window)
    c = c.withColumn("__gain", F.greatest(delta, F.lit(0.0))).withColumn("__loss", F.greatest(-delta, F.lit(0.0)))
    return rolling_std(percent_change(c, "close", "__change", window), "__change", "volatility_20d", 20, window)


def finished(c: DataFrame) -> DataFrame:
    """What needs no other row: RSI of the smoothed gains and losses, range and body."""
    c = c.withColumn("rsi_14", 100 * F.try_divide(F.col("__g"), F.col("__g") + F.col("__l")))
    return c.withColumns({"candle_range": F.col("high") - F.col("low"), "candle_body": F.abs(F.col("close") - F.col("open"))})


def fit_scaler(df: DataFrame, features: list[str], fit_until=None) -> DataFrame:
    """(asset_id, feature, mean, std): population parameters by asset, nulls skipped, in one aggregation."""
    if fit_until is not None:
        df = df.filter(F.col(TS) <= fit_until)
    df = df.select(ASSET, *(F.col(f).cast("double").alias(f) for f in features))
    agg = df.groupBy(ASSET).agg(*(x for f in features for x in (F.avg(f).alias(f"{f}__m"), F.stddev_pop(f).alias(f"{f}__s"))))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"{f}__m").alias("mean"), F.col(f"{f}__s").alias("std")) for f in features)))
    return agg.select(ASSET, pairs.alias("p")).select(ASSET, "p.*")


def scale(df: DataFrame, scaler: DataFrame, features: list[str]) -> DataFrame:
    """z-scores by the fitted parameters; deviation 0 counts as 1, what has no parameters passes."""
    wide = scaler.groupBy(ASSET).agg(
        *(F.max(F.when(F.col("feature") == f, F.struct("mean", "std"))).alias(f"__{f}") for f in features)
    )
    out = df.join(wide, ASSET, "left")
    for f in features:
        p = F.col(f"__{f}")
        known = p["mean"].isNotNull()
        z = (F.col(f) - p["mean"]) / F.when(p["std"] == 0, 1.0).otherwise(p["std"])
        out = out.withColumn(f, F.when(known, z).otherwise(F.col(f).cast("double")))
    return out.select(*df.columns)


def standardised(df: DataFrame, features: list[str], fit_until=None) -> DataFrame:
    """z-scores as by fit_scaler() and scale(), in one pass: the parameters are windows over the asset's rows."""
    whole = Window.partitionBy(ASSET)
    seen = F.lit(True) if fit_until is None else F.col(TS) <= fit_until
    for f in features:
        x = F.col(f).cast("double")
        mean, std = F.avg(F.when(seen, x)).over(whole), F.stddev_pop(F.when(seen, x)).over(whole)
        df = df.withColumns({f"__m_{f}": mean, f"__s_{f}": std})
    z = lambda f: (F.col(f) - F.col(f"__m_{f}")) / F.when(F.col(f"__s_{f}") == 0, 1.0).otherwise(F.col(f"__s_{f}"))
    known = lambda f: F.col(f"__m_{f}").isNotNull()
    out = {f: F.when(known(f), z(f)).otherwise(F.col(f).cast("double")) for f in features}
    return df.select(*(out[c].alias(c) if c in out else c for c in df.columns if not c.startswith(("__m_", "__s_"))))


def asof_backward(left: DataFrame, right: DataFrame, on: str, right_on: str, payload: list[str], ties: list[str]) -> DataFrame:
    """Left rows with the payload of the latest right row at or before them; equal times count.

    One shuffle by asset: both sides in one ordering, and the last right row carried on as a
    whole, so that its nulls stay nulls.
    """
    tagged = left.select(ASSET, F.col(on).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    right = right.select(ASSET, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.struct(*payload).alias("__right"), *(F.col(t).alias(f"__t{i}") for i, t in enumerate(ties)))
    both = right.filter("__at is not null").unionByName(tagged, allowMissingColumns=True)
    w = Window.partitionBy(ASSET).orderBy("__at", "__side", *(f"__t{i}" for i in range(len(ties)))).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__last", F.last("__right", ignorenulls=True).over(w)).filter("__side = 1")
    return carried.select("__left.*", *(F.col(f"__last.{p}").alias(p) for p in payload))
