"""Time-series operators for series of any length: no window, and no task, holds a whole asset.

Rows are numbered by asset across calendar cells: counts of the cells before, and places within
the cell.  Runs of `piece` numbers form the pieces that windows work in.  Frames reach over a
piece's edge by copies of the rows beside it.  A recurrence v -> a v + b is composed: within a piece it
runs from zero, the pieces' last values and lengths make one affine map a piece, the maps are
composed over the asset's few pieces, and what they carry into each piece is joined back and decays there.
The as-of join works in cells likewise, with the last right row of the cells before carried in.

All functions take an asset_id and a ts column without nulls, and no two rows of an asset with the same ts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import INDICATORS
from . import series
from .series import ASSET, TS, Ema

#: Rows of one asset that a window holds at most.
PIECE = 1 << 16
#: Calendar unit of the cells in which rows are counted; a cell of an asset is one task's.
UNIT = "MONTH"

_PIECE_KEY = [ASSET, "__piece"]


def numbered(df: DataFrame, name: str = "__rn", unit: str = UNIT) -> DataFrame:
    """df with each row's place in its asset's series, from 0: the time index without a window over the asset.

    Only the counts of the cells, a row for each asset and month, are summed by asset.
    """
    rows = df.withColumn("__cell", F.date_trunc(unit, TS))
    cells = rows.groupBy(ASSET, "__cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(ASSET).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(ASSET, "__cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy(ASSET, "__cell").orderBy(TS)) - 1
    rows = rows.withColumn("__k", within).join(cells, [ASSET, "__cell"])
    return rows.withColumn(name, F.col("__before") + F.col("__k")).drop("__cell", "__k", "__before")


def in_pieces(df: DataFrame, before: int = 0, after: int = 0, piece: int = PIECE) -> DataFrame:
    """Numbered rows with their `__piece`; the rows beside a piece's edge stand in the next piece too, with `__own` false."""
    if max(before, after) > piece:
        raise ValueError("a frame can't be longer than a piece")
    own, at = F.floor(F.col("__rn") / piece), F.col("__rn") % piece
    onward = F.when(at >= piece - before, own + 1)
    back = F.when((at < after) & (own > 0), own - 1)
    rows = df.withColumn("__piece", F.explode(F.array_compact(F.array(own, onward, back))))
    return rows.withColumn("__own", F.col("__piece") == own)


def by_piece() -> Window:
    return Window.partitionBy(*_PIECE_KEY).orderBy("__rn")


def next_log_return(df: DataFrame, price: str = "close", name: str = "target_return", piece: int = PIECE, unit: str = UNIT) -> DataFrame:
    rows = series.next_log_return(in_pieces(numbered(df, unit=unit), after=1, piece=piece), price, name, by_piece())
    return rows.filter("__own").select(*df.columns, name)


def ema_family(rows: DataFrame, specs: list[Ema], piece: int = PIECE) -> DataFrame:
    """All recurrences over rows with __rn and __piece; see series.ema_family() for their values."""
    if any(s.first + s.length > piece for s in specs):
        raise ValueError("a seed must lie in the first piece")
    columns = rows.columns
    size = min(series.block_of(s.alpha) for s in specs)
    order, at = by_piece(), F.col("__rn") % piece
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__block": F.floor(at / size), "__j": at % size})
    inner = Window.partitionBy(*_PIECE_KEY, "__block").orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
    put, z, ends, own = {}, {}, {}, {}
    for i, s in enumerate(specs):
        seed, r = s.first + s.length - 1, 1 - s.alpha
        put[f"__a{i}"] = F.count_if(F.col(s.value).isNull() & (F.col("__rn") >= s.first)).over(upto)
        if not r:
            own[f"__v{i}"] = F.col(s.value).cast("double")
            continue
        mean = F.avg(s.value).over(order.rowsBetween(1 - s.length, 0))
        put[f"__b{i}"] = F.when(F.col("__rn") < seed, 0.0).when(F.col("__rn") == seed, mean).otherwise(s.alpha * F.col(s.value))
        scaled = F.col(f"__b{i}") * F.pow(F.lit(r), -F.col("__j"))
        z[f"__z{i}"] = F.pow(F.lit(r), F.col("__j")) * F.coalesce(F.sum(scaled).over(inner), F.lit(0.0))
        ends[f"__f{i}"] = (f"__z{i}", r**size, series.reach(r, size))
        carry = F.first(F.when(F.col("__j") == 0, F.col(f"__f{i}")), ignorenulls=True).over(inner)
        own[f"__v{i}"] = F.pow(F.lit(r), F.col("__j") + 1) * carry + F.col(f"__z{i}")
    for some in (put, z):
        rows = rows.withColumns(some) if some else rows
    rows = series.carried(rows, ends, order, size).withColumns(own)
    keep = [f"__{x}{i}" for i in range(len(specs)) for x in "av"]
    rows = rows.select(*columns, *keep)
    # one affine map a piece: its value from zero, and (1 - alpha) to the power of its rows
    maps = rows.groupBy(*_PIECE_KEY).agg(*(x for i in range(len(specs)) for x in (F.max_by(f"__v{i}", "__rn").alias(f"__e{i}"), (F.max(f"__a{i}") > 0).alias(f"__n{i}"))))
    pieces = Window.partitionBy(ASSET).orderBy("__piece")
    maps = series.carried(maps, {f"__c{i}": (f"__e{i}", (1 - s.alpha) ** piece, series.reach(1 - s.alpha, piece)) for i, s in enumerate(specs) if s.alpha < 1}, pieces, 1)
    into = []
    for i, s in enumerate(specs):
        into.append((F.col(f"__c{i}") if s.alpha < 1 else F.lit(0.0)).alias(f"__c{i}"))
        into.append(F.coalesce(F.max(f"__n{i}").over(pieces.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)).alias(f"__o{i}"))
    rows = rows.join(maps.select(*_PIECE_KEY, *into), _PIECE_KEY)
    out = []
    for i, s in enumerate(specs):
        fine = (F.col("__rn") >= s.first + s.length - 1) & (F.col(f"__a{i}") == 0) & ~F.col(f"__o{i}")
        faded = F.pow(F.lit(1 - s.alpha), at + 1) * F.col(f"__c{i}") if s.alpha < 1 else F.lit(0.0)
        out.append(F.when(fine, F.col(f"__v{i}") + faded).alias(s.name))
    return rows.select(*columns, *out)


def indicators(candles: DataFrame, piece: int = PIECE, unit: str = UNIT) -> DataFrame:
    """The table of series.indicators(), for assets with any number of bars."""
    c = candles.select(ASSET, TS, *(F.col(x).cast("double").alias(x) for x in ("open", "high", "low", "close")))
    rows = in_pieces(numbered(c, unit=unit), before=20, piece=piece)
    rows = series.first_differences(rows, by_piece()).filter("__own").drop("__own")
    rows = ema_family(rows, series.INDICATOR_SPECS, piece).withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    rows = ema_family(rows, [series.SIGNAL_SPEC], piece)
    return series.finished(rows).select(ASSET, TS, *INDICATORS).na.drop("any")


#: Units into which a cell with too many rows is cut.
FINER = ("DAY", "HOUR", "MINUTE")


def _crowded(rows: DataFrame, unit: str, piece: int) -> DataFrame:
    """(asset_id, __cell, __unit) of the cells with more than `piece` rows: the coarsest finer unit no part of which has more, else the finest.

    Fewer rows than one in `piece` of rows(asset_id, __at).  They are counted by minute first.
    """
    minutes = rows.groupBy(ASSET, F.date_trunc(FINER[-1], "__at").alias("__minute")).count().withColumn("__cell", F.date_trunc(unit, "__minute"))
    sizes = {u: F.sum("count").over(Window.partitionBy(ASSET, "__cell", F.date_trunc(u, "__minute"))).alias(u) for u in FINER[:-1]}
    cells = minutes.select(ASSET, "__cell", "count", *sizes.values()).groupBy(ASSET, "__cell")
    cells = cells.agg(F.sum("count").alias("__n"), *(F.max(u).alias(u) for u in sizes)).filter(F.col("__n") > piece)
    fits = F.coalesce(*(F.when(F.col(u) <= piece, F.lit(u)) for u in sizes), F.lit(FINER[-1]))
    return cells.select(ASSET, "__cell", fits.alias("__unit"))


def asof_backward(left: DataFrame, right: DataFrame, on: str, right_on: str, payload: list[str], ties: list[str], unit: str = UNIT, piece: int = PIECE) -> DataFrame:
    """Left rows with the payload of the latest right row at or before them, as series.asof_backward().

    Both sides meet in cells of asset and calendar unit; a cell with more than `piece` rows is cut into days, hours or minutes,
    of which an asset's minute is one task's.  The last right row of each cell goes, as a whole, to the head of the later
    cells up to the next one that has a right row: a row for each asset and cell, not the asset's rows.
    """
    tie = [F.col(t).alias(f"__t{i}") for i, t in enumerate(ties)]
    timed = F.col(ASSET).isNotNull() & F.col(on).isNotNull()  # other rows meet no right row
    tagged = left.filter(timed).select(ASSET, F.col(on).cast("timestamp").alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    known = right.filter(F.col(right_on).isNotNull() & F.col(ASSET).isNotNull()).select(ASSET, F.col(right_on).cast("timestamp").alias("__at"), F.lit(0).alias("__side"), F.struct(*payload).alias("__right"), *tie)
    times = known.select(ASSET, "__at").unionByName(tagged.select(ASSET, "__at"))
    crowded = F.broadcast(_crowded(times, unit, piece))

    def celled(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__cell", F.date_trunc(unit, "__at")).join(crowded, [ASSET, "__cell"], "left")
        finer = F.coalesce(*(F.when(F.col("__unit") == u, F.date_trunc(u, "__at")) for u in FINER), "__cell")
        return rows.withColumn("__cell", finer).drop("__unit")

    known, tagged = celled(known), celled(tagged)
    order = ["__at", "__side", *(f"__t{i}" for i in range(len(ties)))]
    ends = known.groupBy(ASSET, "__cell").agg(F.max_by("__right", F.struct(*(c for c in order if c != "__side"))).alias("__end"))
    cells = ends.unionByName(tagged.select(ASSET, "__cell").distinct(), allowMissingColumns=True)
    cells = cells.groupBy(ASSET, "__cell").agg(F.first("__end", ignorenulls=True).alias("__end"))
    earlier = Window.partitionBy(ASSET).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    heads = cells.select(ASSET, "__cell", F.lit(-1).alias("__side"), F.last("__end", ignorenulls=True).over(earlier).alias("__right"))
    heads = heads.filter("__right is not null")
    both = known.unionByName(heads, allowMissingColumns=True).unionByName(tagged, allowMissingColumns=True)
    # a head has no time and comes first
    w = Window.partitionBy(ASSET, "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__last", F.last("__right", ignorenulls=True).over(w)).filter("__side = 1")
    found = found.select("__left.*", *(F.col(f"__last.{p}").alias(p) for p in payload))
    return found.unionByName(left.filter(~timed), allowMissingColumns=True)
