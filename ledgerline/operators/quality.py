"""Data-quality profiles and reports: metrics as rows (section, name, value), by group where asked."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .validate import missing, named, quoted

Rule = dict


@dataclass(frozen=True)
class Profile:
    """What a table should be; unknown columns are reported, not errors."""

    date: str
    keys: list[str]
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    comparisons: list[tuple[str, str, str]] = field(default_factory=list)
    business_days: bool = True
    dtypes: dict[str, str] = field(default_factory=dict)


_SCORE = {"sentiment_score": (-1.0, 1.0)}
# The profiles of the seven tables.
PROFILES = {
    "candles": Profile(
        "ts", ["ts"], {c: (0.0, None) for c in ("open", "high", "low", "close", "volume")},
        comparisons=[("high", ">=", "low"), ("high", ">=", "open"), ("high", ">=", "close"), ("low", "<=", "open"), ("low", "<=", "close")],
        dtypes={"ts": "timestamp", "close": "double", "volume": "bigint"},
    ),
    "news_raw": Profile("published_at", ["article_id"], rules=[{"rule": "not_null", "column": "url"}, {"rule": "not_null", "column": "source"}], business_days=False),
    "scored_news": Profile(
        "published_at", ["article_id"], _SCORE,
        [{"rule": "between", "column": "confidence", "min": 0.0, "max": 1.0}, {"rule": "not_null", "column": "model_name"}], business_days=False,
    ),
    "sentiment_daily": Profile("day", ["day"], _SCORE, [{"rule": "nonnegative", "column": "n_articles"}, {"rule": "nonnegative", "column": "sentiment_std"}]),
    "technical_indicators": Profile("ts", ["ts"]),
    "fundamentals": Profile("fiscal_date_end", ["report_type", "fiscal_date_end"], rules=[{"rule": "in", "column": "report_type", "values": ["annual", "quarterly"]}], business_days=False),
    "dataset_tft": Profile(
        "ts", ["ts"], {"close": (0.0, None), "volume": (0.0, None)} | _SCORE,
        [{"rule": "nonnegative", "column": "time_idx"}, {"rule": "nonnegative", "column": "news_volume"}],
    ),
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def out_of_range(c: str, lo: float | None, hi: float | None) -> Column:
    """Below lo or above hi; missing values are neither."""
    bad = F.lit(False)
    value = named(c).cast("double")
    if lo is not None:
        bad = bad | (value < lo)
    if hi is not None:
        bad = bad | (value > hi)
    return ~missing(c) & bad


def violates(rule: Rule) -> Column:
    """True where a row breaks a rule given as a dict: not_null, nonnegative, between or in."""
    c = rule["column"]
    if rule["rule"] == "not_null":
        return missing(c)
    if rule["rule"] == "nonnegative":
        return out_of_range(c, 0.0, None)
    if rule["rule"] == "between":
        return out_of_range(c, rule.get("min"), rule.get("max"))
    if rule["rule"] == "in":
        return ~F.coalesce(named(c).isin(*rule["values"]), F.lit(False))
    raise KeyError(rule["rule"])


def breaks(left: str, op: str, right: str) -> Column:
    """True where a comparison doesn't hold or a side is missing."""
    a, b = named(left), named(right)
    holds = {">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b}[op]
    return missing(left) | missing(right) | ~F.coalesce(holds, F.lit(False))


def _rule_columns(df: DataFrame, p: Profile) -> tuple[dict[str, Column], list[str]]:
    """Boolean columns of all applicable rules by metric name; columns that rules name and df lacks."""
    have, out, absent = set(df.columns), {}, []
    for c, (lo, hi) in p.ranges.items():
        out[f"range:{c}"] = out_of_range(c, lo, hi) if c in have else absent.append(c)
    for r in p.rules:
        out[f"{r['rule']}:{r['column']}"] = violates(r) if r["column"] in have else absent.append(r["column"])
    for a, op, b in p.comparisons:
        out[f"compare:{a}{op}{b}"] = breaks(a, op, b) if {a, b} <= have else absent.extend({a, b} - have)
    return {k: v for k, v in out.items() if v is not None}, sorted(set(absent))


def counts(df: DataFrame, p: Profile, by: list[str]) -> DataFrame:
    """Metrics of one aggregation: sizes, nulls, zeros, non-finite values, rules, key nulls, moments."""
    numeric = [c for c in numeric_columns(df) if c not in by]
    data = [c for c in df.columns if c not in by]
    rules, _ = _rule_columns(df, p)
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    # as SQL texts, since a wide table has hundreds of them
    null = lambda c: f"({quoted(c)} is null or isnan({quoted(c)}))" if c in floating else f"({quoted(c)} is null)"
    any_of = lambda xs: " or ".join([*xs, "false"])
    zero = lambda c: f"coalesce({quoted(c)} = 0, false)"
    infinite = lambda c: f"({null(c)} or abs(cast({quoted(c)} as double)) = double('infinity'))"
    null_key = any_of(null(k) for k in [*by, *p.keys] if k in df.columns)
    marked = df.withColumns({f"__r{i}": v for i, v in enumerate(rules.values())})
    exprs = {("size", "rows"): "count(*)", ("size", "rows_with_nulls"): f"count_if({any_of(map(null, data))})"}
    exprs |= {("nulls", c): f"count_if({null(c)})" for c in data}
    exprs |= {("zeros", c): f"count_if({zero(c)})" for c in numeric}
    exprs |= {("size", "rows_with_zeros"): f"count_if({any_of(map(zero, numeric))})"}
    exprs |= {("nonfinite", c): f"count_if({infinite(c)})" for c in numeric}
    exprs |= {("rules", name): f"count_if(__r{i})" for i, name in enumerate(rules)}
    exprs |= {("keys", "null_key_rows"): f"count_if({null_key})"}
    exprs |= {("rules", "rows_with_violations"): f"count_if({any_of([null_key, *(f'__r{i}' for i in range(len(rules)))])})"}
    kinds = {"count": "count", "mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    exprs |= {(f"summary:{c}", n): f"{f}(case when not {null(c)} then cast({quoted(c)} as double) end)" for c in numeric for n, f in kinds.items()}
    return _long(marked, exprs, by)


def _text(value: str) -> str:
    """A text in SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _long(df: DataFrame, exprs: dict[tuple[str, str], str], by: list[str]) -> DataFrame:
    """One aggregation of SQL texts, its values as rows."""
    keys = [named(c) for c in by]
    agg = df.groupBy(*keys).agg(*(F.expr(f"cast({e} as double) as m{i}") for i, e in enumerate(exprs.values())))
    rows = ", ".join(f"{_text(s)}, {_text(n)}, m{i}" for i, (s, n) in enumerate(exprs))
    return agg.select(*keys, F.expr(f"stack({len(exprs)}, {rows}) as (section, name, value)"))


#: A column of a group with more values has its quartiles found in brackets; rank error of the sketch that proposes them.
SMALL, ACCURACY = 10_000, 10_000
#: Groups up to which their brackets are broadcast; beyond, the join is Spark's to plan.
MAX_BROADCAST_GROUPS = 100_000


def quartiles(df: DataFrame, by: list[str], small: int = SMALL, accuracy: int = ACCURACY) -> DataFrame:
    """Exact quartiles of numeric columns, between neighbours where a rank falls between them.

    Distributed selection: a mergeable sketch brackets each quartile of each column, values below a bracket are
    counted and only those within it are ranked, so that no task orders a column.  Up to `small` values a bracket holds all.
    A bracket that the exact counts contradict is an error.
    """
    numeric = [c for c in numeric_columns(df) if c not in by]
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    value = lambda c: f"cast(nanvl({quoted(c)}, null) as double)" if c in floating else f"cast({quoted(c)} as double)"
    entries = F.expr(f"stack({len(numeric)}, " + ", ".join(f"{_text(c)}, {value(c)}" for c in numeric) + ") as (__c, __x)")
    keys = [*(named(c) for c in by), F.col("__c")]
    cells = df.select(*keys[:-1], entries).filter("__x is not null")
    off = 5 / accuracy
    ends = F.percentile_approx("__x", [q / 100 + side * off for q in (25, 50, 75) for side in (-1, 1)], accuracy)
    stats = cells.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"), ends.alias("__p"))
    wide = F.array(F.struct("lo", "hi"))
    narrow = F.array(*(F.struct(F.col("__p")[2 * i].alias("lo"), F.col("__p")[2 * i + 1].alias("hi")) for i in range(3)))
    stats = stats.select(*keys, "__n", F.when(F.col("__n") <= small, wide).otherwise(narrow).alias("__brackets"))
    few = df.select(*keys[:-1]).distinct().count() <= MAX_BROADCAST_GROUPS
    names = [*by, "__c"]
    stats = stats.toDF(*(f"__k{i}" for i in range(len(names))), "__n", "__brackets")
    same = [named(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(names)]
    rows = cells.join(F.broadcast(stats) if few else stats, same)
    rows = rows.select(*keys, "__n", F.posexplode("__brackets").alias("__b", "__r"), "__x").filter("__x <= __r.hi")
    within = F.when(F.col("__x") >= F.col("__r.lo"), F.col("__x"))  # null for what is below
    values = rows.groupBy(*keys, "__n", "__b", within.alias("__v")).count()
    bracket = Window.partitionBy(*keys, "__b").orderBy(F.col("__v").asc_nulls_first())
    values = values.withColumn("__upto", F.sum("count").over(bracket))
    rank = {q: (F.col("__n") - 1) * (q / 100) for q in (25, 50, 75)}
    at = lambda i: F.min(F.when(F.col("__upto") > i, F.col("__v")))
    # the highest count below that a rank's bracket may have; a rank at or under it would be outside
    below = F.coalesce(F.max(F.when(F.col("__v").isNull(), F.col("__upto"))), F.lit(0)).alias("below")
    ends = [x for q, r in rank.items() for x in (at(F.floor(r)).alias(f"lo{q}"), at(F.ceil(r)).alias(f"hi{q}"))]
    found = values.groupBy(*keys, "__n", "__b").agg(below, *ends)

    def between(q: int) -> Column:
        fine = (F.col("below") <= F.floor(rank[q])) & F.col(f"hi{q}").isNotNull()
        part = rank[q] - F.floor(rank[q])
        exact = F.col(f"lo{q}") + (F.col(f"hi{q}") - F.col(f"lo{q}")) * part
        return F.when(fine, exact).otherwise(F.raise_error(F.lit(f"the bracket of the {q} % quantile does not hold it")).cast("double"))

    serves = lambda i: (F.col("__n") <= small) | (F.col("__b") == i)
    structs = [F.when(serves(i), F.struct(F.lit(f"{q}%").alias("name"), between(q).alias("value"))) for i, q in enumerate(rank)]
    section = F.concat(F.lit("summary:"), "__c").alias("section")
    return found.select(*keys[:-1], section, F.explode(F.array_compact(F.array(*structs))).alias("r")).select(*keys[:-1], "section", "r.*")


def duplicates(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows after the first of each key (of equal rows, without keys); nulls are equal."""
    keys = [k for k in keys if k in df.columns and k not in by] or [c for c in df.columns if c not in by]
    sizes = df.groupBy(*map(named, [*by, *keys])).agg(F.count("*").alias("__count"))
    return _long(sizes, {("keys", "duplicate_rows"): "sum(__count - 1)"}, by)


def calendar(df: DataFrame, date: str, by: list[str], business_days: bool) -> DataFrame:
    """Per day, weekday and year counts, first and last day, unread dates, missing days, gaps.

    One table of days: what concerns a whole group stands at its first day.
    """
    keys = [named(c) for c in by]
    days = df.groupBy(*keys, F.to_date(named(date)).alias("d")).count()
    order, whole = Window.partitionBy(*keys).orderBy(F.col("d").asc_nulls_last()), Window.partitionBy(*keys)
    days = days.withColumns({"gap": F.datediff("d", F.lag("d").over(order)), "k": F.row_number().over(order)})
    over = F.when(F.col("gap") > 1, F.col("gap"))
    group = {"gaps": F.count(over), "largest_gap": F.max(over), "first_day": F.min("d"), "last_day": F.max("d"), "seen": F.count_if((F.weekday("d") < 5) | F.lit(not business_days) & F.col("d").isNotNull())}
    days = days.withColumns({f"g_{n}": x.over(whole) for n, x in group.items()})
    epoch = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    lo, hi = F.col("g_first_day"), F.col("g_last_day")
    expected = _business(F.date_add(hi, 1)) - _business(lo) if business_days else F.datediff(hi, lo) + 1
    once = {"gaps": F.col("g_gaps"), "largest_gap": F.col("g_largest_gap"), "first_day": epoch(lo), "last_day": epoch(hi), "missing_days": expected - F.col("g_seen")}
    entry = lambda section, name, value: F.struct(F.lit(section).alias("section"), F.lit(name).cast("string").alias("name"), value.cast("double").alias("value"))
    unread = entry("dates", "unparseable", F.when(F.col("d").isNull(), F.col("count")).otherwise(0))
    known = [entry("per_day", F.col("d"), F.col("count")), entry("per_weekday", F.weekday("d"), F.col("count")), entry("per_year", F.year("d"), F.col("count"))]
    first = F.array(*(entry("dates", n, x) for n, x in once.items()))
    entries = F.when(F.col("d").isNull(), F.array(unread)).when(F.col("k") == 1, F.concat(F.array(unread, *known), first)).otherwise(F.array(unread, *known))
    rows = days.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    return rows.groupBy(*keys, "section", "name").agg(F.sum("value").alias("value"))


def _business(day: Column) -> Column:
    """Business days from Monday 1969-12-29 up to the day before `day`."""
    n = F.datediff(day, F.lit("1969-12-29").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def missing_days(df: DataFrame, date: str, by: list[str], business_days: bool) -> DataFrame:
    """The absent days themselves, one row a day: the calendar between the bounds without the observed days."""
    days = df.select(*by, F.to_date(date).alias("d")).filter("d is not null").distinct()
    bounds = days.groupBy(*by).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    expected = bounds.select(*by, F.explode(F.sequence("lo", "hi")).alias("d"))
    if business_days:
        expected = expected.filter(F.weekday("d") < 5)
    return expected.join(days, [*by, "d"], "left_anti")


def gap_sizes(df: DataFrame, date: str, by: list[str]) -> DataFrame:
    """(by..., d, gap): observed days over one day after the one before, weekends counted."""
    days = df.select(*by, F.to_date(date).alias("d")).filter("d is not null").distinct()
    gap = F.datediff("d", F.lag("d").over(Window.partitionBy(*by).orderBy("d")))
    return days.withColumn("gap", gap.cast("long")).filter("gap > 1")


def dtype_mismatches(df: DataFrame, expected: dict[str, str]) -> dict[str, tuple[str, str]]:
    """Expected and actual types where they differ."""
    actual = dict(df.dtypes)
    return {c: (e, actual[c]) for c, e in expected.items() if c in actual and actual[c] != e}


def report(df: DataFrame, profile: Profile | str, by: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """(by..., section, name, value): all metrics of a profile.

    Sections: schema (number of columns, place of each), dtype (1 for a mismatch with the profile, else 0), and those
    of counts, quartiles, duplicates and calendar, each one scan of df; save df first if it is costly.
    """
    p = PROFILES[profile] if isinstance(profile, str) else profile
    by = [c for c in by if c in df.columns]
    parts = [counts(df, p, by), duplicates(df, p.keys, by)]
    if set(numeric_columns(df)) - set(by):
        parts.append(quartiles(df, by))
    if p.date in df.columns:
        parts.append(calendar(df, p.date, by, p.business_days))
    return reduce(DataFrame.unionByName, [*parts, schema_rows(df, p, by)])


def schema_rows(df: DataFrame, profile: Profile | str, by: tuple[str, ...] | list[str] = ("asset_id",)) -> DataFrame:
    """What a report says of the table's columns, without its rows; the group's columns are null."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    _, absent = _rule_columns(df, p)
    absent += [k for k in p.keys if k not in df.columns]
    head = [("schema", "columns", float(len(df.columns)))] + [("column", c, float(i)) for i, c in enumerate(df.columns)]
    head += [("missing_columns", c, 1.0) for c in sorted(set(absent))]
    wrong = dtype_mismatches(df, p.dtypes)
    head += [("dtype", f"{c} {p.dtypes[c]}", float(c in wrong)) for c in p.dtypes if c in df.columns]
    head = df.sparkSession.createDataFrame(head, "section string, name string, value double")
    return head.select(*(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in by), "*")


def report_json(rows: DataFrame, by: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """One JSON text a group: section to name to value, from a report without its per-day counts."""
    entries = F.sort_array(F.collect_list(F.struct("name", "value"))).alias("entries")
    sections = rows.filter("section <> 'per_day'").groupBy(*by, "section").agg(entries)
    ordered = F.sort_array(F.collect_list(F.struct("section", "entries")))
    nested = F.transform(ordered, lambda x: F.struct(x["section"], F.map_from_entries(x["entries"])))
    return sections.groupBy(*by).agg(F.to_json(F.map_from_entries(nested)).alias("report"))


def audit(tables: dict[str, DataFrame | None], by: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """Reports of all given tables by their profiles; a table that is None is reported as missing."""
    parts = []
    for name, df in tables.items():
        if df is not None:
            parts.append(report(df, name, by).withColumn("table", F.lit(name)))
    absent = [(n, "table", "missing", 1.0) for n, df in tables.items() if df is None]
    if absent:
        kind = parts[0].schema if parts else {c: T.StructField(c, T.StringType()) for c in by}
        rows = SparkSession.active().createDataFrame(absent, "table string, section string, name string, value double")
        parts.append(rows.select(*(F.lit(None).cast(kind[c].dataType).alias(c) for c in by), "section", "name", "value", "table"))
    if not parts:
        raise ValueError("no tables")
    return reduce(DataFrame.unionByName, parts)
