"""File sources and sinks: CSV sets, JSON payloads, landing bars, reports, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts, times
from ..operators import keys, validate


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """CSV files with headers.  Where no field holds a line end, multi_line=False lets large files be split over tasks."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_set(spark: SparkSession, paths: list[str], required: list[str], multi_line: bool = True) -> DataFrame:
    """Union of the files that have the required columns; others are skipped."""
    frames = [csv(spark, p, multi_line=multi_line) for p in paths]
    fine = [f for f in frames if set(required) <= set(f.columns)]
    if not fine:
        raise ValueError("no file has the required columns")
    return keys.union_all(*fine)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """Files with a header each."""
    df.write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, prefix: str, run: Column) -> None:
    """Append a report under its prefix, its rows marked with the run's time: a version of its own each run."""
    marked = df.withColumn("prefix", F.lit(prefix)).withColumn("run_ts", run)
    marked.write.mode("append").partitionBy("prefix", "run_ts").json(path)


def report_exists(spark: SparkSession, path: str, prefix: str) -> bool:
    """Whether some run has written a report under this prefix."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/prefix={prefix}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def reports(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All reports written to a path, with prefix and run_ts."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("prefix", T.StringType()), T.StructField("run_ts", T.StringType())])).json(path)


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified, sha256) of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def _items(payloads: DataFrame, column: str, at: str, by: tuple[str, ...]) -> DataFrame:
    """(by, ordinal, item, reason, raw): one row an element of each payload's array, and one a payload that has no array.

    Payloads are parsed as VARIANT, so an odd item leaves its neighbours alone.  An empty array has no rows.
    """
    whole = F.try_parse_json(F.col(column))
    array = F.try_variant_get(whole, at, "array<variant>")
    broken = F.when(F.col(column).isNull(), "no payload").when(whole.isNull(), "unreadable").when(array.isNull(), "no list")
    lost = F.when(broken.isNotNull(), F.col(column))
    marked = payloads.select(*by, lost.alias("lost"), broken.alias("broken"), array.alias("items"))
    rows = marked.select(*by, "lost", "broken", F.posexplode_outer("items").alias("ordinal", "item")).filter("ordinal is not null or broken is not null")
    plain = F.coalesce(F.schema_of_variant("item").startswith("OBJECT"), F.lit(False))
    reason = F.coalesce("broken", F.when(~plain, "no object"))
    return rows.select(*by, "ordinal", "item", reason.alias("reason"), F.when(F.col("broken").isNull(), F.coalesce(F.to_json("item"), F.lit("null"))).otherwise(F.col("lost")).alias("raw"))


def _texts_of(names: str) -> list[Column]:
    return [F.try_variant_get("item", f"$.{n}", "string").alias(n) for n in names.split()]


def feed_outcomes(payloads: DataFrame, column: str = "payload", default_source: str = "alpha_vantage", by: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """Every item of JSON payloads {"feed": [...]}: news columns and ordinal beside the payload's `by` columns, reason and raw.

    reason is null for news rows.  Else the row is for the quarantine, and raw holds its JSON: "no payload" (null),
    "unreadable" (no JSON, also with a key given twice in an object), "no list" (no feed that is an array) for whole payloads, "no object" and
    "no time" (missing or unreadable) for items.  News rows and reasons add up to all items and all payloads without items.
    """
    items = _items(payloads, column, "$.feed", by)
    i = items.select("*", *_texts_of("time_published title summary source url"))
    headline, summary = texts.news_texts(F.col("title"), F.col("summary"))
    when = times.parse_compact(F.col("time_published"))
    return i.select(
        *by,
        texts.fallback_id(F.col("url"), F.col("time_published"), headline).alias("article_id"),
        when.alias("published_at"),
        headline.alias("headline"),
        summary.alias("summary"),
        texts.source_or(F.col("source"), default_source).alias("source"),
        texts.filled(F.col("url")).alias("url"),
        F.lit("en").alias("language"),
        "ordinal",
        F.coalesce("reason", F.when(when.isNull(), "no time")).alias("reason"),
        "raw",
    )


def item_outcomes(payloads: DataFrame, column: str = "payload", limit: int | None = None, default_source: str = "finnhub", by: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    """The same of JSON arrays of items with epoch-second times; of each array the first `limit` items."""
    items = _items(payloads, column, "$", by)
    if limit is not None:
        items = items.filter(F.col("ordinal").isNull() | (F.col("ordinal") < limit))
    i = items.select("*", *_texts_of("id headline summary source url"), F.try_variant_get("item", "$.datetime", "long").alias("datetime"))
    headline, summary = texts.news_texts(F.col("headline"), F.col("summary"))
    return i.select(
        *by,
        F.coalesce(texts.filled(F.col("id")), texts.filled(F.col("url")), F.col("datetime").cast("string")).alias("article_id"),
        times.parse_epoch(F.col("datetime")).alias("published_at"),
        headline.alias("headline"),
        summary.alias("summary"),
        texts.source_or(F.col("source"), default_source).alias("source"),
        texts.filled(F.col("url")).alias("url"),
        F.lit("en").alias("language"),
        "ordinal",
        F.coalesce("reason", F.when(F.col("datetime").isNull(), "no time")).alias("reason"),
        "raw",
    )


def split_outcomes(outcomes: DataFrame, by: tuple[str, ...] = ("asset_id",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """News rows; the quarantine (by, ordinal, reason, raw); and counters (by, reason, n), with the reason "fine" for news."""
    good = outcomes.filter("reason is null").drop("reason", "raw")
    bad = outcomes.filter("reason is not null").select(*by, "ordinal", "reason", "raw")
    counts = outcomes.groupBy(*by, F.coalesce("reason", F.lit("fine")).alias("reason")).agg(F.count("*").alias("n"))
    return good, bad, counts


def news_feed(payloads: DataFrame, column: str = "payload", default_source: str = "alpha_vantage") -> DataFrame:
    """News rows of JSON payloads {"feed": [...]}; what feed_outcomes() has a reason against is skipped."""
    return split_outcomes(feed_outcomes(payloads, column, default_source))[0]


def news_items(payloads: DataFrame, column: str = "payload", limit: int | None = None, default_source: str = "finnhub") -> DataFrame:
    """News rows of JSON arrays with epoch-second times; what item_outcomes() has a reason against is skipped."""
    return split_outcomes(item_outcomes(payloads, column, limit, default_source))[0]


# Fields of the statement payloads by measure.
STATEMENTS = {
    "income": {"revenue": "totalRevenue", "net_income": "netIncome"},
    "cash_flow": {"operating_cash_flow": "operatingCashflow"},
    "balance": {"total_shareholder_equity": "totalShareholderEquity", "total_liabilities": "totalLiabilities"},
}


def _statement(payloads: DataFrame, kind: str, array: str, report_type: str, fields: dict[str, str]) -> DataFrame:
    item = ", ".join(f"{f} string" for f in ["fiscalDateEnding", *fields.values()])
    items = F.from_json(F.col("payload"), f"{array} array<struct<{item}>>").getField(array)
    rows = payloads.filter(F.col("kind") == kind).select("asset_id", F.posexplode(items).alias("ordinal", "i"))
    values = [
        (times.parse_day(F.col(f"i.{f}")) if name == "reported_date" else texts.number(F.col(f"i.{f}"))).alias(name)
        for name, f in fields.items()
    ]
    out = rows.select("asset_id", F.lit(report_type).alias("report_type"), times.parse_day(F.col("i.fiscalDateEnding")).alias("fiscal_date_end"), *values, "ordinal")
    return out.filter("fiscal_date_end is not null")


def fundamentals(payloads: DataFrame) -> DataFrame:
    """Reports of payloads(asset_id, kind, payload): income, cash_flow, balance and earnings merged by type and date."""
    key = ["asset_id", "report_type", "fiscal_date_end"]
    sides = []
    for report_type, reports, earnings in (("annual", "annualReports", "annualEarnings"), ("quarterly", "quarterlyReports", "quarterlyEarnings")):
        parts = [_statement(payloads, kind, reports, report_type, fields) for kind, fields in STATEMENTS.items()]
        known = _statement(payloads, "earnings", earnings, report_type, {"reported_date": "reportedDate"})
        # a later earnings row without a date doesn't undo an earlier one's
        rank = F.struct(F.col("reported_date").isNotNull().alias("has"), "ordinal")
        parts.append(known.withColumn("ordinal", rank))
        sides.append(keys.merge_statements(parts, key))
    return keys.union_all(*sides).withColumn("source", F.lit("alpha_vantage"))


def landing_bars(df: DataFrame) -> DataFrame:
    """Daily bars of a raw landing table: names flattened, columns required, times snapped to midnight, cast."""
    flat = df.select(*(F.col(f"`{c}`").alias(c.split("_")[0].split(",")[0].strip("(' ").lower()) for c in df.columns if c != "asset_id"), "asset_id")
    time = "date" if "date" in flat.columns else "ts"
    validate.require_columns(flat, [time, "open", "high", "low", "close", "volume"])
    prices = [F.col(c).cast("float").alias(c) for c in ("open", "high", "low", "close")]
    return flat.select("asset_id", times.midnight(F.col(time).cast("timestamp")).alias("ts"), *prices, F.col("volume").cast("long").alias("volume"))


def page_record(pages: DataFrame, html: str, rules: dict[str, tuple[str, int, str, str]]) -> DataFrame:
    """pages with one column a rule (keyword, part, start, end): text between marks."""
    return pages.withColumns({name: texts.between(F.col(html), *r) for name, r in rules.items()})
