"""Tables partitioned by asset: scans with pushed-down ranges, and sinks that replace only what they touch."""

from __future__ import annotations

import uuid
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import texts, times
from ..operators import keys, series, validate


#: Tasks, and files at most, that one asset's rows are written by.
FILES_AN_ASSET = 8


def scan(spark: SparkSession, path: str, schema: T.StructType, assets: list[str] | None = None) -> DataFrame:
    """Declared columns of a table; missing ones are an error.  Assets prune partitions."""
    df = spark.read.parquet(path)
    df = validate.conform(df, schema)
    return df.filter(F.col("asset_id").isin(assets)) if assets else df


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def reports_of(spark: SparkSession, path: str) -> DataFrame:
    """Reports kept by asset; an asset_id is text, whatever it looks like."""
    kind = T.StructType([T.StructField(c, T.StringType()) for c in ("section", "name")] + [T.StructField("value", T.DoubleType()), T.StructField("asset_id", T.StringType())])
    return spark.read.schema(kind).parquet(path)


def between(df: DataFrame, column: str, start, end) -> DataFrame:
    """Rows from start to end, both included; a None bound is open.

    A start after the end is an error, and so are times that are no instants; bounds without zone are UTC.
    """
    if start is not None and end is not None:
        utc = lambda b: b.replace(tzinfo=UTC) if isinstance(b, datetime) and b.tzinfo is None else b
        if utc(start) > utc(end):
            raise ValueError(f"start {start} is after end {end}")
    if not isinstance(df.schema[column].dataType, T.DateType):
        times.require_instants(df, column)
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    return df if end is None else df.filter(F.col(column) <= F.lit(end))


def candles(spark: SparkSession, path: str, assets=None, start: datetime | None = None, end: datetime | None = None, ordered: bool = False) -> DataFrame:
    """Prices, stored narrow and widened on load; `ordered` gives each asset's bars by time, of which a repeated one is an error."""
    df = between(scan(spark, path, schemas.CANDLES, assets), "ts", start, end)
    df = series.rising_times(df).sortWithinPartitions("asset_id", "ts") if ordered else df
    return df.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close")})


def news(spark: SparkSession, path: str, assets=None, start=None, end=None) -> DataFrame:
    df = between(scan(spark, path, schemas.NEWS, assets), "published_at", start, end)
    return news_defaults(df)


def news_defaults(df: DataFrame) -> DataFrame:
    """Empty texts for null ones, "en" for a null language."""
    return df.fillna("", ["headline", "summary", "source"]).fillna("en", ["language"])


def scored_news(spark: SparkSession, path: str, assets=None, start=None, end=None) -> DataFrame:
    df = between(scan(spark, path, schemas.SCORED_NEWS, assets), "published_at", start, end)
    return df.withColumn("model_name", F.nullif("model_name", F.lit("")))


def daily_sentiment(spark: SparkSession, path: str, assets=None, start: datetime | date | None = None, end=None) -> DataFrame:
    """Bounds count by their day."""
    day = lambda b: b.date() if isinstance(b, datetime) else b
    return between(scan(spark, path, schemas.DAILY_SENTIMENT, assets), "day", day(start), day(end))


def fundamentals(spark: SparkSession, path: str, assets=None, start=None, end=None, report_type: str | None = None) -> DataFrame:
    day = lambda b: b.date() if isinstance(b, datetime) else b
    df = between(scan(spark, path, schemas.FUNDAMENTALS, assets), "fiscal_date_end", day(start), day(end))
    return df.filter(F.col("report_type") == report_type) if report_type else df


def indicator_maps(spark: SparkSession, path: str, assets=None) -> DataFrame:
    """(asset_id, ts, indicators): every further column that isn't null."""
    df = validate.require_columns(spark.read.parquet(path), ["asset_id", "ts"])
    df = df.filter(F.col("asset_id").isin(assets)) if assets else df
    return keys.wide_to_map(df, [c for c in df.columns if c not in ("asset_id", "ts")], "indicators")


def write_training(df: DataFrame, path: str) -> None:
    """Replace the training rows of the assets in df: base columns required and cast, further ones kept."""
    write(df, path, schemas.TRAINING_BASE, ("ts",), extras=True)


def training(spark: SparkSession, path: str, assets=None) -> DataFrame:
    df = validate.require_columns(spark.read.parquet(path), schemas.TRAINING_BASE.fieldNames())
    return df.filter(F.col("asset_id").isin(assets)) if assets else df


def write(df: DataFrame, path: str, schema: T.StructType | None = None, order: tuple[str, ...] = (), mode: str = "overwrite", extras: bool = False) -> None:
    """Replace the partitions of the assets in df (mode overwrite), or fail if the table exists (error).

    Empty input is an error; it is looked for first, so save a costly df before.  An asset's rows are dealt to FILES_AN_ASSET
    tasks, by years where the order is in time, so that no task holds all of an asset with very many rows, and sorted within files.
    """
    df = validate.conform(df, schema, extras) if schema else df
    if df.isEmpty():
        raise ValueError("nothing to write")
    in_time = bool(order) and dict(df.dtypes)[order[0]] in ("timestamp", "date")
    deal = F.pmod(F.year(order[0]) if in_time else F.xxhash64(*df.columns), F.lit(FILES_AN_ASSET))
    out = df.repartition("asset_id", deal).sortWithinPartitions("asset_id", *order).write.partitionBy("asset_id").mode(mode)
    if mode == "overwrite":
        out = out.option("partitionOverwriteMode", "dynamic")
    out.parquet(path)


def staged(df: DataFrame, staging: str) -> DataFrame:
    """df written once to the staging folder and read again, for what reads it several times or replaces what it reads."""
    at = f"{staging}/{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def merge(spark: SparkSession, path: str, batch: DataFrame, schema: T.StructType, key: list[str], staging: str) -> DataFrame:
    """Upsert a batch (with `ordinal`) into a table: only the batch's assets are read and replaced.

    The batch is written to the staging folder first, since it is read several times, and the result, since it reads what
    it replaces.  An empty batch is an error.
    """
    batch = staged(batch, staging)
    if batch.isEmpty():
        raise ValueError("nothing to merge")
    stored = spark.createDataFrame([], schema)
    if exists(spark, path):  # the batch's assets prune the table's partitions as the plan runs
        stored = scan(spark, path, schema).join(batch.select("asset_id").distinct(), "asset_id", "left_semi")
    merged = staged(validate.conform(keys.upsert(stored, batch, key), schema), staging)
    write(merged, path, schema)
    return merged


def with_article_id(batch: DataFrame) -> DataFrame:
    """News with article_id filled from the url; blank in both is an error."""
    filled = batch.withColumn("article_id", texts.article_id(F.col("article_id"), F.col("url")))
    return validate.require_ids(filled)


def update_scores(news_table: DataFrame, batch: DataFrame) -> DataFrame:
    """Upsert on url in which a known article changes its sentiment and confidence only."""
    return keys.upsert_columns(news_table, batch, "url", ["sentiment", "confidence"])


def latest(df: DataFrame, column: str, by: tuple[str, ...] = ("asset_id",)) -> DataFrame:
    return df.groupBy(*by).agg(F.max(column).alias("latest"))


def coverage(df: DataFrame, column: str, start: date, end: date, check_start: bool = True) -> DataFrame:
    """(asset_id, first_day, last_day, covered) of stored days against a requested range."""
    agg = df.groupBy("asset_id").agg(F.min(F.to_date(column)).alias("first_day"), F.max(F.to_date(column)).alias("last_day"))
    fine = F.col("last_day") >= F.lit(end)
    return agg.withColumn("covered", fine & (F.col("first_day") <= F.lit(start)) if check_start else fine)
