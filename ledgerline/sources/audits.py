"""Quality reports that are kept and renewed only for the assets whose files have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from . import tables

REPORT = ["asset_id", "section", "name", "value"]


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(asset_id, print) of a table partitioned by asset, from the names, sizes and times of its files; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    asset = F.url_decode(F.replace(F.regexp_extract("path", r"asset_id=([^/]+)/", 1), F.lit("+"), F.lit("%2B")))
    one = F.xxhash64("path", "length", "modificationTime")
    found = files.select(asset.alias("asset_id"), one.alias("h")).groupBy("asset_id")
    return found.agg(F.concat_ws(":", F.count("*"), F.bit_xor("h"), F.sum(F.col("h") % (1 << 40))).alias("print"))


def audit_changed(spark: SparkSession, path: str, profile: str, state: str) -> tuple[DataFrame, DataFrame]:
    """The report of a stored table by asset, and the assets (asset_id) that were read for it.

    `state` keeps each asset's report with the fingerprint that it was made for.  Only assets that are new or have
    other files are read and reported again; assets that are gone leave the report.  With no asset in the table an error.
    """
    now = fingerprints(spark, path)
    kept = f"{state}/reports"
    if tables.exists(spark, kept):
        before = tables.reports_of(spark, kept).filter("section = 'fingerprint'").select("asset_id", F.col("name").alias("print"))
        changed = now.join(before, ["asset_id", "print"], "left_anti")
    else:
        changed = now
    changed = spark.createDataFrame(changed.collect(), now.schema)  # a row an asset that has changed
    table = spark.read.parquet(path)
    table = table.select("asset_id", *(c for c in table.columns if c != "asset_id"))
    if not changed.isEmpty():
        fresh = quality.report(table.join(F.broadcast(changed.select("asset_id")), "asset_id", "left_semi"), profile)
        marks = changed.select("asset_id", F.lit("fingerprint").alias("section"), F.col("print").alias("name"), F.lit(1.0).alias("value"))
        tables.write(fresh.filter("asset_id is not null").unionByName(marks), kept, None, ("section", "name"))
    held = tables.reports_of(spark, kept).filter("section <> 'fingerprint'").join(now.select("asset_id"), "asset_id", "left_semi")
    whole = quality.schema_rows(table, profile, ("asset_id",))
    return held.select(*REPORT).unionByName(whole.select(*REPORT)), changed.select("asset_id")
