"""The domain tables as views of the given tables, for the registered queries.

orders give daily bars, events give news and scores, line items give fundamentals.  Event dates
are shifted into the range of the orders.  plans/sql.py states the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Days from the events' dates back into the orders' range.
SHIFT = 9131


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _asset(n: Column) -> Column:
    return F.concat(F.lit("A"), n.cast("int").cast("string"))


def candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        _asset(F.left("o_orderpriority", F.lit(1)).cast("int") - 1).alias("asset_id"),
        F.date_trunc("DAY", F.col("o_orderdate").cast("timestamp")).alias("ts"),
        "o_orderkey",
        F.col("o_totalprice").alias("p"),
    )
    return o.groupBy("asset_id", "ts").agg(
        F.min_by("p", "o_orderkey").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "o_orderkey").alias("close"),
        F.count("*").alias("volume"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        _asset(n % 5).alias("asset_id"),
        F.when(n % 11 != 0, F.concat(F.lit("n"), n.cast("string"))).alias("article_id"),
        (F.col("ts").cast("timestamp") - F.make_dt_interval(F.lit(SHIFT))).alias("published_at"),
        F.when(n % 13 == 0, F.lit(" ")).otherwise(F.concat_ws(" ", "event_type", "props")).alias("headline"),
        F.when(n % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" user "), F.col("user_id").cast("string"))).alias("summary"),
        F.when(n % 17 == 0, F.lit("")).when(n % 19 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("source"),
        F.when(n % 7 == 0, F.lit(None)).when(n % 23 == 0, F.lit("ftp://x")).otherwise(F.concat(F.lit("https://news.example/"), F.floor(n / 2).cast("string"))).alias("url"),
        F.when(n % 29 == 0, F.lit("en_US")).otherwise(F.lit("en")).alias("language"),
        n.alias("ordinal"),
        F.col("value"),
    )


def scored_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, score = F.col("ordinal"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50) / 100))
    return news(spark, sf_dir).select(
        "asset_id",
        F.concat(F.lit("n"), n.cast("string")).alias("article_id"),
        "published_at",
        F.when(n % 31 == 0, F.lit(2.0)).otherwise(score).alias("sentiment_score"),
        F.when(n % 37 != 0, F.abs(score)).alias("confidence"),
        F.when(n % 41 == 0, F.lit("")).otherwise(F.lit("linear")).alias("model_name"),
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), _asset(F.left("o_orderpriority", F.lit(1)).cast("int") - 1).alias("asset_id"))
    cents = lambda x: F.round(x * 100).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.to_date("l_shipdate").alias("d"),
        cents(F.col("l_extendedprice")).alias("revenue"),
        cents(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        cents(F.col("l_quantity")).alias("flow"),
        cents(F.col("l_tax")).alias("tax"),
    ).join(o, "l_orderkey")

    # sums of whole cents are exact, so years are added up from their quarters: the lines are joined and shuffled once
    names = ("revenue", "net", "flow", "tax")
    end = lambda unit, d, months: F.date_sub(F.add_months(F.trunc(d, unit), months), 1)
    quarters = lines.groupBy("asset_id", end("quarter", "d", 3).alias("quarter")).agg(*(F.sum(c).alias(c) for c in names), F.count("*").alias("n"))
    kinds = F.array(*(F.struct(F.lit(k).alias("report_type"), e.alias("fiscal_date_end")) for k, e in (("annual", end("year", "quarter", 12)), ("quarterly", F.col("quarter")))))
    agg = quarters.select("asset_id", F.inline(kinds), *names, "n").groupBy("asset_id", "report_type", "fiscal_date_end").agg(
        *((F.sum(c) / 100.0).alias(name) for c, name in zip(names, ("revenue", "net_income", "operating_cash_flow", "total_shareholder_equity"), strict=True)),
        F.sum("n").cast("double").alias("total_liabilities"),
    )
    reported = F.when(F.month("fiscal_date_end") % 2 == 0, F.date_add("fiscal_date_end", 30))
    equity = F.when(F.year("fiscal_date_end") % 3 != 0, F.col("total_shareholder_equity"))
    return agg.select("asset_id", "report_type", "fiscal_date_end", reported.alias("reported_date"), "revenue", "net_income", "operating_cash_flow", equity.alias("total_shareholder_equity"), "total_liabilities", F.lit("lines").alias("source"))
