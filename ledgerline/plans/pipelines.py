"""Composite pipelines: indicator, sentiment and training tables for all assets in one plan."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import times
from ..operators import keys, sentiment, series
from ..sources import tables


def training_table(
    candles: DataFrame, indicators: DataFrame, daily: DataFrame, fundamentals: DataFrame, start: date, end: date, lookback_days: int = 0
) -> DataFrame:
    """Features and next-day target of every asset.

    Bars are cut to the range first, so an asset's last bar in it has no target and goes.  Days without
    news keep nulls.  Reports with fiscal dates within the range (less lookback_days) join from the
    day they are known; of equal days the later fiscal date, then the quarterly report counts.  Several bars of an
    asset at one time are an error when the table is computed.
    """
    ts = F.col("ts")
    bars = candles.filter((ts >= F.lit(start)) & times.before_day_end(ts, F.lit(end)))
    bars = bars.select("asset_id", "ts", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")))
    out = bars.join(indicators, ["asset_id", "ts"], "left").withColumn("date", times.day_of(ts))
    news = daily.filter(F.col("day").between(F.lit(start), F.lit(end))).select(
        "asset_id", F.col("day").alias("date"), "sentiment_score", F.col("n_articles").alias("news_volume"), "sentiment_std"
    )
    out = out.join(news, ["asset_id", "date"], "left")
    reports = fundamentals.filter(F.col("fiscal_date_end").between(F.date_sub(F.lit(start), lookback_days), F.lit(end)))
    reports = reports.withColumn("known_from", times.effective_day(F.col("reported_date"), F.col("fiscal_date_end")))
    out = series.asof_backward(out, reports, "date", "known_from", list(schemas.MEASURES), ["fiscal_date_end", "report_type"]).drop("date")
    out = out.withColumn("day_of_week", times.day_of_week(ts)).withColumn("month", times.month(ts))
    return series.time_index(series.next_log_return(series.rising_times(out)).na.drop(subset=["target_return"]))


def checked_training_table(candles: DataFrame, *args, **options) -> DataFrame:
    """training_table() after a check that needs an action: some asset has two bars in the range."""
    out = training_table(candles, *args, **options)
    if out.isEmpty():
        raise ValueError("no asset has two bars in the range, so there is no target")
    return out


def indicator_table(candles: DataFrame, normalise: bool = True, fit_until=None) -> DataFrame:
    """Indicators of candles, z-scored by asset over the whole series or up to fit_until."""
    table = series.indicators(candles)
    if not normalise:
        return table
    return series.standardised(table, list(schemas.INDICATORS), fit_until)


def incremental_news(stored: DataFrame, landing: DataFrame, window_days: int = 1) -> DataFrame:
    """Landing rows to upsert: not before the asset's stored high-water mark, first of each url, not stored near it.

    The stored side is cut to the days around the mark before the anti join.
    """
    return _unstored(stored, _since_mark(stored, landing), window_days)


def _marks(stored: DataFrame) -> DataFrame:
    return stored.groupBy("asset_id").agg(F.max("published_at").alias("mark"))


def _since_mark(stored: DataFrame, landing: DataFrame) -> DataFrame:
    marked = landing.join(_marks(stored), "asset_id", "left")
    return marked.filter(F.col("mark").isNull() | (F.col("published_at") >= F.col("mark"))).drop("mark")


def _unstored(stored: DataFrame, rows: DataFrame, window_days: int) -> DataFrame:
    near = stored.join(_marks(stored), "asset_id").filter(F.col("published_at") >= F.col("mark") - F.make_dt_interval(F.lit(window_days)))
    return keys.keep_first_by_url(rows).join(near.select("asset_id", "url"), ["asset_id", "url"], "left_anti")


def sentiment_features(scored: DataFrame, stored_daily: DataFrame) -> DataFrame:
    """Daily sentiment of scored news, upserted into the stored days."""
    fresh = sentiment.daily_sentiment(scored).withColumn("ordinal", F.lit(0))
    return keys.upsert(stored_daily, fresh, ["asset_id", "day"])


#: What tells a landing row that an earlier run has passed over.
_PASSED = T.StructType([schemas.NEWS[c] for c in ("asset_id", "url", "published_at")])


def ingest_news(spark: SparkSession, path: str, landing: DataFrame, staging: str, window_days: int = 1) -> DataFrame:
    """New landing rows merged into the stored news; returns them.  Nothing new changes nothing.

    A row that is passed over, since its url came first in another row or was stored near the mark, would seem new once the
    marks have moved.  Such rows are kept beside the table, as far as they are not before the new marks, and stay passed over.
    """
    stored, passed = tables.scan(spark, path, schemas.NEWS), f"{path.rstrip('/')}.passed"
    rows = _since_mark(stored, landing)
    if tables.exists(spark, passed):
        rows = _without(rows, spark.read.schema(_PASSED).parquet(passed))
    fresh = tables.staged(tables.with_article_id(_unstored(stored, rows, window_days)), staging)
    if not fresh.isEmpty():
        marks = _marks(stored.select("asset_id", "published_at").unionByName(fresh.select("asset_id", "published_at")))
        again = _since_mark(marks.withColumnRenamed("mark", "published_at"), rows.filter("url is not null").select(*_PASSED.names))
        _without(again, fresh).write.mode("append").parquet(passed)  # before the merge: a run that fails between is repeated alike
        tables.merge(spark, path, fresh, schemas.NEWS, schemas.KEYS["news"], staging)
    return fresh


def _without(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows that no other row equals in asset, url and time."""
    others = others.select(*(F.col(c).alias(f"__{c}") for c in _PASSED.names))
    return rows.join(others, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _PASSED.names)), "left_anti")


def score_stored_news(spark: SparkSession, news: DataFrame, path: str, factory, staging: str, model_name: str) -> None:
    """News without a score in the stored table, scored and merged into it."""
    fresh = sentiment.score_news(news, tables.scan(spark, path, schemas.SCORED_NEWS), factory, model_name)
    tables.merge(spark, path, fresh.withColumn("ordinal", F.lit(0)), schemas.SCORED_NEWS, schemas.KEYS["scored_news"], staging)


def add_scored_news(spark: SparkSession, path: str, scored: DataFrame, staging: str) -> None:
    """Articles added to the stored moments of their days, however late; each article is to be added once.

    A day's state is a count, a mean and a sum of squares, so its other articles are not read.
    """
    fresh = sentiment.daily_moments(scored)
    stored = tables.scan(spark, path, schemas.DAILY_MOMENTS) if tables.exists(spark, path) else spark.createDataFrame([], schemas.DAILY_MOMENTS)
    known = stored.join(fresh.select("asset_id", "day"), ["asset_id", "day"], "left_semi")
    merged = sentiment.merged_moments(fresh.unionByName(known)).withColumn("ordinal", F.lit(0))
    tables.merge(spark, path, merged, schemas.DAILY_MOMENTS, schemas.KEYS["daily_sentiment"], staging)


def select_reports(reports: DataFrame, types: list[str], start: date, end: date) -> DataFrame:
    return reports.filter(F.col("report_type").isin(*types) & F.col("fiscal_date_end").between(F.lit(start), F.lit(end)))
