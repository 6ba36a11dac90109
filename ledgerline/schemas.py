"""Table schemas, keys and feature roles.  Every table carries asset_id."""

from pyspark.sql import types as T

_S, _D, _L, _TS, _DAY = T.StringType(), T.DoubleType(), T.LongType(), T.TimestampType(), T.DateType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Names and types of the tables' columns, the indicators' names and the keys below.
CANDLES = _schema(asset_id=_S, ts=_TS, open=T.FloatType(), high=T.FloatType(), low=T.FloatType(), close=T.FloatType(), volume=_L)
NEWS = _schema(asset_id=_S, article_id=_S, published_at=_TS, headline=_S, summary=_S, source=_S, url=_S, language=_S)
SCORED_NEWS = _schema(asset_id=_S, article_id=_S, published_at=_TS, sentiment_score=_D, confidence=_D, model_name=_S)
DAILY_SENTIMENT = _schema(asset_id=_S, day=_DAY, sentiment_score=_D, n_articles=_L, sentiment_std=_D)
MEASURES = ("revenue", "net_income", "operating_cash_flow", "total_shareholder_equity", "total_liabilities")
#: State of daily sentiment that late articles can be added to: count, mean and sum of squared deviations.
DAILY_MOMENTS = _schema(asset_id=_S, day=_DAY, n=_L, mean=_D, m2=_D)
FUNDAMENTALS = _schema(
    asset_id=_S, report_type=_S, fiscal_date_end=_DAY, reported_date=_DAY, **dict.fromkeys(MEASURES, _D), source=_S
)
INDICATORS = (
    "rsi_14", "macd", "macd_signal", "ema_10", "ema_50", "ema_100", "ema_200", "volatility_20d", "candle_range", "candle_body",
)
INDICATOR_TABLE = _schema(asset_id=_S, ts=_TS, **dict.fromkeys(INDICATORS, T.FloatType()))
TRAINING_BASE = _schema(asset_id=_S, ts=_TS, time_idx=_L, day_of_week=_L, month=_L, target_return=_D)

#: Keys by which tables are upserted.
KEYS = {
    "candles": ["asset_id", "ts"],
    "news": ["asset_id", "article_id"],
    "scored_news": ["asset_id", "article_id"],
    "daily_sentiment": ["asset_id", "day"],
    "fundamentals": ["asset_id", "report_type", "fiscal_date_end"],
}
#: Roles of the training table's columns.
ROLES = {
    "index": ["asset_id", "time_idx"],
    "known": ["day_of_week", "month"],
    "observed": ["open", "high", "low", "close", "volume", *INDICATORS, "sentiment_score", "news_volume", "sentiment_std", *MEASURES],
    "target": ["target_return"],
}
