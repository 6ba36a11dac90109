"""The registered queries and their DuckDB SQL.  Names start with the inventory's ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import texts, times
from ..operators import counters, datasets, keys, long_series, quality, sentiment, series, validate
from ..sources import audits, digests, files, tables, versions
from ..streaming import fresh
from . import pipelines, sql, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
START, END = date(1996, 1, 1), date(2000, 12, 31)
MID = datetime(1999, 1, 16)
#: Ordinals that one JSON payload spans: payloads grow in number, not in size.
PAYLOAD = 50


def register(oracle: str | None = None, days: tuple[str, ...] = ()):
    """Add a query and its SQL; date columns are given as text on both sides."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir).withColumns({d: F.col(d).cast("string") for d in days})
        if oracle:
            cast = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in days)
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({cast}) FROM ({oracle})" if days else oracle
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both see it: a local temporary one for a local master only."""
    local = spark.sparkContext.master.startswith("local")
    own = "/tmp/checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.scratch"
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{own}/ledgerline"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _daily(scored: DataFrame) -> DataFrame:
    return sentiment.daily_sentiment(scored.filter("sentiment_score between -1 and 1"))


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.candles(spark, sf_dir)
    return pipelines.training_table(c, series.indicators(c), _daily(views.scored_news(spark, sf_dir)), views.fundamentals(spark, sf_dir), START, END)


_TRAINING_SQL = f"""
cut AS (SELECT * FROM candles WHERE ts >= DATE '{START}' AND ts < DATE '{END}' + 1),
reports AS (
  SELECT *, coalesce(reported_date, fiscal_date_end + 45) AS known_from FROM fundamentals WHERE fiscal_date_end BETWEEN DATE '{START}' AND DATE '{END}'),
known AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, known_from ORDER BY fiscal_date_end DESC, report_type DESC) k FROM reports) WHERE k = 1),
target AS (
  SELECT c.*, ln(lead("close") OVER (PARTITION BY asset_id ORDER BY ts) / "close") AS target_return FROM cut c),
training AS (
  SELECT t.asset_id, t.ts, t.open, t.high, t.low, t."close", CAST(t.volume AS DOUBLE) AS volume,
    {", ".join("i." + n for n in sql.NAMES)}, d.sentiment_score, d.n_articles AS news_volume, d.sentiment_std,
    {", ".join("f." + m for m in sql.MEASURES)}, CAST(isodow(t.ts) - 1 AS BIGINT) AS day_of_week, CAST(month(t.ts) AS BIGINT) AS month, target_return,
    row_number() OVER (PARTITION BY t.asset_id ORDER BY t.ts) - 1 AS time_idx
  FROM target t LEFT JOIN indicators i USING (asset_id, ts) LEFT JOIN daily d ON d.asset_id = t.asset_id AND d.day = t.ts::DATE
    AND d.day BETWEEN DATE '{START}' AND DATE '{END}'
    ASOF LEFT JOIN known f ON f.asset_id = t.asset_id AND t.ts::DATE >= f.known_from
  WHERE target_return IS NOT NULL)
"""
_REALS = ["open", "high", "low", "close", "volume", *sql.NAMES, "sentiment_score", "sentiment_std", *sql.MEASURES, "target_return"]


@register(sql.with_views(f"SELECT asset_id, ts, time_idx, day_of_week, month, news_volume, {sql.rounded(*_REALS)} FROM training", True, _TRAINING_SQL))
def q1_training_table(spark, sf_dir):
    """The flagship."""
    return rounded(_training(spark, sf_dir), *_REALS)


@register(sql.with_views(f"SELECT asset_id, ts, {sql.rounded(*sql.NAMES)} FROM indicators", True))
def q2_indicators(spark, sf_dir):
    """W2-W7 H15 B8 F2."""
    return rounded(series.indicators(views.candles(spark, sf_dir)), *sql.NAMES)


@register(
    sql.with_views(
        "SELECT asset_id, ts, "
        + ", ".join(f'round(("{n}" - avg("{n}") OVER w) / CASE WHEN stddev_pop("{n}") OVER w = 0 THEN 1 ELSE stddev_pop("{n}") OVER w END, 6) AS "{n}"' for n in sql.NAMES)
        + " FROM indicators WINDOW w AS (PARTITION BY asset_id)",
        True,
    )
)
def q3_normalised_indicators(spark, sf_dir):
    """W13 F3."""
    return rounded(pipelines.indicator_table(views.candles(spark, sf_dir)), *sql.NAMES)


@register(
    sql.with_views(f"""
    SELECT c.asset_id, ts, round((c."close" - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS "close", round((volume - vm) / CASE WHEN vs = 0 THEN 1 ELSE vs END, 6) AS volume
    FROM candles c JOIN (SELECT asset_id, avg("close") AS m, stddev_pop("close") AS s, avg(volume) AS vm, stddev_pop(volume) AS vs FROM candles WHERE ts <= TIMESTAMP '{MID}' GROUP BY 1) USING (asset_id)""")
)
def d20_scaled_prices(spark, sf_dir):
    """Parameters fitted up to a time, saved as rows, applied to all bars."""
    c = views.candles(spark, sf_dir).select("asset_id", "ts", F.col("close").cast("double"), F.col("volume").cast("double"))
    scaler = series.fit_scaler(c, ["close", "volume"], MID)
    return rounded(series.scale(c, scaler, ["close", "volume"]), "close", "volume")


@register(
    sql.with_views("""
    SELECT n.asset_id, 'n' || ordinal AS article_id, n.published_at, t AS text FROM (
      SELECT *, CASE WHEN trim(headline) = '' AND trim(summary) = '' THEN ' '
        ELSE concat_ws(' ', nullif(trim(headline), ''), nullif(trim(summary), '')) END AS t FROM news) n
    WHERE ordinal % 3 <> 1""")
)
def q4_unscored_news(spark, sf_dir):
    """What is left to score; F1 in q4_scored_news."""
    n = views.news(spark, sf_dir).withColumn("article_id", F.concat(F.lit("n"), F.col("ordinal").cast("string")))
    done = views.scored_news(spark, sf_dir).filter(F.substring("article_id", 2, 20).cast("long") % 3 == 1)
    return sentiment.unscored(n, done).select("asset_id", "article_id", "published_at", "text")


@register(
    sql.with_views("""
    SELECT asset_id, 'n' || ordinal AS article_id, published_at, v AS sentiment_score, abs(v) AS confidence, 'checksum' AS model_name FROM (
      SELECT n.*, CAST('0x' || left(md5(CASE WHEN trim(headline) = '' AND trim(summary) = '' THEN ' '
        ELSE concat_ws(' ', nullif(trim(headline), ''), nullif(trim(summary), '')) END), 6) AS BIGINT) % 2001 / 1000.0::DOUBLE - 1 AS v FROM news n)
    WHERE 'n' || ordinal NOT IN (SELECT article_id FROM scored_news WHERE sentiment_score > 0.5)""")
)
def q4_scored_news(spark, sf_dir):
    """What has no score yet, scored by a Python model in bounded batches."""
    n = views.news(spark, sf_dir).withColumn("article_id", F.concat(F.lit("n"), F.col("ordinal").cast("string")))
    return sentiment.score_news(n, views.scored_news(spark, sf_dir).filter("sentiment_score > 0.5"), sentiment.checksum_scorer, "checksum")


_SCORED_SQL = """SELECT asset_id, 'n' || ordinal AS article_id, published_at, v AS sentiment_score, abs(v) AS confidence, 'checksum' AS model_name FROM (
  SELECT n.*, CAST('0x' || left(md5(CASE WHEN trim(headline) = '' AND trim(summary) = '' THEN ' '
    ELSE concat_ws(' ', nullif(trim(headline), ''), nullif(trim(summary), '')) END), 6) AS BIGINT) % 2001 / 1000.0::DOUBLE - 1 AS v FROM news n)"""


@register(sql.with_views(f"""
    {_SCORED_SQL} WHERE 'n' || ordinal NOT IN (SELECT article_id FROM scored_news WHERE sentiment_score > 0.5)
    UNION ALL SELECT * FROM scored_news WHERE sentiment_score > 0.5"""))  # fmt: skip
def k3_scores_merged(spark, sf_dir):
    """Q4 K3: what has no score yet, scored and merged into the stored scores."""
    path, staging = scratch(spark, "scores"), scratch(spark, "staging")
    n = views.news(spark, sf_dir).withColumn("article_id", F.concat(F.lit("n"), F.col("ordinal").cast("string")))
    tables.write(views.scored_news(spark, sf_dir).filter("sentiment_score > 0.5"), path, schemas.SCORED_NEWS)
    pipelines.score_stored_news(spark, n, path, sentiment.checksum_scorer, staging, "checksum")
    return tables.scan(spark, path, schemas.SCORED_NEWS)


@register(sql.with_views("SELECT asset_id, day, n_articles, round(sentiment_score, 12) AS sentiment_score, round(sentiment_std, 12) AS sentiment_std FROM daily"), days=("day",))
def k4_late_news(spark, sf_dir):
    """Articles in three batches, latest first, added to stored moments of their days."""
    path, staging = scratch(spark, "moments"), scratch(spark, "staging")
    scored = views.scored_news(spark, sf_dir).filter("sentiment_score between -1 and 1")
    batch = F.pmod(F.xxhash64("article_id"), F.lit(3))
    for k in (2, 0, 1):
        pipelines.add_scored_news(spark, path, scored.filter(batch == k), staging)
    daily = sentiment.sentiment_of(tables.scan(spark, path, schemas.DAILY_MOMENTS))
    return daily.withColumns({c: F.round(c, 12) for c in ("sentiment_score", "sentiment_std")})


@register(sql.with_views(f"SELECT asset_id, day, n_articles, {sql.rounded('sentiment_score', 'sentiment_std')} FROM daily"), days=("day",))
def q5_daily_sentiment(spark, sf_dir):
    """Daily sentiment upserted into an older state."""
    scored = views.scored_news(spark, sf_dir).filter("sentiment_score between -1 and 1")
    old = sentiment.daily_sentiment(scored.filter(F.col("published_at") < F.lit(MID))).withColumn("sentiment_score", F.lit(0.0))
    return rounded(pipelines.sentiment_features(scored, old), "sentiment_score", "sentiment_std")


#: Most characters of a padded batch in w15_budgeted_scores.
BUDGET = 40_000


def _budgeted_scorer() -> sentiment.Scorer:
    """Checksum scores; a batch of several texts beyond the budget is an error."""
    score = sentiment.checksum_scorer()

    def checked(batch: list[str]) -> list[float]:
        if len(batch) > 1 and len(batch) * max(map(len, batch)) > BUDGET:
            raise ValueError("batch over the budget")
        return score(batch)

    return checked


@register("SELECT doc_id, v AS sentiment_score, abs(v) AS confidence FROM (SELECT doc_id, CAST('0x' || left(md5(coalesce(text, '')), 6) AS BIGINT) % 2001 / 1000.0::DOUBLE - 1 AS v FROM documents)")
def w15_budgeted_scores(spark, sf_dir):
    """Texts of very uneven lengths scored in batches of like lengths under a budget of characters."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return sentiment.score_text(docs, _budgeted_scorer, batch=64, budget=BUDGET).select("doc_id", "sentiment_score", "confidence")


@register(
    sql.with_views("""
    SELECT asset_id, url, ordinal, published_at FROM (
      SELECT n.*, row_number() OVER (PARTITION BY n.url ORDER BY ordinal) AS k FROM news n
      JOIN (SELECT asset_id, max(published_at) AS mark FROM news WHERE published_at < TIMESTAMP '1999-01-16' GROUP BY 1) m USING (asset_id)
      WHERE n.published_at >= mark) f
    WHERE (url IS NULL OR k = 1) AND (url IS NULL OR (asset_id, url) NOT IN (
      SELECT (s.asset_id, s.url) FROM news s JOIN (SELECT asset_id, max(published_at) AS mark FROM news WHERE published_at < TIMESTAMP '1999-01-16' GROUP BY 1) m USING (asset_id)
      WHERE s.published_at < TIMESTAMP '1999-01-16' AND s.published_at >= mark - INTERVAL 1 DAY AND s.url IS NOT NULL))""")
)
def q6_incremental_news(spark, sf_dir):
    """Landing rows since the high-water mark that are new."""
    n = views.news(spark, sf_dir)
    return pipelines.incremental_news(n.filter(F.col("published_at") < F.lit(MID)), n).select("asset_id", "url", "ordinal", "published_at")


@register(
    sql.with_views("""
    SELECT asset_id, id AS article_id, published_at, url FROM (
      SELECT *, row_number() OVER (PARTITION BY asset_id, id ORDER BY fresh DESC, ordinal DESC) AS k FROM (
        SELECT s.*, 0 AS fresh FROM stored s UNION ALL SELECT f.*, 1 FROM fresh f)) WHERE k = 1""",
    more="""
    named AS (SELECT *, coalesce(nullif(article_id, ''), nullif(url, '')) AS id FROM news WHERE coalesce(nullif(article_id, ''), nullif(url, '')) IS NOT NULL),
    stored AS (SELECT asset_id, id, published_at, url, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, id ORDER BY ordinal DESC) AS k FROM named WHERE published_at < TIMESTAMP '1999-01-16') WHERE k = 1),
    mark AS (SELECT asset_id, max(published_at) AS mark FROM stored GROUP BY 1),
    fresh AS (
      SELECT asset_id, id, published_at, url, ordinal FROM (
        SELECT n.*, row_number() OVER (PARTITION BY n.url ORDER BY ordinal) AS k FROM named n JOIN mark USING (asset_id) WHERE n.published_at >= mark)
      WHERE (url IS NULL OR k = 1) AND (url IS NULL OR (asset_id, url) NOT IN (
        SELECT (s.asset_id, s.url) FROM stored s JOIN mark USING (asset_id) WHERE s.published_at >= mark - INTERVAL 1 DAY AND s.url IS NOT NULL)))""")
)
def q6_news_merged(spark, sf_dir):
    """The new landing rows merged into the stored news, and the table read back; a second run adds nothing."""
    path, staging = scratch(spark, "news"), scratch(spark, "staging")
    n = tables.with_article_id(views.news(spark, sf_dir).filter("article_id is not null or url is not null"))
    stored = keys.keep_last(n.filter(F.col("published_at") < F.lit(MID)), ["asset_id", "article_id"], ["ordinal"])
    tables.write(stored, path, schemas.NEWS)
    for _ in range(2):
        pipelines.ingest_news(spark, path, n, staging)
    return tables.scan(spark, path, schemas.NEWS).select("asset_id", "article_id", "published_at", "url")


@register(
    sql.with_views("""
    SELECT asset_id, article_id, url, published_at FROM one WHERE r = 1
    UNION ALL
    SELECT asset_id, article_id, url, published_at FROM two WHERE r = 1""",
    more="""
    named AS (SELECT *, coalesce(nullif(url, ''), article_id) AS k FROM news WHERE coalesce(nullif(url, ''), article_id) IS NOT NULL),
    one AS (SELECT *, row_number() OVER (PARTITION BY asset_id, k ORDER BY published_at, ordinal) AS r FROM named WHERE published_at < TIMESTAMP '1999-01-16'),
    newest AS (SELECT date_trunc('milliseconds', max(published_at)) - INTERVAL 1 DAY AS late FROM one),
    held AS (SELECT asset_id, k, date_trunc('milliseconds', published_at) + INTERVAL 1 DAY AS until FROM one, newest WHERE r = 1 AND date_trunc('milliseconds', published_at) + INTERVAL 1 DAY > late),
    two AS (
      SELECT n.*, row_number() OVER (PARTITION BY n.asset_id, n.k ORDER BY published_at, ordinal) AS r FROM named n CROSS JOIN newest LEFT JOIN held h ON h.asset_id = n.asset_id AND h.k = n.k
      WHERE published_at > late AND (until IS NULL OR date_trunc('milliseconds', published_at) >= until))""")
)
def q6_streamed_news(spark, sf_dir):
    """Older news, then after a restart all news, overlapping and late rows among them, by a stream with keyed state."""
    landing, path, state = scratch(spark, "landing"), scratch(spark, "fresh"), scratch(spark, "state")
    n = views.news(spark, sf_dir).filter("article_id is not null or url is not null").select(*fresh.LANDING.fieldNames())
    for part in (n.filter(F.col("published_at") < F.lit(MID)), n):
        part.write.mode("append").parquet(landing)
        fresh.stream_fresh_news(spark, landing, path, state).awaitTermination()
    return tables.scan(spark, path, schemas.NEWS).select("asset_id", "article_id", "url", "published_at")


def _payloads(spark, sf_dir) -> DataFrame:
    """Statement payloads as JSON, made of the fundamentals."""
    f = views.fundamentals(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    out = []
    for kind, fields in [*files.STATEMENTS.items(), ("earnings", {"reported_date": "reportedDate"})]:
        item = F.struct(text("fiscal_date_end").alias("fiscalDateEnding"), *(F.coalesce(text(c), F.lit("None")).alias(a) for c, a in fields.items()))
        some = f.filter(F.month("fiscal_date_end") % 4 != 1) if kind == "balance" else f
        of = lambda t, item=item: F.sort_array(F.collect_list(F.when(F.col("report_type") == t, item)))
        a, q = ("annualEarnings", "quarterlyEarnings") if kind == "earnings" else ("annualReports", "quarterlyReports")
        body = some.groupBy("asset_id").agg(of("annual").alias(a), of("quarterly").alias(q))
        out.append(body.select("asset_id", F.lit(kind).alias("kind"), F.to_json(F.struct(a, q)).alias("payload")))
    return keys.union_all(*out)


_PAYLOAD_MEASURES = "revenue, net_income, operating_cash_flow, CASE WHEN month(fiscal_date_end) % 4 <> 1 THEN total_shareholder_equity END AS total_shareholder_equity, CASE WHEN month(fiscal_date_end) % 4 <> 1 THEN total_liabilities END AS total_liabilities"


@register(sql.with_views(f"SELECT asset_id, report_type, fiscal_date_end, reported_date, {_PAYLOAD_MEASURES} FROM fundamentals WHERE report_type = 'quarterly' AND fiscal_date_end BETWEEN DATE '{START}' AND DATE '{END}'"), days=("fiscal_date_end", "reported_date",))
def q7_fundamentals_load(spark, sf_dir):
    """Four JSON payloads merged, then selected by type and date."""
    found = files.fundamentals(_payloads(spark, sf_dir)).drop("source")
    return pipelines.select_reports(found, ["quarterly"], START, END).select("asset_id", "report_type", "fiscal_date_end", "reported_date", *schemas.MEASURES)


@register(sql.with_views(f'SELECT asset_id, ts, {", ".join(f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}" for c in ("open", "high", "low"))}, CAST(CAST("close" AS FLOAT) AS DOUBLE) AS "close", volume FROM candles WHERE ts >= DATE \'{START}\' AND ts < DATE \'{END}\' + 1'))
def q8_candle_load(spark, sf_dir):
    """A landing table with provider names, written by asset and scanned."""
    c = views.candles(spark, sf_dir)
    landing = c.select("asset_id", (F.col("ts") + F.expr("interval 5 hours")).alias("Date"), *(F.col(x).alias(f"{x.title()}_X") for x in ("open", "high", "low", "close", "volume")))
    landing = landing.withColumn("asset_id", texts.symbol(F.concat(F.lower("asset_id"), F.lit(".sa"))))
    path = scratch(spark, "candles")
    tables.write(files.landing_bars(landing), path, schemas.CANDLES, ("ts",))
    df = tables.candles(spark, path, ordered=True)
    return df.filter((F.col("ts") >= F.lit(START)) & times.before_day_end(F.col("ts"), F.lit(END)))


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again, for what reads it several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _report(df: DataFrame, profile: str) -> DataFrame:
    return rounded(quality.report(saved(df, "profiled"), profile), "value")


_REPORTS: dict[str, str] = {}


def _report_sql(profile: str, view: str, *args, indicators: bool = False, more: str = "") -> str:
    _REPORTS[profile] = f"SELECT asset_id, section, name, round(value, 6) AS value FROM ({sql.long_report(view, 'asset_id', *args)})"
    return sql.with_views(_REPORTS[profile], indicators, more)


_PRICES = ["open", "high", "low", "close", "volume"]
_BELOW = {f"range:{c}": f"coalesce({c} < 0, false)" for c in _PRICES}
_COMPARE = {f"compare:{a}{op}{b}": f"NOT coalesce({a} {op} {b}, false)" for a, op, b in quality.PROFILES["candles"].comparisons}
_SCORE = {"range:sentiment_score": "coalesce(sentiment_score NOT BETWEEN -1 AND 1, false)"}


_CANDLE_COLUMNS = ["ts", *_PRICES]
_NEWS = ["article_id", "published_at", "headline", "summary", "source", "url", "language"]
_SCORED = ["article_id", "published_at", "sentiment_score", "confidence", "model_name"]
_DAILY = ["day", "sentiment_score", "n_articles", "sentiment_std"]
_REPORT_COLUMNS = ["report_type", "fiscal_date_end", "reported_date", *sql.MEASURES, "source"]
_TRAIN = ["ts", *_PRICES, *sql.NAMES, "sentiment_score", "news_volume", "sentiment_std", *sql.MEASURES, "day_of_week", "month", "target_return", "time_idx"]


def _profiled(spark, sf_dir) -> dict[str, DataFrame]:
    """The seven tables that have profiles."""
    scored = views.scored_news(spark, sf_dir)
    return {
        "candles": views.candles(spark, sf_dir),
        "news_raw": views.news(spark, sf_dir).select("asset_id", *_NEWS),
        "scored_news": scored,
        "sentiment_daily": _daily(scored),
        "technical_indicators": series.indicators(views.candles(spark, sf_dir)),
        "fundamentals": views.fundamentals(spark, sf_dir),
        "dataset_tft": _training(spark, sf_dir),
    }


@register(_report_sql("candles", "candles", "ts", ["ts"], _PRICES, _CANDLE_COLUMNS, _BELOW | _COMPARE, True, _CANDLE_COLUMNS, ("ts timestamp", "close double", "volume bigint")))
def q9_quality_candles(spark, sf_dir):
    """D7-D13 D15-D19 W11 B6."""
    return _report(_profiled(spark, sf_dir)["candles"], "candles")


@register(_report_sql("news_raw", "news", "published_at", ["article_id"], [], _NEWS, {"not_null:url": "url IS NULL", "not_null:source": "source IS NULL"}, False, _NEWS))
def q9_quality_news(spark, sf_dir):
    """D11 D12 D14 D17 D18 on all days."""
    return _report(_profiled(spark, sf_dir)["news_raw"], "news_raw")


_CONFIDENT = {"between:confidence": "coalesce(confidence NOT BETWEEN 0 AND 1, false)", "not_null:model_name": "model_name IS NULL"}


@register(_report_sql("scored_news", "scored_news", "published_at", ["article_id"], ["sentiment_score", "confidence"], _SCORED, _SCORE | _CONFIDENT, False, _SCORED))
def q9_quality_scored_news(spark, sf_dir):
    """D14 between, not_null."""
    return _report(_profiled(spark, sf_dir)["scored_news"], "scored_news")


_COUNTED = {"nonnegative:n_articles": "coalesce(n_articles < 0, false)", "nonnegative:sentiment_std": "coalesce(sentiment_std < 0, false)"}


@register(_report_sql("sentiment_daily", "daily", "day", ["day"], _DAILY[1:], _DAILY, _SCORE | _COUNTED, True, _DAILY))
def q9_quality_daily_sentiment(spark, sf_dir):
    """D14 nonnegative, business days."""
    return _report(_profiled(spark, sf_dir)["sentiment_daily"], "sentiment_daily")


_TYPED = {"in:report_type": "NOT coalesce(report_type IN ('annual', 'quarterly'), false)"}


@register(_report_sql("fundamentals", "fundamentals", "fiscal_date_end", ["report_type", "fiscal_date_end"], sql.MEASURES, _REPORT_COLUMNS, _TYPED, False, _REPORT_COLUMNS))
def q9_quality_fundamentals(spark, sf_dir):
    """D14 in, two-column key."""
    return _report(_profiled(spark, sf_dir)["fundamentals"], "fundamentals")


@register(_report_sql("technical_indicators", "indicators", "ts", ["ts"], sql.NAMES, ["ts", *sql.NAMES], {}, True, ["ts", *sql.NAMES], indicators=True))
def q9_quality_indicators(spark, sf_dir):
    return _report(_profiled(spark, sf_dir)["technical_indicators"], "technical_indicators")


_TRAIN_RULES = {k: _BELOW[k] for k in ("range:close", "range:volume")} | _SCORE
_TRAIN_RULES |= {"nonnegative:time_idx": "coalesce(time_idx < 0, false)", "nonnegative:news_volume": "coalesce(news_volume < 0, false)"}


@register(_report_sql("dataset_tft", "training", "ts", ["ts"], _TRAIN[1:], _TRAIN, _TRAIN_RULES, True, _TRAIN, indicators=True, more=_TRAINING_SQL))
def q9_quality_training(spark, sf_dir):
    return _report(_profiled(spark, sf_dir)["dataset_tft"].select("asset_id", *_TRAIN), "dataset_tft")


_AUDIT_SQL = " UNION ALL ".join(f"SELECT '{name}' AS \"table\", * FROM ({body})" for name, body in _REPORTS.items())
_FOUND = " UNION ALL ".join(f"SELECT '{n}', NULL, 'report', 'exists', {v}" for n, v in (("audit", 1.0), ("other", 0.0)))


def _audited(spark, sf_dir) -> dict[str, DataFrame]:
    """The seven tables, saved; what is made of other tables is made of the saved ones."""
    found = _profiled(spark, sf_dir)
    found = {n: saved(df, n) for n, df in found.items() if n in ("candles", "news_raw", "scored_news", "fundamentals")}
    found["sentiment_daily"] = saved(_daily(found["scored_news"]), "sentiment_daily")
    found["technical_indicators"] = saved(series.indicators(found["candles"]), "technical_indicators")
    parts = [found[n] for n in ("candles", "technical_indicators", "sentiment_daily", "fundamentals")]
    found["dataset_tft"] = saved(pipelines.training_table(*parts, START, END).select("asset_id", *_TRAIN), "dataset_tft")
    return found


@register(sql.with_views(f"{_AUDIT_SQL} UNION ALL {_FOUND}", True, _TRAINING_SQL))
def q11_audit(spark, sf_dir):
    """Reports of all seven tables, written as a report of one run, looked up by prefix and read back."""
    found = _audited(spark, sf_dir)
    rows, path = quality.audit(found), scratch(spark, "reports")
    files.write_report(rows, path, "audit", F.lit("20240101_000000"))
    there = [(p, None, "report", "exists", float(files.report_exists(spark, path, p))) for p in ("audit", "other")]
    columns = "table string, asset_id string, section string, name string, value double"
    back = files.reports(spark, path, rows.schema).select("table", "asset_id", "section", "name", "value")
    return rounded(back.unionByName(spark.createDataFrame(there, columns)), "value")


_CHANGED = "changed AS (SELECT * REPLACE (CASE WHEN asset_id = 'A2' THEN volume + 1 ELSE volume END AS volume) FROM candles)"


@register(sql.with_views(f"""
    SELECT asset_id, section, name, round(value, 6) AS value FROM ({sql.long_report('changed', 'asset_id', 'ts', ['ts'], _PRICES, _CANDLE_COLUMNS, _BELOW | _COMPARE, True, _CANDLE_COLUMNS, ('ts timestamp', 'close double', 'volume bigint'))})
    UNION ALL SELECT 'A2', 'audited', 'again', 1.0""", more=_CHANGED))  # fmt: skip
def q11_renewed_audit(spark, sf_dir):
    """A stored table audited, one asset rewritten, and audited again by reading that asset only."""
    path, state = scratch(spark, "audited"), scratch(spark, "audits")
    c = views.candles(spark, sf_dir)
    tables.write(c, path, None, ("ts",))
    audits.audit_changed(spark, path, "candles", state)
    tables.write(c.filter("asset_id = 'A2'").withColumn("volume", F.col("volume") + 1), path, None, ("ts",))
    rows, again = audits.audit_changed(spark, path, "candles", state)
    again = again.select("asset_id", F.lit("audited").alias("section"), F.lit("again").alias("name"), F.lit(1.0).alias("value"))
    return rounded(rows.unionByName(again), "value")


# one asset with most of all bars

#: Rows of a piece in these queries; the default holds all bars of the given tables.
SMALL_PIECE = 1_024
_HOT_SQL = """hot AS (SELECT CASE WHEN asset_id = 'A0' THEN 'A0' ELSE 'HOT' END AS asset_id, ts + to_hours(CAST(right(asset_id, 1) AS INT)) AS ts,
  open, high, low, "close", volume FROM candles)"""


def _hot_asset() -> F.Column:
    return F.when(F.col("asset_id") == "A0", "A0").otherwise("HOT")


def _hot_candles(spark, sf_dir) -> DataFrame:
    """Candles of which one asset has four fifths, its bars hours apart."""
    hours = F.make_dt_interval(hours=F.right("asset_id", F.lit(1)).cast("int"))
    return views.candles(spark, sf_dir).withColumn("ts", F.col("ts") + hours).withColumn("asset_id", _hot_asset())


@register(f"WITH RECURSIVE {sql.VIEWS.strip()}, {_HOT_SQL}, {sql.INDICATORS.strip().replace('FROM candles', 'FROM hot')} SELECT asset_id, ts, {sql.rounded(*sql.NAMES)} FROM indicators")
def w4_long_series(spark, sf_dir):
    """Indicators in pieces of a series, recurrences composed over the pieces."""
    return rounded(long_series.indicators(_hot_candles(spark, sf_dir), SMALL_PIECE), *sql.NAMES)


@register(sql.with_views('SELECT asset_id, ts, row_number() OVER w - 1 AS time_idx, round(ln(lead("close") OVER w / "close"), 6) AS target_return FROM hot WINDOW w AS (PARTITION BY asset_id ORDER BY ts)', more=_HOT_SQL))
def w8_long_index(spark, sf_dir):
    """Time index and target of a series in pieces."""
    c = long_series.next_log_return(_hot_candles(spark, sf_dir).select("asset_id", "ts", "close"), piece=SMALL_PIECE)
    return rounded(long_series.numbered(c, "time_idx").select("asset_id", "ts", "time_idx", "target_return"), "target_return")


@register(sql.with_views("""
    SELECT n.asset_id, n.ordinal, h.ts AS bar, h."close" AS price, CASE WHEN h.volume % 2 = 0 THEN h.volume END AS volume
    FROM (SELECT CASE WHEN asset_id = 'A0' THEN 'A0' ELSE 'HOT' END AS asset_id, ordinal, published_at FROM news) n
    ASOF LEFT JOIN hot h ON h.asset_id = n.asset_id AND n.published_at >= h.ts""", more=_HOT_SQL))  # fmt: skip
def c3_long_asof(spark, sf_dir):
    """Every article with the last bar before it, in cells of an asset and month."""
    n = views.news(spark, sf_dir).select(_hot_asset().alias("asset_id"), "ordinal", "published_at")
    bars = _hot_candles(spark, sf_dir).select("asset_id", F.col("ts").alias("bar"), F.col("close").alias("price"), F.when(F.col("volume") % 2 == 0, F.col("volume")).alias("volume"))
    found = long_series.asof_backward(n, bars, "published_at", "bar", ["bar", "price", "volume"], ["price"])
    return found.select("asset_id", "ordinal", "bar", "price", "volume")


# scans


@register(sql.with_views("SELECT asset_id, article_id, published_at, coalesce(headline, '') AS headline, coalesce(source, '') AS source, language FROM news WHERE published_at BETWEEN TIMESTAMP '1999-01-05' AND TIMESTAMP '1999-01-16'"))
def a2_news_scan(spark, sf_dir):
    """A2 B1: written by asset and scanned over an inclusive range, defaults for null texts."""
    path = scratch(spark, "news")
    tables.write(views.news(spark, sf_dir), path, schemas.NEWS, ("published_at",))
    return tables.news(spark, path, None, datetime(1999, 1, 5), MID).select("asset_id", "article_id", "published_at", "headline", "source", "language")


@register(sql.with_views("SELECT asset_id, article_id, published_at, sentiment_score, nullif(model_name, '') AS model_name FROM scored_news WHERE published_at BETWEEN TIMESTAMP '1999-01-05' AND TIMESTAMP '1999-01-16'"))
def a3_scored_news_scan(spark, sf_dir):
    """A3 K3: written by asset and scanned."""
    path = scratch(spark, "scored")
    tables.write(views.scored_news(spark, sf_dir), path, schemas.SCORED_NEWS, ("published_at",))
    df = tables.scored_news(spark, path, start=datetime(1999, 1, 5), end=MID)
    return df.select("asset_id", "article_id", "published_at", "sentiment_score", "model_name")


@register(sql.with_views(f"SELECT asset_id, day, n_articles, {sql.rounded('sentiment_score')} FROM daily WHERE asset_id = 'A1' AND day BETWEEN DATE '1999-01-05' AND DATE '1999-01-16'"), days=("day",))
def a4_daily_sentiment_scan(spark, sf_dir):
    """A4: bounds count by their day, one asset's partition."""
    path = scratch(spark, "daily")
    scored = views.scored_news(spark, sf_dir).filter("sentiment_score between -1 and 1")
    tables.write(sentiment.daily_sentiment(scored), path, schemas.DAILY_SENTIMENT, ("day",))
    df = tables.daily_sentiment(spark, path, ["A1"], datetime(1999, 1, 5, 9), MID)
    return rounded(df, "sentiment_score").select("asset_id", "day", "n_articles", "sentiment_score")


@register(sql.with_views(f"SELECT asset_id, fiscal_date_end, reported_date, revenue FROM fundamentals WHERE report_type = 'annual' AND fiscal_date_end BETWEEN DATE '{START}' AND DATE '{END}'"), days=("fiscal_date_end", "reported_date",))
def a5_fundamentals_scan(spark, sf_dir):
    """A5 S2."""
    path = scratch(spark, "fundamentals")
    tables.write(views.fundamentals(spark, sf_dir), path, schemas.FUNDAMENTALS, ("report_type", "fiscal_date_end"))
    return tables.fundamentals(spark, path, None, START, END, "annual").select("asset_id", "fiscal_date_end", "reported_date", "revenue")


@register(sql.with_views(" UNION ALL ".join(f"SELECT asset_id, ts, '{n}' AS name, round(CAST(CAST(\"{n}\" AS FLOAT) AS DOUBLE), 3) AS value FROM indicators WHERE asset_id = 'A2'" for n in ("rsi_14", "macd_signal")), True))
def a6_indicator_maps(spark, sf_dir):
    """Wide table written once, read as maps, an asset's entries."""
    path = scratch(spark, "indicators")
    table = series.indicators(views.candles(spark, sf_dir)).select("asset_id", "ts", "rsi_14", "macd_signal")
    tables.write(table.withColumns({c: F.col(c).cast("float") for c in ("rsi_14", "macd_signal")}), path, None, ("ts",), "error")
    maps = tables.indicator_maps(spark, path, ["A2"])
    return maps.select("asset_id", "ts", F.explode("indicators").alias("name", "value")).withColumn("value", F.round("value", 3))



@register(sql.with_views(f"SELECT asset_id, ts, time_idx, day_of_week, month, {sql.rounded('target_return', 'close', 'ema_200', 'revenue')}, 'A' AS run FROM training", True, _TRAINING_SQL))
def a7_training_scan(spark, sf_dir):
    """The training table written by asset with a further column, and scanned."""
    path = scratch(spark, "training")
    tables.write_training(_training(spark, sf_dir).withColumn("run", F.lit("A")), path)
    df = tables.training(spark, path).select("asset_id", "ts", "time_idx", "day_of_week", "month", "target_return", "close", "ema_200", "revenue", "run")
    return rounded(df, "target_return", "close", "ema_200", "revenue")


@register(
    sql.with_views("""
    SELECT asset_id, p AS published_at, h AS headline, coalesce(nullif(trim(source), ''), 'alpha_vantage') AS source,
      coalesce(url, strftime(p, '%Y%m%dT%H%M%S') || ':' || left(h, 80)) AS article_id
    FROM (SELECT *, date_trunc('second', published_at) AS p,
            CASE WHEN trim(headline) = '' AND trim(summary) = '' THEN ' ' ELSE trim(headline) END AS h FROM news) WHERE ordinal % 10 <> 3""")
)
def a8_news_feed(spark, sf_dir):
    """JSON feeds by asset and user, items without a valid time skipped."""
    n = views.news(spark, sf_dir)
    time = F.when(F.col("ordinal") % 10 != 3, F.date_format("published_at", "yyyyMMdd'T'HHmmss")).otherwise("soon")
    item = F.struct(time.alias("time_published"), F.col("headline").alias("title"), "summary", "source", "url")
    feeds = n.groupBy("asset_id", F.floor(F.col("ordinal") / PAYLOAD).alias("feed_no")).agg(F.collect_list(item).alias("feed"))
    found = files.news_feed(feeds.select("asset_id", F.to_json(F.struct("feed")).alias("payload")))
    return found.select("asset_id", "published_at", "headline", "source", "article_id")


@register(
    sql.with_views("""
    SELECT asset_id, to_timestamp(epoch(date_trunc('second', published_at)))::TIMESTAMP AS published_at, coalesce(url, CAST(CAST(epoch(date_trunc('second', published_at)) AS BIGINT) AS VARCHAR)) AS article_id
    FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, ordinal // 50 ORDER BY ordinal) AS k FROM news) WHERE k <= 5""")
)
def a9_news_items(spark, sf_dir):
    """JSON arrays with epoch seconds, the first five of each."""
    n = views.news(spark, sf_dir)
    item = F.struct("ordinal", F.unix_timestamp("published_at").alias("datetime"), "headline", "summary", "source", "url")
    lists = n.groupBy("asset_id", F.floor(F.col("ordinal") / PAYLOAD).alias("no")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    found = files.news_items(lists.select("asset_id", F.to_json("items").alias("payload")), limit=5)
    return found.select("asset_id", "published_at", "article_id")


@register(
    sql.with_views("""
    SELECT asset_id, feed_no, pos AS ordinal, CASE WHEN ordinal % 10 = 7 THEN 'no object' WHEN ordinal % 10 = 3 THEN 'no time' END AS reason,
      CASE WHEN ordinal % 10 NOT IN (3, 7) THEN coalesce(url, strftime(p, '%Y%m%dT%H%M%S') || ':' || left(h, 80)) END AS article_id FROM items WHERE feed_no % 8 NOT IN (3, 5, 6)
    UNION ALL
    SELECT DISTINCT asset_id, feed_no, CAST(NULL AS BIGINT), CASE feed_no % 8 WHEN 3 THEN 'unreadable' WHEN 5 THEN 'no list' ELSE 'no payload' END, NULL FROM items WHERE feed_no % 8 IN (3, 5, 6)""",
    more="""
    items AS (
      SELECT *, ordinal // 50 AS feed_no, row_number() OVER (PARTITION BY asset_id, ordinal // 50 ORDER BY ordinal) - 1 AS pos, date_trunc('second', published_at) AS p,
        CASE WHEN trim(headline) = '' AND trim(summary) = '' THEN ' ' ELSE trim(headline) END AS h FROM news)""")
)
def a8_feed_outcomes(spark, sf_dir):
    """JSON feeds of which some are cut off, without a list or null, and items that are no objects or have no time, each with its reason."""
    n = views.news(spark, sf_dir)
    time = F.when(F.col("ordinal") % 10 != 3, F.date_format("published_at", "yyyyMMdd'T'HHmmss")).otherwise("soon")
    item = F.to_json(F.struct(time.alias("time_published"), F.col("headline").alias("title"), "summary", "source", "url"))
    item = F.struct("ordinal", F.when(F.col("ordinal") % 10 == 7, F.lit('"moved"')).otherwise(item).alias("item"))
    feeds = n.groupBy("asset_id", F.floor(F.col("ordinal") / PAYLOAD).alias("feed_no")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    text, kind = F.concat(F.lit('{"feed": ['), F.array_join("items.item", ", "), F.lit("]}")), F.col("feed_no") % 8
    text = F.when(kind == 3, F.left(text, F.length(text) - 1)).when(kind == 5, '{"feeds": []}').when(kind != 6, text)
    out = files.feed_outcomes(feeds.withColumn("payload", text), by=("asset_id", "feed_no"))
    good, bad, _ = files.split_outcomes(out, ("asset_id", "feed_no"))
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
    return both.select("asset_id", "feed_no", F.col("ordinal").cast("long"), "reason", "article_id")


@register(
    sql.with_views("""
    SELECT asset_id, CASE WHEN ordinal % 10 = 7 THEN 'no object' WHEN ordinal % 6 = 2 THEN 'no time' ELSE 'fine' END AS reason, count(*) AS n FROM news GROUP BY 1, 2""")
)
def a9_item_counters(spark, sf_dir):
    """News and quarantined items of JSON arrays, counted by reason."""
    n = views.news(spark, sf_dir)
    item = F.struct("ordinal", F.when(F.col("ordinal") % 6 != 2, F.unix_timestamp("published_at")).alias("datetime"), "headline", "summary", "source", "url")
    item = F.when(F.col("ordinal") % 10 == 7, F.lit("[1]")).otherwise(F.to_json(item))
    lists = n.groupBy("asset_id", F.floor(F.col("ordinal") / PAYLOAD).alias("no")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("payload"))
    return files.split_outcomes(files.item_outcomes(lists))[2]


@register("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, NULL FROM supplier")
def a12_csv_set(spark, sf_dir):
    """CSV files written, one without a required column skipped, united by name."""
    t = lambda n: views.table(spark, sf_dir, n)
    paths = [scratch(spark, n) for n in ("a", "b", "c")]
    c = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    files.write_csv(c.filter("c_custkey % 2 = 0"), paths[0])
    files.write_csv(c.filter("c_custkey % 2 = 1"), paths[0], append=True)
    files.write_csv(t("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name")), paths[1])
    files.write_csv(t("nation").select("n_name"), paths[2])
    return files.csv_set(spark, paths, ["c_custkey", "c_name"])


@register("SELECT c_nationkey AS nation, strlen(t) AS length, sha256(t) AS sha256 FROM (SELECT c_nationkey, string_agg(c_custkey || '|' || c_name || chr(10), '' ORDER BY c_custkey) AS t FROM customer GROUP BY 1)")
def a14_provenance(spark, sf_dir):
    """Size and checksum of text files, one a nation, that hold all customers."""
    path = scratch(spark, "lines")
    c = views.table(spark, sf_dir, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    c.select("c_nationkey", F.concat_ws("|", "c_custkey", "c_name").alias("line")).write.partitionBy("c_nationkey").text(path)
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("long").alias("nation")
    return files.provenance(spark, path).filter(F.col("path").endswith(".txt")).select(nation, "length", "sha256")


@register("SELECT c_nationkey AS nation, strlen(t) AS length, sha256(t) AS sha256 FROM (SELECT c_nationkey, string_agg(c_custkey || '|' || c_name || chr(10), '' ORDER BY c_custkey) AS t FROM customer GROUP BY 1)")
def a14_file_digests(spark, sf_dir):
    """The same by a data source that reads files in chunks, of 1,000 bytes here."""
    path = scratch(spark, "lines")
    c = views.table(spark, sf_dir, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    c.select("c_nationkey", F.concat_ws("|", "c_custkey", "c_name").alias("line")).write.partitionBy("c_nationkey").text(path)
    nation = F.regexp_extract("path", "c_nationkey=([0-9]+)", 1).cast("long").alias("nation")
    return digests.digests(spark, path, chunk=1000).filter(F.col("path").endswith(".txt")).select(nation, "length", "sha256")


# keys and sinks


@register(
    sql.with_views("""
    SELECT asset_id, id AS article_id, ordinal, CASE WHEN renewed THEN headline ELSE 'old ' || headline END AS headline FROM (
      SELECT *, row_number() OVER (PARTITION BY asset_id, id ORDER BY renewed DESC, ordinal DESC) AS k
      FROM (SELECT *, coalesce(nullif(article_id, ''), nullif(url, '')) AS id, published_at >= TIMESTAMP '1999-01-16' OR ordinal % 4 = 0 AS renewed FROM news) WHERE id IS NOT NULL) WHERE k = 1""")
)
def k2_news_upsert(spark, sf_dir):
    """All older news stored, later news and a part of the older upserted by id, the last kept."""
    n = views.news(spark, sf_dir).withColumn("article_id", texts.article_id(F.col("article_id"), F.col("url"))).filter("article_id is not null")
    n = n.select("asset_id", "article_id", "published_at", "ordinal", "headline", F.col("ordinal").alias("o"))
    before = F.col("published_at") < F.lit(MID)
    old = n.filter(before).withColumn("headline", F.concat(F.lit("old "), "headline"))
    old = keys.keep_last(old, ["asset_id", "article_id"], ["o"]).drop("o", "published_at")
    return keys.upsert(old, n.filter(~before | (F.col("ordinal") % 4 == 0)).drop("published_at"), ["asset_id", "article_id"], "o")


@register(sql.with_views("SELECT asset_id, report_type, fiscal_date_end, revenue * 2 AS revenue FROM fundamentals"), days=("fiscal_date_end",))
def k5_fundamentals_merge(spark, sf_dir):
    """K5: two-column key; a stored table merged in place, only the batch's assets rewritten."""
    path, staging = scratch(spark, "reports"), scratch(spark, "staging")
    f = saved(views.fundamentals(spark, sf_dir), "fundamentals")
    tables.write(f.filter(F.year("fiscal_date_end") < 1999), path, schemas.FUNDAMENTALS)
    batch = f.withColumn("revenue", F.col("revenue") * 2).withColumn("ordinal", F.lit(1))
    batch = batch.unionByName(f.withColumn("ordinal", F.lit(0)))
    tables.merge(spark, path, batch, schemas.FUNDAMENTALS, schemas.KEYS["fundamentals"], staging)
    return tables.scan(spark, path, schemas.FUNDAMENTALS).select("asset_id", "report_type", "fiscal_date_end", "revenue")


@register(
    sql.with_views("""
    SELECT 1 AS version, asset_id, report_type, fiscal_date_end, revenue FROM fundamentals WHERE year(fiscal_date_end) < 1999
    UNION ALL SELECT 2, asset_id, report_type, fiscal_date_end, CASE WHEN asset_id = 'A0' THEN revenue ELSE revenue * 2 END FROM fundamentals WHERE asset_id <> 'A0' OR year(fiscal_date_end) < 1999"""),
    days=("fiscal_date_end",),
)
def k5_versioned_reports(spark, sf_dir):
    """K1 K5: a table in versions, to which all assets but one are merged; both versions read after that."""
    root, f = scratch(spark, "versions"), saved(views.fundamentals(spark, sf_dir), "fundamentals")
    versions.write(spark, root, f.filter(F.year("fiscal_date_end") < 1999), schemas.FUNDAMENTALS, ("fiscal_date_end",))
    batch = f.filter("asset_id <> 'A0'").withColumn("revenue", F.col("revenue") * 2).withColumn("ordinal", F.lit(0))
    versions.merge(spark, root, batch, schemas.FUNDAMENTALS, schemas.KEYS["fundamentals"], ("fiscal_date_end",))
    both = [versions.read(spark, root, schemas.FUNDAMENTALS, n).withColumn("version", F.lit(n)) for n in (1, 2)]
    return keys.union_all(*both).select("version", "asset_id", "report_type", "fiscal_date_end", "revenue")


@register(
    "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS p_name, "
    "CASE WHEN p_partkey % 2 = 0 THEN -1 ELSE p_size END AS p_size FROM part"
)
def k6_partial_upsert(spark, sf_dir):
    """K6: on conflict only one column changes; rows not stored come whole."""
    p = views.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    batch = p.filter("p_partkey % 2 = 0 or p_partkey % 3 = 0").withColumn("p_name", F.when(F.col("p_partkey") % 3 == 0, "new").otherwise(F.col("p_name")))
    batch = batch.withColumn("p_size", F.when(F.col("p_partkey") % 2 == 0, -1).otherwise(F.col("p_size"))).withColumn("ordinal", F.lit(0))
    return keys.upsert_columns(p.filter("p_partkey % 3 <> 0"), batch, "p_partkey", ["p_size"])


@register(
    sql.with_views("""
    SELECT url, CASE WHEN o.url IS NULL THEN n.headline ELSE o.headline END AS headline, round(CASE WHEN n.url IS NULL THEN o.value ELSE n.value + 1 END, 6) AS sentiment
    FROM (SELECT url, headline, value FROM kept WHERE ordinal % 3 <> 0) o FULL JOIN (SELECT url, 'new' AS headline, value FROM kept WHERE ordinal % 2 = 0) n USING (url)""",
    more="kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ordinal) AS k FROM news WHERE url IS NOT NULL) WHERE k = 1)")
)
def k6_score_updates(spark, sf_dir):
    """K6: scores of stored news updated by url; an unknown url comes whole."""
    n = keys.keep_first_by_url(views.news(spark, sf_dir)).filter("url is not null")
    n = n.select("url", "headline", F.col("value").alias("sentiment"), F.abs("value").alias("confidence"), "ordinal")
    batch = n.filter("ordinal % 2 = 0").withColumns({"headline": F.lit("new"), "sentiment": F.col("sentiment") + 1})
    found = tables.update_scores(n.filter("ordinal % 3 <> 0").drop("ordinal"), batch)
    return rounded(found.select("url", "headline", "sentiment"), "sentiment")


# validators, filters and scalar functions


_VALID = {
    "candles": "",
    "news": """list_filter([CASE WHEN published_at IS NULL THEN 'published_at' END, CASE WHEN headline IS NULL THEN 'headline' END,
      CASE WHEN coalesce(trim(source), '') = '' THEN 'source' END,
      CASE WHEN coalesce(trim(url), '') <> '' AND NOT regexp_matches(trim(url), '^https?://') THEN 'url' END,
      CASE WHEN NOT regexp_full_match(lower(trim(language)), '[\\p{L}-]+') THEN 'language' END], lambda x: x IS NOT NULL)""",
}


@register(sql.with_views(f"SELECT ordinal, array_to_string({_VALID['news']}, ',') AS violations FROM news"))
def b5_news_violations(spark, sf_dir):
    """Broken rules of each row."""
    n = validate.violations(views.news(spark, sf_dir), "news")
    return n.select("ordinal", F.array_join("violations", ",").alias("violations"))


@register(
    sql.with_views("""
    SELECT 'scored_news' AS t, count_if(sentiment_score NOT BETWEEN -1 AND 1 OR model_name = '') AS bad, count(*) AS n FROM scored_news
    UNION ALL SELECT 'candles', count_if("close" <= 0 OR volume < 0), count(*) FROM candles
    UNION ALL SELECT 'fundamentals', count_if(fiscal_date_end > DATE '1997-06-01' AND report_type = 'annual'), count(*) FROM fundamentals
    UNION ALL SELECT 'daily_sentiment', count_if(n_articles < 4 OR sentiment_std > 0.2), count(*) FROM daily""")
)
def b5_split_valid(spark, sf_dir):
    """Valid and quarantined rows of four tables."""
    scored = views.scored_news(spark, sf_dir)
    found = {
        "scored_news": scored,
        "candles": views.candles(spark, sf_dir),
        "fundamentals": views.fundamentals(spark, sf_dir).withColumn("report_type", F.when((F.col("fiscal_date_end") > "1997-06-01") & (F.col("report_type") == "annual"), "draft").otherwise(F.col("report_type"))),
        "daily_sentiment": sentiment.daily_sentiment(scored.filter("sentiment_score between -1 and 1")).withColumns({"n_articles": F.col("n_articles") - 3, "sentiment_std": F.when(F.col("sentiment_std") > 0.2, -F.col("sentiment_std")).otherwise(F.col("sentiment_std"))}),
    }
    marked = [validate.violations(df, t).select(F.lit(t).alias("t"), (F.size("violations") > 0).alias("bad")) for t, df in found.items()]
    return keys.union_all(*marked).groupBy("t").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n"))


@register("SELECT event_id, user_id FROM events WHERE value IS NOT NULL AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 100 = 1")
def b10_anti_join_keeps_nulls(spark, sf_dir):
    """Rows not matched; null keys stay."""
    e = views.table(spark, sf_dir, "events")
    some = e.filter("value is not null").select("event_id", "user_id")
    nulls = e.filter("event_id % 100 = 1").select("event_id", F.lit(None).cast("long").alias("user_id"))
    return keys.not_in(some.unionByName(nulls), e.filter("event_type = 'purchase'"), "user_id")


@register(
    """
    SELECT doc_id, pos, line FROM (
      SELECT doc_id, unnest(range(len(s))) AS pos, trim(unnest(s), ' ') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))
    WHERE line <> '' AND NOT regexp_full_match(line, '[0-9]+') AND line NOT IN ('•', '·', '-', '*')"""
)
def b14_content_lines(spark, sf_dir):
    """Lines without noise."""
    df = datasets.content_lines(views.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.withColumn("pos", F.col("pos").cast("long"))


@register("SELECT page_id, url FROM pages WHERE starts_with(html, '<!DOCTYPE') AND url IS NOT NULL AND html IS NOT NULL")
def b15_marked_pages(spark, sf_dir):
    """B15."""
    return datasets.marked_items(views.table(spark, sf_dir, "pages"), "html", "<!DOCTYPE", ["url", "html"]).select("page_id", "url")


@register(
    sql.with_views("""
    SELECT c.asset_id, c.ts, round(coalesce(n.sentiment_score, c.old), 6) AS sentiment_score FROM
      (SELECT *, CASE WHEN volume % 2 = 0 THEN 0.5 END::DOUBLE AS old FROM candles) c LEFT JOIN daily n ON n.asset_id = c.asset_id AND n.day = c.ts::DATE""")
)
def c4_coalescing_update(spark, sf_dir):
    """C4: new sentiment on bars, the old kept elsewhere."""
    bars = views.candles(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("sentiment_score", F.when(F.col("volume") % 2 == 0, 0.5))
    daily = sentiment.daily_sentiment(views.scored_news(spark, sf_dir).filter("sentiment_score between -1 and 1"))
    found = keys.coalescing_update(bars, daily, ["asset_id", "day"], ["sentiment_score"], ["day"])
    return rounded(found.select("asset_id", "ts", "sentiment_score"), "sentiment_score")


@register(sql.with_views("""
    SELECT asset_id, d FROM (SELECT b.asset_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM (SELECT asset_id, min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM candles GROUP BY 1) b)
    WHERE isodow(d) < 6 AND (asset_id, d) NOT IN (SELECT (asset_id, ts::DATE) FROM candles)"""), days=("d",))  # fmt: skip
def c9_missing_days(spark, sf_dir):
    """Business days without a bar."""
    return quality.missing_days(views.candles(spark, sf_dir), "ts", ["asset_id"], True)


@register(sql.with_views("SELECT asset_id, d, gap FROM (SELECT asset_id, ts::DATE AS d, ts::DATE - lag(ts::DATE) OVER (PARTITION BY asset_id ORDER BY ts) AS gap FROM candles) WHERE gap > 1"), days=("d",))
def w11_gaps(spark, sf_dir):
    """Gaps between observed days, weekends counted."""
    return quality.gap_sizes(views.candles(spark, sf_dir), "ts", ["asset_id"])


@register(sql.with_views(f"SELECT asset_id, min(ts)::DATE AS first_day, max(ts)::DATE AS last_day, max(ts)::DATE >= DATE '{END}' AND min(ts)::DATE <= DATE '{START}' AS covered FROM candles GROUP BY 1"), days=("first_day", "last_day",))
def d5_coverage(spark, sf_dir):
    """D5."""
    return tables.coverage(views.candles(spark, sf_dir), "ts", START, END)


@register(sql.with_views("SELECT asset_id, NULL AS report_type, max(published_at) AS latest FROM news GROUP BY 1 UNION ALL SELECT asset_id, report_type, max(fiscal_date_end)::TIMESTAMP FROM fundamentals GROUP BY 1, 2"))
def d2_latest(spark, sf_dir):
    """Newest news and reports."""
    n = tables.latest(views.news(spark, sf_dir), "published_at").withColumn("report_type", F.lit(None).cast("string"))
    f = tables.latest(views.fundamentals(spark, sf_dir), "fiscal_date_end", ("asset_id", "report_type"))
    return n.unionByName(f.withColumn("latest", F.col("latest").cast("timestamp"))).select("asset_id", "report_type", "latest")


@register(sql.with_views("SELECT report_type, count(*) AS n FROM fundamentals GROUP BY 1"))
def d22_reports_per_type(spark, sf_dir):
    return views.fundamentals(spark, sf_dir).groupBy("report_type").agg(F.count("*").alias("n"))


@register("SELECT round(avg(CASE WHEN list_position(l, list_max(l)) - 1 = label % 3 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM (SELECT embedding[1:3] AS l, label FROM embeddings)")
def d23_accuracy(spark, sf_dir):
    """D23 H9."""
    e = views.table(spark, sf_dir, "embeddings").select(F.slice("embedding", 1, 3).alias("l"), (F.col("label") % 3).alias("y"))
    return rounded(sentiment.accuracy(e, "l", "y"), "accuracy")


@register("""
    SELECT vec_id, round((exp(l[3] - m) - exp(l[1] - m)) / (exp(l[1] - m) + exp(l[2] - m) + exp(l[3] - m)), 6) AS score,
      ['negative', 'neutral', 'positive'][list_position(l, m)] AS label
    FROM (SELECT vec_id, l, list_max(l) AS m FROM (SELECT vec_id, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS l FROM embeddings))""")  # fmt: skip
def h8_sentiment_of_logits(spark, sf_dir):
    """H8 H9: softmax score and label."""
    classes = ["negative", "neutral", "positive"]
    logits = F.slice(F.col("embedding").cast("array<double>"), 1, 3)
    score, _ = texts.sentiment(logits, classes)
    return rounded(views.table(spark, sf_dir, "embeddings").select("vec_id", score.alias("score"), texts.label_of(logits, classes).alias("label")), "score")


@register("""
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts - to_minutes(event_id % 50) WHEN 1 THEN ts - to_hours(event_id % 30) WHEN 2 THEN ts - to_days(CAST(event_id % 9 AS INT)) ELSE ts::DATE::TIMESTAMP END AS t,
      CASE WHEN event_id % 6 = 0 THEN NULL ELSE date_trunc('second', ts) END AS compact, value AS number, ts::DATE AS day FROM events""", days=("day",))  # fmt: skip
def h17_parsed_times(spark, sf_dir):
    """Relative, compact, ISO and strict forms read back."""
    e = views.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    n = F.col("event_id")
    ago = lambda k, unit: F.concat((n % k).cast("string"), F.lit(f" {unit} ago"))
    said = F.when(n % 4 == 0, ago(50, "minutes")).when(n % 4 == 1, ago(30, "hours")).when(n % 4 == 2, ago(9, "days")).otherwise(F.to_date("ts").cast("string"))
    compact = F.when(n % 6 == 0, "20240199T0000").otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss"))
    return e.select(
        "event_id",
        times.relative_time(said, F.col("ts")).alias("t"),
        times.parse_compact(compact).alias("compact"),
        texts.number(F.col("value").cast("string")).alias("number"),
        times.parse_day(F.to_date("ts").cast("string")).alias("day"),
    )


@register("""
    SELECT page_id, regexp_extract(html, '(?s)<li>.*?href="([^"]*)"', 1) AS link, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title,
      trim(regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)) AS description, TIMESTAMP '2024-03-01' - to_days(CAST(page_id % 9 AS INT)) AS published_at FROM pages""")  # fmt: skip
def h18_page_records(spark, sf_dir):
    """Link, title, description and date of each page, all between marks."""
    said = F.concat(F.lit("<i>"), (F.col("page_id") % 9).cast("string"), F.lit(" days ago</i>"), "html")
    rules = {
        "link": ("<li>", 1, 'href="', '"'), "title": ("<head>", 1, "<title>", "</title>"),
        "description": ("<article>", 1, "<h1>", "</h1>"), "said": ("<i>", 1, "", "</i>"),
    }
    found = files.page_record(views.table(spark, sf_dir, "pages").withColumn("item", said), "item", rules)
    now = F.lit(datetime(2024, 3, 1))
    filled = {c: F.coalesce(c, F.lit("")) for c in ("link", "title", "description")}
    return found.withColumns(filled).select("page_id", *filled, times.relative_time(F.col("said"), now).alias("published_at"))


@register("""
    SELECT page_id, lower(tag) AS tag, trim(regexp_replace(t, '<[^>]*>', '', 'g')) AS text FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(h[1-3])\\b[^>]*>(.*?)</h[1-3]>', 1)) AS tag,
        unnest(regexp_extract_all(html, '(?is)<(h[1-3])\\b[^>]*>(.*?)</h[1-3]>', 2)) AS t FROM pages)""")  # fmt: skip
def h20_headings(spark, sf_dir):
    """H20."""
    return views.table(spark, sf_dir, "pages").select("page_id", F.explode(texts.headings(F.col("html"))).alias("h")).select("page_id", "h.*")


@register("""
    SELECT doc_id, block, array_to_string(s[1 + block * 3 : 3 + block * 3], '|') AS items FROM (
      SELECT doc_id, list_slice(l, 2, len(l) - 1) AS s, unnest(range((len(l) - 2) // 3)) AS block FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) > 2)""")  # fmt: skip
def w14_line_blocks(spark, sf_dir):
    """Lines in blocks of three after trimming one at either end."""
    lines = views.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value"))
    found = series.sequence_blocks(lines, ["doc_id"], "pos", 3, head=1, tail=1)
    return found.select("doc_id", F.col("block").cast("long").alias("block"), F.array_join("items", "|").alias("items"))


@register(sql.with_views("SELECT asset_id, ts, round(volatility_20d, 6) AS volatility_20d, round(ln(lead(\"close\") OVER (PARTITION BY asset_id ORDER BY ts) / \"close\"), 6) AS target_return FROM seeds", True))
def w3_volatility(spark, sf_dir):
    """W1 W2 W3."""
    c = series.rolling_std(series.percent_change(views.candles(spark, sf_dir)), "change", "volatility_20d")
    return rounded(series.next_log_return(c).select("asset_id", "ts", "volatility_20d", "target_return"), "volatility_20d", "target_return")


@register("SELECT 'A' || (CAST(left(o_orderpriority, 1) AS INT) - 1) AS asset_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, count(*) AS count FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def w12_duplicate_times(spark, sf_dir):
    """Days that an asset's raw orders have several times."""
    asset = F.concat(F.lit("A"), (F.left("o_orderpriority", F.lit(1)).cast("int") - 1).cast("string")).alias("asset_id")
    return series.duplicate_times(views.table(spark, sf_dir, "orders").select(asset, F.date_trunc("DAY", F.col("o_orderdate").cast("timestamp")).alias("ts")))


@register(sql.with_views("""
    SELECT 'read' AS name, count(*) AS n FROM news UNION ALL SELECT 'without_url', count_if(url IS NULL) FROM news
    UNION ALL SELECT 'saved', count(*) FROM news WHERE ordinal % 3 <> 1 UNION ALL SELECT 'with_text', count_if(trim(headline) <> '' OR trim(summary) <> '') FROM news WHERE ordinal % 3 <> 1"""))  # fmt: skip
def d21_scoring_counters(spark, sf_dir):
    """Rows read, skipped and saved by one scoring run, counted while it runs."""
    n = views.news(spark, sf_dir).withColumn("article_id", F.concat(F.lit("n"), F.col("ordinal").cast("string")))
    done = views.scored_news(spark, sf_dir).filter(F.substring("article_id", 2, 20).cast("long") % 3 == 1)
    n, read = counters.counted(n, "read", without_url=F.col("url").isNull())
    todo, fresh = counters.counted(sentiment.unscored(n, done), "saved", with_text=F.trim("text") != "")
    todo.write.parquet(scratch(spark, "unscored"))
    return spark.createDataFrame([(k, int(v)) for seen in (read, fresh) for k, v in seen.get.items()], "name string, n long")


@register(sql.with_views("SELECT ordinal, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ordinal) AS k FROM news) WHERE url IS NULL OR k = 1"))
def w10_first_by_url(spark, sf_dir):
    """W10."""
    return keys.keep_first_by_url(views.news(spark, sf_dir)).select("ordinal", "url")


@register("SELECT doc_id, lang || '. ' || source || ' ' || text AS text, CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END AS label FROM documents JOIN labels USING (doc_id)")
def p1_labelled_texts(spark, sf_dir):
    """P1 H21 B13."""
    d = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id").withColumn("q", F.col("quality").cast("string"))
    found = datasets.labelled_texts(d.withColumn("lang", F.concat(F.col("doc_id").cast("string"), F.lit("\t"), "lang")), ("lang", "source", "text"), "q", {"1": "good", "0": "bad"})
    return found.select(F.split_part("text", F.lit("\t"), F.lit(1)).cast("long").alias("doc_id"), F.substring("text", F.instr("text", "\t") + 1, F.length("text")).alias("text"), "label")


@register("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id || '7'), doc_id) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part FROM documents")
def p2_split(spark, sf_dir):
    """Exact seeded split."""
    return datasets.split(views.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.8, 7)


@register("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'ERRO' WHEN length(text) > 1000 THEN 'long' ELSE 'short' END AS label FROM documents")
def p3_classified_texts(spark, sf_dir):
    """A Python classifier with row errors as labels."""
    classify = lambda: lambda t: "long" if len(t) > 1000 else "short" if t else 1 / 0
    return sentiment.classify_text(views.table(spark, sf_dir, "documents").select("doc_id", "text"), classify).select("doc_id", "label")
