"""Operators on small frames with known results."""

import json
import math
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.functions import texts, times
from ledgerline.operators import counters, datasets, keys, quality, sentiment, series, validate
from ledgerline.plans import pipelines
from ledgerline.sources import files, tables
from ledgerline.streaming import ingest


def at(day, hour=0, minute=0):
    return datetime(2024, 1, day, hour, minute)


def candles(spark, rows, asset="A"):
    return spark.createDataFrame([(asset, *r) for r in rows], "asset_id string, ts timestamp, open double, high double, low double, close double, volume long")


NEWS = "asset_id string, article_id string, published_at timestamp, headline string, summary string, source string, url string, language string, ordinal long"


def news(spark, rows):
    return spark.createDataFrame([("A", None, t, "h", "s", "src", f"https://x/{u}" if u else None, "en", i) for i, (u, t) in enumerate(rows)], NEWS)


@pytest.fixture
def bars(spark):
    return candles(spark, [(at(1), 100.0, 101.0, 99.0, 100.0, 10), (at(2), 101.0, 102.0, 99.0, 101.0, 11), (at(3), 102.0, 103.0, 100.0, 102.0, 12)])


@pytest.fixture
def daily(spark):
    return spark.createDataFrame([("A", date(2024, 1, 1), 0.2, 2, 0.1), ("A", date(2024, 1, 2), -0.1, 1, 0.2)], schemas.DAILY_SENTIMENT)


@pytest.fixture
def reports(spark):
    return spark.createDataFrame([("A", "annual", date(2023, 12, 31), date(2024, 1, 1), 1000.0, 200.0, 150.0, 300.0, 400.0, "x")], schemas.FUNDAMENTALS)


def test_assembly(spark, bars, daily, reports):
    wide = spark.createDataFrame([("A", at(1), 1.0)], "asset_id string, ts timestamp, rsi_14 double")
    out = pipelines.checked_training_table(bars, wide, daily, reports, date(2024, 1, 1), date(2024, 1, 3), lookback_days=30).orderBy("ts").collect()
    assert [r.time_idx for r in out] == [0, 1] and [r.day_of_week for r in out] == [0, 1]
    assert [r.sentiment_score for r in out] == [0.2, -0.1] and [r.rsi_14 for r in out] == [1.0, None]
    assert [r.revenue for r in out] == [1000.0, 1000.0] and out[0].target_return == pytest.approx(math.log(1.01))
    cut = pipelines.training_table(bars, wide, daily, reports, date(2024, 1, 1), date(2024, 1, 3)).collect()
    assert [r.revenue for r in cut] == [None, None]
    none = pipelines.training_table(bars, wide, daily.limit(0), reports.limit(0), date(2024, 1, 1), date(2024, 1, 2)).collect()
    assert len(none) == 1 and none[0].sentiment_score is None and none[0].revenue is None
    with pytest.raises(ValueError, match="no asset has two bars"):
        pipelines.checked_training_table(bars, wide, daily, reports, date(2024, 1, 1), date(2024, 1, 1))
    with pytest.raises(Exception, match="several bars"):
        pipelines.checked_training_table(bars.union(bars), wide, daily, reports, date(2024, 1, 1), date(2024, 1, 3)).collect()


def test_recurrences_of_length_one_with_nulls_and_over_blocks(spark):
    rows = [("A", at(1) + timedelta(days=i), float(i % 7)) for i in range(900)] + [("B", at(1) + timedelta(days=i), None if i == 4 else 1.0 * i) for i in range(6)]
    specs = [series.Ema.of("one", "x", 1), series.Ema.of("three", "x", 3), series.Ema.of("many", "x", 400)]
    got = series.ema_family(spark.createDataFrame(rows, "asset_id string, ts timestamp, x double"), specs).orderBy("asset_id", "ts").collect()
    a, b = got[:900], got[900:]
    assert [r.one for r in a] == [r.x for r in a] and [r.one for r in b] == [0, 1, 2, 3, None, None]
    for name, n in (("three", 3), ("many", 400)):
        v, want = None, []
        for i, r in enumerate(a):
            v = sum(q.x for q in a[: i + 1]) / n if i == n - 1 else v + 2 / (n + 1) * (r.x - v) if i >= n else None
            want.append(v)
        assert [r[name] for r in a] == pytest.approx(want)
    assert [r.three for r in b] == [None, None, 1.0, 2.0, None, None] and {r.many for r in b} == {None}


def test_audit_of_absent_tables_and_dtypes(spark, bars, tmp_path):
    rows = quality.audit({"candles": bars, "news_raw": None}).collect()
    found = {(r.table, r.section, r.name): r.value for r in rows}
    assert found["news_raw", "table", "missing"] == 1 and found["candles", "size", "rows"] == bars.count()
    assert found["candles", "dtype", "close double"] == float(dict(bars.dtypes)["close"] != "double") and found["candles", "column", "asset_id"] == 0
    assert [tuple(r) for r in quality.audit({"candles": None}).select("table", "name").collect()] == [("candles", "missing")]
    with pytest.raises(ValueError, match="no tables"):
        quality.audit({})
    assert not files.report_exists(spark, str(tmp_path / "reports"), "candles")


def test_training_sink(spark, bars, daily, reports, tmp_path):
    path = str(tmp_path / "training")
    out = pipelines.training_table(bars, spark.createDataFrame([], "asset_id string, ts timestamp, rsi_14 double"), daily, reports, date(2024, 1, 1), date(2024, 1, 3))
    tables.write_training(out, path)
    assert tables.training(spark, path, ["A"]).count() == out.count() and "rsi_14" in tables.training(spark, path).columns
    with pytest.raises(ValueError, match="missing columns: target_return"):
        tables.write_training(out.drop("target_return"), path)
    with pytest.raises(ValueError, match="nothing to write"):
        tables.write_training(out.limit(0), path)


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([("A", date(2024, 1, d)) for d in (1, 5, 9)] + [("B", date(2024, 1, 5))], "asset_id string, d date")
    right = spark.createDataFrame(
        [("A", date(2024, 1, 5), "annual", 1.0, 1.0), ("A", date(2024, 1, 5), "quarterly", 2.0, None), ("A", None, "annual", 9.0, 9.0)],
        "asset_id string, k date, t string, x double, y double",
    )
    out = series.asof_backward(left, right, "d", "k", ["x", "y"], ["t"]).orderBy("asset_id", "d").collect()
    assert [(r.x, r.y) for r in out] == [(None, None), (2.0, None), (2.0, None), (None, None)]


def test_indicators_of_linear_and_flat_series(spark):
    start = datetime(2024, 1, 1)
    linear = [(start + timedelta(days=i), 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, 1000) for i in range(250)]
    out = series.indicators(candles(spark, linear)).orderBy("ts").collect()
    assert len(out) == 51 and out[0].rsi_14 == pytest.approx(100)
    assert out[0].ema_200 == pytest.approx(sum(range(10, 210)) / 200) and out[-1].ema_10 == pytest.approx(259 - 4.5)
    flat = [(t, 5.0, 5.0, 5.0, 5.0, 1) for t, *_ in linear]
    assert series.indicators(candles(spark, flat)).count() == 0


def test_recurrence_across_blocks_and_assets(spark):
    xs = [math.sin(i) * 50 + i % 7 for i in range(1500)]
    rows = [(a, datetime(2020, 1, 1) + timedelta(days=i), x * (1 if a == "A" else 3)) for a in "AB" for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "asset_id string, ts timestamp, x double")
    got = {(r.asset_id, r.ts): r for r in series.ema_family(df, [series.Ema.of("e", "x", 20), series.Ema("w", "x", 14, 1 / 14, 1), series.Ema.of("long", "x", 400)]).collect()}
    for asset, k in (("A", 1), ("B", 3)):
        for name, length, alpha, first in (("e", 20, 2 / 21, 0), ("w", 14, 1 / 14, 1), ("long", 400, 2 / 401, 0)):
            seed, v = first + length - 1, None
            for i, x in enumerate(xs):
                x *= k
                if i == seed:
                    v = k * sum(xs[first : seed + 1]) / length
                elif i > seed:
                    v = alpha * x + (1 - alpha) * v
                value = got[asset, datetime(2020, 1, 1) + timedelta(days=i)][name]
                assert value is None if v is None else value == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_scaler(spark):
    df = spark.createDataFrame([("A", at(1), 1.0, 5.0), ("A", at(2), 3.0, 5.0), ("A", at(3), None, 5.0)], "asset_id string, ts timestamp, x double, y double")
    fitted = series.fit_scaler(df, ["x", "y"])
    out = series.scale(df, fitted, ["x", "y"]).orderBy("ts").collect()
    assert [r.x for r in out] == [-1.0, 1.0, None] and [r.y for r in out] == [0.0] * 3
    early = series.fit_scaler(df, ["x"], fit_until=at(1)).collect()[0]
    assert (early["mean"], early["std"]) == (1.0, 0.0)
    assert series.scale(df, fitted.filter("feature = 'y'"), ["x"]).orderBy("ts").first().x == 1.0


def test_overlap_and_resume(spark):
    first = news(spark, [(1, at(1)), (2, at(1, 0, 1)), (3, at(1, 0, 1))])
    second = news(spark, [(2, at(1, 0, 1)), (3, at(1, 0, 1)), (4, at(1, 0, 2)), (5, at(1, 0, 3)), (None, at(1, 0, 4)), (None, at(1, 0, 4))])
    fresh = pipelines.incremental_news(first, second)
    assert sorted(str(r.url) for r in fresh.collect()) == ["None", "None", "https://x/4", "https://x/5"]
    assert pipelines.incremental_news(first.limit(0), first).count() == 3


def test_upserts(spark):
    a = spark.createDataFrame([("A", "1", 0.1, 0), ("A", None, 0.5, 1)], "asset_id string, id string, v double, ordinal long")
    b = spark.createDataFrame([("A", "1", 0.7, 0), ("A", "1", 0.9, 1), ("B", "1", 0.3, 2), ("A", None, 0.6, 3)], a.schema)
    out = {(r.asset_id, r.id): r.v for r in keys.upsert(a.drop("ordinal"), b, ["asset_id", "id"]).collect()}
    assert out == {("A", "1"): 0.9, ("B", "1"): 0.3, ("A", None): 0.6}


def test_tables_round_trip_and_merge(spark, tmp_path):
    path, staging = str(tmp_path / "news"), str(tmp_path / "staging")
    batch = tables.with_article_id(news(spark, [(1, at(1)), (2, at(2))]))
    for _ in range(2):  # a repeated merge changes nothing
        tables.merge(spark, path, batch, schemas.NEWS, schemas.KEYS["news"], staging)
    assert tables.news(spark, path, ["A"], at(2), at(2)).count() == 1 and tables.news(spark, path).count() == 2
    other = batch.withColumn("asset_id", F.lit("B"))
    tables.merge(spark, path, other, schemas.NEWS, schemas.KEYS["news"], staging)
    assert tables.news(spark, path).count() == 4
    with pytest.raises(ValueError, match="nothing"):
        tables.write(batch.limit(0), path, schemas.NEWS)
    with pytest.raises(ValueError, match="missing columns: low"):
        validate.conform(batch.withColumn("ts", F.col("published_at")).withColumns({c: F.lit(1) for c in ("open", "high")}).withColumn("close", F.lit(1)).withColumn("volume", F.lit(1)), schemas.CANDLES)
    with pytest.raises(Exception, match="blank article_id"):
        tables.with_article_id(news(spark, [(None, at(1))])).collect()


def test_streamed_ingest(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), str(tmp_path / "table")
    for rows in ([(1, at(1)), (2, at(2)), (2, at(2))], [(2, at(2)), (3, at(3))]):
        news(spark, rows).withColumn("language", F.lit(None).cast("string")).write.mode("append").parquet(landing)
        ingest.stream_news(spark, landing, table, str(tmp_path / "state"), str(tmp_path / "staging")).awaitTermination()
    found = tables.news(spark, table).collect()
    assert sorted(r.url for r in found) == [f"https://x/{i}" for i in (1, 2, 3)] and {r.language for r in found} == {"en"}


def test_news_payloads(spark):
    feed = [
        {"time_published": "20100105T1150", "title": "a ", "summary": "b", "source": "s", "url": "https://x/1"},
        {"time_published": "20100105T120030", "title": " ", "summary": "", "source": "", "url": None},
        {"time_published": "soon", "title": "x"}, {"title": "no time"}, "no object",
    ]
    df = spark.createDataFrame([("A", json.dumps({"feed": feed[:4]})), ("B", json.dumps({"feed": []})), ("C", "broken")], "asset_id string, payload string")
    rows = files.news_feed(df).orderBy("published_at").collect()
    assert [r.article_id for r in rows] == ["https://x/1", "20100105T120030: "] and rows[0].language == "en"
    assert (rows[1].headline, rows[1].summary, rows[1].source) == (" ", " ", "alpha_vantage") and rows[0].headline == "a"
    items = json.dumps([{"datetime": 86400, "headline": "h", "url": "u"}, {"headline": "x"}, {"datetime": 1, "id": 7}])
    rows = files.news_items(spark.createDataFrame([("A", items)], "asset_id string, payload string"), limit=2).collect()
    assert [(r.article_id, r.published_at, r.source) for r in rows] == [("u", datetime(1970, 1, 2), "finnhub")]


def test_statement_merge(spark):
    row = lambda kind, payload: ("A", kind, json.dumps(payload))
    df = spark.createDataFrame(
        [
            row("income", {"annualReports": [{"fiscalDateEnding": "2023-12-31", "totalRevenue": "5", "netIncome": "None"}, {"fiscalDateEnding": "2023-12-31", "totalRevenue": None, "netIncome": "2"}]}),
            row("balance", {"annualReports": [{"fiscalDateEnding": "2022-12-31", "totalLiabilities": "nan"}]}),
            row("earnings", {"annualEarnings": [{"fiscalDateEnding": "2021-12-31", "reportedDate": "2022-02-01"}, {"fiscalDateEnding": "2021-12-31", "reportedDate": "bad"}, {"fiscalDateEnding": "x"}]}),
        ],
        "asset_id string, kind string, payload string",
    )
    out = {r.fiscal_date_end.year: r for r in files.fundamentals(df).collect()}
    assert sorted(out) == [2021, 2022, 2023]
    assert (out[2023].revenue, out[2023].net_income, out[2021].reported_date, out[2022].total_liabilities) == (None, 2.0, date(2022, 2, 1), None)


def test_landing_bars(spark):
    raw = spark.createDataFrame([("A", at(2, 5), 1.0, 2.0, 0.5, 1.5, 3.0)], "asset_id string, Date timestamp, Open_X double, High_X double, Low_X double, Close_X double, Volume_X double")
    r = files.landing_bars(raw).first()
    assert (r.ts, r.close, r.volume) == (at(2), 1.5, 3)
    with pytest.raises(ValueError, match="missing columns: volume"):
        files.landing_bars(raw.drop("Volume_X"))


def metrics(df, profile, **changes):
    p = quality.Profile(**(vars(quality.PROFILES[profile]) | changes))
    return {(r.section, r.name): r.value for r in quality.report(df, p, ()).collect()}


def test_quality_rules(spark):
    m = metrics(candles(spark, [(at(1), 10.0, 9.0, 11.0, 10.0, 100), (at(2), 10.0, 11.0, 9.0, 10.0, -1)]), "candles")
    assert all(m["rules", f"compare:{c}"] == 1 for c in ("high>=low", "high>=open", "high>=close", "low<=open", "low<=close"))
    assert m["rules", "range:volume"] == 1 and m["rules", "rows_with_violations"] == 2
    scored = spark.createDataFrame([("A", "1", at(1), 0.5, 0.5, "m"), ("A", "2", at(2), 2.0, 1.2, None)], schemas.SCORED_NEWS)
    m = metrics(scored, "scored_news")
    assert m["rules", "range:sentiment_score"] == m["rules", "between:confidence"] == m["rules", "not_null:model_name"] == 1
    types = spark.createDataFrame([("annual",), ("invalid",), (None,)], "report_type string")
    m = metrics(types, "fundamentals")
    assert m["rules", "in:report_type"] == 2 and m["missing_columns", "fiscal_date_end"] == 1


def test_quality_days_nulls_and_duplicates(spark):
    gap = candles(spark, [(at(d), 1.0, 1.0, 1.0, 1.0, 0) for d in (1, 2, 4)])
    m = metrics(gap, "candles", business_days=False)
    assert (m["dates", "missing_days"], m["dates", "gaps"], m["keys", "duplicate_rows"], m["zeros", "volume"]) == (1, 1, 0, 3)
    weekend = candles(spark, [(at(d), 1.0, 1.0, 1.0, 1.0, 1) for d in (5, 8)])
    assert metrics(weekend, "candles")["dates", "missing_days"] == 0
    assert metrics(weekend, "candles", business_days=False)["dates", "missing_days"] == 2
    assert quality.missing_days(weekend, "ts", ["asset_id"], False).count() == 2
    twice = candles(spark, [(at(1), float("nan"), None, 1.0, float("inf"), 1)] * 2 + [(at(2), 1.0, 1.0, 1.0, 1.0, 1)])
    m = metrics(twice, "candles")
    assert (m["per_day", "2024-01-01"], m["keys", "duplicate_rows"], m["nulls", "open"], m["nulls", "high"], m["nonfinite", "close"]) == (2, 1, 2, 2, 2)
    assert m["rules", "compare:high>=low"] == 2
    assert quality.dtype_mismatches(twice, {"open": "float", "volume": "bigint"}) == {"open": ("float", "double")}


def test_validators(spark):
    bad = [("", "1", at(1), "h", "s", "x", "u", "en"), ("A", "1", at(1), None, "s", " ", "https://u", "en_US"), ("A", "1", at(1), "h", "s", "x", None, "pt-BR")]
    df = spark.createDataFrame(bad, schemas.NEWS)
    found = [sorted(r.violations) for r in validate.violations(df, "news").collect()]
    assert found == [["asset_id", "url"], ["headline", "language", "source"], []]
    good, out = validate.split_valid(df, "news")
    assert (good.count(), out.count()) == (1, 2)
    with pytest.raises(Exception, match="news: "):
        validate.strict(df, "news").collect()
    sets = spark.createDataFrame([({"a": 1.0},), ({},), (None,)], "indicators map<string,double>")
    assert [len(r.violations) for r in validate.violations(sets, "indicator_sets").collect()] == [0, 1, 1]


def test_daily_sentiment_and_scoring(spark):
    rows = [("A", "a1", at(1, 9), 0.2, 0.1, "m"), ("A", "a2", at(1, 23), 0.6, 0.9, "m"), ("A", "a3", at(1), 0.4, None, None), ("A", "b", at(2), 1.0, None, None)]
    out = sentiment.daily_sentiment(spark.createDataFrame(rows, schemas.SCORED_NEWS)).orderBy("day").collect()
    assert (out[0].n_articles, out[1].sentiment_std) == (3, 0.0) and out[0].sentiment_score == pytest.approx(0.4)
    n = news(spark, [(i, at(i)) for i in (1, 2, 3)]).withColumn("article_id", F.col("url"))
    stored = spark.createDataFrame([("A", "https://x/1", at(1), 0.0, None, None), ("A", "https://x/3", at(3), 0.0, None, None)], schemas.SCORED_NEWS)
    got = sentiment.score_news(n, stored, sentiment.checksum_scorer, "checksum").withColumn("want", sentiment.checksum_score(F.lit("h s"))).collect()
    assert [r.article_id for r in got] == ["https://x/2"] and got[0].sentiment_score == pytest.approx(got[0].want)
    assert got[0].confidence == abs(got[0].sentiment_score)
    with pytest.raises(Exception, match="one score"):
        sentiment.score_text(n.select("headline"), lambda: lambda batch: [], "headline").collect()


def test_counters(spark, tmp_path):
    df, seen = counters.counted(spark.range(10).withColumnRenamed("id", "k"), "read", skipped=F.col("k") < 3)
    df.write.parquet(str(tmp_path / "out"))
    assert seen.get == {"read": 10, "skipped": 3}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(texts.symbol(F.lit("petr4.SA"))) == "PETR4"
    assert one(texts.scoring_text(F.lit(" a "), F.lit(None))) == "a" and one(texts.scoring_text(F.lit(" "), F.lit(""))) == " "
    assert [one(texts.number(F.lit(x))) for x in ("1.5", "None", "", "NaN", "x", "-")] == [1.5, None, None, None, None, None]
    assert one(texts.between(F.lit("k<b>1</b>k<b> 2 </b>"), "k", 2, "<b>", "</b>")) == "2"
    assert one(texts.between(F.lit("no"), "k", 1, "<b>", "</b>")) is None and one(texts.between(F.lit("k<b>1"), "k", 1, "<b>", "</b>")) is None
    assert one(texts.joined(F.lit("a"), F.lit("b"), F.lit("c"))) == "a. b c" and one(texts.joined(F.lit("a"), F.lit(None), F.lit("c"))) is None
    assert one(texts.label_of(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)), ["n", "m", "p"])) == "m"
    assert one(texts.sentiment(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), ["positive", "negative", "neutral"])[0]) == 0


def test_times(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(times.parse_instant(F.lit(x))) for x in ("2024-01-02", "2024-01-02T03:00:00Z", "2024-01-02T03:00:00+02:00", "x")] == [at(2), at(2, 3), at(2, 1), None]
    assert one(times.parse_compact(F.lit("20240102T0304"))) == at(2, 3, 4) and one(times.parse_compact(F.lit("2024"))) is None
    now = F.lit(at(5, 12))
    said = ("5 minutes ago", "an hour ago", "2 days ago", "2024-01-03", "whenever")
    assert [one(times.relative_time(F.lit(x), now)) for x in said] == [at(5, 11, 55), at(5, 11), at(3, 12), at(3), None]
    assert one(times.effective_day(F.lit(None).cast("date"), F.lit(date(2024, 1, 1)))) == date(2024, 2, 15)
    assert times.next_midnight(date(2022, 1, 5)) == date(2022, 1, 6)
    with pytest.raises(ValueError, match="no time zone"):
        times.utc_range(at(1), at(2))
    with pytest.raises(ValueError, match="is after"):
        times.utc_range(datetime(2024, 1, 2, tzinfo=UTC), datetime(2024, 1, 1, tzinfo=UTC))
    with pytest.raises(TypeError):
        times.require_instants(spark.sql("select timestamp_ntz'2024-01-01' t"), "t")


def test_datasets(spark, tmp_path):
    df = spark.range(1000).withColumnRenamed("id", "k")
    parts = {r.part: r["count"] for r in datasets.split(df, "k", 0.25, 3).groupBy("part").count().collect()}
    assert parts == {"train": 250, "test": 750}
    with pytest.raises(ValueError):
        datasets.split(df, "k", 1.0)
    t = spark.createDataFrame([("a", "b", "c", "0"), (None, "b", "c", "1"), ("x", "y", "z", "9")], "h string, s string, f string, y string")
    assert [tuple(r) for r in datasets.labelled_texts(t, ("h", "s", "f"), "y", {"0": "neg"}).collect()] == [("a. b c", "neg"), ("x. y z", "9")]
    lines = datasets.content_lines(spark.createDataFrame([(1, "a\n \n12\n•\n b ")], "i long, text string")).collect()
    assert [(r.pos, r.line) for r in lines] == [(0, "a"), (4, "b")]
    labelled = sentiment.classify_text(spark.createDataFrame([("ab",), ("",)], "text string"), lambda: lambda x: x[0])
    assert sorted(r.label for r in labelled.collect()) == ["ERRO", "a"]
    quality_rows = quality.report(t, quality.Profile("d", ["h"]), ())
    files.write_report(quality_rows, str(tmp_path / "r"), "candles", F.lit("2024"))
    assert spark.read.json(str(tmp_path / "r")).count() == quality_rows.count()
