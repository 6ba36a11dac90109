"""Long series, quartiles by selection, late news, renewed audits and guards against plain versions."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import long_series, quality, sentiment, series, validate
from ledgerline.plans import pipelines
from ledgerline.sources import audits, tables

DAY = dt.datetime(2024, 1, 1)


def bars(spark, sizes, seed=1, holes=()):
    """Daily closes of several assets, with nulls at the given rows of the first."""
    rng = random.Random(seed)
    rows = []
    for k, (asset, n) in enumerate(sizes.items()):
        price = 100.0
        for i in range(n):
            price = max(1.0, price + rng.uniform(-2, 2))
            close = None if k == 0 and i in holes else price
            rows.append((asset, DAY + dt.timedelta(days=i), price - 0.5, price + 1, price - 1, close))
    return spark.createDataFrame(rows, "asset_id string, ts timestamp, open double, high double, low double, close double").repartition(5)


def recurrence(x, spec):
    """The plain loop: seed, then alpha * x + (1 - alpha) * v; nothing from the first null on."""
    out, v, seed = [], None, spec.first + spec.length - 1
    for i, a in enumerate(x):
        gone = any(b is None for b in x[spec.first : i + 1])
        if i == seed and not gone:
            v = sum(x[spec.first : seed + 1]) / spec.length if spec.alpha < 1 else a
        elif i > seed and not gone:
            v = spec.alpha * a + (1 - spec.alpha) * v
        out.append(None if gone or i < seed else v)
    return out


SPECS = [
    series.Ema("a", "close", 3, 0.5), series.Ema("b", "close", 5, 0.95), series.Ema("c", "close", 4, 0.9999999), series.Ema("d", "close", 2, 1.0),
    series.Ema("e", "close", 10, 0.001), series.Ema.of("f", "close", 20, 2),
]


@pytest.mark.parametrize("holes", [(), (150,)])
@pytest.mark.parametrize("piece", [32, 97, 1 << 16])
def test_recurrences_in_pieces(spark, piece, holes):
    c = bars(spark, {"L": 400, "S": 7, "M": 97}, holes=holes)
    rows = long_series.in_pieces(long_series.numbered(c), piece=piece).filter("__own")
    got = long_series.ema_family(rows, SPECS, piece).toPandas()
    whole = series.ema_family(c, SPECS).toPandas()
    for frame in (got, whole):
        for _, g in frame.sort_values("ts").groupby("asset_id"):
            x = [None if pd.isna(v) else v for v in g["close"]]
            for s in SPECS:
                want = np.array([np.nan if v is None else v for v in recurrence(x, s)])
                np.testing.assert_allclose(g[s.name].to_numpy(float), want, rtol=1e-9, err_msg=s.name)


def test_numbers_and_halos(spark):
    c = bars(spark, {"L": 400, "S": 7})
    numbers = long_series.numbered(c, "n").toPandas().sort_values(["asset_id", "ts"])
    assert numbers["n"].tolist() == [*range(400), *range(7)]
    rows = long_series.in_pieces(long_series.numbered(c), before=3, after=2, piece=50).filter("asset_id = 'L'").toPandas()
    for p, g in rows.groupby("__piece"):
        own = range(p * 50, min(400, p * 50 + 50))
        want = [*range(max(0, p * 50 - 3), p * 50), *own, *range(p * 50 + 50, min(400, p * 50 + 52))]
        assert sorted(g["__rn"]) == [w for w in want if w < 400] and sorted(g.loc[g["__own"], "__rn"]) == list(own)
    with pytest.raises(ValueError, match="piece"):
        long_series.in_pieces(c, before=51, piece=50)


def test_long_series_equals_the_windows(spark):
    c = bars(spark, {"L": 900, "S": 210, "T": 30})
    order = ["asset_id", "ts"]
    pd.testing.assert_frame_equal(
        long_series.indicators(c, 256).toPandas().sort_values(order, ignore_index=True), series.indicators(c).toPandas().sort_values(order, ignore_index=True), rtol=1e-9
    )
    got = long_series.next_log_return(c, piece=64).toPandas().sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(got, series.next_log_return(c).toPandas().sort_values(order, ignore_index=True))


def test_one_asset_is_spread_over_tasks(spark):
    c = bars(spark, {"H": 2000})
    spread = long_series.in_pieces(long_series.numbered(c), before=20, piece=100)
    sizes = [r["count"] for r in spread.groupBy("asset_id", "__piece").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 120
    plan = long_series.indicators(c, 256)._jdf.queryExecution().optimizedPlan().toString()
    rows_by_asset = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition(asset_id" in line and "__piece" not in line and "__cell" not in line]
    assert not rows_by_asset


def test_asof_in_cells(spark):
    rng = random.Random(4)
    at = lambda: DAY + dt.timedelta(hours=rng.randrange(24 * 400))
    left = [(rng.choice(["H", "H", "H", "S", "N"]), at(), i) for i in range(400)] + [("H", None, 1000), (None, DAY, 1001)]
    right = [(rng.choice(["H", "S"]), at(), i, None if i % 3 else i) for i in range(40)]
    right += [(a, t, i + 100, v) for a, t, i, v in right[:10]] + [("H", None, 5000, 1), (None, DAY, 5001, 1)]
    x = spark.createDataFrame(left, "asset_id string, at timestamp, id long")
    y = spark.createDataFrame(right, "asset_id string, since timestamp, k long, v long")
    got = long_series.asof_backward(x, y, "at", "since", ["k", "v"], ["k"], "WEEK")
    assert got.columns == ["asset_id", "at", "id", "k", "v"]
    for a, t, i, k, v in got.collect():
        fine = [r for r in right if r[0] == a and a and t and r[1] and r[1] <= t]
        want = max(fine, key=lambda r: (r[1], r[2]))[2:] if fine else (None, None)
        assert (k, v) == want, (a, t, i)
    assert got.count() == len(left)


def test_asof_cuts_crowded_cells(spark):
    x = spark.range(6_000).select(F.lit("H").alias("asset_id"), (F.lit(DAY).cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 20)).alias("at"), "id")
    y = x.filter("id % 700 = 3").select("asset_id", F.col("at").alias("since"), F.col("id").alias("k"))
    got = long_series.asof_backward(x, y, "at", "since", ["k"], ["k"], piece=100).withColumn("task", F.spark_partition_id())
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {r.id: r.k for r in rows} == {i: None if i < 3 else (i - 3) // 700 * 700 + 3 for i in range(6_000)} and len(rows) == 6_000
    assert max(sum(r.task == n for r in rows) for n in {r.task for r in rows}) < 3_000  # two days of one asset in one month
    crowd = long_series._crowded(x.select("asset_id", F.col("at").alias("__at")), "MONTH", 100).collect()
    assert [c["__unit"] for c in crowd] == ["MINUTE"]
    assert [c["__unit"] for c in long_series._crowded(x.select("asset_id", F.col("at").alias("__at")), "MONTH", 200).collect()] == ["HOUR"]


def test_zero_and_missing_prices_have_no_return(spark):
    rows = [("A", DAY + dt.timedelta(days=i), p) for i, p in enumerate([1.0, 0.0, 2.0, None, 3.0, -3.0, -6.0])]
    c = spark.createDataFrame(rows, "asset_id string, ts timestamp, close double")
    got = [r.target_return for r in series.next_log_return(c).orderBy("ts").collect()]
    assert got == [None, None, None, None, None, math.log(2), None]


def test_alpha_is_bounded(spark):
    c = bars(spark, {"L": 3})
    for alpha in (0.0, -1.0, 1.5):
        with pytest.raises(ValueError, match="alpha"):
            series.ema_family(c, [series.Ema("x", "close", 2, alpha)])


def test_quartiles_by_selection(spark):
    rng = random.Random(2)
    groups = {"a'b": 3000, "b": 2501, "c": 4, "d": 1, None: 700}
    value = {"many": lambda: rng.randrange(5), "real": lambda: rng.gauss(0, 1e6), "one": lambda: 7, "gaps": lambda: rng.choice([None, float("nan"), 1.5, -2.0])}
    rows = [(g, *(f() for f in value.values())) for g, n in groups.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "`g.k` string, `it's` long, `x.y` double, `q``r` long, z double").repartition(6)
    got = {(r[0], r.section.removeprefix("summary:"), r.name): r.value for r in quality.quartiles(df, ["g.k"], small=100, accuracy=1000).collect()}
    names = dict(zip(value, ["it's", "x.y", "q`r", "z"], strict=True))
    frame = pd.DataFrame(rows, columns=["g", *value])
    n = 0
    for g in groups:
        own = frame[frame["g"].isna()] if g is None else frame[frame["g"] == g]
        for c, name in names.items():
            x = pd.to_numeric(own[c]).dropna()
            for q in (25, 50, 75):
                if len(x):
                    n += 1
                    assert got[g, name, f"{q}%"] == pytest.approx(x.quantile(q / 100), rel=1e-12), (g, c, q)
    assert len(got) == n


def test_report_with_any_column_name(spark):
    p = quality.Profile("the.day", ["k`y"], ranges={"it's": (0, None)}, rules=[{"rule": "in", "column": "a b", "values": ["x"]}], comparisons=[("it's", ">=", "x.y")])
    rows = [("g", dt.date(2024, 1, 1), 1, -1.0, 2.0, "x"), ("g", dt.date(2024, 1, 5), 1, 3.0, 2.0, None)]
    df = spark.createDataFrame(rows, "`as.set` string, `the.day` date, `k``y` long, `it's` double, `x.y` double, `a b` string")
    got = {(r.section, r.name): r.value for r in quality.report(df, p, ("as.set",)).filter("`as.set` is not null").collect()}
    assert got["rules", "range:it's"] == 1 and got["rules", "in:a b"] == 1 and got["rules", "compare:it's>=x.y"] == 1
    assert got["keys", "duplicate_rows"] == 1 and got["dates", "gaps"] == 1 and got["summary:x.y", "50%"] == 2 and got["summary:it's", "25%"] == 0


def test_moments_merge_in_any_order(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), DAY + dt.timedelta(hours=rng.randrange(96)), 1e6 + rng.random()) for _ in range(300)]
    scored = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "asset_id string, published_at timestamp, sentiment_score double, i long")
    parts = [sentiment.daily_moments(scored.filter(F.col("i") % 7 == k)) for k in (3, 0, 6, 1, 5, 2, 4)]
    merged = parts[0]
    for p in parts[1:4]:
        merged = sentiment.merged_moments(merged.unionByName(p))
    merged = sentiment.merged_moments(merged.unionByName(parts[4]).unionByName(parts[5]).unionByName(parts[6]))
    got = sentiment.sentiment_of(merged).toPandas().sort_values(["asset_id", "day"], ignore_index=True)
    want = sentiment.daily_sentiment(scored).toPandas().sort_values(["asset_id", "day"], ignore_index=True)
    pd.testing.assert_frame_equal(got, want, rtol=1e-9)
    assert got["n_articles"].sum() == 300


def test_late_articles_leave_other_days_alone(spark, tmp_path):
    day = lambda *xs: spark.createDataFrame([("a", DAY + dt.timedelta(days=d), s) for d, s in xs], "asset_id string, published_at timestamp, sentiment_score double")
    path, staging = f"{tmp_path}/moments", f"{tmp_path}/staging"
    for batch in (day((0, 0.2), (1, 0.5)), day((0, 0.4)), day((2, None), (1, -0.5))):
        pipelines.add_scored_news(spark, path, batch, staging)
    got = sentiment.sentiment_of(tables.scan(spark, path, schemas.DAILY_MOMENTS)).orderBy("day").collect()
    assert [(r.n_articles, round(r.sentiment_score, 9), round(r.sentiment_std, 9)) for r in got] == [(2, 0.3, 0.1), (2, 0.0, 0.5)]
    with pytest.raises(ValueError, match="nothing"):
        pipelines.add_scored_news(spark, path, day().limit(0), staging)


def test_audit_reads_changed_assets_only(spark, tmp_path):
    path, state = f"{tmp_path}/table", f"{tmp_path}/state"
    c = bars(spark, {"007": 30, "b+c": 20, "d": 10}).withColumn("volume", F.lit(1).cast("long"))
    tables.write(c, path, None, ("ts",))
    first, read = audits.audit_changed(spark, path, "candles", state)
    assert {r[0] for r in read.collect()} == {"007", "b+c", "d"}
    assert {r.asset_id: r.value for r in first.filter("section = 'size' and name = 'rows'").collect()} == {"007": 30, "b+c": 20, "d": 10}
    assert audits.audit_changed(spark, path, "candles", state)[1].count() == 0
    tables.write(c.filter("asset_id = 'b+c'").limit(5), path, None, ("ts",))
    again, read = audits.audit_changed(spark, path, "candles", state)
    assert [r[0] for r in read.collect()] == ["b+c"]
    want = quality.report(spark.read.parquet(path).select(*c.columns).withColumn("asset_id", F.col("asset_id").cast("string")), "candles")
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.filter("asset_id = 'b+c'").select("section", "name", F.round("value", 9)).collect())))
    assert rows(again) == rows(want)


def test_guards_of_scans_and_merges(spark, tmp_path):
    path = f"{tmp_path}/candles"
    c = bars(spark, {"a": 3}).withColumn("volume", F.lit(1).cast("long"))
    tables.write(c, path, schemas.CANDLES, ("ts",))
    assert [r.ts for r in tables.candles(spark, path, ordered=True).collect()] == [DAY + dt.timedelta(days=i) for i in range(3)]
    with pytest.raises(ValueError, match="after"):
        tables.candles(spark, path, start=DAY, end=DAY - dt.timedelta(days=1))
    tables.write(c.unionByName(c.limit(1)), path, schemas.CANDLES, ("ts",))
    with pytest.raises(Exception, match="several bars"):
        tables.candles(spark, path, ordered=True).collect()
    with pytest.raises(Exception, match="several bars"):
        series.rising_times(c.unionByName(c)).collect()
    with pytest.raises(TypeError, match="timestamp"):
        tables.between(c.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", DAY, None)
    with pytest.raises(ValueError, match="nothing"):
        tables.merge(spark, path, c.withColumn("ordinal", F.lit(0)).limit(0), schemas.CANDLES, schemas.KEYS["candles"], f"{tmp_path}/staging")
    assert validate.quoted("a`b.c") == "`a``b.c`"
