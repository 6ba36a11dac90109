"""Stateful ingest, quarantined payloads, budgeted batches, files and versions."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline import schemas
from ledgerline.operators import sentiment
from ledgerline.plans import pipelines, queries, views
from ledgerline.sources import digests, files, tables, versions
from ledgerline.streaming import fresh

DAY0 = datetime(2024, 1, 1)


def landing_rows(spark, rows):
    """(asset, id, hours, url, ordinal) as news."""
    full = [(a, i, DAY0 + timedelta(hours=h), "h", None, "s", u, None, o) for a, i, h, u, o in rows]
    return spark.createDataFrame(full, fresh.LANDING)


def test_stateful_stream_over_overlap_late_rows_and_restart(spark, tmp_path):
    landing, path, state = (str(tmp_path / n) for n in ("landing", "fresh", "state"))
    first = [("A", "1", 0, "u1", 1), ("A", "2", 70, "u2", 3), ("A", "2b", 70, "u2", 2), ("B", "3", 72, None, 4), ("A", "9", 72, "u9", 9)]
    second = [
        ("A", "2", 71, "u2", 5),  # overlap: known
        ("B", "2", 71, "u2", 6),  # another asset
        ("B", "3", 72, None, 7),  # known by its id
        ("A", "0", 40, "u0", 8),  # late
        ("A", "1", 0, "u1", 9),  # late and no longer known
        ("A", "4", 50, "u4", 10),  # old, but within the delay
        ("A", "5", 90, "u5", 12), ("A", "5", 90, "u5", 11),
    ]
    third = [("A", "2", 170, "u2", 20), ("A", "6", 200, "u6", 21)]  # u2 has been forgotten, its row isn't late
    for rows in (first, second, [], third, third):
        if rows:
            landing_rows(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        fresh.stream_fresh_news(spark, landing, path, state).awaitTermination()  # a restart each
    got = sorted((r.asset_id, r.article_id, r.url) for r in tables.news(spark, path).collect())
    want = [("A", "1", "u1"), ("A", "2b", "u2"), ("B", "3", None), ("A", "9", "u9"), ("B", "2", "u2"), ("A", "4", "u4"), ("A", "5", "u5"), ("A", "2", "u2"), ("A", "6", "u6")]
    assert got == sorted(want, key=lambda r: r[:2])
    assert {r.language for r in tables.news(spark, path).collect()} == {"en"}


def test_stream_equals_the_batch_form_where_no_row_is_between(spark, tmp_path):
    landing, path, state = (str(tmp_path / n) for n in ("landing", "fresh", "state"))
    stored = landing_rows(spark, [(a, f"{a}{h}", h, f"{a}{h}", h) for a in "AB" for h in range(49)])
    more = landing_rows(spark, [(a, f"{a}{h}", h, f"{a}{h // 2 * 2}", h) for a in "AB" for h in range(48, 60)])
    want = pipelines.incremental_news(stored, more).select("asset_id", "url", "ordinal")
    for part in (stored, more):
        part.write.mode("append").parquet(landing)
        fresh.stream_fresh_news(spark, landing, path, state).awaitTermination()
    got = spark.read.parquet(path).filter("ordinal > 48").select("asset_id", "url", "ordinal")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 10


def test_a_second_batch_run_adds_no_row_that_the_first_passed_over(spark, tmp_path):
    path, staging = str(tmp_path / "news"), str(tmp_path / "staging")
    stored = [("A", "a", 0, "u", 1), ("B", "b", 0, "v", 2), ("C", "c", 0, None, 3)]
    tables.write(landing_rows(spark, stored), path, schemas.NEWS)
    rows = [*stored, ("B", "b1", 1, "w", 4), ("B", "b2", 60, None, 5), ("A", "a1", 61, "w", 6), ("A", "a2", 60, None, 7), ("A", "a3", 62, "u", 8), ("C", "c1", 50, "x", 9), ("C", "c2", 50, "x", 10)]
    once = {"a", "b", "c", "b1", "b2", "a2", "c1"}  # w came first in B, u is stored near A's mark
    for _ in range(3):
        pipelines.ingest_news(spark, path, landing_rows(spark, rows), staging)
        assert {r.article_id for r in tables.news(spark, path).collect()} == once
    later = [*rows, ("A", "a4", 63, "w", 11), ("C", "c3", 51, None, 12)]  # w again, at another time
    assert {r.article_id for r in pipelines.ingest_news(spark, path, landing_rows(spark, later), staging).collect()} >= {"a4", "c3"}
    pipelines.ingest_news(spark, path, landing_rows(spark, later), staging)
    assert {r.article_id for r in tables.news(spark, path).collect()} == once | {"a4", "c3"}


def test_a_merge_computes_its_batch_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    rows = landing_rows(spark, [("A", "a", 1, "u", 1), ("B", "b", 1, None, 2)]).coalesce(1)
    batch = rows.mapInArrow(counted, rows.schema)
    root, path = str(tmp_path / "versions"), str(tmp_path / "news")
    tables.write(rows, path, schemas.NEWS)
    versions.write(spark, root, rows, schemas.NEWS)
    tables.merge(spark, path, batch, schemas.NEWS, schemas.KEYS["news"], str(tmp_path / "staging"))
    assert calls.value == 2
    versions.merge(spark, root, batch, schemas.NEWS, schemas.KEYS["news"])
    assert calls.value == 4 and versions.read(spark, root, schemas.NEWS).count() == 2
    versions.forget(spark, root)
    assert not tables.exists(spark, f"{root}/staged") and versions.read(spark, root, schemas.NEWS).count() == 2


def test_reports_join_their_lines_once(spark, sf_dir):
    plan = views.fundamentals(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_an_audit_reads_the_large_tables_for_their_own_views_only(spark, sf_dir, monkeypatch):
    read = {}

    def saved(df, name):
        read[name] = {t for t in ("orders", "lineitem", "events") if any(f.endswith(f"/{t}.parquet") for f in df.inputFiles())}
        return spark.createDataFrame([], df.schema)

    monkeypatch.setattr(queries, "saved", saved)
    assert len(queries._audited(spark, sf_dir)) == len(read) == 7
    assert {n: t for n, t in read.items() if t} == {"candles": {"orders"}, "news_raw": {"events"}, "scored_news": {"events"}, "fundamentals": {"orders", "lineitem"}}


def test_stream_refuses_rows_without_key(spark, tmp_path):
    landing_rows(spark, [("A", "", 1, None, 1)]).write.parquet(str(tmp_path / "landing"))
    with pytest.raises(Exception, match="without asset, time or key"):
        fresh.stream_fresh_news(spark, str(tmp_path / "landing"), str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()


def test_quarantine_adds_up(spark):
    feed = [{"time_published": "20100105T1150", "title": "a", "url": "https://x/1"}, "text", None, 5, [], {"time_published": "soon"}, {"title": 3}]
    payloads = [
        json.dumps({"feed": feed}), '{"feed": [', None, "", '{"feed": {"a": 1}}', '{"feed": null}', "[]", '{"feed": []}',
        '{"feed": [{"title": "a", "title": "b"}]}',
    ]
    df = spark.createDataFrame([("A", n, p) for n, p in enumerate(payloads)], "asset_id string, no int, payload string")
    good, bad, counts = files.split_outcomes(files.feed_outcomes(df, by=("asset_id", "no")), ("asset_id", "no"))
    assert [(r.no, r.ordinal, r.article_id) for r in good.collect()] == [(0, 0, "https://x/1")]
    found = {(r.no, r.ordinal): (r.reason, r.raw) for r in bad.collect()}
    assert {k: v[0] for k, v in found.items()} == {
        (0, 1): "no object", (0, 2): "no object", (0, 3): "no object", (0, 4): "no object", (0, 5): "no time", (0, 6): "no time",
        (1, None): "unreadable", (2, None): "no payload", (3, None): "unreadable", (4, None): "no list", (5, None): "no list", (6, None): "no list",
        (8, None): "unreadable",
    }
    assert found[0, 1][1] == '"text"' and found[1, None][1] == '{"feed": [' and json.loads(found[0, 5][1]) == feed[5]
    assert sum(r.n for r in counts.collect()) == 1 + len(found)
    items = json.dumps([{"datetime": 1, "id": 7}, "x", {"datetime": "later"}, {"datetime": None}])
    df = spark.createDataFrame([("A", items), ("A", "x")], "asset_id string, payload string")
    assert {r.reason: r.n for r in files.split_outcomes(files.item_outcomes(df))[2].collect()} == {"fine": 1, "no object": 1, "no time": 2, "unreadable": 1}
    assert files.feed_outcomes(df.limit(0)).count() == 0


@given(st.lists(st.integers(0, 50)), st.integers(1, 8), st.one_of(st.none(), st.integers(1, 60)))
def test_batches_hold_each_text_once_within_bounds(sizes, most, budget):
    batches = list(sentiment.budgeted(sizes, most, budget))
    assert sorted(i for b in batches for i in b) == list(range(len(sizes))) and all(1 <= len(b) <= most for b in batches)
    if budget is None:
        assert [i for b in batches for i in b] == list(range(len(sizes)))
    else:
        assert all(len(b) == 1 or len(b) * max(sizes[i] for i in b) <= budget for b in batches)


def test_scores_stay_with_their_rows(spark):
    texts = ["x" * n for n in (5, 1, 900, 3, 0, 40)] + [None, "y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    found = sentiment.score_text(df, lambda: lambda b: [-1.0 if t is None else float(len(t)) for t in b], batch=3, budget=50).collect()
    assert [(r.i, r.sentiment_score) for r in found] == [(i, -1.0 if t is None else float(len(t))) for i, t in enumerate(texts)]
    with pytest.raises(ValueError, match="positive"):
        sentiment.score_text(df, lambda: None, budget=0)


def test_digests_of_files_larger_than_a_chunk(spark, tmp_path):
    (tmp_path / "x=1").mkdir()
    data = {"a": b"", "x=1/b": b"0123456789" * 100_001, "c c": b"x" * 4096, "_skipped": b"1", ".skipped": b"1"}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    df = digests.digests(spark, str(tmp_path), chunk=4096, share=5000)
    found = {r.path[len(str(tmp_path)) + 1 :]: (r.length, r.sha256) for r in df.collect()}
    assert found == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in data.items() if "skipped" not in n}
    assert df.rdd.getNumPartitions() > 1
    want = {r.path.split("/")[-1].replace("%20", " "): (r.length, r.sha256, r.modified) for r in files.provenance(spark, str(tmp_path)).collect()}
    got = {r.path.split("/")[-1]: (r.length, r.sha256, r.modified) for r in df.collect()}
    assert want and all(want[n][:2] == got[n][:2] and abs(want[n][2] - got[n][2]) < timedelta(seconds=1) for n in want)
    (tmp_path / "none").mkdir()
    assert digests.digests(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="positive"):
        digests.digests(spark, str(tmp_path), chunk=0)


def scores(spark, rows):
    full = [(a, i, DAY0, float(v), None, "m", n) for n, (a, i, v) in enumerate(rows)]
    return spark.createDataFrame(full, "asset_id string, article_id string, published_at timestamp, sentiment_score double, confidence double, model_name string, ordinal int")


def test_versions_stay_readable(spark, tmp_path):
    root, schema, key = str(tmp_path / "t"), schemas.SCORED_NEWS, schemas.KEYS["scored_news"]
    rows = lambda df: sorted((r.asset_id, r.article_id, r.sentiment_score) for r in df.collect())
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, root, schema)
    odd = "a/b =%é"
    assert versions.merge(spark, root, scores(spark, [("A", "1", 0.1), ("A", "2", 0.2), (odd, "1", 0.3), ("007", "1", 0)]), schema, key) == 1
    before = versions.read(spark, root, schema)
    first = rows(before)
    assert first == [("007", "1", 0.0), ("A", "1", 0.1), ("A", "2", 0.2), (odd, "1", 0.3)]

    broken = scores(spark, [("A", "1", 0.9), (odd, "2", 0.9)]).withColumn("sentiment_score", F.when(F.col("asset_id") != "A", F.raise_error(F.lit("lost in the middle")).cast("double")).otherwise(F.col("sentiment_score")))
    with pytest.raises(Exception, match="lost in the middle"):
        versions.merge(spark, root, broken, schema, key)
    for empty in (broken.limit(0), scores(spark, []).filter("false")):
        with pytest.raises(ValueError, match="nothing"):
            versions.merge(spark, root, empty, schema, key)
    with pytest.raises(Exception, match="null asset_id"):
        versions.merge(spark, root, scores(spark, [(None, "1", 0)]), schema, key)
    assert versions.versions(spark, root) == [1] and rows(versions.read(spark, root, schema)) == first

    assert versions.merge(spark, root, scores(spark, [("A", "1", 0.5), ("A", "3", 0.4), ("A", "3", 0.6)]), schema, key) == 2
    now = [("007", "1", 0.0), ("A", "1", 0.5), ("A", "2", 0.2), ("A", "3", 0.6), (odd, "1", 0.3)]
    assert rows(versions.read(spark, root, schema)) == now
    assert rows(before) == first == rows(versions.read(spark, root, schema, 1))  # a reader keeps its version

    with pytest.raises(RuntimeError, match="another writer"):
        versions.write(spark, root, scores(spark, [("A", "9", 0)]), schema, base=1)
    assert rows(versions.read(spark, root, schema)) == now and versions.versions(spark, root) == [1, 2]
    assert versions.forget(spark, root) >= 2 and versions.versions(spark, root) == [2]
    assert rows(versions.read(spark, root, schema)) == now and versions.forget(spark, root) == 0
    with pytest.raises(ValueError, match="no version 1"):
        versions.read(spark, root, schema, 1)


def test_csv_files_are_split_where_lines_are_rows(spark, tmp_path):
    path = str(tmp_path / "wide")
    files.write_csv(spark.range(20_000).select("id", F.lit('a "b", c').alias("t")).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        whole, split = files.csv(spark, path), files.csv(spark, path, multi_line=False)
        assert whole.rdd.getNumPartitions() == 1 and split.rdd.getNumPartitions() > 2
        assert split.count() == whole.count() == 20_000 and {r.t for r in split.select("t").distinct().collect()} == {'a "b", c'}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
