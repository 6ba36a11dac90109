"""The pipeline against plain versions of its stages."""

import itertools
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, quality
from tests.llm.test_links import groups, plain_line_dedup, plain_shingles


def plain_overlap(text, item):
    words, item = re.split(r"[^\w]|_", (text or "").lower()), [w for w in re.split(r"[^\w]|_", item.lower()) if w]
    words = [w for w in words if w]
    n = min(20, len(item))
    for shift in range(-len(item), len(words)):
        agree = [0 <= shift + j < len(words) and words[shift + j] == w for j, w in enumerate(item)]
        if sum(agree) >= 0.8 * n and max(sum(agree[k : k + n]) for k in range(len(item) - n + 1)) >= 0.8 * n:
            return True
    return False


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.lit("x"))
    odd = spark.createDataFrame([(9001, None, None, None, None, "x"), (9002, "", "en", "s", 0, "x")], docs.schema)
    docs = docs.unionByName(odd)
    steps = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r.text for r in docs.collect()}
    stage = lambda name, d: corpus_pipeline.save(steps[name](spark, d, sf_dir), "t")
    good = stage("quality classifier", docs)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~corpus_pipeline.fold()))
    want = {i for i, t in rows.items() if model.score(np.array([quality.features(t)]))[0] >= 0.7}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns
    rows = {r.doc_id: r.text for r in good.collect()}
    cut = stage("line dedup", good)
    want = {i: t for i, t in plain_line_dedup(list(rows.items())).items() if t or not rows[i]} | {i: None for i, t in rows.items() if t is None}
    assert {r.doc_id: r.text for r in cut.collect()} == want and cut.columns == docs.columns
    rows = want
    one = stage("n-gram Jaccard join", cut)
    sets = {i: plain_shingles(t, 5) for i, t in rows.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    rows = {i: t for i, t in rows.items() if groups(sets, links)[i] == i}
    assert {r.doc_id: r.text for r in one.collect()} == rows and one.columns == docs.columns
    clean = stage("benchmark decontamination", one)
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(plain_overlap(t, item) for item in items)}
    assert {r.doc_id: r.text for r in clean.collect()} == rows and clean.columns == docs.columns
    packed = steps["packing"](spark, clean, sf_dir)
    assert {r.doc_id for r in packed.collect()} == set(rows)


def test_whole_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() and out.agg(F.max("sequence_tokens")).first()[0] <= 2048
    assert decontaminate.MASKS  # the stage's operator is the library's own


def test_near_copies_by_five_words_and_four_fifths(spark):
    words = [f"w{i}" for i in range(300)]
    scattered = [f"x{i}" if i in (120, 140, 160) else w for i, w in enumerate(words)][100:230]
    rows = [
        (1, words[:100]), (2, words[:50] + [f"y{i}" for i in range(16)] + words[50:100]),  # a block of more text: 92 of 116
        (3, [f"a{i}" for i in range(100)]), (4, [f"a{i}" for i in range(120)]),  # 96 of 116 shingles
        (5, words[100:230]), (6, scattered),  # 111 of 141
        (7, [f"b{i}" for i in range(100)]), (8, [f"b{i}" for i in range(120)][:100] + ["c"] * 9),
    ]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()}
    assert got == {i for i, root in groups(sets, links).items() if root == i} and 4 not in got and 2 in got


def test_near_copies_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, b), (2, c + " more"), (None, c), (None, "no copy of any other text"), (3, None), (3, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()
    want = [(1, a), (1, b), (2, c + " more"), (None, "no copy of any other text"), (3, None), (3, None), (None, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def write_tables(spark, folder, items, labels=()):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality long").write.parquet(f"{folder}/labels.parquet")


def test_decontamination_with_repeated_and_null_ids(spark, tmp_path):
    item = " ".join(f"secret{i}" for i in range(25))
    write_tables(spark, tmp_path, [(1, item)])
    rows = [(1, "before " + item), (1, "clean"), (None, item), (None, "clean too"), (2, None), (2, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = [(1, "clean", "x"), (None, "clean too", "x"), (2, None, "x"), (2, "", "x")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_stages_on_an_empty_table_and_without_labels(spark, tmp_path):
    write_tables(spark, tmp_path, [(1, " ".join(f"w{i}" for i in range(25)))])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.save(stage(spark, docs, str(tmp_path)), "t")
        assert docs.count() == 0 and (name == "packing" or docs.columns == [c.split()[0] for c in schema.split(", ")])
    some = spark.createDataFrame([(1, "no label says what this is", "en", "s", 26)], schema)
    assert corpus_pipeline.keep_good(spark, some, str(tmp_path)).count() == 1
