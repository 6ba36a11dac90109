"""A corpus pipeline: raw documents to packed training sequences in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again.  All but the
last return the columns of documents; null texts and extra columns pass through them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, jaccard, line_dedup, packing, quality
from ledgerline.llm.common import repeats, save
from ledgerline.llm.queries import fold


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled quality classifier accepts; all, where there is nothing trusted to learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.filter(~fold()))
    return quality.accepted(docs, model) if model.weights.any() else docs


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; documents of which nothing is left go."""
    cut = line_dedup.dedup(docs, counts=("__lines", "__deleted")).filter("__deleted = 0 or text <> ''")
    n_chars = F.when(F.col("__deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select(*(n_chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def not_told_apart(docs: DataFrame) -> bool:
    """Whether some doc_id is null or stands in several rows."""
    return repeats(docs, "doc_id") or bool(docs.filter("doc_id is null").limit(1).count())


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Rows with equal or null doc_id are documents of their own, those without id after all others.
    """
    if not_told_apart(docs):
        rows = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
        rows = save(rows, "rows")
        found = jaccard.join(rows.select(F.col("__row").alias("doc_id"), "text"), size=5, percent=80)
        gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__row"))
        return rows.join(gone, "__row", "left_anti").select(*docs.columns)
    gone = jaccard.join(docs, size=5, percent=80).filter("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go; rows with equal or null doc_id are judged one by one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    if not_told_apart(docs):
        rows = save(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        found = decontaminate.overlaps(rows.select(F.col("__row").alias("doc_id"), "text"), items)
        gone = found.select(F.col("doc_id").alias("__row")).distinct()
        return rows.join(gone, "__row", "left_anti").select(*docs.columns)
    found = decontaminate.overlaps(docs, items)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids; see packing.pack()."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier and the tokenizer have no SQL; tests/llm/test_pipeline.py holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
