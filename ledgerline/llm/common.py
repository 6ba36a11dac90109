"""What several text-pipeline operators share: the shared scratch folder and link components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one in the warehouse.

    Only a local master has one machine for all, and there it is a temporary folder.
    """
    local = spark.sparkContext.master.startswith("local")
    own = "/tmp/checkpoints" if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.scratch"
    return (spark.conf.get("spark.checkpoint.dir", None) or f"{own}/ledgerline").rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text, about, that a Python task holds as strings at a time (longer texts alone).
TEXT_BYTES = 2 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `size` bytes of text, so that a task's memory does not grow with the batch's rows."""
    for batch in batches:
        held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(held):
            before = held[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(held, before + size, side="right")))
            yield batch.slice(at, end - at)
            at = end


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b), ids of type long.

    Alternating large-star and small-star steps, each a shuffle of the remaining links only; the
    links turn into stars around the smallest id in logarithmically many rounds.  Returns
    (id, component_id) for every id that is not the smallest of its component.
    """
    links = save(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = mark(links)
    for _ in range(rounds):
        if not before[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        links = save(small.filter("u <> v").distinct(), "stars")
        after = mark(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component_id"))


#: A key is hot if it holds more than one in so many of all rows; there are fewer hot keys than this.
HOT_PARTS = 512
#: Parts that a hot key's rows are dealt to.
SALTS = 64


def hot_keys(sizes: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """The keys of sizes(keys..., count) that hold over 1 / HOT_PARTS of all rows: fewer than HOT_PARTS of them."""
    total = sizes.agg(F.sum(count)).first()[0] or 0
    return sizes.filter(F.col(count) * HOT_PARTS > total).select(*keys)


def spread_join(rows: DataFrame, others: DataFrame, keys: list[str], hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """Inner join by keys in which a hot key's rows are dealt to `salts` parts, each with a copy of the others' rows."""
    hot = F.broadcast(hot.select(*keys, F.lit(True).alias("__hot")))  # fewer than HOT_PARTS rows
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0)
    dealt = rows.join(hot, keys, "left").withColumn("__salt", salt).drop("__hot")
    all_salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = others.join(hot, keys, "left").withColumn("__salt", F.explode(all_salts)).drop("__hot")
    return dealt.join(copied, [*keys, "__salt"]).drop("__salt")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """rows with the row of their group; no group, however large, lands in one task.

    groups(keys..., count, ...) is read three times, so it should be a saved table.
    """
    return spread_join(rows, groups.drop(count), keys, hot_keys(groups, keys, count))


def repeats(table: DataFrame, key: str) -> bool:
    """Whether some key stands in several rows."""
    return bool(table.groupBy(key).count().filter("count > 1").limit(1).count())
