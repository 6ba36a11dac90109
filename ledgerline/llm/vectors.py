"""Embedding near-duplicates by a random-projection tree forest.

Every tree splits the vectors of a label at the median of a random projection, again and again,
until leaves are small.  Rows close to a split go to both sides (spill), so that a near pair
rarely parts; several trees make up for the rest.  Vectors are compared with those of their leaf
in double precision.  The upper splits are fitted on one bounded sample; a leaf that is still too
large is split further on a sample drawn inside it, round by round, so that leaves are as small in
a table of any size.  Every row is indexed.

Equal vectors are one class.  Leaves that no split can part (a dense group) are cut into blocks, and
pairs of blocks are compared, so that a task holds two blocks at most.  A pair counts in the first
leaf that it shares.  Tasks return counts and local components, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, hot_keys, join_groups, repeats, save, spread_join

#: The upper splits are fitted on at most so many vectors, those of smallest hash.
MAX_SAMPLE = 20_000
#: Vectors, about, that the further splits of a large leaf are fitted on, and levels that are split in one round.
LEAF_SAMPLE, LEVELS = 2_000, 4
#: Rows within this part of the usual distance of a pair at the threshold go to both sides of a split.
SPILL = 0.5
#: Large leaves whose splits are broadcast; beyond, they are joined by shuffles.
MAX_BROADCAST_LEAVES = 50_000
AT = ["label", "size", "leaf"]


def margin_of(threshold: float, size: int) -> float:
    """SPILL of the usual distance that a pair just at the threshold has on a random unit direction."""
    return SPILL * float(np.sqrt(max(0.0, 2 - 2 * threshold) / size))


def directions(size: int, n: int, *seed: int) -> np.ndarray:
    """n random unit directions as columns."""
    d = np.random.default_rng((*seed, size)).normal(size=(size, n))
    return d / np.linalg.norm(d, axis=0)


def splits_of(p: np.ndarray, small: int, margin: float) -> np.ndarray:
    """Splits of a sample by its places p(rows, levels), node k's parts being nodes 2k + 1 and 2k + 2; NaN: none."""
    out = np.full(2 ** p.shape[1] - 1, np.nan)
    todo = [(0, np.arange(len(p)), 0)]
    while todo:
        k, rows, level = todo.pop()
        if level < p.shape[1] and len(rows) > small:
            at = p[rows, level]
            split = float(np.median(at))
            left, right = rows[at <= split + margin], rows[at >= split - margin]
            if max(len(left), len(right)) <= 0.8 * len(rows):
                out[k] = split
                todo += [(2 * k + 1, left, level + 1), (2 * k + 2, right, level + 1)]
    return out


def parts_of(p: np.ndarray, splits: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and end nodes of rows with places p and splits of their own; some rows have several."""
    rows, nodes = np.arange(len(p)), np.zeros(len(p), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(p.shape[1]):
        split = splits[rows, nodes]
        over = np.isnan(split)
        ends.append((rows[over], nodes[over]))
        rows, nodes, split = rows[~over], nodes[~over], split[~over]
        left, right = p[rows, level] <= split + margin, p[rows, level] >= split - margin
        rows, nodes = np.r_[rows[left], rows[right]], np.r_[2 * nodes[left] + 1, 2 * nodes[right] + 2]
    ends.append((rows, nodes))
    return np.concatenate([r for r, _ in ends]), np.concatenate([n for _, n in ends])


class Forest:
    """Split trees by (label, size of vectors), and the leaves of any row."""

    def __init__(self, sample: list[tuple[int, np.ndarray]], total: int, threshold: float, trees: int, leaf: int, seed: int = 11):
        self.trees, self.depth = trees, 24
        self.threshold, self.seed = threshold, seed
        self.small = max(8, round(leaf * min(1.0, len(sample) / max(1, total))))
        self.nodes: dict[tuple[int, int], list] = {}
        groups: dict[tuple[int, int], list] = {}
        for label, v in sample:
            groups.setdefault((label, len(v)), []).append(v / np.linalg.norm(v))
        for key, rows in groups.items():
            x = np.array(rows)
            self.nodes[key] = [self._grow(self._project(x, t), np.arange(len(x)), 0, [0], self._margin(key[1])) for t in range(trees)]

    def _margin(self, size: int) -> float:
        return margin_of(self.threshold, size)

    def _project(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Places of rows on the tree's directions, one a level."""
        return x @ directions(x.shape[1], self.depth, self.seed, tree)

    def _grow(self, p: np.ndarray, rows: np.ndarray, level: int, leaves: list[int], margin: float):
        """A leaf's number, or (split, left, right)."""
        if len(rows) > self.small and level < self.depth:
            at = p[rows, level]
            split = float(np.median(at))
            left, right = rows[at <= split + margin], rows[at >= split - margin]
            if max(len(left), len(right)) <= 0.8 * len(rows):
                return split, self._grow(p, left, level + 1, leaves, margin), self._grow(p, right, level + 1, leaves, margin)
        leaves[0] += 1
        return leaves[0] - 1

    def leaves(self, label: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaves (tree * 2^24 + leaf) of unit vectors with one label, sorted by both."""
        margin = self._margin(x.shape[1])
        found: list[tuple[np.ndarray, int]] = []
        for tree, root in enumerate(self.nodes.get((label, x.shape[1]), [0] * self.trees)):
            p = self._project(x, tree)
            todo = [(root, np.arange(len(x)), 0)]
            while todo:
                node, rows, level = todo.pop()
                if not len(rows):
                    continue
                if isinstance(node, int):
                    found.append((rows, tree << 24 | node))
                    continue
                at = p[rows, level]
                todo += [(node[1], rows[at <= node[0] + margin], level + 1), (node[2], rows[at >= node[0] - margin], level + 1)]
        rows = np.concatenate([r for r, _ in found])
        leaf = np.concatenate([np.full(len(r), n) for r, n in found])
        order = np.lexsort((leaf, rows))
        return rows[order], leaf[order]


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    return (x @ y.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) >= threshold


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy())
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _split_further(members: DataFrame, own: DataFrame, threshold: float, leaf: int, rounds: int = 40) -> DataFrame:
    """members(vec_id, label, size, tree, leaf) with every leaf of over 2 * leaf rows split, while a split parts it."""
    done, left = [], members.withColumn("label", F.col("label").cast("long"))  # as the functions below return it
    for turn in range(1, rounds + 1):
        large = save(left.groupBy(*AT).count().filter(F.col("count") > 2 * leaf), "large")
        n = large.count()
        if not n:
            break
        hot = hot_keys(large, AT)
        few = F.broadcast if n <= MAX_BROADCAST_LEAVES else (lambda df: df)
        done.append(left.join(few(large.select(*AT)), AT, "left_anti"))
        chance = F.pmod(F.xxhash64("vec_id", F.lit(turn)), F.lit(1_000_000)) * F.col("count") < LEAF_SAMPLE * 1_000_000
        sample = left.join(few(large), AT).filter(chance).join(own.select("vec_id", "v"), "vec_id")

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            first = frame.iloc[0]
            size, small = int(first["size"]), max(8, round(leaf * min(1.0, len(frame) / first["count"])))
            p = _unit(frame["v"]) @ directions(size, LEVELS, turn, int(first["tree"]))
            splits = splits_of(p, small, margin_of(threshold, size))
            return pd.DataFrame({"label": [first["label"]], "size": [size], "leaf": [first["leaf"]], "splits": [splits]})

        splits = save(sample.groupBy(*AT).applyInPandas(fit, "label long, size int, leaf long, splits array<double>"), "splits")
        rows = left.join(F.broadcast(splits), AT) if n <= MAX_BROADCAST_LEAVES else spread_join(left, splits, AT, hot)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                frame = batch.to_pandas()
                for (size, tree), some in frame.groupby(["size", "tree"]):
                    p = _unit(some["v"]) @ directions(int(size), LEVELS, turn, int(tree))
                    at, node = parts_of(p, np.stack(some["splits"].to_numpy()), margin_of(threshold, int(size)))
                    out = some[["vec_id", "label", "size", "tree", "leaf"]].iloc[at].assign(node=node)
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

        fields = "vec_id long, label long, size int, tree int, leaf long"
        made = rows.join(own.select("vec_id", "v"), "vec_id").select("vec_id", "label", "size", "tree", "leaf", "splits", "v")
        made = save(made.mapInArrow(part, fields + ", node long"), "parts")
        done.append(made.filter("node = 0").drop("node"))  # no split parts these
        left = made.filter("node > 0").withColumn("leaf", F.xxhash64("leaf", "node")).drop("node")
    return reduce(DataFrame.unionByName, [*done, left])


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, trees: int = 6, leaf: int = 256, block: int = 512, max_sample: int = MAX_SAMPLE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors(vec_id, embedding, label), one row a vec_id.

    Vectors of equal, non-null label and equal size link at cosine >= threshold, in double
    precision.  Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing.  Labels may be of any type that can be joined.  Of rows with equal vec_id the least (label, embedding) counts; rows
    without vec_id are left out.
    """
    rows = vectors.filter("vec_id is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    if isinstance(vectors.schema["label"].dataType, T.IntegralType):
        rows = rows.withColumn("label", F.col("label").cast("long"))
    else:  # labels of other types are told by a number each
        numbers = save(rows.select("label").filter("label is not null").distinct().withColumn("number", F.monotonically_increasing_id()), "labels")
        rows = rows.join(numbers, "label", "left").select("vec_id", F.col("number").alias("label"), "v")
    # squares of very small or large components leave the range of doubles
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("v", F.when(largest.between(1e-100, 1e100) | ~(largest > 0) | ~(largest < float("inf")), F.col("v")).otherwise(F.transform("v", lambda x: x / largest)))
    if repeats(rows, "vec_id"):
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("s")).select("vec_id", "s.*")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    key = [F.xxhash64("label", "v").alias("h"), F.xxhash64("v", F.lit(1), "label").alias("g")]
    keyed = valid.select("vec_id", *key)
    classes = keyed.groupBy("h", "g").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = save(keyed.join(classes, ["h", "g"]).select("vec_id", "first", "copies"), "classes")
    own = save(valid.join(classes.filter("vec_id = first").drop("first"), "vec_id").select("vec_id", "label", "v", "copies"), "vectors")
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("label", "v").collect()
    forest = Forest([(r[0], np.array(r[1])) for r in sample], own.count(), threshold, trees, leaf)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            frame["size"] = frame["v"].map(len)
            for (label, size), part in frame.groupby(["label", "size"]):
                at, leaves = forest.leaves(label, _unit(part["v"]))
                bounds = np.searchsorted(at, np.arange(len(part) + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(leaves, pa.int64()))
                made = [pa.array(part["vec_id"]), pa.array(part["label"], pa.int64()), pa.array(np.full(len(part), size), pa.int32()), lists]
                yield pa.record_batch(made, names=["vec_id", "label", "size", "leaves"])

    placed = own.mapInArrow(index, "vec_id long, label long, size int, leaves array<long>")
    placed = save(placed, "placed")
    members = placed.select("vec_id", "label", "size", F.explode("leaves").alias("leaf"))
    if not members.groupBy(*AT).count().filter(F.col("count") > 2 * leaf).isEmpty():
        tree = F.shiftright("leaf", 24).cast("int").alias("tree")
        members = _split_further(members.select("vec_id", "label", "size", tree, "leaf"), own, threshold, leaf).drop("tree")
        members = save(members, "members")
        placed = members.groupBy("vec_id", "label", "size").agg(F.collect_list("leaf").alias("leaves"))  # a few a tree
    blocks = members.groupBy(*AT).agg(F.count("*").alias("count"), F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    blocks = save(blocks.filter("count > 1"), "blocks")
    indexed = placed.join(own.select("vec_id", "v", "copies"), "vec_id")
    spread = indexed.select("*", F.explode("leaves").alias("leaf"))
    spread = join_groups(spread, blocks, AT).withColumn("mine", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("vec_id", *AT, "v", "copies", "leaves", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("second"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["v"].to_numpy())
        leaf, second = frame["leaf"].iloc[0], frame["second"].to_numpy()
        if frame["i"].iloc[0] != frame["j"].iloc[0]:
            a, b = np.flatnonzero(~second), np.flatnonzero(second)
        else:
            a = b = np.arange(len(frame))
        linked = _linked(x[a], x[b], threshold)
        linked[a[:, None] == b[None, :]] = False
        if linked.any():
            earlier = [[n for n in leaves if n < leaf] for leaves in frame["leaves"]]
            number = {n: i for i, n in enumerate(sorted({n for some in earlier for n in some}))}
            member = np.zeros((len(frame), len(number)), np.float32)
            for i, some in enumerate(earlier):
                member[i, [number[n] for n in some]] = 1
            linked &= (member[a] @ member[b].T) == 0
        copies, ids = frame["copies"].to_numpy(), frame["vec_id"].to_numpy()
        adjacent = np.zeros((len(frame), len(frame)), bool)
        adjacent[np.ix_(a, b)] |= linked
        adjacent |= adjacent.T
        root = ids.copy()
        while True:
            least = np.minimum(root, np.where(adjacent, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (least == root).all():
                break
            root = least
        some = adjacent.any(axis=1)
        return pd.DataFrame({"vec_id": ids[some], "links": (adjacent @ copies)[some], "root": root[some]})

    found = spread.groupBy("label", "size", "leaf", "i", "j").applyInPandas(compare, "vec_id long, links long, root long")
    found = save(found, "found")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    own = links.join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left").withColumnRenamed("vec_id", "first")
    of = classes.join(own, "first", "left").select(
        "vec_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
        F.coalesce("component_id", "first").alias("c"),
    )
    out = rows.select("vec_id").join(of, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
