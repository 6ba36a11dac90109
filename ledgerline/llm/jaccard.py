"""N-gram Jaccard join with prefix filters under several global token orders.

Documents are sets of hashed word shingles.  Two sets of Jaccard similarity t share a token among
the first n - ceil(t n) + 1 of each, whatever global order the tokens stand in.  The orders go from rare
to frequent by counts of hash buckets over the whole corpus, each by hashes of its own, so that
passages that many documents share seldom lead, and seldom under several orders.  Candidates meet on a
prefix token of the first order, must meet under the second before their sets are fetched and
under the third before they are verified on the full sets.

Equal sets are one class from the start.  A first round verifies each document with the most
connected one under each of its prefix tokens only, which joins groups of near copies around the
text they are edits of, at linear cost; a second round takes what remains, pairs of different
components under one token, so that no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, components, hot_keys, join_groups, repeats, save, spread_join

#: Hash buckets of the corpus-wide token counts (2^bits for either of two hashes); more for larger corpora.
SKETCH_BITS = 21
BLOCKS = 64
#: Bytes of text that are hashed at a time (longer texts alone).
CHUNK = 1 << 18
#: Ids of copies or of documents with candidates, up to which they are broadcast; beyond, texts are shuffled by id.
MAX_BROADCAST_IDS = 500_000
#: Tokens before a token that its row carries; where there are more, a pair may be taken several times before it is made distinct.
MAX_AHEAD = 64
#: Parts that one side of a hot token's pairs is dealt to, each with a copy of the other side.
PAIR_SALTS = 16

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit hash (splitmix64 finaliser) of salted values."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of UTF-8 bytes (runs other than white space, A-Z lower-cased), and its first byte's place."""
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    # each byte is hashed with its place in the word, then the word's bytes are added up
    first = np.zeros(len(data), np.int64)
    first[start[1:]] = start[1:] - start[:-1]
    first[start[0]] = start[0]
    place = (np.arange(len(data)) - np.cumsum(first)).astype(np.uint64)
    h = mix(_BYTE[data] + place * np.uint64(_MULTIPLIER))
    h[~inside] = 0
    total = np.cumsum(h)
    return mix(total[end - 1] - np.where(start > 0, total[start - 1], np.uint64(0)), 1), start


def _chained(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words."""
    n = max(0, len(words) - size + 1)
    h = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = mix(h + words[i : i + n], 2)
    return h


def raw_shingles(texts: list[str | None], size: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingle hashes of whole texts, some texts at a time: all of them, and each text's end among them."""
    at = 0
    while at < len(texts):
        blobs, held = [], 0
        while at < len(texts) and (not blobs or held < CHUNK):
            blobs.append((texts[at] or "").encode("utf-8", "replace"))
            held += len(blobs[-1])
            at += 1
        words, start = word_hashes(np.frombuffer(b" ".join(blobs), np.uint8))
        ends = np.searchsorted(start, np.cumsum([len(b) + 1 for b in blobs]))
        counts = np.diff(ends, prepend=0)
        made = _chained(words, size)
        doc = np.repeat(np.arange(len(blobs)), counts)
        whole = doc[: len(made)] == doc[len(doc) - len(made) :]
        made, n = made[whole], np.maximum(counts - size + 1, 0)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):  # texts of fewer words have one shingle, the whole sequence
            own = [_chained(words[ends[i] - counts[i] : ends[i]], int(counts[i]))[0] for i in short]
            made = np.insert(made, np.cumsum(n)[short], own)
            n[short] = 1
        yield made, np.cumsum(n)


def shingle_sets(texts: list[str | None], size: int = 4) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text; see join()."""
    return [np.unique(some) for made, ends in raw_shingles(texts, size) for some in np.split(made, ends[:-1])]


def buckets(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The buckets of each token under the two hashes, in one array of 2^(bits + 1) counts."""
    one = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    two = (mix(tokens, 30) >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits)
    return np.stack([one, two])


class Order:
    """Global token orders by bucket counts.

    Orders 0 and 1 go by the counts under the first and the second hash, order 2 by powers of two of the first and
    then by another hash.
    """

    def __init__(self, counts: np.ndarray, bits: int):
        self.bits, self.counts = bits, counts

    def rank(self, tokens: np.ndarray, which: int) -> np.ndarray:
        """The place of each token in the order `which`; of equal ones the smaller token is first."""
        count = np.minimum(self.counts[buckets(tokens, self.bits)[which % 2]], (1 << 23) - 1).astype(np.uint64)
        if which == 2:
            count = np.log2(np.maximum(count, 1)).astype(np.uint64)
        return mix(tokens, 10 + which) >> np.uint64(23) | count << np.uint64(41)

    def prefixes(self, sets: list[np.ndarray], percent: int, which: int) -> list[np.ndarray]:
        """The tokens of each set's prefix, in the order `which`."""
        rank = self.rank(np.concatenate([*sets, np.zeros(0, np.uint64)]), which)
        out, at = [], 0
        for tokens in sets:
            own, at = rank[at : at + len(tokens)], at + len(tokens)
            length = prefix_length(len(tokens), percent) if len(tokens) else 0
            first = np.argpartition(own, length - 1)[:length] if length < len(tokens) else np.arange(len(tokens))
            out.append(tokens[first[np.lexsort((tokens[first], own[first]))]])
        return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bucket_counts(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """How often each hash bucket's shingles occur in all documents: one array of 2^(bits + 1) counts."""
    whole = 2 << bits
    width = whole // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(whole, np.int32)
        held: list[np.ndarray] = []

        def flush() -> None:
            if held:
                counts[:] += np.bincount(buckets(np.concatenate(held), bits).ravel(), minlength=whole).astype(np.int32)
                held.clear()

        for batch in by_bytes(batches):
            for made, _ in raw_shingles(batch.column(0).to_pylist(), size):
                held.append(made)
                if sum(map(len, held)) > 1 << 20:
                    flush()
        flush()
        blocks = [counts[i * width : (i + 1) * width] for i in range(BLOCKS)]
        some = [(i, b.tobytes()) for i, b in enumerate(blocks) if b.any()]
        yield pa.record_batch([pa.array([i for i, _ in some], pa.int32()), pa.array([b for _, b in some], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(blob.as_py(), np.int32)
                total[block] = total.get(block, np.zeros(width, np.int64)) + one
        made = [pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in total.values()], pa.binary())]
        yield pa.record_batch(made, names=["block", "counts"])

    schema = "block int, counts binary"
    partial = docs.select("text").mapInArrow(count, schema)
    out = np.zeros(whole, np.int32)
    for block, blob in partial.repartition(BLOCKS, "block").mapInArrow(add, schema).toLocalIterator():  # 2^(bits + 1) counts in all
        out[block * width : (block + 1) * width] = np.frombuffer(blob, np.int32)
    return out


def _few(ids: DataFrame) -> DataFrame:
    """A saved table of ids, marked for broadcast if its measured count is within the bound."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def _verified(pairs: DataFrame, text: DataFrame, level: Broadcast, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets agree: those that meet under order 1, then under order 2, then by their whole sets."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document the prefix under order 1, and the whole set."""
        order = level.value
        for batch in by_bytes(batches):
            found = shingle_sets(batch.column(1).to_pylist(), size)
            heads = pa.array([h.view(np.int64) for h in order.prefixes(found, percent, 1)], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), heads, pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_id", "head", "s"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = level.value
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                heads = order.prefixes([x, y], percent, 2)
                both = len(np.intersect1d(x, y, True)) if len(np.intersect1d(*heads, True)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def both(pairs: DataFrame, column: str) -> DataFrame:
        """The pairs with this column of either side."""
        x = sets.select(F.col("doc_id").alias("a"), F.col(column).alias("x"))
        y = sets.select(F.col("doc_id").alias("b"), F.col(column).alias("y"))
        return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")

    ids = save(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    sets = text.join(_few(ids), "doc_id", "left_semi").mapInArrow(describe, "doc_id long, head array<long>, s binary")
    sets = save(sets, "described")
    met = save(both(pairs, "head").filter(F.arrays_overlap("x", "y")).select("a", "b"), "met")
    return save(both(met, "s").mapInArrow(check, "a long, b long"), "links")


def join(docs: DataFrame, size: int = 4, percent: int = 85, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs(doc_id, text), one row a doc_id.

    A set holds the distinct `size`-word shingles of the whole text (words: runs without
    white space, A-Z lower-cased), of fewer words the whole sequence as one.  Texts that are null or
    without words have empty sets and link with nothing.  Documents link when
    100 * intersection >= percent * union; component_id is the smallest doc_id reachable by links.
    Of rows with equal doc_id the smallest text counts; rows without doc_id are left out.  Shingles
    are compared by 64-bit hash.
    """
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    if repeats(docs, "doc_id"):
        docs = save(docs.groupBy("doc_id").agg(F.min("text").alias("text")), "docs")
    order = Order(bucket_counts(docs, size, sketch_bits), sketch_bits)
    level = docs.sparkSession.sparkContext.broadcast(order)  # 2^(bits + 1) counts of four bytes

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document the set's size, its hash, and its prefix under the first order."""
        order = level.value
        for batch in by_bytes(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens = np.concatenate([*sets, np.zeros(1, np.uint64)])
            starts = np.minimum(np.cumsum(sizes) - sizes, len(tokens) - 1)
            sums = []
            for salt in (20, 21):
                mixed = mix(tokens, salt)
                mixed[-1] = 0  # the one behind the last set
                sums.append(np.where(sizes > 0, np.add.reduceat(mixed, starts), 0).view(np.int64) if len(sets) else [])
            heads = pa.array([h.view(np.int64) for h in order.prefixes(sets, percent, 0)], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array(sizes), *(pa.array(x, pa.int64()) for x in sums), heads], names=["doc_id", "n", "h", "g", "head"])

    found = save(docs.mapInArrow(describe, "doc_id long, n long, h long, g long, head array<long>"), "sets")
    same = found.filter("n > 0").groupBy("n", "h", "g").agg(F.min("doc_id").alias("first"), F.count("*").alias("count"))
    same = save(same.filter("count > 1"), "same")
    copies = join_groups(found.drop("head"), same, ["n", "h", "g"]).filter("doc_id <> first").select("doc_id", "first")
    copies = save(copies, "copies")
    tokens = found.filter("n > 0").join(_few(copies.select("doc_id")), "doc_id", "left_anti").select("doc_id", "n", F.posexplode("head").alias("pos", "token"))
    shared = save(tokens.groupBy("token").count().filter("count > 1"), "shared")
    hot = hot_keys(shared, ["token"])
    # a token's place in its document's prefix, and how many of the tokens before it others share
    before = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    tokens = save(spread_join(tokens, shared.select("token"), ["token"], hot).withColumn("before", before), "tokens")

    def near(a: Column, b: Column) -> Column:
        """Whether documents with a common token can still agree enough.

        Of what stands before the token only shared tokens can be common, since both prefixes reach it.
        """
        most = F.least(a["before"], b["before"]) + 1 + F.least(a["n"] - a["pos"], b["n"] - b["pos"]) - 1
        return 100 * most >= percent * (a["n"] + b["n"] - most)

    # round 1: every document with the one of each of its tokens that shares most tokens: the text that others are edits of
    degree = tokens.groupBy("doc_id").agg(F.count("*").alias("degree"))
    own = F.struct("doc_id", "n", "pos", "before")
    ranked = tokens.join(degree, "doc_id").select("token", F.struct("degree", (-F.col("doc_id")).alias("key"), own.alias("own")).alias("r"))
    middle = ranked.groupBy("token").agg(F.max("r").alias("r")).select("token", F.col("r.own").alias("x"))
    stars = spread_join(tokens.select("token", own.alias("y")), middle, ["token"], hot).filter("x.doc_id <> y.doc_id").filter(near(F.col("x"), F.col("y")))
    stars = save(stars.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct(), "pairs")
    links = _verified(stars, docs, level, size, percent)
    joined = components(links)

    # round 2: documents of different components under one token
    rest = tokens.join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    rest = rest.select("token", own.alias("x"), F.coalesce("component_id", "doc_id").alias("c"))
    mixed = rest.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("token")
    # a pair is taken at its first common token: with each token goes what its document has before it, while that is short
    held = spread_join(rest, mixed, ["token"], hot).groupBy(F.col("x.doc_id").alias("doc_id"), "c")
    held = held.agg(F.sort_array(F.collect_list(F.struct("x.pos", "token", "x"))).alias("held"))
    one = held.select("c", F.col("held.token").alias("all"), F.posexplode("held").alias("at", "h"))
    ahead = F.when(F.col("at") <= MAX_AHEAD, F.slice("all", F.lit(1), F.col("at"))).otherwise(F.array().cast("array<long>"))
    rest = save(one.select("h.token", "h.x", "c", ahead.alias("ahead")), "rest")
    other = rest.select("token", F.col("x").alias("y"), F.col("c").alias("d"), F.col("ahead").alias("behind"))
    fresh = (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("c") != F.col("d")) & ~F.arrays_overlap("ahead", "behind")
    more = spread_join(rest, other, ["token"], hot, PAIR_SALTS).filter(fresh & near(F.col("x"), F.col("y")))
    more = more.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    more = save(more.join(stars, ["a", "b"], "left_anti"), "more")
    late = _verified(more, docs, level, size, percent)
    edges = links.unionByName(late).unionByName(copies.select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    settled = components(edges).withColumnRenamed("id", "doc_id")
    out = found.select("doc_id", "n").join(settled, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

