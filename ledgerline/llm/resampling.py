"""Target-distribution importance resampling.

Features, runs of words, are hashed to buckets and counted in the documents and in a target text
set.  A document's weight is the sum of its features' log ratios, looked up in one array; with
Gumbel noise from its id, the highest scores are a draw without replacement in proportion to the
weights.

The cutoff score comes from a mergeable quantile sketch: two of its quantiles bracket the cutoff,
exact counts outside the bracket validate it or widen it, and only the bracket's rows are sorted to find
the last row drawn.  What is drawn is then sorted once more for its ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import by_bytes, save

#: Size parameter of the quantile sketch, and how far either end of the first bracket lies from the cutoff's rank.
SKETCH_K, MARGIN = 4_000, 0.002


def features(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of each run of 1 to `longest` words, and each text's number of words."""
    doc, word, known = words.encoded(texts, words.LETTERS_DIGITS)
    known = known.to_pylist()
    texts_of, found = [], []
    code, text, names = word, doc, known
    for n in range(1, longest + 1):
        if n > 1:  # one word more at the end of each run that has one in its text
            room = np.flatnonzero(text[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
            longer, code_ = np.unique(code[room] * len(known) + word[room + n - 1], return_inverse=True)
            names = [names[k // len(known)] + b" " + known[k % len(known)] for k in longer.tolist()]
            full = np.full(len(doc), -1)
            full[room] = code_
            code, text = full, np.where(full >= 0, doc, -1)
        has = code >= 0
        hashed = np.array([zlib.crc32(x) % buckets for x in names], np.int64)
        texts_of.append(doc[has])
        found.append(hashed[code[has]])
    return np.concatenate(texts_of), np.concatenate(found), np.bincount(doc, minlength=len(texts))


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in by_bytes(batches):
            total += np.bincount(features(words.blobs(batch.column(0)), longest, buckets)[1], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    counted = texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n"))
    for bucket, n in counted.collect():  # one row a bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the target's to the source's share of each bucket, every count plus one."""
    s, t = float(source.sum() + len(source)), float(target.sum() + len(target))
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in pairs], np.int64)


def noise(seed: str, doc_id: object) -> int:
    """floor(1000 times Gumbel noise) from a hash of seed and id; a null id counts as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, longest: int, seed: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of docs(doc_id, text)."""
    names = ["doc_id", "n_words", "n_features", "weight", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            n = batch.num_rows
            doc, bucket, n_words = features(words.blobs(batch.column(1)), longest, len(gain))
            weight = np.bincount(doc, weights=gain[bucket], minlength=n).astype(np.int64)  # sums of integers, exact in doubles
            lot = np.array([noise(seed, d) for d in batch.column(0).to_pylist()], np.int64)
            made = [n_words, np.bincount(doc, minlength=n), weight, weight + lot]
            yield pa.record_batch([batch.column(0), *(pa.array(x.astype(np.int64)) for x in made)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def numbered(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """rows with their place in this order, from 1: a distributed sort, and the rows before each partition added."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows = save(rows.withColumn("__part", F.shiftright("__at", 33).cast("int")), "numbered")
    parts = rows.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))  # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__part", "__first", before.alias("__before"))
    place = F.col("__before") + F.col("__at") - F.col("__first") + 1
    return rows.join(F.broadcast(parts), "__part").withColumn(name, place).drop("__part", "__at", "__first", "__before")


def bracket(scores: DataFrame, n: int, k: int, margin: float = MARGIN) -> tuple[int, int, int]:
    """Scores lo and hi between which the k-th highest of n lies, and how many rows are above hi.

    The sketch's quantiles only propose; exact counts decide, and the bracket is widened until it holds the row.
    """
    sketch = scores.agg(F.kll_sketch_agg_bigint("score", F.lit(SKETCH_K)).alias("s"))
    while True:
        ends = [min(1.0, max(0.0, 1 - k / n + side * margin)) for side in (-1, 1)]
        lo, hi = sketch.select(*(F.kll_sketch_get_quantile_bigint("s", F.lit(float(q))) for q in ends)).first()
        above, inside = scores.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score").between(lo, hi))).first()
        if above < k <= above + inside:
            return lo, hi, above
        margin *= 4  # at most up to the least and the largest score, which the sketch has exactly


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: str = "2024", margin: float = MARGIN) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of docs(doc_id, text), one row a row of docs.

    Of the documents with at least min_words words the floor(percent / 100) part with the highest scores is
    drawn and ranked from 1; the others' rank is null.  Of equal scores the smaller doc_id counts more, null
    last; of rows with equal id and score any.  Null and empty texts have no features and weight 0; with an empty target
    the weights follow the documents alone; an empty table gives no rows; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = save(weighted(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id()), "weighted")
    fit = rows.filter(F.col("n_words") >= min_words)
    n = fit.count()
    k = percent * n // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    out = ["doc_id", "n_features", "weight", "score"]
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    lo, hi, above = bracket(fit.select("score"), n, k, margin)
    last = numbered(fit.filter(F.col("score").between(lo, hi)).select("score", "doc_id", "row"), order).filter(F.col("rank") == k - above).first()
    score, doc_id = F.col("score"), F.col("doc_id")
    if last["doc_id"] is None:
        ahead, same = doc_id.isNotNull(), doc_id.isNull()
    else:
        ahead, same = F.coalesce(doc_id < last["doc_id"], F.lit(False)), doc_id.eqNullSafe(F.lit(last["doc_id"]))
    drawn = (F.col("n_words") >= min_words) & ((score > last["score"]) | ((score == last["score"]) & (ahead | (same & (F.col("row") <= last["row"])))))
    ranked = numbered(rows.filter(drawn).select(*out, "row"), order).select(*out, F.col("rank").cast("long").alias("rank"))
    return ranked.unionByName(rows.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))
