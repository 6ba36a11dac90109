"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes holds the counts of every byte after contexts of
0 to 3 bytes.  A byte is coded by its longest context that has seen it; each longer context
that is known but hasn't costs an escape (method C: distinct followers against all).  Counts
are frozen after training, so the code length of a byte depends on its last four bytes alone
and is tabulated; a text's code length in each language is an exact sum of table entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most about so many documents of each language are learned from.
MAX_DOCS = 500
#: Bytes that are scored at a time.
CHUNK = 1 << 19
UNKNOWN = "und"


def windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte with the three before it as one number; zeros stand before a text's start."""
    d = data.astype(np.uint32)
    out = d.copy()
    for back in (1, 2, 3):
        shifted = np.zeros_like(d)
        shifted[back:] = d[:-back] if back < len(d) else d[:0]
        for j in range(back):
            at = starts + j
            shifted[at[at < len(d)]] = 0
        out |= shifted << np.uint32(8 * back)
    return out


def _text_windows(texts: list[str | None]) -> np.ndarray:
    blobs = [t.encode("utf-8", "replace") for t in texts if t]
    if not blobs:
        return np.zeros(0, np.uint32)
    sizes = np.array([len(b) for b in blobs])
    return windows(np.frombuffer(b"".join(blobs), np.uint8), np.cumsum(sizes) - sizes)


class _Lookup:
    """Row numbers of rising keys by hashing into a few tables, each without collisions of its own.

    The tables grow with the keys; keys for which no table has a place are searched for in order.
    """

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.tables, left = [], np.arange(len(keys))
        self.keys, self.bits = keys.astype(np.uint32), min(28, max(bits, (2 * len(keys)).bit_length()))
        bits = self.bits
        for salt in (2654435761, 2246822519, 3266489917, 668265263, 374761393, 2654435789, 1597334677, 3812015801):
            if not len(left):
                break
            slot = self._slot(self.keys[left], salt)
            _, first = np.unique(slot, return_index=True)
            row = np.full(1 << bits, -1, np.int32)
            row[slot[first]] = left[first]
            self.tables.append((salt, row))
            left = np.delete(left, first)
        self.rest = np.sort(left)

    def _slot(self, keys: np.ndarray, salt: int) -> np.ndarray:
        return (keys * np.uint32(salt)) >> np.uint32(32 - self.bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where absent."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        left = slice(None)
        for salt, row in self.tables:
            at = row[self._slot(keys[left], salt)]
            good = (at >= 0) & (self.keys[at] == keys[left])
            left = np.arange(len(keys))[left]
            out[left[good]] = at[good]
            # a key may stand in a later table only where its slot here is taken by another key
            left = left[~good & (at >= 0)]
            if not len(left):
                break
        if len(self.rest):
            left = np.arange(len(keys))[left]
            some = self.keys[self.rest]
            at = np.minimum(np.searchsorted(some, keys[left]), len(some) - 1)
            good = some[at] == keys[left]
            out[left[good]] = self.rest[at[good]]
        return out


class Model:
    """Code lengths in bits, tabulated from counts(lang, window, n)."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts["lang"].unique())
        self.by_language = [counts[counts["lang"] == x] for x in self.languages]
        self._tabulate()

    def _tabulate(self) -> None:
        keys4 = np.unique(np.concatenate([x["window"].to_numpy(np.uint32) for x in self.by_language] or [np.zeros(0, np.uint32)]))
        keys3 = np.unique(np.concatenate([keys4 >> 8, keys4 & 0xFFFFFF]))
        k = len(self.languages)
        self.cost1 = np.zeros((1 << 16, k), np.float32)
        self.escape2 = np.zeros((1 << 16, k), np.float32)
        self.cost2, self.escape3 = np.zeros((len(keys3), k), np.float32), np.zeros((len(keys3), k), np.float32)
        self.cost3 = np.zeros((len(keys4), k), np.float32)
        for j, one in enumerate(self.by_language):
            window, n = one["window"].to_numpy(np.uint32), one["n"].to_numpy(float)

            def order(bytes_: int, window=window, n=n):
                """Windows of so many bytes: their code lengths, and the contexts with their escapes."""
                key, at = np.unique(window & np.uint32((1 << 8 * bytes_) - 1), return_inverse=True)
                c = np.bincount(at, n)
                context, of = np.unique(key >> 8, return_inverse=True)
                total, followers = np.bincount(of, c), np.bincount(of)
                return key, -np.log2(c / (total + followers)[of]), context, -np.log2(followers / (total + followers))

            key, bits, _, escape = order(1)
            cost0 = np.full(256, escape[0] + 8)
            cost0[key] = bits
            key, bits, context, escape = order(2)
            cost1 = np.tile(cost0, (256, 1))
            cost1[context] += escape[:, None]
            cost1 = cost1.ravel()
            cost1[key] = bits
            key, bits, context, escape = order(3)
            self.escape2[context, j] = escape
            cost2 = cost1[keys3 & 0xFFFF] + self.escape2[keys3 >> 8, j]
            cost2[np.searchsorted(keys3, key)] = bits
            self.cost1[:, j], self.cost2[:, j] = cost1, cost2
            key, bits, context, escape = order(4)
            self.escape3[np.searchsorted(keys3, context), j] = escape
            cost3 = cost2[np.searchsorted(keys3, keys4 & 0xFFFFFF)] + self.escape3[np.searchsorted(keys3, keys4 >> 8), j]
            cost3[np.searchsorted(keys4, key)] = bits
            self.cost3[:, j] = cost3
        self.keys3, self.keys4 = keys3, keys4

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("by_language", "_find3", "_find4")}

    def bits(self, window: np.ndarray) -> np.ndarray:
        """Code length of each window's last byte in each language."""
        if not hasattr(self, "_find4"):
            self._find3, self._find4 = _Lookup(self.keys3), _Lookup(self.keys4, 21)
        at = self._find4(window)
        out = self.cost3[at] if len(self.cost3) else np.zeros((len(window), len(self.languages)), np.float32)
        new = np.flatnonzero(at < 0)
        if len(new):
            w = window[new]
            here, before = self._find3(w & np.uint32(0xFFFFFF)), self._find3(w >> np.uint32(8))
            bits = self.cost1[w & 0xFFFF] + self.escape2[(w >> 8) & 0xFFFF]
            bits[here >= 0] = self.cost2[here[here >= 0]]
            bits[before >= 0] += self.escape3[before[before >= 0]]
            out[new] = bits
        return out

    def text_bits(self, texts: list[str | None]) -> np.ndarray:
        """Code length of each whole text in each language."""
        total = np.zeros((len(texts), len(self.languages)))
        blobs = [t.encode("utf-8", "replace") if t else b"" for t in texts]
        at = 0
        while at < len(blobs):  # whole texts together up to a chunk, long ones in chunks of their own
            end, size = at, 0
            while end < len(blobs) and (end == at or size + len(blobs[end]) <= CHUNK):
                size += len(blobs[end])
                end += 1
            data = np.frombuffer(b"".join(blobs[at:end]), np.uint8)
            sizes = np.array([len(b) for b in blobs[at:end]])
            if end - at == 1:
                for i in range(0, size, CHUNK):
                    lead = min(i, 3)
                    w = windows(data[i - lead : i + CHUNK], np.array([0], int))[lead:]
                    total[at] += self.bits(w).sum(axis=0, dtype=float)
            elif size:
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                total[at + full] = np.add.reduceat(self.bits(windows(data, starts)).astype(float), starts, axis=0)
            at = end
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability (uniform prior) of each whole text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.text_bits(texts)
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        known = np.array([bool(t) and any(c.isalpha() for c in t) for t in texts], bool)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Learn from docs(doc_id, text, lang), whole texts of at most about max_docs documents a language.

    Rows without text or lang teach nothing; equal rows count once each.
    """
    docs = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    rank = F.abs(F.xxhash64("doc_id", F.lit(4)) % 1_000_000)
    sizes = docs.groupBy("lang").count().withColumn("below", F.lit(max_docs) * 1_000_000 / F.col("count"))
    some = docs.join(F.broadcast(sizes.select("lang", "below")), "lang").filter(rank < F.col("below"))  # a row a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for lang, group in frame.groupby("lang"):
                w, n = np.unique(_text_windows(group["text"].tolist()), return_counts=True)
                yield pa.record_batch(
                    [pa.array([lang] * len(w)), pa.array(w.astype(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "window", "n"],
                )

    counts = some.select("text", "lang").mapInArrow(run, "lang string, window long, n long")
    return Model(counts.groupBy("lang", "window").agg(F.sum("n").alias("n")).toPandas())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text).

    `und` with score 0 where the text is null or has no letter; rows with equal or null doc_id
    are scored one by one; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = model.predict(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
