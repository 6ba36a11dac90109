"""Substring dedup: words in repeated windows are removed, found by a count-min prefilter.

A window is `size` consecutive words of a text.  A first pass counts what windows are known by in
count-min sketches, one a task, which are merged; the merged counts are never too low.  A second
pass groups exactly, by 128-bit hashes of their words, the windows that are estimated to be
repeated, so that none is lost.

A window is counted by its anchor, the run of `gram` words of the least hash in it.  Equal windows
have equal anchors at equal places, so an anchor counts at least as often as any of its windows;
neighbouring windows mostly share one, which keeps the sketch about six times smaller.  Cells say
no, one or several.  The sketch has a fixed size: with more windows than it can tell apart more
are grouped exactly, never fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import by_bytes, save
from .jaccard import mix

#: Cells of the sketch (2^bits) and its rows, each with a hash of its own; one bit a cell is broadcast.
SKETCH_BITS, DEPTH = 28, 4
#: Places of windows that were estimated to be repeated and are not, up to which they are broadcast; beyond, texts are shuffled.
MAX_BROADCAST_PLACES = 2_000_000
#: Cells that a partial sketch's row covers.
BLOCK = 1 << 16
#: Cells that a task holds before it hands out a partial sketch.
HELD = 1 << 22
#: Bytes of text that a task has as arrays at a time (longer texts alone).
CHUNK = 1 << 17


def anchors(h: np.ndarray, size: int, gram: int) -> np.ndarray:
    """Of the windows over these word hashes the place of each one's anchor, the leftmost of equal ones."""
    value = words.runs(h, gram)
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, length, width = np.arange(len(value)), 1, size - gram + 1
    while length < width:
        step = min(length, width - length)
        left, right = value[: len(value) - step], value[step:]
        value, place = np.minimum(left, right), np.where(left <= right, place[: len(value) - step], place[step:])
        length += step
    return place


def cells(anchor: np.ndarray, bits: int) -> np.ndarray:
    """The sketch's DEPTH cells of each anchor's hash, each in a row of its own."""
    row = bits - (DEPTH - 1).bit_length()
    return np.stack([mix(anchor, s) >> np.uint64(64 - row) | np.uint64(s << row) for s in range(DEPTH)]).astype(np.int64)


class Text:
    """The words of some texts in one array, `doc` the text of each, `first` each text's first word, `n` its number of words."""

    def __init__(self, texts: list[bytes]):
        self.data, self.start, self.end, self.doc = words.spans(texts, words.BETWEEN_BLANKS)
        self.n = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.n) - self.n

    def hashes(self, salt: int = 0) -> np.ndarray:
        return words.hashes(self.data, self.start, self.end, salt)

    def windows(self, size: int) -> np.ndarray:
        """The words that windows within a text start at."""
        reach = max(0, len(self.doc) - size + 1)
        return np.flatnonzero(self.doc[:reach] == self.doc[len(self.doc) - reach :])

    def covered(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Of each word whether it is in a window that begins at one of `starts`."""
        change = np.zeros(len(self.doc) + 1, np.int64)
        change[starts] += 1
        change[starts + size] -= 1
        return np.cumsum(change[:-1]) > 0

    def kept(self, gone: np.ndarray) -> pa.Array:
        """Each text's words that are not gone, joined by one blank."""
        at = np.flatnonzero(~gone)
        doc, start, end = self.doc[at], self.start[at], self.end[at]
        last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
        end = end + ~last  # the byte behind a word is white space
        size = end - start
        change = np.zeros(len(self.data) + 2, np.int8)
        change[start] += 1
        change[end] -= 1
        body = self.data[np.cumsum(change[: len(self.data)], dtype=np.int8) > 0]
        body[np.cumsum(size)[~last] - 1] = 0x20
        ends = np.append(0, np.cumsum(np.bincount(doc, weights=size, minlength=len(self.n)).astype(np.int64)))
        kind, width = (pa.string(), np.int32) if ends[-1] < 1 << 31 else (pa.large_string(), np.int64)
        return pa.Array.from_buffers(kind, len(self.n), [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(body)])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Text]]:
    for batch in by_bytes(batches, size=CHUNK):
        yield batch, Text(words.blobs(batch.column("text")))


def sketch(docs: DataFrame, size: int, gram: int, bits: int) -> np.ndarray:
    """A bit a cell: whether several anchors of all docs fall into it."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (block, once, twice) of the cells that a task has met, as offsets in the block."""
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            block, at = np.unique(cell // BLOCK, return_index=True)
            parts = list(zip(np.split(cell, at[1:]), np.split(n, at[1:]), strict=True)) if len(block) else []
            offsets = lambda c: (c % BLOCK).astype("<u2").tobytes()
            once, twice = [offsets(c[k == 1]) for c, k in parts], [offsets(c[k > 1]) for c, k in parts]
            return pa.record_batch([pa.array(block, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], names=["block", "once", "twice"])

        for _, text in _slices(batches):
            h = text.hashes()
            at = np.unique(anchors(h, size, gram)[text.windows(size)])
            held.append(cells(words.runs(h, gram)[at], bits).ravel())
            if sum(map(len, held)) > HELD:
                yield out()
        yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = total.setdefault(block, np.zeros(BLOCK, np.uint8))
                for blob, add in ((once, 1), (twice, 2)):
                    at = np.frombuffer(blob, "<u2")
                    count[at] = np.minimum(count[at] + add, 2)
        several = [np.packbits(c > 1, bitorder="little").tobytes() for c in total.values()]
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array(several, pa.binary())], names=["block", "several"])

    parts = docs.select("text").mapInArrow(partial, "block int, once binary, twice binary").repartition("block")
    found = np.zeros((1 << bits) // 8, np.uint8)
    for block, several in parts.mapInArrow(merge, "block int, several binary").toLocalIterator():  # 2^bits bits in all
        found[block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(several, np.uint8)
    return found


def estimated(text: Text, several: np.ndarray, size: int, gram: int, bits: int) -> np.ndarray:
    """The words that windows start at whose anchor is estimated to be repeated."""
    h, starts = text.hashes(), text.windows(size)
    place = anchors(h, size, gram)[starts]
    chosen, back = np.unique(place, return_inverse=True)
    at = cells(words.runs(h, gram)[chosen], bits)
    twice = (several[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=0)
    return starts[twice[back]]


def remove_repeated(docs: DataFrame, size: int = 35, gram: int = 24, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, text): docs(doc_id, text) without the words in repeated windows.

    Words are runs without white space, unchanged.  A word goes if some window over it has its words also
    at another place, in the same document or another; windows are judged on the input.  The words
    that stay are joined by one blank.  Null and empty texts have no words and give empty texts; rows
    with equal or null doc_id are documents of their own, so of equal rows all windows are repeated; an
    empty table gives no rows; other columns are ignored.
    """
    if not 0 < gram <= size:
        raise ValueError("gram must be from 1 to size")
    docs = docs.select("doc_id", "text")
    level: Broadcast = docs.sparkSession.sparkContext.broadcast(sketch(docs, size, gram, sketch_bits))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, text string"

    def met(text: Text) -> np.ndarray:
        return estimated(text, level.value, size, gram, sketch_bits)

    def made(batch: pa.RecordBatch, text: Text, gone: np.ndarray) -> pa.RecordBatch:
        removed = np.bincount(text.doc[gone], minlength=len(text.n))
        columns = [batch.column("doc_id"), pa.array(text.n), pa.array(removed), text.kept(gone).cast(pa.string())]
        return pa.record_batch(columns, names=["doc_id", "n_words", "n_removed", "text"])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in _slices(batches):
            has = np.bincount(text.doc[met(text)], minlength=len(text.n)) > 0
            yield made(batch, text, has[text.doc]).filter(pa.array(~has))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in _slices(batches):
            yield batch.filter(pa.array(np.bincount(text.doc[met(text)], minlength=len(text.n)) > 0))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, row, at) of each window to be grouped: its hashes and its place."""
        for batch, text in _slices(batches):
            starts = met(text)
            doc = text.doc[starts]
            found = [words.runs(text.hashes(salt), size, salt)[starts].view(np.int64) for salt in (0, 1)]
            found += [batch.column("row").to_numpy()[doc], (starts - text.first[doc]).astype(np.int32)]
            yield pa.record_batch([pa.array(c) for c in found], names=["a", "b", "row", "at"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in _slices(batches):
            once = batch.column("once")
            doc = np.repeat(np.arange(len(text.n)), pc.fill_null(pc.list_value_length(once), 0).to_numpy(zero_copy_only=False))
            starts = np.setdiff1d(met(text), text.first[doc] + once.flatten().to_numpy())
            yield made(batch, text, text.covered(starts, size))

    some = save(docs.mapInArrow(touched, docs.schema).withColumn("row", F.monotonically_increasing_id()), "touched")
    grouped = some.mapInArrow(windows, "a long, b long, row long, at int").groupBy("a", "b")
    # what the sketch took for repeated and is not; hot windows meet in the partial counts
    once = grouped.agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("at").alias("at")).filter("n = 1")
    once = save(once.select("row", "at"), "once")
    few = once.count() <= MAX_BROADCAST_PLACES
    once = once.groupBy("row").agg(F.collect_list("at").alias("once"))
    rest = some.join(F.broadcast(once) if few else once, "row", "left").select("doc_id", "text", "once")
    return docs.mapInArrow(untouched, schema).unionByName(rest.mapInArrow(cut, schema))
