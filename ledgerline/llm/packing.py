"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Every task packs its own rows, so nothing is shuffled: whole windows are cut from the front of
long documents, and the rests are collected into batches of bounded size.  A batch of rests is
divided into k windows by differencing, k rising while a window would hold over `capacity`.  Where
more than one window beyond the least possible number would be needed, since the rests' lengths fit
badly, they are cut in two and divided again: smaller pieces leave less room in any window.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe
from .common import by_bytes

#: Rests are not cut below this to leave less room.
SMALLEST = 16

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long, padded_to long"
)


def differencing(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """Divide items into k windows of near-equal sums: [(sum, items)], empty windows left out.

    A partial partition is the list of its non-empty windows, largest first.  The two partials
    with the largest spread are merged, the largest windows of one onto the smallest of the other.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, order, b = heapq.heappop(heap)
        shared = max(0, len(a) + len(b) - k)
        kept = len(a) - shared
        both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[kept:], reversed(b[len(b) - shared :]), strict=True)]
        merged = sorted(a[:kept] + both + b[: len(b) - shared], key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], order, merged))
    return heap[0][2] if heap else []


def windows(sizes: list[int], capacity: int, spare: int | None = None) -> list[tuple[int, list[int]]] | None:
    """Near-equal windows of at most capacity each; the window count rises until all fit.

    With `spare`, None if more windows than that would be needed beyond the least possible number.
    """
    least = max(1, -(-sum(sizes) // capacity))
    k = least
    while spare is None or k <= least + spare:
        found = differencing(sizes, k)
        if not found or found[0][0] <= capacity:
            return found
        k += 1
    return None


def divide(lengths: list[int], capacity: int, cut: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows [(sum, [(item, start, length)])] of items that may be cut freely, at first in equal parts of at most `cut`.

    Half as long parts are tried while more than one window beyond the least possible number would be needed.
    """
    while True:
        pieces = []
        for i, length in enumerate(lengths):
            parts = -(-length // cut)
            ends = [length * j // parts for j in range(parts + 1)]
            pieces += [(i, a, b - a) for a, b in zip(ends, ends[1:], strict=False)]
        found = windows([p[2] for p in pieces], capacity, 1 if cut > SMALLEST else None)
        if found is not None:
            return [(total, [pieces[i] for i in items]) for total, items in found]
        cut = max(cut // 2, SMALLEST)


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
    cut: int = 682,
    batch_items: int = 200,
    with_ids: bool = False,
) -> DataFrame:
    """Pack docs(doc_id, text) into sequences of at most `capacity` ids.

    Each document's ids end with `end_id`; null and empty texts have that id alone.  Pieces are
    whole windows of `capacity` ids from the document's front, then equal cuts of the rest of at
    most `cut` ids, smaller ones if these leave much room, which differencing deals to windows.  A sequence counts as padded to
    `capacity` (`padded_to`) unless its length is a power of two.  Rows with equal or null doc_id
    are packed one by one; an empty table gives no rows; other columns are ignored.  with_ids
    adds the piece's ids as little-endian unsigned 32-bit `ids`.
    """
    path = tokenizer_path or bpe.default_path()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * len(names)
    schema = SCHEMA
    if with_ids:
        names, kinds, schema = [*names, "ids"], [*kinds, pa.binary()], SCHEMA + ", ids binary"
    arrow = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        encode = encoder.ids
        end = end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 40
        rows, rests = [], []

        def put(doc_id: int, start: int, ids: bytes, n: int, offset: int, total: int) -> None:
            padded = total if total & (total - 1) == 0 else capacity
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, sequence, offset, total, padded, *([ids] if with_ids else [])))

        def deal() -> None:
            """rests: (doc_id, start, ids, number of the document's ids)."""
            nonlocal sequence
            for total, pieces in divide([len(r[2]) // 4 for r in rests], capacity, cut):
                offset = 0
                for i, at, length in pieces:
                    doc_id, start, ids, n = rests[i]
                    put(doc_id, start + at, ids[4 * at : 4 * (at + length)], n, offset, total)
                    offset += length
                sequence += 1
            rests.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            rows.clear()
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema=arrow)

        for batch in by_bytes(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                n, start = len(ids) // 4, 0
                while n - start >= capacity:
                    put(doc_id, start, ids[4 * start : 4 * (start + capacity)], n, 0, capacity)
                    sequence += 1
                    start += capacity
                if start < n:
                    rests.append((doc_id, start, ids[4 * start :], n))
                if len(rests) >= batch_items:
                    deal()
                if len(rows) >= 5_000:
                    yield out()
        encoder.forget()
        deal()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
