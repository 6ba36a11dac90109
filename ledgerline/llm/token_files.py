"""Token ids in files: frequency ranks in byte-aligned variable-length coding.

An id is replaced by its rank in the corpus (0: most frequent) and written in 1 to 4 bytes; the
lengths, two bits each, stand apart in control bytes of four values.  Decoding looks the four
lengths of a control byte up in a table, all of a document's control bytes at once.

Files: Parquet folders part=0, 1, ... of ascending doc_id, each row a document with its control
and data bytes, and a table of the ids by rank.  Spark's committed writes make lost tasks harmless.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import by_bytes, save, shared_dir

#: Bytes, about, of pieces that the encoder keeps a generation: nothing else in these tasks needs much memory.
MAX_BYTES = 150 << 20
#: Ids, about, that are coded or decoded at a time.
SLICE = 1 << 20
#: Lengths of the four values of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype("<u4", copy=False)
    length = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = length - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that encode() wrote."""
    return _values(LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n], data)


def _values(length: np.ndarray, data: bytes) -> np.ndarray:
    at = np.cumsum(length) - length
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)).astype(np.uint32)
    value = raw[at]
    for j in (1, 2, 3):
        longer = np.flatnonzero(length > j)
        if not len(longer):
            break
        value[longer] |= raw[at[longer] + j] << np.uint32(8 * j)
    return value


def encode_all(ranks: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """encode() of several arrays that stand in one: their control bytes and data bytes, each with the places where they end, from 0."""
    ranks = ranks.astype("<u4", copy=False)
    length = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    padded = _ends(-(-sizes // 4))
    code = np.zeros(padded[-1] * 4, np.uint8)
    code[np.arange(len(ranks)) + np.repeat(padded[:-1] * 4 - _ends(sizes)[:-1], sizes)] = length - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]]
    return control, padded, data, np.append(0, np.cumsum(length, dtype=np.int64))[_ends(sizes)]


def decode_all(control: bytes, data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The values of several arrays whose control bytes and data bytes stand one after the other."""
    per = -(-sizes // 4)
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    spare = per * 4 - sizes  # values of the last control byte of each that are none
    kept = np.ones(len(length), bool)
    for j in range(1, 4):
        kept[_ends(per)[1:][spare >= j] * 4 - j] = False
    return _values(length[kept], data)


def _ends(sizes: np.ndarray) -> np.ndarray:
    """0 and the running sums."""
    return np.append(0, np.cumsum(sizes, dtype=np.int64))


def _blobs(column: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """Bytes of a binary column without nulls, one value after the other, and their sizes."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]] if len(column) else memoryview(b""), np.diff(ends)


def _column(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the stretches of `values` between `ends`, which count bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE ids by their n_tokens, so that memory does not grow with a batch's rows."""
    for batch in batches:
        held = np.cumsum(batch.column("n_tokens").to_numpy(zero_copy_only=False))
        at = 0
        while at < len(held):
            end = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + SLICE, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _batches(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Ids of docs(doc_id, text) in ascending doc_id: one partition of rows after the other.

    (part, doc_id, start_in_part, n_tokens, ids); ids take two bytes each while they fit.
    """
    names = ["part", "doc_id", "start_in_part", "n_tokens", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = bpe.encoder(path, MAX_BYTES).ids
        part, start = TaskContext.get().partitionId(), 0
        for batch in by_bytes(batches):
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(np.frombuffer(ids_of(text), "<u4"), np.uint32(end_id))
                narrow = ids.astype("<u2") if ids.max() < 1 << 16 else ids
                # the width shows in the size: two or four bytes for each of n_tokens
                rows.append((part, doc_id, start, len(ids), narrow.tobytes()))
                start += len(ids)
                held += len(ids)
                if held > 1 << 22:
                    yield _batches(rows, names, kinds)
                    rows, held = [], 0
            yield _batches(rows, names, kinds)

    sorted_docs = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return sorted_docs.mapInArrow(run, "part int, doc_id long, start_in_part long, n_tokens long, ids binary")


def _wide(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _all_wide(blobs: pa.Array, n: np.ndarray) -> np.ndarray:
    """The ids of all rows in one array."""
    data, sizes = _blobs(blobs)
    if (sizes == 2 * n).all():
        return np.frombuffer(data, "<u2")
    ends = _ends(sizes)
    return np.concatenate([_wide(data[a:b], k).astype("<u4", copy=False) for a, b, k in zip(ends, ends[1:], n, strict=False)])


def frequency_ranks(ids: DataFrame) -> DataFrame:
    """(rank, id, n) over all ids, the most frequent first, ties by id; at most one row an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in _slices(batches):
            one = np.bincount(_all_wide(batch.column("ids"), batch.column("n_tokens").to_numpy()))
            if len(one) > len(counts):
                counts = np.append(counts, np.zeros(len(one) - len(counts), np.int64))
            counts[: len(one)] += one
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "n"])

    total = ids.select("ids", "n_tokens").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # one row an id of the vocabulary, which bounds this single-partition window
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1
    return total.select(rank.cast("long").alias("rank"), "id", "n")


def write(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = 0) -> None:
    """Write docs(doc_id, text) as token files under `folder`.

    Null and empty texts are the end id alone; rows with equal doc_id stand side by side, rows
    with null doc_id come first; other columns are ignored; an empty table writes empty files.
    """
    ids = save(tokenize(docs, tokenizer_path or bpe.default_path(), end_id), "ids")
    ranks = save(frequency_ranks(ids), "ranks")
    ranks.coalesce(1).write.parquet(f"{folder}/ranks")
    table = ranks.toPandas()  # at most the vocabulary's size
    rank_of = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.uint32)
    rank_of[table["id"]] = table["rank"]
    names = ["part", "doc_id", "start_in_part", "n_tokens", "control", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.column("n_tokens").to_numpy()
            control, ends, data, data_ends = encode_all(rank_of[_all_wide(batch.column("ids"), n)], n)
            yield pa.record_batch([*batch.columns[:4], _column(control, ends), _column(data, data_ends)], names=names)

    coded = ids.mapInArrow(run, "part int, doc_id long, start_in_part long, n_tokens long, control binary, data binary")
    coded.sortWithinPartitions("part", "doc_id", "start_in_part").write.partitionBy("part").parquet(f"{folder}/tokens")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Read token files back: (doc_id, start, n_tokens, ids_crc32[, ids]); start counts all ids before."""
    table = spark.read.parquet(f"{folder}/ranks").toPandas().sort_values("rank")
    id_of = table["id"].to_numpy(np.uint32)
    names = ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            n = batch.column("n_tokens").to_numpy()
            control, data = (_blobs(batch.column(c))[0] for c in ("control", "data"))
            ids, ends = id_of[decode_all(control, data, n)].astype("<u4", copy=False), _ends(n) * 4
            raw = memoryview(ids).cast("B") if len(ids) else memoryview(b"")
            crc = pa.array([zlib.crc32(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64())
            yield pa.record_batch([*batch.columns[:4], crc, *([_column(ids, ends)] if with_ids else [])], names=names)

    schema = "part int, doc_id long, start_in_part long, n_tokens long, control binary, data binary"
    coded = spark.read.schema(schema).parquet(f"{folder}/tokens")
    coded = coded.select("part", "doc_id", "start_in_part", "n_tokens", "control", "data")
    # one row a file part, as many as the writing shuffle had partitions
    parts = coded.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("before"))
    fields = "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    out = coded.mapInArrow(run, fields).join(parts, "part")
    start = (F.col("start_in_part") + F.col("before")).alias("start")
    return out.select("doc_id", start, "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """write() into the shared folder, then read()."""
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer_path, end_id)
    return read(docs.sparkSession, folder)
