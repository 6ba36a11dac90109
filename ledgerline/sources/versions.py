"""Tables by asset that can be read at all times: writes add folders, one renamed file makes them count.

    root/data/version=<name>/asset_id=<asset>/*.parquet     what one write has written, never changed
    root/log/<number>                                       the folder that holds each asset as of that version
    root/staged/                                            batches being merged; forget() drops them

A reader takes the log's newest file once and sees that version to its end, whatever is written meanwhile.  A write that
fails leaves folders that no log names.  Of two writers at a time the later rename fails, and nothing of its own counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import keys, validate
from . import tables


def _path(spark: SparkSession, *parts: str):
    return spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _files(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, *parts: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    at, fs = _path(spark, *parts), _files(spark, parts[0])
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that can be read, in order; none for a new table."""
    return sorted(int(n) for n in _names(spark, root, "log") if n.isdigit())


def _log(spark: SparkSession, root: str, number: int) -> dict[str, str]:
    """Folder of each asset's folder name: one entry an asset."""
    return json.loads(spark.read.text(f"{root}/log/{number:012d}", wholetext=True).first()[0])


def _commit(spark: SparkSession, root: str, number: int, log: dict[str, str]) -> None:
    """Publish a version by a rename that fails if there is one of this number."""
    fs = _files(spark, root)
    fs.mkdirs(_path(spark, root, "log"))
    new, at = _path(spark, root, "log", f"_{uuid.uuid4().hex}"), _path(spark, root, "log", f"{number:012d}")
    out = fs.create(new, False)
    out.write(bytearray(json.dumps(log, sort_keys=True).encode()))
    out.close()
    gateway = spark.sparkContext._gateway
    options = gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, at, options)
    except Exception as e:
        fs.delete(new, False)
        raise RuntimeError(f"version {number} has been written by another writer") from e


def read(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """Rows of a version, the newest if none is given, as of now.  A table or version that doesn't exist is an error."""
    known = versions(spark, root)
    number = version if version is not None else (known[-1] if known else None)
    if number not in known:
        raise ValueError(f"no version {number} in {root}")
    folders = [f"{root}/data/{folder}/{asset}" for asset, folder in sorted(_log(spark, root, number).items())]
    kind = T.StructType([*(f for f in schema.fields if f.name != "asset_id"), T.StructField("version", T.StringType()), T.StructField("asset_id", T.StringType())])
    df = spark.read.schema(kind).option("basePath", f"{root}/data").parquet(*folders)
    return validate.conform(df, schema)


def write(spark: SparkSession, root: str, df: DataFrame, schema: T.StructType, order: tuple[str, ...] = (), base: int | None = None) -> int:
    """Replace the assets in df, as a new version whose number is returned.  Empty input is an error, a null asset too.

    With `base` the write fails if that is no longer the newest version (0: no version yet).
    """
    before = (versions(spark, root) or [0])[-1] if base is None else base
    folder = f"version={before + 1}-{uuid.uuid4().hex}"
    named = df.withColumn("asset_id", F.coalesce("asset_id", F.raise_error(F.lit("null asset_id")).cast("string")))
    tables.write(named, f"{root}/data/{folder}", schema, order, mode="error")
    log = _log(spark, root, before) if before else {}
    log |= {name: folder for name in _names(spark, root, "data", folder) if name.startswith("asset_id=")}
    _commit(spark, root, before + 1, log)
    return before + 1


def merge(spark: SparkSession, root: str, batch: DataFrame, schema: T.StructType, key: list[str], order: tuple[str, ...] = ()) -> int:
    """Upsert a batch (with `ordinal`) as a new version; only the batch's assets are written, batch and result are staged."""
    before = (versions(spark, root) or [0])[-1]
    batch = tables.staged(batch, f"{root}/staged")
    stored = spark.createDataFrame([], schema)
    if before:
        stored = read(spark, root, schema, before).join(batch.select("asset_id").distinct(), "asset_id", "left_semi")
    merged = tables.staged(validate.conform(keys.upsert(stored, batch, key), schema), f"{root}/staged")
    return write(spark, root, merged, schema, order, before)


def forget(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Drop all but the last `keep` versions and the folders that none of them names; returns how many folders went.

    Run it while nobody reads older versions and nobody writes: it also takes what a writer hasn't published yet.
    """
    if keep < 1:
        raise ValueError("at least one version must stay")
    known, fs = versions(spark, root), _files(spark, root)
    live = {f"{folder}/{asset}" for number in known[-keep:] for asset, folder in _log(spark, root, number).items()}
    for number in known[:-keep]:
        fs.delete(_path(spark, root, "log", f"{number:012d}"), False)
    fs.delete(_path(spark, root, "staged"), True)
    gone = 0
    for folder in _names(spark, root, "data"):
        assets = [n for n in _names(spark, root, "data", folder) if n.startswith("asset_id=")]
        dead = [a for a in assets if f"{folder}/{a}" not in live]
        for asset in dead:
            fs.delete(_path(spark, root, "data", folder, asset), True)
        if len(dead) == len(assets):
            fs.delete(_path(spark, root, "data", folder), True)
        gone += len(dead)
    return gone
