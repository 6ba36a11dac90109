"""Checksums of files of any size: a data source whose tasks read files in chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, modified timestamp, sha256 string"


@dataclass
class Share(InputPartition):
    """Files of one task: (path, length, microseconds of the last change) each."""

    files: list[tuple[str, int, int]]


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.chunk, self.share = options["uri"], int(options["chunk"]), int(options["share"])

    def partitions(self) -> list[Share]:
        """Files dealt to tasks of about `share` bytes; a larger one has a task of its own.  Names with a leading _ or . are skipped."""
        files, root = fs.FileSystem.from_uri(self.uri)
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        shares: list[Share] = []
        room = 0
        for f in sorted(found, key=lambda f: f.path):
            inner = f.path[len(root) :].strip("/").split("/")
            if f.type != fs.FileType.File or any(n[0] == "." or (n[0] == "_" and "=" not in n) for n in inner):
                continue
            cost = max(f.size, 1 << 16)  # small files cost their opening
            if not shares or cost > room:
                shares.append(Share([]))
                room = self.share
            shares[-1].files.append((f.path, f.size, f.mtime_ns // 1000))
            room -= cost
        return shares or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.uri)
        for path, length, changed in partition.files:
            digest, done = hashlib.sha256(), 0
            with files.open_input_stream(path) as stream:
                while part := stream.read(self.chunk):
                    digest.update(part)
                    done += len(part)
            if done != length:
                raise ValueError(f"{path} changed while it was read")
            yield path, length, datetime.fromtimestamp(changed / 1_000_000, UTC), digest.hexdigest()


class FileDigests(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def digests(spark: SparkSession, path: str, chunk: int = 8 << 20, share: int = 128 << 20) -> DataFrame:
    """(path, length, modified, sha256) of each file below a folder; a task holds one chunk at a time, whatever a file's size.

    The driver lists names, as for any file scan.  Local folders, HDFS and S3 are read through Arrow's file systems; for others use
    files.provenance(), which holds a file in one row.  Paths are without scheme.  A file that changes meanwhile fails its task.
    """
    if chunk < 1 or share < 1:
        raise ValueError("chunk and share must be positive")
    spark.dataSource.register(FileDigests)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri()
    scheme = "s3" if uri.getScheme() == "s3a" else uri.getScheme()
    at = uri.getPath() if scheme == "file" else f"{scheme}://{uri.getAuthority() or ''}{uri.getPath()}"
    return spark.read.format("file_digests").options(uri=at, chunk=chunk, share=share).load()
