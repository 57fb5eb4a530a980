"""Verified copies of folders: staged, hashed while copied, committed by one rename, checked before use.

Files are dealt to tasks; each reads its files in pieces, so neither size nor number matters to memory, and
only names, sizes and hashes come together, as a table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.sinks import verify_manifest

PIECE = 1 << 20
_ENTRY = "name string, size long, sha string"


class Damaged(RuntimeError):
    """A copy that is not what its manifest says."""


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """name, relative to the folder, of every file below it, hidden ones too."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = _fs(folder)
    root = root.rstrip("/")
    found = [f.path[len(root) + 1 :] for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.type == FileType.File]
    rows = spark.createDataFrame([(n,) for n in sorted(found)], "name string")
    return rows.repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism)))


def _hashed(source: str, target: str | None):
    """Size and SHA-256 of each file, which is copied on the way if there is a target."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = _fs(source)
        out_fs, out_root = _fs(target) if target else (None, "")
        for pdf in batches:
            rows = []
            for name in pdf["name"]:
                sha, size, out = hashlib.sha256(), 0, None
                if target:
                    out_fs.create_dir(f"{out_root}/{name}".rsplit("/", 1)[0], recursive=True)
                    out = out_fs.open_output_stream(f"{out_root}/{name}")
                with fs.open_input_stream(f"{root.rstrip('/')}/{name}") as f:
                    while piece := f.read(PIECE):
                        sha.update(piece)
                        size += len(piece)
                        if out:
                            out.write(piece)
                if out:
                    out.close()
                rows.append((name, size, sha.hexdigest()))
            yield pd.DataFrame(rows, columns=["name", "size", "sha"])

    return run


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """(name, size, sha) of every file below a folder."""
    return _names(spark, folder).mapInPandas(_hashed(folder, None), _ENTRY)


def backup(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy a folder to target/files with its manifest beside it, and return that. The target must not be
    there; it comes into being whole or not at all, and is checked once more before it does."""
    fs, root = _fs(target)
    from pyarrow.fs import FileType

    root = root.rstrip("/")
    if fs.get_file_info(root).type != FileType.NotFound:
        raise FileExistsError(target)
    stage = f"{root}.{uuid.uuid4().hex}"
    prefix = target[: len(target.rstrip("/")) - len(root)] if target.rstrip("/").endswith(root) else ""
    fs.create_dir(f"{stage}/files", recursive=True)
    _names(spark, source).mapInPandas(_hashed(source, f"{prefix}{stage}/files"), _ENTRY).write.parquet(f"{prefix}{stage}/manifest")
    wrong = verify(spark, f"{prefix}{stage}").limit(5).collect()
    if wrong:
        fs.delete_dir(stage)
        raise Damaged(f"{target}: {[tuple(r) for r in wrong]}")
    fs.move(stage, root)
    return manifest(spark, target)


def manifest(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(_ENTRY).parquet(f"{target.rstrip('/')}/manifest")


def verify(spark: SparkSession, target: str) -> DataFrame:
    """(name, error) of files that are missing, unexpected, or differ in size or hash; none for a good copy."""
    return verify_manifest(manifest(spark, target), entries(spark, f"{target.rstrip('/')}/files"), "name")


def restore(spark: SparkSession, target: str, to: str) -> int:
    """Copy a backup's files to a folder that is not there yet, and their number; refuses a damaged copy and
    leaves nothing behind if what arrives differs."""
    from pyarrow.fs import FileType

    fs, root = _fs(to)
    root = root.rstrip("/")
    if fs.get_file_info(root).type != FileType.NotFound:
        raise FileExistsError(to)
    wrong = verify(spark, target).limit(5).collect()
    if wrong:
        raise Damaged(f"{target}: {[tuple(r) for r in wrong]}")
    stage = f"{root}.{uuid.uuid4().hex}"
    prefix = to.rstrip("/")[: len(to.rstrip("/")) - len(root)] if to.rstrip("/").endswith(root) else ""
    fs.create_dir(stage, recursive=True)
    source = f"{target.rstrip('/')}/files"
    arrived = _names(spark, source).mapInPandas(_hashed(source, f"{prefix}{stage}"), _ENTRY).persist()
    try:
        wrong = verify_manifest(manifest(spark, target), arrived, "name").limit(5).collect()
        if wrong:
            fs.delete_dir(stage)
            raise Damaged(f"{to}: {[tuple(r) for r in wrong]}")
        fs.move(stage, root)
        return arrived.count()
    finally:
        arrived.unpersist()


def stale(last_success: str, now: str, seconds: int = 86_400):
    """Whether a backup that succeeded at last_success (none: stale) is older than a day."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(last_success) > seconds, F.lit(True))
