"""Lineage cuts and bounded bitmaps shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or on a local master a folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sparkloom-"))
        import shutil

        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def cut(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, so a
    lost executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more. The collection lets Spark's cleaner
    delete the shuffle files of jobs that have ended, too."""
    spark = SparkSession.active()
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.System.gc()
    _release()


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), after which the worker gives the memory it freed back to the system:
    workers are used again, and what they keep adds up over the operators of a job."""

    def rows(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(rows, schema)


def _release() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def bitmap(df: DataFrame, column: str, log2_bits: int = 24, hashed: bool = False) -> np.ndarray:
    """One-hash membership bitmap of a bigint column: 2**log2_bits bits whatever the input, so it may
    be broadcast. It only ever lets too much through; callers join exactly afterwards. Values that are
    hashes already give their low bits."""
    slot = (F.col(column) if hashed else F.xxhash64(F.col(column))).bitwiseAND(F.lit((1 << log2_bits) - 1))
    words = (
        df.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def row_slot(column: str, log2_bits: int = 24):
    """The slot of a value, computed in the JVM so that it agrees with bitmap()."""
    return F.xxhash64(F.col(column)).bitwiseAND(F.lit((1 << log2_bits) - 1))


def in_bitmap(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((bits[slots >> 6].view(np.uint64) >> (slots & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def unique_ids(docs: DataFrame) -> tuple[DataFrame, bool, str]:
    """docs with a bigint column, named last, that is unique: doc_id where that is unique and never null, else a
    number given to each row of a written copy, in which rows still come in the order of doc_id. The
    flag tells which."""
    row = free(docs, "__row")
    counts = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("named")).first()
    if counts["n"] == counts["named"] and docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long")), True, row
    return cut(docs.orderBy(F.col("doc_id").asc_nulls_last()).withColumn(row, F.monotonically_increasing_id())), False, row
