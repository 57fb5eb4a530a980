"""Sinks: last-write-wins upserts, deletes, content-addressed artifacts, verified copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.relational import latest


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """current with changes laid over it: the first row of each key in the given order, changes winning."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, [F.desc("_new"), *order]).drop("_new")


def delete(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti")


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace just the partitions that df has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def new_artifacts(df: DataFrame, content: str, known: DataFrame) -> DataFrame:
    """Contents not stored yet, once each, with their sha: what a write-once store has to add."""
    return df.select(F.sha2(content, 256).alias("sha"), F.col(content).alias("content")).dropDuplicates(["sha"]).join(known.select("sha"), "sha", "left_anti")


def verify_manifest(manifest: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, error) of entries that are missing, unexpected, or differ in size or hash."""
    m, a = manifest.alias("m"), actual.alias("a")
    j = m.join(a, F.col(f"m.{key}") == F.col(f"a.{key}"), "full")
    error = (
        F.when(F.col(f"a.{key}").isNull(), "missing").when(F.col(f"m.{key}").isNull(), "unexpected")
        .when(F.col("m.size") != F.col("a.size"), "size_mismatch").when(F.col("m.sha") != F.col("a.sha"), "hash_mismatch")
    )
    return j.select(F.coalesce(f"m.{key}", f"a.{key}").alias(key), error.alias("error")).where("error IS NOT NULL")
