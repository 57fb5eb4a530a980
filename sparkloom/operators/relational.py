"""Joins, set operations and summaries that plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The n first rows of each group; Spark keeps n a group and task before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= n)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins: of rows of the same keys the first in the given order."""
    return top_per_group(df, keys, order, 1, "_rank").drop("_rank")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, value: str) -> DataFrame:
    """left with the value that right had last at or before left's time, per key.

    Both sides are laid in one order per key and the last value is carried on, so one shuffle serves and
    no pairs are made."""
    a = left.select(*left.columns, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(None).cast(right.schema[right_ts].dataType).alias("_vt"))
    b = right.select(*by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.col(value).alias("_v"), F.col(right_ts).alias("_vt"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_hit", F.last(F.when(F.col("_side") == 0, F.struct("_v", "_vt")), ignorenulls=True).over(w))
    return filled.where("_side = 1").select(*left.columns, F.col("_hit._v").alias(value), F.col("_hit._vt").alias(f"matched_{right_ts}"))


def range_join(left: DataFrame, right: DataFrame, point: str, lo: str, hi: str, width: float) -> DataFrame:
    """Rows of left whose point lies in [lo, hi) of a row of right: both are dealt to buckets of the
    given width, so it is an equi-join with a residual condition instead of a nested loop."""
    a = left.withColumn("_b", F.floor(F.col(point) / width))
    b = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return a.join(b, "_b").where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("_b")


def either_end(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Both directions of an edge as rows (node, other, ...): turns an OR-join into one equi-join."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    return edges.select(F.col(src).alias("node"), F.col(dst).alias("other"), *rest).unionAll(edges.select(F.col(dst).alias("node"), F.col(src).alias("other"), *rest))


def recovered(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """df with `violations`: the names of the checks that a row fails, in order."""
    return df.withColumn("violations", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull()))
