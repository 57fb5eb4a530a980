"""Memories and conversations: supersession, validity, recall scores, budgets, rolling summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def superseded(memories: DataFrame, order: list[str]) -> DataFrame:
    """memories with superseded_by and superseded_at: the next write of the same namespace and key."""
    w = Window.partitionBy("namespace", "memory_key").orderBy(*order)
    return memories.withColumns({"superseded_by": F.lead("memory_id").over(w), "superseded_at": F.lead("created_at").over(w)})


def valid_at(memories: DataFrame, now: Column) -> DataFrame:
    """Not superseded, begun, and not expired (the end is exclusive)."""
    return memories.where(F.col("superseded_at").isNull() & (F.col("valid_from") <= now) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def recency(created: Column, now: Column, half_life_days: float = 180.0) -> Column:
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp(created)) / 86400.0)
    return F.exp(-F.ln(F.lit(2.0)) * age / half_life_days)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over united distinct tokens, 0 if there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def recall_score(cosine: Column, overlap: Column, importance: Column, fresh: Column) -> Column:
    return F.least(F.lit(1.0), 0.65 * F.greatest(F.lit(0.0), cosine) + 0.20 * overlap + 0.10 * importance + 0.05 * fresh)


def units(messages: DataFrame, by: str, order: str) -> DataFrame:
    """messages with unit: it begins at each user message; what comes before the first is unit 0."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("unit", F.sum((F.col("role") == "user").cast("long")).over(w))


def fit_budget(messages: DataFrame, by: str, order: str, size: str, budget: int) -> DataFrame:
    """Leading system messages, and as many of the newest units as fit; the newest one always."""
    m = units(messages, by, order)
    lead = F.max((F.col("role") != "system").cast("int")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) == 0
    m = m.withColumn("leading", lead)
    sums = m.where(~F.col("leading")).groupBy(by, "unit").agg(F.sum(size).alias("unit_size"))
    head = m.where("leading").groupBy(by).agg(F.sum(size).alias("head_size"))
    newest = Window.partitionBy(by).orderBy(F.desc("unit"))
    sums = sums.join(head, by, "left").withColumns({"used": F.sum("unit_size").over(newest.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("head_size", F.lit(0)), "nth": F.row_number().over(newest)})
    kept = sums.where((F.col("used") <= budget) | (F.col("nth") == 1)).select(by, "unit")
    rest = m.where(~F.col("leading")).join(kept, [by, "unit"], "left_semi").select(*m.columns)
    return m.where("leading").unionByName(rest)


def rolling_summary(messages: DataFrame, by: str, order: str, keep: int, longest: int) -> DataFrame:
    """(by, n_kept, summary): all but the newest `keep` messages as lines, the last `longest` characters."""
    m = messages.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))))
    line = F.concat(F.col("role"), F.lit(": "), F.trim(F.regexp_replace("text", r"\s+", " ")))
    g = m.groupBy(by).agg(
        F.sum((F.col("nth") <= keep).cast("long")).alias("n_kept"),
        F.sort_array(F.collect_list(F.when(F.col("nth") > keep, F.struct(F.col(order).alias("o"), line.alias("line"))))).alias("_l"),
    )
    return g.select(by, "n_kept", F.right(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit(longest)).alias("summary"))
