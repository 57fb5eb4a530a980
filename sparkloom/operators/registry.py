"""Versions of sources as an append-only log of events, and ingestion that skips what is active."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.relational import top_per_group

KEYS = ["tenant_id", "source_id"]


def version_status(events: DataFrame) -> DataFrame:
    """(tenant_id, source_id, version_id, status) of events(tenant_id, source_id, version_id, event, seq)
    with event building, activated or failed: the version activated last is active and all others that
    ever were are retired; a failure never takes the active version down."""
    v = events.groupBy(*KEYS, "version_id").agg(
        F.max(F.when(F.col("event") == "activated", F.col("seq"))).alias("activated"), F.max_by("event", "seq").alias("last")
    )
    newest = F.max("activated").over(Window.partitionBy(*KEYS))
    status = (
        F.when(F.col("activated") == newest, "active").when(F.col("last") == "failed", "failed").when(F.col("activated").isNotNull(), "retired").otherwise("building")
    )
    return v.withColumn("status", status).select(*KEYS, "version_id", "status")


def active_versions(events: DataFrame) -> DataFrame:
    return top_per_group(events.where("event = 'activated'"), KEYS, [F.desc("seq")], 1).select(*KEYS, "version_id")


def version_id(acl: str = "acl", content: str = "text", profile: str = "p1"):
    """`rv_` and the hash of what makes a version: access list, content, profile, source, tenant."""
    key = F.to_json(
        F.struct(F.array_sort(F.array_distinct(F.col(acl))).alias("acl"), F.sha2(F.col(content), 256).alias("content_sha256"), F.lit(profile).alias("pipeline_profile"), "source_id", "tenant_id")
    )
    return F.concat(F.lit("rv_"), F.sha2(key, 256))


def to_ingest(sources: DataFrame, events: DataFrame, profile: str = "p1") -> DataFrame:
    """sources(tenant_id, source_id, text, acl) with version_id, less those whose version is active:
    ingesting the same content twice does nothing, an earlier version is activated anew."""
    wanted = sources.withColumn("version_id", version_id(profile=profile))
    return wanted.join(active_versions(events), [*KEYS, "version_id"], "left_anti")


def ingest(sources: DataFrame, events: DataFrame, accepted: str = "accepted", profile: str = "p1") -> DataFrame:
    """The events that an ingestion appends: building, then activated or, if not accepted, failed."""
    new = to_ingest(sources, events, profile)
    seq = F.lit(events.agg(F.max("seq").alias("s")).first()["s"] or 0)
    rows = new.select(*KEYS, "version_id", F.explode(F.array(F.struct(F.lit("building").alias("event"), (seq + 1).alias("seq")), F.struct(F.when(F.col(accepted), "activated").otherwise("failed").alias("event"), (seq + 2).alias("seq")))).alias("e"))
    return rows.select(*KEYS, "version_id", "e.event", F.col("e.seq").cast("long").alias("seq"))
