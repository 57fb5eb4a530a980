"""Entity graphs of documents: document, section and entity nodes from chunks and what was extracted of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.evidence import clean_path
from sparkloom.functions.text import relation_type
from sparkloom.operators.entities import WEIGHTS, canonical_name

_ENTITY = ["tenant_id", "entity_id", "canonical_name", "display_name", "entity_type", "description", "aliases"]


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24))


def _named(df: DataFrame) -> DataFrame:
    """df(tenant_id, name, entity_type, ...) with canonical_name and entity_id."""
    named = df.withColumn("canonical_name", canonical_name()("name"))
    return named.withColumn("entity_id", _id("ent_", F.col("tenant_id"), F.lower("entity_type"), F.col("canonical_name")))


def document_graph(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, mentions, relations) of chunks(tenant_id, version_id, source_name, chunk_id, heading: array), what
    was found in them, entities(chunk_id, key, name, entity_type, description, aliases: array), and how that
    hangs together, relations(chunk_id, source_key, target_key, relation_type, weight).

    A document contains a section for each heading path, `Document root` without one; a section mentions the
    entities of its chunks. A relation whose ends are not both entities of its chunk is dropped. Chunks of which
    nothing was extracted still give their section. Of an entity's descriptions the longest stays, of its names
    the first by chunk."""
    c = chunks.select("tenant_id", "version_id", "source_name", "chunk_id", F.array_join(clean_path(F.col("heading")), " / ").alias("path"))
    c = c.withColumn("path", F.when(F.col("path") == "", "Document root").otherwise(F.col("path")))
    none = F.array().cast("array<string>")
    documents = _named(c.select("tenant_id", F.col("source_name").alias("name"), F.lit("Document").alias("entity_type"), F.concat(F.lit("Source document "), "source_name").alias("description"), none.alias("aliases"), F.lit("").alias("chunk_id"), "source_name").distinct())
    where = F.concat(F.lit("Structural section in "), "source_name", F.lit(": "), "path")
    sections = _named(c.select("tenant_id", "version_id", "source_name", F.concat_ws("::", "source_name", "path").alias("name"), F.lit("Section").alias("entity_type"), where.alias("description"), F.array("path").alias("aliases"), "chunk_id"))
    at = c.select("chunk_id", "tenant_id", "version_id")
    told = _named(entities.join(at, "chunk_id").select("chunk_id", "key", "tenant_id", "version_id", "name", F.coalesce(F.nullif(F.trim("entity_type"), F.lit("")), F.lit("Entity")).alias("entity_type"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), clean_path(F.col("aliases")).alias("aliases")))
    every = None
    for part in (documents, sections, told):
        x = part.select("tenant_id", "entity_id", "canonical_name", F.trim("name").alias("display_name"), "entity_type", "description", "aliases", "chunk_id")
        every = x if every is None else every.unionByName(x)
    nodes = every.groupBy("tenant_id", "entity_id").agg(
        F.first("canonical_name").alias("canonical_name"), F.min_by("display_name", F.struct("chunk_id", "display_name")).alias("display_name"), F.min_by("entity_type", F.struct("chunk_id", "entity_type")).alias("entity_type"),
        F.min_by("description", F.struct(-F.length("description"), "description")).alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"),
    )
    mentions = sections.select("tenant_id", "version_id", "entity_id", "chunk_id").unionByName(told.select("tenant_id", "version_id", "entity_id", "chunk_id")).distinct()
    owner = documents.select("tenant_id", "source_name", F.col("entity_id").alias("src")).distinct()
    contains = sections.join(owner, ["tenant_id", "source_name"]).select("tenant_id", "version_id", "src", F.col("entity_id").alias("dst"), F.lit("CONTAINS_SECTION").alias("relation_type"), F.lit(WEIGHTS["CONTAINS_SECTION"]).alias("weight"), "chunk_id")
    mention = sections.select("chunk_id", F.col("entity_id").alias("src")).join(told.select("chunk_id", "tenant_id", "version_id", F.col("entity_id").alias("dst")), "chunk_id")
    mention = mention.select("tenant_id", "version_id", "src", "dst", F.lit("MENTIONS_ENTITY").alias("relation_type"), F.lit(WEIGHTS["MENTIONS_ENTITY"]).alias("weight"), "chunk_id")
    # of entities with the same key in a chunk the last stands for it
    keys = told.groupBy("chunk_id", "key", "tenant_id", "version_id").agg(F.max("entity_id").alias("entity_id"))
    ends = relations.join(keys.select("chunk_id", "tenant_id", "version_id", F.col("key").alias("source_key"), F.col("entity_id").alias("src")), ["chunk_id", "source_key"])
    ends = ends.join(keys.select("chunk_id", F.col("key").alias("target_key"), F.col("entity_id").alias("dst")), ["chunk_id", "target_key"])
    drawn = ends.select("tenant_id", "version_id", "src", "dst", relation_type(F.trim("relation_type")).alias("relation_type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "weight")).alias("weight"), "chunk_id")
    rel = contains.unionByName(mention).unionByName(drawn)
    rel = rel.withColumn("relation_id", _id("rel_", *[F.col(x) for x in ("tenant_id", "version_id", "src", "relation_type", "dst", "chunk_id")]))
    rel = rel.groupBy("relation_id").agg(*[F.first(x).alias(x) for x in ("tenant_id", "version_id", "src", "dst", "relation_type")], F.max("weight").alias("weight"), F.first("chunk_id").alias("evidence"))
    return nodes.select(*_ENTITY), mentions, rel
