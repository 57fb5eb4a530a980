"""The tables read as evidence: tenants, sources, pages, access lists, versions, chunks, memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DOCS = """doc_id, text, n_chars, lang AS tenant_id, source AS source_id,
 CAST(FLOOR(doc_id / 20.0) AS BIGINT) AS blk"""
_MORE = """*, CAST(blk % 5 AS BIGINT) AS page, CAST(CASE WHEN doc_id % 20 < 4 THEN NULL WHEN blk % 8 = 7 THEN NULL ELSE blk % 4 END AS BIGINT) AS version_no"""

#: DuckDB text of `documents`, as common table expressions.
DOCS_SQL = f"""docs0 AS (SELECT {_DOCS} FROM documents),
docs AS (SELECT {_MORE}, CASE doc_id % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['group:a'] ELSE ['group:b'] END AS acl FROM docs0)"""

CHUNK, STEP = 400, 360
CHUNKS_SQL = f"""{DOCS_SQL},
chunks AS (SELECT doc_id, tenant_id, source_id, page, version_no, acl, i AS idx, CAST(doc_id AS VARCHAR) || ':' || lpad(CAST(i AS VARCHAR), 4, '0') AS chunk_id,
  substring(text, CAST(i * {STEP} + 1 AS BIGINT), {CHUNK}) AS chunk_text
  FROM docs, unnest(range(0, CAST(ceil(length(text) / {STEP}.0) AS BIGINT))) AS t(i) WHERE length(text) > 0)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr(*[x.strip() for x in _DOCS.split(",\n")[0].split(",")], "CAST(FLOOR(doc_id / 20.0) AS BIGINT) AS blk")
    docs = docs.selectExpr(
        "*",
        "CAST(blk % 5 AS BIGINT) AS page",
        "CAST(CASE WHEN doc_id % 20 < 4 THEN NULL WHEN blk % 8 = 7 THEN NULL ELSE blk % 4 END AS BIGINT) AS version_no",
    )
    acl = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array(F.lit("group:a"))).otherwise(F.array(F.lit("group:b")))
    return docs.withColumn("acl", acl)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 400 characters, 40 of which the next one repeats."""
    from sparkloom.functions.text import char_windows

    docs = documents(spark, sf_dir).where(F.length("text") > 0)
    rows = docs.select("doc_id", "tenant_id", "source_id", "page", "version_no", "acl", F.posexplode(char_windows(F.col("text"), CHUNK, CHUNK - STEP)).alias("idx", "chunk_text"))
    return rows.withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.lpad(F.col("idx").cast("string"), 4, "0")))


#: Vectors of chunks and of benchmark items: given ones, by a fixed rule on ids.
VECTORS_SQL = """nvec AS (SELECT count(*) AS n FROM embeddings), vec AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings)"""


def with_vectors(df: DataFrame, vectors: DataFrame, key) -> DataFrame:
    """df with the vector whose vec_id is `key` modulo the number of vectors; vec_id runs from 0."""
    n = vectors.count()
    slot = F.pmod(key, F.lit(n)).cast("long")
    return df.withColumn("_slot", slot).join(vectors.select(F.col("vec_id").alias("_slot"), F.col("embedding").alias("vector")), "_slot", "left").drop("_slot")


NOW = "2024-02-01 00:00:00"
MEMORIES_SQL = """memories AS (SELECT conv_id, turn, role, text, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS memory_id,
  CAST(conv_id AS VARCHAR) AS namespace, role AS memory_key, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(turn AS INTEGER)) AS created_at, (turn % 5) / 4.0 AS importance FROM conversations)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as memories: a namespace for each conversation, a key for each role."""
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role", "text", "concat_ws(':', conv_id, turn) AS memory_id", "CAST(conv_id AS STRING) AS namespace", "role AS memory_key",
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(turn AS INT)) AS created_at", "(turn % 5) / 4.0D AS importance",
    )
