"""Queries of conversations and memories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.catalog import query
from sparkloom.functions.text import memory_tokens, tokens_by_width
from sparkloom.operators import memory as mem
from sparkloom.plans.overlay import MEMORIES_SQL, NOW, memories, table

_SUP = f"""{MEMORIES_SQL}, sup AS (SELECT *, lead(memory_id) OVER w AS superseded_by, lead(created_at) OVER w AS superseded_at FROM memories WINDOW w AS (PARTITION BY namespace, memory_key ORDER BY created_at, turn))"""


def _superseded(spark, d):
    return mem.superseded(memories(spark, d), ["created_at", "turn"])


@query("memory_supersession", f"WITH {_SUP} SELECT memory_id, superseded_by, CAST(date_diff('day', created_at, superseded_at) AS BIGINT) AS days FROM sup")
def memory_supersession(spark, d):
    return _superseded(spark, d).select("memory_id", "superseded_by", F.date_diff("superseded_at", "created_at").cast("long").alias("days"))


_VALID = f"""{_SUP}, valid AS (SELECT *, created_at AS valid_from, CASE WHEN turn % 3 = 0 THEN created_at + INTERVAL 31 DAY END AS expires_at FROM sup)"""
_VALID_NOW = f"superseded_at IS NULL AND valid_from <= TIMESTAMP '{NOW}' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')"


def _valid(spark, d):
    m = _superseded(spark, d).withColumns({"valid_from": F.col("created_at"), "expires_at": F.when(F.col("turn") % 3 == 0, F.col("created_at") + F.expr("INTERVAL 31 DAYS"))})
    return mem.valid_at(m, F.to_timestamp(F.lit(NOW)))


@query("memory_valid_now", f"WITH {_VALID} SELECT memory_id FROM valid WHERE {_VALID_NOW}")
def memory_valid_now(spark, d):
    return _valid(spark, d).select("memory_id")


_MT = "regexp_extract_all(lower({}), '[A-Za-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]')"


@query(
    "memory_recall_score",
    f"""WITH {_VALID}, t AS (SELECT memory_id, namespace, importance, created_at, list_distinct({_MT.format('text')}) AS a FROM valid WHERE {_VALID_NOW}), q AS (SELECT list_distinct({_MT.format("'the of and in that is on for with as was by'")}) AS b),
    j AS (SELECT memory_id, namespace, importance, created_at, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS overlap FROM t, q),
    s AS (SELECT memory_id, namespace, round(least(1.0, 0.65 * 0 + 0.20 * overlap + 0.10 * importance + 0.05 * exp(-ln(2.0) * greatest(0, epoch(TIMESTAMP '{NOW}') - epoch(created_at)) / 86400.0 / 180.0)), 6) AS score FROM j)
    SELECT memory_id, score, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, memory_id) AS rank FROM s WHERE score >= 0.05 QUALIFY rank <= 4""",
)
def memory_recall_score(spark, d):
    now = F.to_timestamp(F.lit(NOW))
    asked = F.array_distinct(memory_tokens(F.lit("the of and in that is on for with as was by")))
    overlap = mem.jaccard(F.array_distinct(memory_tokens(F.col("text"))), asked)
    s = _valid(spark, d).withColumn("score", F.round(mem.recall_score(F.lit(0.0), overlap, F.col("importance"), mem.recency(F.col("created_at"), now)), 6)).where("score >= 0.05")
    rank = F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc("score"), "memory_id")).cast("long")
    return s.select("memory_id", "score", rank.alias("rank")).where("rank <= 4")


@query(
    "jaccard_overlap",
    f"""WITH t AS (SELECT conv_id, turn, list_distinct({_MT.format('text')}) AS a FROM conversations), p AS (SELECT conv_id, turn, a, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
    SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS overlap FROM p WHERE b IS NOT NULL""",
)
def jaccard_overlap(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(memory_tokens(F.col("text"))).alias("a"))
    t = t.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b IS NOT NULL")
    return t.select("conv_id", "turn", F.round(mem.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


_UNITS = "units AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unit FROM conversations)"


@query("conversation_units", f"WITH {_UNITS} SELECT conv_id, turn, unit FROM units")
def conversation_units(spark, d):
    return mem.units(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "unit")


@query(
    "context_budget_fit",
    f"""WITH {_UNITS}, l AS (SELECT *, ceil(length(text) / 4.0) AS size, max(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 0 AS lead_ FROM units),
    h AS (SELECT conv_id, sum(size) AS head FROM l WHERE lead_ GROUP BY 1), s AS (SELECT conv_id, unit, sum(size) AS size FROM l WHERE NOT lead_ GROUP BY 1, 2),
    k AS (SELECT conv_id, unit FROM (SELECT conv_id, unit, sum(s.size) OVER (PARTITION BY conv_id ORDER BY unit DESC ROWS UNBOUNDED PRECEDING) + coalesce(head, 0) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY unit DESC) AS nth FROM s LEFT JOIN h USING (conv_id)) WHERE used <= 400 OR nth = 1)
    SELECT conv_id, turn, unit FROM l WHERE lead_ UNION ALL SELECT conv_id, turn, unit FROM l SEMI JOIN k USING (conv_id, unit) WHERE NOT lead_""",
)
def context_budget_fit(spark, d):
    m = table(spark, d, "conversations").withColumn("size", tokens_by_width(F.col("text")))
    return mem.fit_budget(m, "conv_id", "turn", "size", 400).select("conv_id", "turn", "unit")


@query("retain_last_n", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4")
def retain_last_n(spark, d):
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, d, "conversations").withColumn("nth", nth).where("nth <= 4").select("conv_id", "turn")


@query(
    "rolling_summary",
    """WITH m AS (SELECT conv_id, turn, role || ': ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth FROM conversations)
    SELECT conv_id, count(*) FILTER (nth <= 3) AS n_kept, right(coalesce(string_agg(line, chr(10) ORDER BY turn) FILTER (nth > 3), ''), 600) AS summary FROM m GROUP BY conv_id""",
)
def rolling_summary(spark, d):
    return mem.rolling_summary(table(spark, d, "conversations"), "conv_id", "turn", 3, 600)


@query("memory_reads", f"WITH {MEMORIES_SQL} SELECT namespace, memory_key, count(*) AS writes, CAST(max(turn) AS BIGINT) AS last_turn FROM memories GROUP BY 1, 2")
def memory_reads(spark, d):
    return memories(spark, d).groupBy("namespace", "memory_key").agg(F.count("*").alias("writes"), F.max("turn").alias("last_turn"))
