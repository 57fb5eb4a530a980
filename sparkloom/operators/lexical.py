"""Inverted index, BM25 over weighted fields, term overlap, rank fusion and diversification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import index_tokens, prefix_key, whitespace_terms

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def postings(rows: DataFrame, id_col: str, fields: dict[str, float]) -> DataFrame:
    """(id, term, tf, length): weighted occurrences of each term and the unweighted number of tokens
    of all fields."""
    toks = rows.select(id_col, *[index_tokens(F.col(f)).alias(f"_t{i}") for i, f in enumerate(fields)])
    toks = toks.withColumn("length", sum((F.size(f"_t{i}") for i in range(len(fields))), F.lit(0)))
    parts = None
    for i, weight in enumerate(fields.values()):
        part = toks.select(id_col, "length", F.explode(f"_t{i}").alias("term"), F.lit(float(weight)).alias("w"))
        parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy(id_col, "term").agg(F.sum("w").alias("tf"), F.max("length").alias("length"))


def bm25(rows: DataFrame, id_col: str, fields: dict[str, float], queries: DataFrame) -> DataFrame:
    """(query_id, id, score) for rows that hold a term of queries(query_id, term), all rows being the
    statistics: idf = ln((rows - n + .5) / (n + .5)), floored; length is that of all fields together.

    A written index holds each word of a block once, and a block's scores are summed where it lies, so pairs of
    query and row are made but not shuffled."""
    from sparkloom.operators import index
    from sparkloom.operators.graph import scratch

    built = index.build(rows, id_col, fields, scratch(rows.sparkSession))
    asked = queries.select("query_id", F.col("term").alias("phrase"), F.array("term").alias("tokens"))
    return index.scores(built, asked).withColumnRenamed("id", id_col)


def term_overlap(rows: DataFrame, id_col: str, text: Column, queries: DataFrame) -> DataFrame:
    """(query_id, id, overlap): sum over terms of the smaller count, of queries(query_id, term, qtf).

    Texts are dealt out by id, once; their words and what they share with queries stay there, and only words that
    some query has are counted."""
    from sparkloom.operators.graph import held_in, settled

    queries = settled(queries)
    dealt = rows.select(id_col, text.alias("_text")).repartition(id_col)
    asked = held_in(dealt.select(id_col, F.explode(whitespace_terms(F.col("_text"))).alias("term")), queries, "term")
    counts = asked.groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    return held_in(counts, queries, "term", "inner").groupBy("query_id", id_col).agg(F.sum(F.least("qtf", "tf")).cast("long").alias("overlap"))


def ranked(df: DataFrame, by: list[str], score: str, tie: str, name: str, positive: bool = False, limit: int | None = None) -> DataFrame:
    """Places from 1 in order of falling score, ties by `tie`."""
    df = df.where(F.col(score) > 0) if positive else df
    df = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))).cast("long"))
    return df.where(F.col(name) <= limit) if limit else df


def fused(branches: list[DataFrame], keys: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of branches(keys, rank)."""
    every = None
    for b in branches:
        part = b.select(*keys, "rank")
        every = part if every is None else every.unionAll(part)
    return every.groupBy(*keys).agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def diversified(hits: DataFrame, by: str, rank: str, text: Column, group: list[str], keep: str, k: int) -> DataFrame:
    """At most k hits of each query: first those whose opening words and group (say source and page)
    are both new, then, while there is room, hits put aside for their group. A hit dropped for its
    opening claims no group; one put aside claims no opening. Nulls are a group like any other.

    hits should be bounded per query, as after a top-k; the fold runs in the JVM."""
    item = F.struct(F.col(rank).alias("rank"), F.col(keep).alias("id"), prefix_key(text).alias("prefix"), F.to_json(F.struct(*group)).alias("grp"))
    rows = hits.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("h"))
    rows = rows.withColumn("start", F.struct(F.filter("h", lambda x: F.lit(False)).alias("sel"), F.filter("h", lambda x: F.lit(False)).alias("aside")))

    def new_prefix(s, x):
        return ~F.exists(s["sel"], lambda y: y["prefix"] == x["prefix"])

    def first(s, x):
        fits = new_prefix(s, x) & (F.size(s["sel"]) < k)
        taken = F.exists(s["sel"], lambda y: y["grp"] == x["grp"])
        return F.struct(
            F.when(fits & ~taken, F.array_append(s["sel"], x)).otherwise(s["sel"]).alias("sel"),
            F.when(fits & taken, F.array_append(s["aside"], x)).otherwise(s["aside"]).alias("aside"),
        )

    def second(s, x):
        fits = new_prefix(s, x) & (F.size(s["sel"]) < k)
        return F.struct(F.when(fits, F.array_append(s["sel"], x)).otherwise(s["sel"]).alias("sel"), s["aside"].alias("aside"))

    rows = rows.withColumn("one", F.aggregate("h", F.col("start"), first))
    rows = rows.withColumn("two", F.aggregate(F.col("one.aside"), F.col("one"), second))
    return rows.select(by, F.posexplode("two.sel").alias("place", "hit")).select(by, (F.col("place") + 1).cast("long").alias("place"), F.col("hit.id").alias(keep))
