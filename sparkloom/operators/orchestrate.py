"""Retrieval end to end, for many queries at once: plan, search variants, fuse, gate, search once more."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import long_terms
from sparkloom.operators import index
from sparkloom.operators.graph import held_in, scratch, settled
from sparkloom.operators.lexical import ranked
from sparkloom.operators.planning import plan_variants
from sparkloom.operators.retrieval import FIELDS, hybrid_search

MIN_RELEVANCE, MIN_COVERAGE = 0.2, 0.25


def fuse_variants(hits: DataFrame, k: int = 60) -> DataFrame:
    """hits(query_id, variant_no, rank, chunk_id, rerank) to one row a query and chunk: reciprocal ranks
    summed, the best rerank kept."""
    return hits.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.max("rerank").alias("rerank"))


def gate(hits: DataFrame, chunks: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, best, coverage, confidence, sufficient): the best rerank and the share of the query's
    terms that its first hits hold."""
    first = settled(ranked(hits, ["query_id"], "rerank", "chunk_id", "place", limit=top))
    terms = first.join(held_in(chunks.select("chunk_id", "chunk_text"), first, "chunk_id"), "chunk_id").select("query_id", F.explode(long_terms(F.col("chunk_text"))).alias("t")).distinct()
    asked = queries.select("query_id", F.explode(F.array_distinct(long_terms(F.col("text")))).alias("t"))
    cover = asked.join(terms.withColumn("there", F.lit(1)), ["query_id", "t"], "left").groupBy("query_id").agg((F.count("there") / F.count("*")).alias("coverage"))
    best = hits.groupBy("query_id").agg(F.max("rerank").alias("best"))
    out = queries.select("query_id").join(best, "query_id", "left").join(cover, "query_id", "left").fillna(0.0, ["best", "coverage"])
    confidence = F.least(F.lit(1.0), 0.65 * F.col("best") + 0.35 * F.col("coverage"))
    return out.withColumns({"confidence": confidence, "sufficient": (F.col("best") >= MIN_RELEVANCE) & (F.col("coverage") >= MIN_COVERAGE)})


def retrieve(chunks: DataFrame, queries: DataFrame, top_k: int = 6, principals: list[str] | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, rerank, sufficient): variants of each query's plan are searched, the
    original and its sub-questions first; queries whose evidence falls short are searched once more with
    their normalised form. Hits are ordered by rerank, the fused ranks break ties."""
    built = index.build(chunks, "chunk_id", FIELDS, scratch(chunks.sparkSession))
    variants = settled(plan_variants(queries))

    def search(part: DataFrame) -> DataFrame:
        named = part.select(F.concat_ws("#", "query_id", "variant_no").alias("query_id"), F.col("query").alias("text"))
        hits = settled(hybrid_search(chunks, named, 2 * top_k, principals, built=built))
        ids = F.split("query_id", "#")
        return hits.select(ids[0].cast("long").alias("query_id"), ids[1].cast("long").alias("variant_no"), "rank", "chunk_id", "rerank")

    first = fuse_variants(search(variants.where("kind <> 'normalized'")))
    short = settled(gate(first, chunks, queries).where("NOT sufficient").select("query_id"))
    again = search(variants.where("kind = 'normalized'").join(short, "query_id", "left_semi"))
    every = settled(first.unionByName(fuse_variants(again)).groupBy("query_id", "chunk_id").agg(F.sum("rrf").alias("rrf"), F.max("rerank").alias("rerank")))
    order = every.withColumn("score", F.col("rerank") + F.col("rrf") * 1e-9)
    out = ranked(order, ["query_id"], "score", "chunk_id", "rank", limit=top_k)
    return out.join(gate(every, chunks, queries).select("query_id", "sufficient"), "query_id").select("query_id", "rank", "chunk_id", "rerank", "sufficient")
