"""Structural neighbours: what stands under the same parent or heading as a hit, nearest first, within caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import SMALL, held_in, settled
from sparkloom.operators.relational import top_per_group


def neighbours(chunks: DataFrame, seeds: DataFrame, terms: DataFrame, per_seed: int = 2, most: int = 6, text_terms: Column | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, seed_id, structural, lexical, rerank), at most `most` a query.

    chunks(chunk_id, source_id, version_id, parent_id, heading, seq, text_terms: distinct-term counts as a map)
    that the caller may see, or with what text_terms counts the words of, which is asked for chunks taken only;
    seeds(query_id, seed_no, chunk_id, rerank), in order of seed_no; terms(query_id,
    counts: map, n: their number). Of each seed the `per_seed` chunks of its source and version come that
    share its parent or, failing that, its heading: parents first, then by distance, then by id. Seeds are
    taken in order until `most` different chunks are found, the seed that reaches it included; a chunk keeps
    its best score, which is below its seed's."""
    same = ["source_id", "version_id"]
    c = chunks.select("chunk_id", *same, "parent_id", "heading", "seq")
    seeds = settled(seeds)
    at = held_in(c, seeds, "chunk_id", "inner")
    at = at.select("query_id", "seed_no", F.col("chunk_id").alias("seed_id"), F.col("rerank").alias("seed_rerank"), *[F.col(c).alias(f"s_{c}") for c in (*same, "parent_id", "heading", "seq")])
    at = settled(at)
    # Seeds that stand at one place share their list. Of a query's seeds, which are left out, and of parents among
    # the chunks of a heading there are so few that per_seed chunks remain of as many as this.
    most_seeds = seeds.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    room = 2 * (per_seed + most_seeds)
    apart = F.coalesce(F.abs(F.col("seq") - F.col("s_seq")), F.lit(1000)).cast("long")

    def kin(name, relation, of):
        place = ["s_source_id", "s_version_id", f"s_{name}", "s_seq"]
        places = settled(at.where(of).select(*place).distinct())
        by = F.col("source_id").eqNullSafe(F.col("s_source_id")) & F.col("version_id").eqNullSafe(F.col("s_version_id")) & (F.col(name) == F.col(f"s_{name}"))
        listed = c.join(F.broadcast(places) if places.count() <= SMALL else places, by).select(*place, "chunk_id", apart.alias("distance"))
        listed = top_per_group(listed, place, [F.asc("distance"), F.asc("chunk_id")], room).select(*[F.col(x).alias(f"p_{x}") for x in place], "chunk_id", "distance")
        on = F.lit(True)
        for x in place:
            on = on & F.col(x).eqNullSafe(F.col(f"p_{x}"))
        return at.where(of).join(listed, on).select("query_id", "seed_no", "seed_id", "seed_rerank", "chunk_id", "distance", F.lit(relation).alias("relation"))

    both = kin("parent_id", 0, F.col("s_parent_id").isNotNull()).unionByName(kin("heading", 1, F.size("s_heading") > 0))
    both = both.join(seeds.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    one = both.groupBy("query_id", "seed_no", "seed_id", "seed_rerank", "chunk_id").agg(F.min("relation").alias("relation"), F.min("distance").alias("distance"))
    near = top_per_group(one, ["query_id", "seed_no"], [F.asc("relation"), F.asc("distance"), F.asc("chunk_id")], per_seed)
    # how many chunks the seeds before have brought: a chunk counts where it comes first
    first = F.min("seed_no").over(Window.partitionBy("query_id", "chunk_id"))
    new = near.withColumn("new", (F.col("seed_no") == first).cast("int"))
    # at most per_seed rows a seed: a frame by seed, not by row, holds what came from earlier seeds
    before = F.coalesce(F.sum("new").over(Window.partitionBy("query_id").orderBy("seed_no").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = new.withColumn("before", before).where(F.col("before") < most)
    taken = settled(taken)
    words = chunks.select("chunk_id", "text_terms") if text_terms is None else chunks
    words = held_in(words, taken, "chunk_id").select("chunk_id", (F.col("text_terms") if text_terms is None else text_terms).alias("text_terms"))
    scored = taken.join(words, "chunk_id").join(terms, "query_id")
    shared = F.aggregate(F.map_entries("counts"), F.lit(0), lambda s, e: s + F.least(e["value"], F.coalesce(F.element_at("text_terms", e["key"]), F.lit(0))))
    lexical = F.least(F.lit(1.0), shared / F.greatest("n", F.lit(1)))
    structural = F.when(F.col("distance") < 1000, 1.0 / (1 + F.col("distance"))).otherwise(0.25)
    scored = scored.withColumns({"lexical": lexical, "structural": structural})
    rerank = F.least(0.70 * F.col("seed_rerank") + 0.15 * F.col("lexical") + 0.15 * F.col("structural"), F.greatest(F.lit(0.0), F.col("seed_rerank") * 0.95))
    scored = scored.withColumn("rerank", F.round(rerank, 9))
    best = top_per_group(scored, ["query_id", "chunk_id"], [F.desc("rerank"), F.asc("seed_no")], 1, "_one")
    out = top_per_group(best, ["query_id"], [F.desc("rerank"), F.asc("chunk_id")], most)
    return out.select("query_id", "rank", "chunk_id", "seed_id", F.round("structural", 6).alias("structural"), F.round("lexical", 6).alias("lexical"), F.round("rerank", 6).alias("rerank"))
