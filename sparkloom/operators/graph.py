"""Bounded traversal of evidence graphs and of dependency graphs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.relational import either_end, top_per_group

_LOCAL: list[str] = []


def expand(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node, hop, parent): nodes within `hops` of a seed over edges(src, dst) taken either way,
    each with the fewest hops and, among equals, the smallest parent. Edges must be those the caller
    may see, repeated ones once or more. One equi-join a hop; nodes met before are left out of the next frontier,
    which is written, so that a hop is computed once."""
    both = either_end(edges.select("src", "dst"), "src", "dst")
    found = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"), F.lit(None).cast(dict(seeds.dtypes)["seed"]).alias("parent"))
    frontier = found
    for h in range(1, hops + 1):
        step = held_in(both.withColumnRenamed("node", "parent"), frontier.select("seed", F.col("node").alias("parent")), "parent", "inner").select("seed", "parent", F.col("other").alias("node"))
        step = step.groupBy("seed", "node").agg(F.min("parent").alias("parent"))
        frontier = step.join(found.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(h).alias("hop"), "parent")
        frontier = settled(frontier) if h < hops else frontier
        found = found.unionAll(frontier)
    return found


def expand_paths(seeds: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """(query_id, node, hop, path) from seeds(query_id, node) over edges(src, dst) taken either way, which must be
    those the caller may see: each node by the fewest hops, of equals by the smallest parent; the path leads
    from the seed to the node. Written after each hop, so a hop is computed once."""
    both = settled(either_end(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "src", "dst").distinct())
    found = frontier = settled(seeds.select("query_id", "node").where("node IS NOT NULL").distinct().select("query_id", "node", F.lit(0).cast("long").alias("hop"), F.array("node").alias("path")))
    for h in range(1, hops + 1):
        step = frontier.select("query_id", F.col("node").alias("parent"), "path").join(both, F.col("parent") == both["node"]).select("query_id", F.col("other").alias("node"), "parent", "path")
        step = step.join(found.select("query_id", "node"), ["query_id", "node"], "left_anti").groupBy("query_id", "node").agg(F.min_by("path", "parent").alias("path"))
        frontier = settled(step.select("query_id", "node", F.lit(h).cast("long").alias("hop"), F.array_append("path", F.col("node")).alias("path")))
        found = found.unionAll(frontier)
    return found


def graph_evidence(seeds: DataFrame, mentions: DataFrame, relations: DataFrame, chunks: DataFrame, terms: DataFrame, names: DataFrame, hops: int = 2, most: int = 10) -> DataFrame:
    """(query_id, rank, chunk_id, score, hops, path): chunks that mention an entity within `hops` of what a
    query's seed chunks mention, each once with its best score, at most `most` a query.

    seeds(query_id, chunk_id); mentions(chunk_id, entity_id, visible) and chunks(chunk_id, terms: array) of active
    versions; relations(src, dst, kind, evidence: chunk_id); terms(query_id, asked: array of distinct terms);
    names(entity_id, name). Nothing passes what the caller may not see: a seed's mention, the mention that is
    an edge's evidence, and the mention that is found must all be visible. Sections are not traversed. The path
    is the names from a seed's entity to the one found; seeds are no evidence."""
    seen = mentions.where("visible").select("chunk_id", "entity_id").distinct()
    allowed = relations.where("kind <> 'CONTAINS_SECTION'").join(seen.select(F.col("chunk_id").alias("evidence")).distinct(), "evidence", "left_semi")
    start = seeds.join(seen, "chunk_id").select("query_id", F.col("entity_id").alias("node"))
    met = expand_paths(start, allowed, hops).where("hop > 0")
    found = met.select("query_id", F.col("node").alias("entity_id"), "hop", "path").join(seen, "entity_id").join(seeds, ["query_id", "chunk_id"], "left_anti")
    rows = found.join(chunks.select("chunk_id", "terms"), "chunk_id").join(terms, "query_id")
    overlap = F.size(F.array_intersect("asked", "terms")) / F.greatest(F.size("asked"), F.lit(1))
    rows = rows.withColumn("score", F.round(graph_score(F.col("hop"), overlap), 9))
    best = rows.groupBy("query_id", "chunk_id").agg(F.min_by(F.struct("score", "hop", "path"), F.struct(-F.col("score"), "hop", "entity_id")).alias("b")).select("query_id", "chunk_id", "b.*")
    top = top_per_group(best, ["query_id"], [F.desc("score"), F.asc("chunk_id")], most)
    place = top.select("query_id", "rank", "chunk_id", "score", "hop", F.posexplode("path").alias("i", "entity_id")).join(names, "entity_id", "left")
    told = place.groupBy("query_id", "rank", "chunk_id", "score", "hop").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("name", "entity_id").alias("name")))).alias("p"))
    return told.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"), F.col("hop").alias("hops"), F.array_join(F.transform("p", lambda x: x["name"]), " > ").alias("path"))


def merged_hits(direct: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, origin): direct(query_id, chunk_id, score) and what the graph found, each chunk
    once with the higher score, the direct one of equals."""
    both = direct.select("query_id", "chunk_id", "score", F.lit("direct").alias("origin")).unionByName(found.select("query_id", "chunk_id", "score", F.lit("graph").alias("origin")))
    best = F.min_by(F.struct("score", "origin"), F.struct(-F.col("score"), "origin"))
    return both.groupBy("query_id", "chunk_id").agg(best.alias("b")).select("query_id", "chunk_id", "b.score", "b.origin")


def or_else(first: DataFrame, second: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, warning): rows of `first`, and of `second` for queries that have none there; a
    query without any is one row of its warning."""
    served = first.select("query_id").distinct()
    fallback = second.join(served, "query_id", "left_anti")
    none = queries.select("query_id").distinct().join(served, "query_id", "left_anti").join(second.select("query_id").distinct(), "query_id", "left_anti")
    return (
        first.select("query_id", "chunk_id", "score", F.lit(None).cast("string").alias("warning"))
        .unionByName(fallback.select("query_id", "chunk_id", "score", F.lit("graph_expansion:structural_fallback").alias("warning")))
        .unionByName(none.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("double").alias("score"), F.lit("graph_expansion:no_neighbors").alias("warning")))
    )


def graph_score(hops: Column, overlap: Column) -> Column:
    return F.least(F.lit(0.95), F.pow(F.lit(0.72), hops) * (0.7 + 0.3 * overlap))


def _shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which every executor of a cluster shares; where none is named, on a local
    master only, a folder of this process that goes with it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sparkloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{_shared(spark)}/sparkloom/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written once, its lineage cut, in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint()


SMALL = 200_000


def held_in(rows: DataFrame, keys: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """rows joined with keys on a column. Keys (for a semi join the distinct ones) are written and counted first:
    SMALL at most are broadcast, so that wide rows stay where they are; more are joined."""
    few = settled(keys.select(on).distinct() if how == "left_semi" else keys)
    return rows.join(F.broadcast(few) if few.count() <= SMALL else few, on, how)


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, level) of a plan calls(call_id, depends_on): 0 without dependencies, else one more than the
    highest of them. Calls on a cycle or behind one, and those that wait for a call that is not there, get
    none. One round a level: dependencies that are met are taken away, and who waits for none is next, so
    the work is that of the edges, whatever the number of paths."""
    calls = settled(calls.select("call_id", "depends_on").where("call_id IS NOT NULL"))
    open_ = settled(calls.select("call_id", F.explode("depends_on").alias("dep")).where("dep IS NOT NULL").distinct())
    waiting = calls.select("call_id").distinct()
    done, level = None, 0
    while True:
        ready = settled(waiting.join(open_, "call_id", "left_anti").select("call_id", F.lit(level).cast("long").alias("level")))
        done = ready if done is None else done.unionAll(ready)
        if ready.isEmpty():
            return done
        waiting = settled(waiting.join(ready, "call_id", "left_anti"))
        open_ = settled(open_.join(ready.select(F.col("call_id").alias("dep")), "dep", "left_anti"))
        level += 1


def reachable(calls: DataFrame) -> DataFrame:
    """(ancestor, call_id): which calls depend on which, directly or not, at any depth. Rounds double the depth:
    pairs within 2**i edges go on by those of exactly 2**i, until none is new."""
    found = leap = settled(calls.select(F.explode("depends_on").alias("ancestor"), "call_id").where("ancestor IS NOT NULL AND call_id IS NOT NULL").distinct())
    while True:
        on = leap.select(F.col("ancestor").alias("via"), "call_id")
        more = settled(found.select("ancestor", F.col("call_id").alias("via")).join(on, "via").select("ancestor", "call_id").distinct().join(found, ["ancestor", "call_id"], "left_anti"))
        if more.isEmpty():
            return found
        found = found.unionAll(more)
        leap = settled(leap.select("ancestor", F.col("call_id").alias("via")).join(on, "via").select("ancestor", "call_id").distinct())


def faults(calls: DataFrame) -> DataFrame:
    """(call_id, fault) of what makes a plan invalid: `duplicate` ids, a `missing` dependency, a `cycle` that
    a call is on."""
    ids = calls.groupBy("call_id").agg(F.count("*").alias("n"))
    waits = settled(calls.select("call_id", F.explode_outer("depends_on").alias("dep")))
    # many may wait for the same missing call: it is looked up once
    gone = settled(waits.select("dep").distinct().join(ids.select(F.col("call_id").alias("dep")), "dep", "left_anti").where("dep IS NOT NULL"))
    missing = held_in(waits, gone, "dep")
    # who waits for it is on a cycle by other dependencies only; whoever gets a level then is on none
    there = held_in(waits.where("dep IS NOT NULL"), gone, "dep", "left_anti").select("call_id", F.array("dep").alias("depends_on"))
    there = there.unionAll(waits.select("call_id").distinct().select("call_id", F.array().cast(there.schema["depends_on"].dataType)))
    plan = settled(there)
    stuck = plan.join(levels(plan).select("call_id"), "call_id", "left_anti")
    cyclic = reachable(stuck).where("ancestor = call_id")
    return (
        ids.where("n > 1").select("call_id", F.lit("duplicate").alias("fault"))
        .unionAll(missing.select("call_id", F.lit("missing")))
        .unionAll(cyclic.select("call_id", F.lit("cycle")))
        .distinct()
    )
