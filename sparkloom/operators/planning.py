"""Deterministic query plans: explicit parts, normalised variants, anchors, route and hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as tx


# What ends a part (with line ends) and what pairs of quotes protect.
_ENDS = "?？;；"
_PART = rf'(?:[^{_ENDS}\r\n"“]++|"[^"]*+(?:"|\z)|“[^”]*+(?:”|\z))++'


def split_parts(text: Column) -> Column:
    """Parts between ? ; and line ends (and their wide forms) that stand outside quotes, each of which its
    own kind closes; white space is collapsed, and parts of fewer than two letters or digits are left out."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PART), F.lit(0))
    trimmed = F.transform(found, lambda p: tx.collapse_whitespace(F.regexp_replace(tx.collapse_whitespace(p), rf"^[{_ENDS}]+|[{_ENDS}]+$", "")))
    return F.filter(trimmed, lambda p: F.length(F.regexp_replace(p, r"(?U)[\W_]+", "")) >= 2)


# Markers of questions that take two hops.
TWO_HOPS = ["multi-hop", "across", "why", "多跳", "跨章节", "原因", "如何导致"]


def plan_variants(queries: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, variant_no, kind, query, route, graph_hops, anchors, discarded) for queries(query_id,
    text): the original, explicit sub-questions and a normalised form, in that order, `most` at most, each once
    whatever its case; a normal form that loses an anchor is left out."""
    original = tx.collapse_whitespace(F.col("text"))
    q = queries.select("query_id", original.alias("original"), split_parts(F.col("text")).alias("parts")).where("original <> ''")
    q = q.withColumns({"anchors": tx.protected_anchors(F.col("original")), "normal": tx.lexical_query(F.col("original"))})
    once = F.filter("parts", lambda p, i: F.array_position(F.transform("parts", lambda x: F.lower(x)), F.lower(p)) == i + 1)
    q = q.withColumn("subs", F.when(F.size("parts") > 1, F.filter(once, lambda p: F.lower(p) != F.lower("original"))).otherwise(F.array().cast("array<string>")))

    def variant(kind, value):
        return F.struct(F.lit(kind).alias("kind"), value.alias("query"))

    said = F.array_contains(F.transform(F.concat(F.array("original"), "subs"), lambda x: F.lower(x)), F.lower("normal"))
    kept = tx.keeps_anchors(F.col("normal"), F.col("anchors")) & ~said
    every = F.concat(
        F.array(variant("original", F.col("original"))),
        F.transform("subs", lambda s: variant("subquery", s)),
        F.when(kept, F.array(variant("normalized", F.col("normal")))).otherwise(F.array().cast("array<struct<kind:string,query:string>>")),
    )
    relational = tx.has_marker(F.col("original"), tx.RELATIONAL_MARKERS) | (F.size("subs") > 0)
    two = tx.has_marker(F.col("original"), TWO_HOPS)
    q = q.withColumns(
        {
            "variants": F.slice(every, 1, most),
            "route": F.when(relational, "graph").otherwise("hybrid"),
            "graph_hops": F.when(relational & two, 2).when(relational, 1).otherwise(0),
            "discarded": F.when(F.size("subs") > most - 1, F.array(F.lit("subquery_limit"))).otherwise(F.array().cast("array<string>")),
        }
    )
    return q.select("query_id", F.posexplode("variants").alias("variant_no", "v"), "route", "graph_hops", "anchors", "discarded").select(
        "query_id", F.col("variant_no").cast("long").alias("variant_no"), "v.kind", "v.query", "route", "graph_hops", "anchors", "discarded"
    )


def merge_decisions(plans: DataFrame, decisions: DataFrame, most: int = 3) -> DataFrame:
    """plans (as plan_variants gives them) with what a model decided, decisions(query_id, route, graph_hops,
    subqueries, rewrites: arrays): (query_id, variant_no, kind, query, route, graph_hops, discarded).

    The original stays first; then sub-questions and rewrites of the model in turn, each once whatever its case,
    rewrites only if they keep what must be kept of the original; what room is left goes to the plan's own
    variants. Names of what was left out: model_variant_limit, model_rewrite_anchor_drift. Queries without a
    decision keep their plan."""
    own = plans.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("variant_no", "kind", "query"))).alias("v"), F.first("anchors").alias("anchors"), F.first("route").alias("r"), F.first("graph_hops").alias("h"), F.first("discarded").alias("d")
    )
    q = own.join(decisions, "query_id", "left")
    none = F.array().cast("array<string>")

    def told(values, kind):
        cleaned = F.filter(F.transform(F.coalesce(values, none), lambda x: F.trim(x)), lambda x: x != "")
        return F.transform(cleaned, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("query")))

    model = F.concat(told(F.col("subqueries"), "subquery"), told(F.col("rewrites"), "rewrite"))
    rest = F.transform(F.slice("v", 2, 1000), lambda x: F.struct(x["kind"].alias("kind"), x["query"].alias("query")))
    start = F.struct(F.array(F.struct(F.col("v")[0]["kind"].alias("kind"), F.col("v")[0]["query"].alias("query"))).alias("kept"), F.col("d").alias("gone"), F.lit(False).alias("full"))

    def known(s, x):
        return F.exists(s["kept"], lambda y: F.lower(y["query"]) == F.lower(x["query"]))

    def add(s, x):
        limit = F.size(s["kept"]) >= most
        drift = (x["kind"] == "rewrite") & ~tx.keeps_anchors(x["query"], F.col("anchors"))
        skip = s["full"] | limit | known(s, x) | drift
        name = F.when(s["full"], F.lit(None)).when(limit, "model_variant_limit").when(~known(s, x) & drift, "model_rewrite_anchor_drift")
        return F.struct(
            F.when(skip, s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept"),
            F.when(name.isNull() | F.array_contains(s["gone"], name), s["gone"]).otherwise(F.array_append(s["gone"], name)).alias("gone"),
            (s["full"] | limit).alias("full"),
        )

    def fill(s, x):
        skip = (F.size(s["kept"]) >= most) | known(s, x)
        return F.struct(F.when(skip, s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept"), s["gone"].alias("gone"), s["full"].alias("full"))

    done = q.withColumn("s", F.aggregate(rest, F.aggregate(model, start, add), fill))
    routed = F.coalesce("route", "r")
    hops = F.when(F.col("route").isNull(), F.col("h")).when(F.col("route") == "graph", F.least(F.lit(2), F.col("graph_hops"))).otherwise(0)
    out = done.select("query_id", routed.alias("route"), hops.cast("int").alias("graph_hops"), F.col("s.gone").alias("discarded"), F.posexplode("s.kept").alias("variant_no", "x"))
    return out.select("query_id", F.col("variant_no").cast("long").alias("variant_no"), "x.kind", "x.query", "route", "graph_hops", "discarded")
