"""Queries of evidence about evidence: citations, chunk metadata, document graphs, parsed files, metrics as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalog import query
from sparkloom.functions import evidence as ev
from sparkloom.functions.text import index_tokens, whitespace_terms
from sparkloom.operators import graphbuild, planning
from sparkloom.plans.overlay import DOCS_SQL, documents, table
from sparkloom.sources.parsing import parsed

_WORDS = r"list_filter(string_split_regex(trim(regexp_replace(replace(lower({}), '_', ' '), '\s+', ' ', 'g')), ' '), lambda t: t <> '')"


@query(
    "citations",
    f"""WITH {DOCS_SQL}, n AS (SELECT count(*) AS n FROM benchmark), c AS (SELECT doc_id, d.text, d.source_id, CASE WHEN doc_id % 4 <> 0 THEN page END AS page, 'section:s' || CAST(doc_id % 7 AS VARCHAR) || ':chunk:' || CAST(doc_id AS VARCHAR) AS locator, 'd' || CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'b' || CAST(doc_id AS VARCHAR) END AS block_id, {_WORDS.format("b.text")} AS terms FROM docs d, n, benchmark b WHERE b.item_id = (SELECT min(item_id) FROM benchmark) + doc_id % n),
    p AS (SELECT *, list_min(list_filter(list_transform(terms, lambda t: instr(lower(text), t)), lambda x: x > 0)) AS hit FROM c),
    s AS (SELECT *, greatest(0, coalesce(hit, 1) - 1 - 100) AS s0 FROM p),
    q AS (SELECT *, CASE WHEN length(text) <= 300 THEN text ELSE substring(text, CAST(CASE WHEN length(text) - s0 < 300 THEN greatest(0, length(text) - 300) ELSE s0 END + 1 AS BIGINT), 300) END AS quote FROM s)
    SELECT doc_id, 'cit_' || substr(sha256(source_id || ':' || chunk_id || ':' || quote), 1, 24) AS citation_id, quote, CASE WHEN page IS NOT NULL THEN 'pdf' ELSE 'text' END AS kind, CAST(page AS INTEGER) AS page_number, CASE WHEN page IS NULL THEN locator END AS locator, coalesce(block_id, chunk_id) AS block_id, CAST(doc_id AS INTEGER) AS seq, substr(sha256(text), 1, 16) AS text_key FROM q""",
)
def citations(spark, d):
    """Every document cited for a benchmark item."""
    b = table(spark, d, "benchmark")
    n, first = b.count(), b.agg(F.min("item_id")).first()[0]
    docs = documents(spark, d).withColumn("item_id", first + F.col("doc_id") % n)
    rows = docs.join(b.select("item_id", whitespace_terms(F.col("text")).alias("terms")), "item_id")
    page = F.when(F.col("doc_id") % 4 != 0, F.col("page"))
    locator = F.concat(F.lit("section:s"), (F.col("doc_id") % 7).cast("string"), F.lit(":chunk:"), F.col("doc_id").cast("string"))
    chunk, block = F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("b"), F.col("doc_id").cast("string")))
    c = ev.citation(F.col("source_id"), F.col("source_id"), chunk, F.col("text"), page, locator, block, F.col("terms"), F.lit(1.0))
    key = F.substring_index(ev.hit_key(F.lit(None).cast("string"), F.col("source_id"), F.col("text")), ":", -1)
    return rows.select("doc_id", c.alias("c"), ev.sequence(locator, F.lit(None).cast("int")).alias("seq"), key.alias("text_key")).select(
        "doc_id", "c.citation_id", "c.quote", "c.location.kind", "c.location.page_number", "c.location.locator", "c.location.block_id", "seq", "text_key"
    )


@query(
    "chunk_metadata",
    f"""WITH {DOCS_SQL} SELECT 'v' || CAST(coalesce(version_no, 0) AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR) AS indexed_id,
    'content_sha256=' || sha256(text) || ';kind=' || CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'text' END || ';lang=' || tenant_id || CASE WHEN doc_id % 2 = 0 THEN ';owner=chunk' ELSE ';owner=request' END || ';parser=builtin' AS metadata,
    trim(source_id || ' ' || tenant_id || ' ' || CASE WHEN doc_id % 2 = 0 THEN 'table' ELSE 'text' END || ' ') AS search_text FROM docs""",
)
def chunk_metadata(spark, d):
    """Metadata of the request, of the chunk and of the system as one map, later ones winning."""
    docs = documents(spark, d)
    kind = F.when(F.col("doc_id") % 2 == 0, "table").otherwise("text")
    request = F.create_map(F.lit("lang"), F.col("tenant_id"), F.lit("owner"), F.lit("request"), F.lit("parser"), F.lit("asked"))
    chunk = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("kind"), kind, F.lit("owner"), F.lit("chunk"))).otherwise(F.create_map(F.lit("kind"), kind))
    system = F.create_map(F.lit("parser"), F.lit("builtin"), F.lit("content_sha256"), F.sha2("text", 256))
    entries = F.array_sort(F.map_entries(ev.merged(request, chunk, system)))
    version = F.concat(F.lit("v"), F.coalesce("version_no", F.lit(0)).cast("string"))
    path = ev.clean_path(F.array(F.col("source_id"), F.lit("  "), F.col("tenant_id")))
    return docs.select(
        ev.indexed_id(version, F.col("doc_id").cast("string")).alias("indexed_id"),
        F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"),
        ev.search_text(path, kind, F.lit(None).cast("string")).alias("search_text"),
    )


@query(
    "citation_footers",
    f"""WITH {DOCS_SQL}, n AS (SELECT count(*) AS n, min(item_id) AS lo FROM benchmark), c AS (SELECT lo + doc_id % n AS item_id, string_agg('- [' || source_id || ' — ' || CASE WHEN page <> 0 THEN 'p.' || CAST(page AS VARCHAR) WHEN doc_id % 2 = 0 THEN 'l' || CAST(doc_id AS VARCHAR) ELSE 'd' || CAST(doc_id AS VARCHAR) END || ']', chr(10) ORDER BY doc_id) AS lines FROM docs, n WHERE doc_id % 3 = 0 GROUP BY 1)
    SELECT b.item_id, sha256(CASE WHEN lines IS NULL OR b.item_id % 7 = 0 THEN reply ELSE regexp_replace(reply, '\\s+$', '') || chr(10) || chr(10) || 'Sources:' || chr(10) || lines END) AS reply_sha FROM (SELECT item_id, text || CASE WHEN item_id % 7 = 0 THEN ' Sources: own ' ELSE '  ' END AS reply FROM benchmark) b LEFT JOIN c USING (item_id)""",
)
def citation_footers(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.concat("text", F.when(F.col("item_id") % 7 == 0, " Sources: own ").otherwise("  ")).alias("reply"))
    n, first = b.count(), b.agg(F.min("item_id")).first()[0]
    docs = documents(spark, d).where("doc_id % 3 = 0")
    one = F.struct("doc_id", F.col("source_id").alias("name"), "page", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("l"), F.col("doc_id").cast("string"))).alias("locator"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"))
    cited = docs.groupBy((first + F.col("doc_id") % n).alias("item_id")).agg(F.sort_array(F.collect_list(one)).alias("c"))
    none = F.lit(None).cast(cited.schema["c"].dataType)
    rows = b.join(cited, "item_id", "left").withColumn("c", F.coalesce("c", F.filter(F.coalesce(none, F.array()), lambda x: F.lit(False))))
    return rows.select("item_id", F.sha2(ev.with_footer(F.col("reply"), F.col("c")), 256).alias("reply_sha"))


_EXTRACTED = r"""ch AS (SELECT lang AS tenant_id, 'v' || CAST(doc_id % 3 AS VARCHAR) AS version_id, source AS source_name, CAST(doc_id AS VARCHAR) AS chunk_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Part ' || CAST(doc_id % 5 AS VARCHAR) ELSE 'Part ' || CAST(doc_id % 5 AS VARCHAR) || ' / Sub' END AS path0, list_filter(string_split_regex(text, '\s+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}')) AS w FROM documents),
c AS (SELECT *, CASE WHEN path0 = '' THEN 'Document root' ELSE path0 END AS path, list_filter(w, lambda x, i: list_position(w, x) = i)[1:3] AS names FROM ch),
tl AS (SELECT tenant_id, version_id, source_name, chunk_id, path, 'k' || CAST(i AS VARCHAR) AS key, names[i] AS name, CASE WHEN i = 2 THEN 'Place' ELSE 'Entity' END AS entity_type, 'seen in ' || chunk_id AS description FROM c, unnest(range(1, len(names) + 1)) AS t(i)),
dn AS (SELECT DISTINCT tenant_id, source_name, 'ent_' || substr(sha256(tenant_id || chr(0) || 'document' || chr(0) || lower(source_name)), 1, 24) AS entity_id FROM c),
sn AS (SELECT *, 'ent_' || substr(sha256(tenant_id || chr(0) || 'section' || chr(0) || lower(source_name || '::' || path)), 1, 24) AS entity_id FROM c),
en AS (SELECT *, 'ent_' || substr(sha256(tenant_id || chr(0) || lower(entity_type) || chr(0) || lower(name)), 1, 24) AS entity_id FROM tl)"""


def _document_graph(spark, d):
    docs = table(spark, d, "documents")
    words = F.filter(F.split("text", r"\s+"), lambda w: w.rlike("^[A-Z][a-z]{3,}$"))
    part = F.concat(F.lit("Part "), (F.col("doc_id") % 5).cast("string"))
    heading = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(" "))).when(F.col("doc_id") % 3 == 1, F.array(part)).otherwise(F.array(part, F.lit(""), F.lit(" Sub ")))
    chunks = docs.select(F.col("lang").alias("tenant_id"), F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string")).alias("version_id"), F.col("source").alias("source_name"), F.col("doc_id").cast("string").alias("chunk_id"), heading.alias("heading"), F.slice(F.array_distinct(words), 1, 3).alias("names"))
    found = chunks.select("chunk_id", F.posexplode("names").alias("i", "name")).select("chunk_id", F.concat(F.lit("k"), (F.col("i") + 1).cast("string")).alias("key"), "name", F.when(F.col("i") == 1, "Place").otherwise("").alias("entity_type"), F.concat(F.lit("seen in "), "chunk_id").alias("description"), F.array("name").alias("aliases"))
    # the second follows the first; the fourth, which no chunk has, follows the third
    drawn = chunks.select("chunk_id", F.inline(F.array(
        F.struct(F.lit("k1").alias("source_key"), F.lit("k2").alias("target_key"), F.lit("is followed-by").alias("relation_type"), F.lit(0.35).alias("weight")),
        F.struct(F.lit("k3").alias("source_key"), F.lit("k4").alias("target_key"), F.lit("x").alias("relation_type"), F.lit(7.0).alias("weight")),
    )))
    return graphbuild.document_graph(chunks.drop("names"), found, drawn)


@query(
    "document_graph_nodes",
    f"""WITH {_EXTRACTED}, u AS (SELECT tenant_id, entity_id, 'Document' AS entity_type, 'Source document ' || source_name AS description FROM dn UNION ALL SELECT tenant_id, entity_id, 'Section', 'Structural section in ' || source_name || ': ' || path FROM sn UNION ALL SELECT tenant_id, entity_id, entity_type, description FROM en)
    SELECT tenant_id, entity_id, min(entity_type) AS entity_type, arg_min(description, (-length(description), description)) AS description FROM u GROUP BY 1, 2""",
)
def document_graph_nodes(spark, d):
    """Documents, sections and entities, with the longest description of each."""
    return _document_graph(spark, d)[0].select("tenant_id", "entity_id", "entity_type", "description")


@query(
    "document_graph_edges",
    f"""WITH {_EXTRACTED}, r AS (SELECT tenant_id, version_id, dn.entity_id AS src, sn.entity_id AS dst, 'CONTAINS_SECTION' AS relation_type, 0.8 AS weight, chunk_id AS evidence FROM sn JOIN dn USING (tenant_id, source_name)
      UNION ALL SELECT en.tenant_id, en.version_id, sn.entity_id, en.entity_id, 'MENTIONS_ENTITY', 0.55, chunk_id FROM en JOIN sn USING (chunk_id)
      UNION ALL SELECT a.tenant_id, a.version_id, a.entity_id, b.entity_id, 'IS_FOLLOWED_BY', 0.35, chunk_id FROM en a JOIN en b USING (chunk_id) WHERE a.key = 'k1' AND b.key = 'k2')
    SELECT DISTINCT 'rel_' || substr(sha256(tenant_id || chr(0) || version_id || chr(0) || src || chr(0) || relation_type || chr(0) || dst || chr(0) || evidence), 1, 24) AS relation_id, src, dst, relation_type, CAST(weight AS DOUBLE) AS weight, evidence FROM r""",
)
def document_graph_edges(spark, d):
    return _document_graph(spark, d)[2].select("relation_id", "src", "dst", "relation_type", "weight", "evidence")


@query("model_plan_merge")
def model_plan_merge(spark, d):
    """Plans of benchmark items merged with decisions made of their words."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    w = index_tokens(F.col("text"))
    decisions = b.select("query_id", F.when(F.col("query_id") % 2 == 0, "graph").otherwise("hybrid").alias("route"), F.lit(3).alias("graph_hops"), F.array(F.array_join(F.slice(w, 1, 5), " "), F.lit(" ")).alias("subqueries"), F.array(F.lower("text"), F.lit("something else")).alias("rewrites"))
    return planning.merge_decisions(planning.plan_variants(b), decisions.where("query_id % 3 <> 0"))


@query(
    "parsed_files_report",
    """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS b, len(string_split(text, chr(10))) AS n, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) AS e FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'html' WHEN 2 THEN 'layout' END AS parser, CAST(CASE WHEN doc_id % 4 = 3 THEN 0 ELSE len(b) END AS BIGINT) AS blocks, CAST(CASE WHEN doc_id % 4 = 3 THEN 0 ELSE length(regexp_replace(array_to_string(b, ''), '[^a-zA-Z]', '', 'g')) END AS BIGINT) AS letters,
      CAST(CASE WHEN doc_id % 4 = 2 THEN n ELSE 0 END AS INTEGER) AS page_count, CAST(CASE WHEN doc_id % 4 = 2 THEN e ELSE 0 END AS INTEGER) AS empty_pages, CASE WHEN doc_id % 4 = 3 THEN 'unsupported:.pdf' WHEN doc_id % 4 = 2 AND 2 * e >= n THEN 'SCANNED_PDF_SUSPECTED' END AS warning FROM l""",
)
def parsed_files_report(spark, d):
    """Documents as files of four kinds, through one table function: a line is a paragraph, an element or a page."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    lines = F.split("text", "\n")
    html = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>"))), "")
    paged = F.to_json(F.struct(F.transform(lines, lambda x: F.struct(F.array(F.struct(F.lit("paragraph").alias("kind"), x.alias("text"))).alias("blocks"))).alias("pages")))
    m = F.col("doc_id") % 4
    body = F.when(m == 0, F.array_join(lines, "\n\n")).when(m == 1, html).when(m == 2, paged).otherwise(F.lit("%PDF"))
    suffix = F.when(m == 0, ".txt").when(m == 1, ".html").when(m == 2, ".json").otherwise(".pdf")
    files = docs.select("doc_id", F.concat(F.lit("f/"), F.col("doc_id").cast("string"), suffix).alias("path"), body.cast("binary").alias("content"))
    rows = parsed(files)
    letters = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z]", ""))
    return rows.groupBy("doc_id").agg(
        F.max("parser").alias("parser"), F.count("kind").alias("blocks"), F.sum(letters).cast("long").alias("letters"), F.max("page_count").alias("page_count"), F.max("empty_pages").alias("empty_pages"), F.max("warning").alias("warning")
    )


@query(
    "metrics_exposition",
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
    k AS (SELECT event_type, x, le, ord, count(*) FILTER (value <= x) AS n FROM events, (VALUES (10, '10', 1), (50, '50', 2), (100, '100', 3)) AS b(x, le, ord) GROUP BY 1, 2, 3, 4)
    SELECT 'events_total{event_type="' || event_type || '"} ' || CAST(n AS VARCHAR) AS line, 'events_total' AS name, CAST(0 AS INTEGER) AS place FROM c UNION ALL SELECT '# TYPE events_total counter', 'events_total', -1 UNION ALL SELECT '# TYPE event_value histogram', 'event_value', -1
    UNION ALL SELECT 'event_value_bucket{event_type="' || event_type || '",le="' || le || '"} ' || CAST(n AS VARCHAR), 'event_value', ord FROM k UNION ALL SELECT 'event_value_bucket{event_type="' || event_type || '",le="+Inf"} ' || CAST(n AS VARCHAR), 'event_value', 4 FROM c UNION ALL SELECT 'event_value_count{event_type="' || event_type || '"} ' || CAST(n AS VARCHAR), 'event_value', 5 FROM c""",
)
def metrics_exposition(spark, d):
    """Counters and a histogram as lines of the text format, to be written as they are."""
    from sparkloom.operators.exposition import counter_lines, histogram_lines

    e = table(spark, d, "events")
    return counter_lines(e.groupBy("event_type").count().withColumnRenamed("count", "value"), "events_total", ["event_type"]).unionByName(histogram_lines(e, "event_value", ["event_type"], "value", [10, 50, 100]))


@query(
    "safe_attributes",
    """SELECT click_id, n, string_agg(k, ',' ORDER BY k) AS kept FROM (SELECT click_id, count(*) AS n, props FROM clicks WHERE props IS NOT NULL AND json_valid(props) GROUP BY click_id, props), unnest(list_filter(json_keys(props), lambda x: json_type(props, '$.' || x) NOT IN ('OBJECT', 'ARRAY', 'NULL'))) AS t(k) GROUP BY ALL HAVING true""",
)
def safe_attributes(spark, d):
    """Of clicks' attributes the scalars; distinct rows of an id and its attributes, with their number."""
    rows = table(spark, d, "clicks").where("props IS NOT NULL").groupBy("click_id", "props").agg(F.count("*").alias("n"))
    kept = ev.safe_attributes(F.from_json("props", "map<string,variant>"))
    return rows.select("click_id", "n", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("kept")).where("kept IS NOT NULL AND kept <> ''")


@query(
    "iso_times",
    r"""WITH p AS (SELECT stamp_id, raw, regexp_full_match(raw, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})?') AS iso, try_strptime(replace(substr(raw, 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S') AS t FROM stamps),
    s AS (SELECT *, CASE WHEN iso AND t IS NOT NULL THEN CAST(epoch(t) AS BIGINT) - CASE WHEN length(raw) >= 25 THEN (CASE WHEN substr(raw, 20, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(raw, 21, 2) AS INTEGER) * 3600 + CAST(substr(raw, 24, 2) AS INTEGER) * 60) ELSE 0 END END AS at_s FROM p)
    SELECT stamp_id, at_s, coalesce(1711929600 - at_s >= 2592000, true) AS expired FROM s""",
)
def iso_times(spark, d):
    """Times as text: seconds of those in ISO form, and whether a record of that time is past its thirty days."""
    raw = F.col("raw")
    return table(spark, d, "stamps").select("stamp_id", ev.iso_seconds(raw).alias("at_s"), ev.expired(raw, 1711929600, 30 * ev.DAY).alias("expired"))
