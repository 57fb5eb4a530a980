"""Queries of document processing: blocks, quality, chunks, text scalars, versions, files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.catalog import query
from sparkloom.functions import text as tx
from sparkloom.operators import blocks as bl
from sparkloom.operators.relational import top_per_group
from sparkloom.plans.overlay import CHUNKS_SQL, DOCS_SQL, chunks, documents, table

_LINES = "lines AS (SELECT doc_id, lang, source, i - 1 AS pos, l[i] AS line FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS t(i))"
_KIND = "CASE WHEN contains(line, '|') THEN 'table' WHEN length(line) < 40 THEN 'heading' ELSE 'paragraph' END"
_NORM = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _lines(spark, d, *keep):
    return bl.lines(table(spark, d, "documents"), "doc_id", *keep)


@query("text_blocks", f"WITH {_LINES} SELECT doc_id, CAST(pos AS BIGINT) AS pos, line, {_KIND} AS kind FROM lines WHERE trim(line) <> ''")
def text_blocks(spark, d):
    return bl.indexable(_lines(spark, d), "kind", "line").select("doc_id", F.col("pos").cast("long").alias("pos"), "line", "kind")


@query("block_kinds", f"WITH {_LINES} SELECT lang, {_KIND} AS kind, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines GROUP BY ALL")
def block_kinds(spark, d):
    return _lines(spark, d, "lang").groupBy("lang", "kind").agg(F.count("*").alias("n"), F.sum(F.length("line").cast("long")).alias("chars"))


@query("paragraph_blocks", "SELECT doc_id, CAST(0 AS BIGINT) AS pos, trim(text, chr(10) || ' ') AS text, CASE WHEN contains(text, '|') AND contains(trim(text, chr(10) || ' '), chr(10)) THEN 'table' ELSE 'paragraph' END AS kind FROM documents WHERE trim(text, chr(10) || ' ') <> ''")
def paragraph_blocks(spark, d):
    return bl.paragraphs(table(spark, d, "documents")).select("doc_id", F.col("pos").cast("long").alias("pos"), "text", "kind")


@query(
    "csv_row_blocks",
    "SELECT p_partkey, concat_ws(' | ', 'name=' || p_name, 'brand=' || p_brand, 'size=' || CAST(p_size AS VARCHAR)) AS block, 'row:' || CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS VARCHAR) AS locator FROM part",
)
def csv_row_blocks(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    cells = [F.concat(F.lit(f"{n}="), F.col(c).cast("string")) for n, c in (("name", "p_name"), ("brand", "p_brand"), ("size", "p_size"))]
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" | ", *cells).alias("block"), F.concat(F.lit("row:"), (F.row_number().over(w) + 1).cast("string")).alias("locator"))


@query("html_blocks")
def html_blocks(spark, d):
    from sparkloom.sources.readers import html_blocks as read

    return read(table(spark, d, "pages"), "page_id", "html")


@query(
    "parse_quality_report",
    f"""WITH {_LINES}, b AS (SELECT doc_id, line, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) AS norm FROM lines WHERE trim(line) <> ''),
    g AS (SELECT doc_id, count(*) AS blocks, CAST(sum(length(line)) AS BIGINT) AS chars, CAST(sum(length(line) - length(replace(line, '�', ''))) AS BIGINT) AS repl, count(DISTINCT norm) AS dist FROM b GROUP BY 1),
    s AS (SELECT doc_id, blocks, chars, repl / chars AS replacement, (blocks - dist) / blocks AS duplicate FROM g)
    SELECT doc_id, blocks, chars, round(replacement, 6) AS replacement, round(duplicate, 6) AS duplicate, round(greatest(0, least(1, 1 - least(5 * replacement, 0.3) - least(0.5 * duplicate, 0.25))), 6) AS score, false AS needs_ocr, true AS accepted, false AS needs_review FROM s""",
)
def parse_quality_report(spark, d):
    return bl.quality_report(_lines(spark, d), "doc_id", "line")


@query(
    "repeating_artifacts",
    f"""WITH {_LINES}, p AS (SELECT source, CAST(FLOOR(doc_id / 20.0) AS BIGINT) % 5 AS page, line FROM lines), a AS (SELECT source, count(DISTINCT page) AS n_all FROM p GROUP BY 1 HAVING count(DISTINCT page) >= 3),
    k AS (SELECT source, {_NORM.format('lower(line)')} AS key, count(DISTINCT page) AS n_pages FROM p WHERE length(line) <= 160 GROUP BY 1, 2)
    SELECT source, key, n_pages, CASE WHEN regexp_full_match(key, '(?:page\\s*)?\\d+(?:\\s*(?:/|of)\\s*\\d+)?') THEN 'page_number' ELSE 'running_line' END AS kind FROM k JOIN a USING (source) WHERE n_pages / n_all >= 0.6""",
)
def repeating_artifacts(spark, d):
    rows = _lines(spark, d, "source").withColumn("page", F.floor(F.col("doc_id") / 20) % 5)
    return bl.repeating_artifacts(rows, ["source"], "page", "line")


@query(
    "heading_carry",
    f"WITH {_LINES} SELECT doc_id, CAST(pos AS BIGINT) AS pos, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS heading FROM lines",
)
def heading_carry(spark, d):
    return _sectioned(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "heading")


@query(
    "section_ids",
    f"WITH {_LINES} SELECT doc_id, section, count(*) AS n_lines FROM (SELECT doc_id, CAST(sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM lines) GROUP BY 1, 2",
)
def section_ids(spark, d):
    return _sectioned(spark, d).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"))


def _sectioned(spark, d):
    return bl.with_sections(_lines(spark, d), "doc_id", "pos", F.length("line") < 40, "line")


@query("semantic_chunks")
def semantic_chunks(spark, d):
    return bl.semantic_chunks(_lines(spark, d), "doc_id", "pos", "line", "kind")


@query("char_windows", f"WITH {CHUNKS_SQL} SELECT doc_id, idx, chunk_text FROM chunks")
def char_windows(spark, d):
    return chunks(spark, d).select("doc_id", F.col("idx").cast("long").alias("idx"), "chunk_text")


@query(
    "token_estimate_a",
    r"SELECT doc_id, CAST(greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\x00-\x7F]')) + len(regexp_extract_all(text, '[\x21-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E]')) // 4) AS BIGINT) AS tokens FROM documents",
)
def token_estimate_a(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tokens_by_words(F.col("text")).alias("tokens"))


@query("token_estimate_b", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate_b(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tokens_by_width(F.col("text")).alias("tokens"))


@query("sha_ids", "SELECT doc_id, substr(sha256(source || chr(31) || CAST(doc_id AS VARCHAR) || chr(31) || text), 1, 24) AS block_id FROM documents")
def sha_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.content_id(F.col("source"), F.col("doc_id").cast("string"), F.col("text")).alias("block_id"))


@query(
    "lexical_normalise",
    "WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+(?:[-./][\\p{L}\\p{N}]+)*') AS w FROM benchmark) SELECT item_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS q FROM t",
)
def lexical_normalise(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.lexical_query(F.col("text")).alias("q"))


@query("protected_anchors")
def protected_anchors(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.protected_anchors(F.col("text")), "¦").alias("anchors"))


@query("ws_collapse", f"SELECT doc_id, {_NORM.format('text')} AS t FROM documents")
def ws_collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.collapse_whitespace(F.col("text")).alias("t"))


@query("relation_type_norm", "SELECT DISTINCT p_type, coalesce(nullif(substr(trim(regexp_replace(upper(p_type), '[^A-Za-z0-9]+', '_', 'g'), '_'), 1, 100), ''), 'RELATED_TO') AS relation FROM part")
def relation_type_norm(spark, d):
    return table(spark, d, "part").select("p_type", tx.relation_type(F.col("p_type")).alias("relation")).distinct()


@query("line_slice", f"WITH {_LINES} SELECT doc_id, CAST(pos + 1 AS BIGINT) AS line_no, line, max(pos) OVER (PARTITION BY doc_id) + 1 > 6 AS truncated FROM lines QUALIFY pos BETWEEN 2 AND 5")
def line_slice(spark, d):
    rows = _lines(spark, d).withColumn("truncated", F.max("pos").over(Window.partitionBy("doc_id")) + 1 > 6)
    return rows.where("pos BETWEEN 2 AND 5").select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line", "truncated")


@query("label_kinds", "SELECT DISTINCT p_type, CASE WHEN contains(lower(p_type), 'title') OR contains(lower(p_type), 'heading') THEN 'heading' WHEN contains(lower(p_type), 'table') THEN 'table' WHEN contains(lower(p_type), 'picture') OR contains(lower(p_type), 'figure') THEN 'image' WHEN contains(lower(p_type), 'caption') THEN 'caption' WHEN contains(lower(p_type), 'formula') THEN 'formula' WHEN contains(lower(p_type), 'list') THEN 'list_item' ELSE 'paragraph' END AS kind FROM part")
def label_kinds(spark, d):
    return table(spark, d, "part").select("p_type", tx.label_kind(F.lower("p_type")).alias("kind")).distinct()


@query("tail_overlaps", "SELECT doc_id, CASE WHEN length(text) <= 60 THEN text WHEN instr(right(text, 60), ' ') > 0 THEN substring(right(text, 60), instr(right(text, 60), ' ') + 1) ELSE right(text, 60) END AS tail FROM documents")
def tail_overlaps(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.tail_overlap(F.col("text"), 60).alias("tail"))


@query(
    "cooccurrence_edges",
    r"""WITH e AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}')) AS a FROM documents), d AS (SELECT doc_id, list_filter(a, lambda x, i: list_position(a, x) = i)[1:12] AS n FROM e)
    SELECT doc_id, n[i] AS src, n[i + 1] AS dst, 0.35 AS weight FROM d, unnest(range(1, len(n))) AS t(i)""",
)
def cooccurrence_edges(spark, d):
    names = F.slice(F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: w.rlike(r"^[A-Z][a-z]{3,}$"))), 1, 12)
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(names).alias("i", "src"))
    rows = rows.withColumn("dst", F.lead("src").over(Window.partitionBy("doc_id").orderBy("i")))
    return rows.where("dst IS NOT NULL").select("doc_id", "src", "dst", F.lit(0.35).alias("weight"))


@query(
    "spill_partition",
    "SELECT doc_id, ceil(length(text) / 4.0) > 500 AS spilled, CASE WHEN ceil(length(text) / 4.0) > 500 THEN sha256(text) END AS artifact, left(text, CASE WHEN ceil(length(text) / 4.0) > 500 THEN 200 ELSE length(text) END) AS preview FROM documents",
)
def spill_partition(spark, d):
    big = tx.tokens_by_width(F.col("text")) > 500
    return table(spark, d, "documents").select("doc_id", big.alias("spilled"), F.when(big, F.sha2("text", 256)).alias("artifact"), F.when(big, F.left("text", F.lit(200))).otherwise(F.col("text")).alias("preview"))


_VERSION = """'{"acl":[' || array_to_string(list_transform(acl, lambda x: '"' || x || '"'), ',') || '],"content_sha256":"' || sha256(text) || '","pipeline_profile":"p1","source_id":"' || source_id || '","tenant_id":"' || tenant_id || '"}'"""


@query("version_id_hash", f"WITH {DOCS_SQL} SELECT doc_id, 'rv_' || sha256({_VERSION}) AS version_id FROM docs")
def version_id_hash(spark, d):
    return documents(spark, d).select("doc_id", _version_id().alias("version_id"))


def _version_id():
    key = F.to_json(F.struct("acl", F.sha2("text", 256).alias("content_sha256"), F.lit("p1").alias("pipeline_profile"), "source_id", "tenant_id"))
    return F.concat(F.lit("rv_"), F.sha2(key, 256))


@query(
    "idempotent_skip",
    "SELECT min(doc_id) AS doc_id, sha256(text) AS content FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 7 = 0) GROUP BY 2",
)
def idempotent_skip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    done = docs.where("doc_id % 7 = 0").select("content").distinct()
    return docs.join(done, "content", "left_anti").groupBy("content").agg(F.min("doc_id").alias("doc_id"))


@query(
    "first_accepted_attempt",
    """WITH a AS (SELECT doc_id, backend, attempt, (doc_id * (attempt + 3)) % 10 / 10.0 AS score FROM documents, (VALUES ('primary', 1), ('ocr', 2), ('builtin', 3)) AS t(backend, attempt))
    SELECT d.doc_id, f.backend, f.attempt, f.backend IS NULL AS needs_review FROM documents d LEFT JOIN (SELECT doc_id, backend, CAST(attempt AS BIGINT) AS attempt FROM a WHERE score >= 0.58 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY attempt) = 1) f USING (doc_id)""",
)
def first_accepted_attempt(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    backends = F.array(*[F.struct(F.lit(b).alias("backend"), F.lit(i).cast("long").alias("attempt")) for i, b in enumerate(("primary", "ocr", "builtin"), 1)])
    tried = docs.select("doc_id", F.explode(backends).alias("b")).select("doc_id", "b.backend", "b.attempt").withColumn("score", (F.col("doc_id") * (F.col("attempt") + 3)) % 10 / 10.0)
    first = top_per_group(tried.where("score >= 0.58"), ["doc_id"], [F.asc("attempt")], 1).select("doc_id", "backend", "attempt")
    return docs.join(first, "doc_id", "left").withColumn("needs_review", F.col("backend").isNull())


@query(
    "manifest_verify",
    """WITH m AS (SELECT doc_id, sha256(text) AS sha, length(text) AS size FROM documents WHERE doc_id % 11 <> 0), a AS (SELECT doc_id, sha256(CASE WHEN doc_id % 13 = 0 THEN text || 'x' ELSE text END) AS sha, length(CASE WHEN doc_id % 13 = 0 THEN text || 'x' ELSE text END) AS size FROM documents WHERE doc_id % 17 <> 0)
    SELECT coalesce(m.doc_id, a.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN m.doc_id IS NULL THEN 'unexpected' WHEN m.size <> a.size THEN 'size_mismatch' ELSE 'hash_mismatch' END AS error FROM m FULL JOIN a ON m.doc_id = a.doc_id WHERE m.sha IS DISTINCT FROM a.sha""",
)
def manifest_verify(spark, d):
    from sparkloom.sources.sinks import verify_manifest

    docs = table(spark, d, "documents")
    tampered = docs.where("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))

    def manifest(x):
        return x.select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").alias("size"))

    return verify_manifest(manifest(docs.where("doc_id % 11 <> 0")), manifest(tampered), "doc_id")


@query(
    "neighbours_per_seed",
    f"""WITH {CHUNKS_SQL}, s AS (SELECT * FROM chunks WHERE idx = 1 AND doc_id % 20 = 0), c AS (SELECT s.chunk_id AS seed, c.chunk_id, 0 AS relation_rank, abs(c.idx - s.idx) AS distance FROM s JOIN chunks c ON c.doc_id = s.doc_id AND c.chunk_id <> s.chunk_id)
    SELECT seed, chunk_id, CAST(distance AS BIGINT) AS distance, round(1.0 / (1 + distance), 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY seed ORDER BY relation_rank, distance, chunk_id) <= 2""",
)
def neighbours_per_seed(spark, d):
    c = chunks(spark, d).select("doc_id", "idx", "chunk_id")
    seeds = c.where("idx = 1 AND doc_id % 20 = 0").select("doc_id", F.col("idx").alias("seed_idx"), F.col("chunk_id").alias("seed"))
    near = c.join(seeds, "doc_id").where("chunk_id <> seed").withColumn("distance", F.abs(F.col("idx") - F.col("seed_idx")).cast("long"))
    return top_per_group(near, ["seed"], [F.asc("distance"), F.asc("chunk_id")], 2).select("seed", "chunk_id", "distance", F.round(1.0 / (1 + F.col("distance")), 6).alias("score"))


@query("hash_embedding")
def hash_embedding(spark, d):
    from sparkloom.functions.embedding import hash_embedding as embed

    return table(spark, d, "documents").select("doc_id", embed(64)(F.col("text")).alias("embedding"))


@query("query_plan_variants")
def query_plan_variants(spark, d):
    from sparkloom.operators.planning import plan_variants

    return plan_variants(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
