"""Queries of structure: heading paths, layout payloads and their quality, neighbours, paths through graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalog import query
from sparkloom.functions.text import bound, whitespace_terms
from sparkloom.operators import blocks as bl
from sparkloom.operators import graph, layout
from sparkloom.operators.neighbours import neighbours
from sparkloom.plans.overlay import CHUNKS_SQL, chunks, documents, table

_LINES = r"lines AS (SELECT doc_id, i - 1 AS pos, t[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), unnest(range(1, len(t) + 1)) AS u(i))"


@query(
    "heading_path",
    f"""WITH RECURSIVE {_LINES}, m AS (SELECT doc_id, pos, trim(line) AS name, CASE WHEN length(line) < 40 THEN 1 + length(line) % 3 END AS level FROM lines),
    h AS (SELECT doc_id, pos, name, level, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM m WHERE level IS NOT NULL),
    p AS (SELECT doc_id, n, [name] AS path FROM h WHERE n = 1 UNION ALL SELECT h.doc_id, h.n, list_append(path[1 : level - 1], name) FROM p JOIN h ON h.doc_id = p.doc_id AND h.n = p.n + 1),
    s AS (SELECT doc_id, pos, count(level) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM m)
    SELECT s.doc_id, CAST(pos AS BIGINT) AS pos, coalesce(array_to_string(path, ' > '), '') AS path, CAST(coalesce(len(path), 0) AS BIGINT) AS depth FROM s LEFT JOIN p ON p.doc_id = s.doc_id AND p.n = s.n""",
)
def heading_path(spark, d):
    """Short lines as headings of three levels."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    level = F.when(F.length("line") < 40, 1 + F.length("line") % 3)
    out = bl.heading_paths(lines, "doc_id", "pos", level, "line")
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("path", " > ").alias("path"), F.size("path").cast("long").alias("depth"))


# pages of a document of eight, their paragraphs as payload blocks whose labels and boxes go by number
_PARTS = r"""parts AS (SELECT page_id // 8 AS doc, page_id % 8 + 1 AS page, i, trim(t[i]) AS text FROM (SELECT page_id, regexp_extract_all(html, '<p[^>]*>([^<]*)</p>', 1) AS t FROM pages), unnest(range(1, len(t) + 1)) AS u(i)),
lab AS (SELECT *, CASE i % 6 WHEN 1 THEN 'doc_title' WHEN 2 THEN 'Table' WHEN 3 THEN 'figure' WHEN 4 THEN 'formula' ELSE 'text' END AS label FROM parts),
blk AS (SELECT doc, page, i, text, lower(label) AS label, CASE WHEN label = 'doc_title' THEN 'heading' WHEN label = 'Table' THEN 'table' WHEN label = 'figure' THEN 'image' WHEN label = 'formula' THEN 'formula' ELSE 'paragraph' END AS kind,
  CASE WHEN i % 4 < 3 THEN CAST(i AS DOUBLE) / 10 END AS top, 'page:' || CAST(page AS VARCHAR) || ':ocr-block:' || CAST(i AS VARCHAR) AS locator FROM lab WHERE text <> ''),
bn AS (SELECT doc, page, count(*) AS n FROM blk GROUP BY 1, 2), bp AS (SELECT doc, page, coalesce(sum(n) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bn)"""


def _payloads(spark, d):
    parts = F.transform(F.regexp_extract_all("html", F.lit("<p[^>]*>([^<]*)</p>"), F.lit(1)), lambda t, i: F.struct((i + 1).alias("i"), t.alias("t")))

    def block(x):
        i = x["i"]
        label = F.when(i % 6 == 1, "doc_title").when(i % 6 == 2, "Table").when(i % 6 == 3, "figure").when(i % 6 == 4, "formula").otherwise("text")
        top = i / 10
        named = F.struct(F.lit(0.0).alias("l"), top.alias("t"), F.lit(1.0).alias("r"), F.lit(1.0).alias("b"))
        return F.to_json(F.struct(
            x["t"].alias("block_content"), label.alias("block_label"),
            F.when(i % 4 == 0, F.array(F.lit(0.0), top, F.lit(1.0), F.lit(1.0))).alias("block_bbox"), F.when(i % 4 == 1, named).alias("bbox"),
        ))

    def other(x):  # the third way to give a box, and none
        top = x["i"] / 10
        named = F.struct(F.lit(0.0).alias("left"), top.alias("top"), F.lit(1.0).alias("right"), F.lit(1.0).alias("bottom"))
        label = F.when(x["i"] % 6 == 1, "doc_title").when(x["i"] % 6 == 2, "Table").when(x["i"] % 6 == 3, "figure").when(x["i"] % 6 == 4, "formula").otherwise("text")
        return F.to_json(F.struct(x["t"].alias("text"), label.alias("type"), F.when(x["i"] % 4 == 2, named).alias("bbox")))

    listed = F.transform(parts, lambda x: F.when(x["i"] % 4 < 2, block(x)).otherwise(other(x)))
    body = F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]"))
    payload = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"parsing_res_list":'), body, F.lit("}"))).otherwise(F.concat(F.lit('{"layout_parsing_result":{"blocks":'), body, F.lit("}}")))
    return table(spark, d, "pages").select(F.floor(F.col("page_id") / 8).alias("doc"), (F.col("page_id") % 8 + 1).alias("page"), payload.alias("payload"))


@query("layout_blocks", f"WITH {_PARTS} SELECT doc, page, CAST(before + i AS BIGINT) AS reading_order, locator, kind, text, top FROM blk JOIN bp USING (doc, page)")
def layout_blocks(spark, d):
    """JSON payloads made of pages' paragraphs, read back."""
    return layout.payload_blocks(_payloads(spark, d)).select("doc", "page", "reading_order", "locator", "kind", "text", F.col("bbox.top").alias("top"))


@query(
    "layout_assets",
    f"""WITH {_PARTS} SELECT doc, substr(sha256(locator), 1, 24) AS asset_id, kind AS asset_type, page, page AS block_page, top AS block_top FROM blk WHERE kind IN ('table', 'image', 'formula')""",
)
def layout_assets(spark, d):
    blocks = layout.payload_blocks(_payloads(spark, d))
    return layout.linked(layout.assets(blocks), blocks).select("doc", "asset_id", "asset_type", "page", "block_page", F.col("block_bbox.top").alias("block_top"))


_RUNNING = r"""rk AS (SELECT *, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key FROM blk), ra AS (SELECT doc, count(DISTINCT page) AS n_all FROM rk GROUP BY 1 HAVING count(DISTINCT page) >= 3),
rh AS (SELECT doc, key FROM (SELECT doc, key, count(DISTINCT page) AS n FROM rk WHERE length(text) <= 160 GROUP BY 1, 2) JOIN ra USING (doc) WHERE n / n_all >= 0.6),
fin AS (SELECT rk.* REPLACE (CASE WHEN rh.key IS NULL THEN kind WHEN regexp_full_match(rk.key, '(?:page\s*)?\d+(?:\s*(?:/|of)\s*\d+)?') THEN 'page_number' WHEN top <= 0.2 THEN 'running_header' ELSE 'running_footer' END AS kind) FROM rk LEFT JOIN rh USING (doc, key))"""


@query(
    "layout_quality",
    f"""WITH {_PARTS}, {_RUNNING}, dd AS (SELECT page_id // 8 AS doc, count(*) AS page_count, count(*) FILTER (len(list_filter(regexp_extract_all(html, '<p[^>]*>([^<]*)</p>', 1), lambda x: trim(x) <> '')) = 0) AS empty_pages FROM pages GROUP BY 1),
    ib AS (SELECT doc, count(*) AS blocks, sum(length(text)) AS chars, sum(length(text) - length(replace(text, '�', ''))) AS garbled, count(*) - count(DISTINCT key) AS repeats, sum(CASE WHEN kind = 'table' THEN length(text) ELSE 0 END) AS tb FROM fin WHERE kind NOT IN ('running_header', 'running_footer', 'page_number') GROUP BY 1),
    ia AS (SELECT doc, count(*) AS assets, count(*) FILTER (kind IN ('image', 'table', 'formula')) AS va, sum(CASE WHEN kind = 'table' THEN length(text) ELSE 0 END) AS ta, count(*) FILTER (kind = 'table') AS tables FROM blk WHERE kind IN ('table', 'image', 'formula') GROUP BY 1),
    j AS (SELECT dd.doc, page_count, empty_pages, doc % 3 <> 0 AS is_pdf, doc % 11 = 5 AS scanned, coalesce(blocks, 0) AS blocks, coalesce(chars, 0) AS chars, coalesce(garbled, 0) AS garbled, coalesce(repeats, 0) AS repeats, coalesce(tb, 0) AS tb, coalesce(assets, 0) AS assets, coalesce(va, 0) AS va, coalesce(ta, 0) AS ta, coalesce(tables, 0) AS tables FROM dd LEFT JOIN ib USING (doc) LEFT JOIN ia USING (doc)),
    k AS (SELECT *, garbled / greatest(chars, 1) AS g, repeats / greatest(blocks, 1) AS du, empty_pages / greatest(page_count, 1) AS e, greatest(tb, ta) AS tc, chars / greatest(page_count, 1) AS cpp FROM j),
    l AS (SELECT *, is_pdf AND va > 0 AND cpp < 160 AS sv, is_pdf AND (tb > 0 OR tables > 0) AND tc < 160 AS st FROM k),
    o AS (SELECT *, scanned OR (page_count > 0 AND e >= 0.5) OR sv OR st AS needs_ocr, round(greatest(0, least(1, 1 - CASE WHEN blocks = 0 THEN 0.7 ELSE 0 END - least(g * 5, 0.3) - least(du * 0.5, 0.25) - least(e * 0.5, 0.45) - CASE WHEN sv THEN 0.45 ELSE 0 END - CASE WHEN st THEN 0.25 ELSE 0 END)), 6) AS score FROM l)
    SELECT doc, blocks, CAST(chars AS BIGINT) AS chars, round(cpp, 6) AS chars_per_page, round(g, 6) AS garbled, round(du, 6) AS duplicate, round(e, 6) AS empty, assets, va AS visual_assets, CAST(tc AS BIGINT) AS table_chars,
      concat_ws(',', CASE WHEN blocks = 0 THEN 'NO_INDEXABLE_TEXT' END, CASE WHEN g > 0.02 THEN 'HIGH_GARBLED_CHARACTER_RATIO' END, CASE WHEN du > 0.35 THEN 'HIGH_DUPLICATE_BLOCK_RATIO' END, CASE WHEN sv THEN 'LOW_TEXT_COVERAGE_WITH_VISUAL_ASSETS' END, CASE WHEN st THEN 'SPARSE_TABLE_EXTRACTION' END, CASE WHEN needs_ocr THEN 'OCR_REQUIRED' END) AS issues,
      CAST(score AS DOUBLE) AS score, needs_ocr, score >= 0.58 AND NOT needs_ocr AS accepted, NOT (score >= 0.58 AND NOT needs_ocr) AND NOT needs_ocr AS needs_review FROM o""",
)
def layout_quality(spark, d):
    """The gate over documents of eight pages, running lines told apart first; two thirds count as PDF."""
    blocks = graph.settled(layout.payload_blocks(_payloads(spark, d)))
    filled = F.size(F.filter(F.regexp_extract_all("html", F.lit("<p[^>]*>([^<]*)</p>"), F.lit(1)), lambda x: F.trim(x) != "")) > 0
    docs = table(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 8).alias("doc")).agg(F.count("*").alias("page_count"), F.count(F.when(~filled, 1)).alias("empty_pages"))
    docs = docs.withColumns({"is_pdf": F.col("doc") % 3 != 0, "scanned": F.col("doc") % 11 == 5})
    return layout.quality(layout.running_lines(blocks), layout.assets(blocks), docs)


@query(
    "accepted_attempts",
    r"""WITH t AS (SELECT doc_id AS doc, 1 AS attempt, 'builtin' AS backend, [string_split(text, chr(10))[1]] AS b FROM documents UNION ALL SELECT doc_id, 2, 'lines', string_split(text, chr(10)) FROM documents UNION ALL SELECT doc_id, 3, 'words', string_split_regex(text, '\s+') FROM documents),
    u AS (SELECT doc, attempt, backend, unnest(b) AS x FROM t), g AS (SELECT doc, attempt, backend, count(*) AS blocks, sum(length(trim(x))) AS chars, count(*) - count(DISTINCT trim(regexp_replace(lower(trim(x)), '\s+', ' ', 'g'))) AS repeats, sum(length(trim(x)) - length(replace(trim(x), '�', ''))) AS garbled FROM u WHERE trim(x) <> '' GROUP BY ALL),
    s AS (SELECT t.doc, t.attempt, t.backend, round(greatest(0, 1 - CASE WHEN coalesce(blocks, 0) = 0 THEN 0.7 ELSE 0 END - least(coalesce(garbled / greatest(chars, 1), 0) * 5, 0.3) - least(coalesce(repeats / greatest(blocks, 1), 0) * 0.5, 0.25) - CASE WHEN coalesce(chars, 0) < 160 THEN 0.45 ELSE 0 END), 6) AS score FROM t LEFT JOIN g USING (doc, attempt)),
    a AS (SELECT *, score >= 0.9 AS accepted FROM s)
    SELECT doc, CAST(attempt AS INTEGER) AS attempt, backend, NOT accepted AS needs_review FROM a QUALIFY row_number() OVER (PARTITION BY doc ORDER BY NOT accepted, CASE WHEN accepted THEN 0 ELSE -score END, attempt) = 1""",
)
def accepted_attempts(spark, d):
    """Three ways to cut a document into blocks, tried in turn: the first whose measured quality is accepted."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    ways = [("builtin", F.array(F.get(F.split("text", "\n"), 0))), ("lines", F.split("text", "\n")), ("words", F.split("text", r"\s+"))]
    tried = None
    for i, (name, parts) in enumerate(ways, 1):
        part = docs.select("doc", F.lit(i).alias("attempt"), F.lit(name).alias("backend"), parts.alias("b"))
        tried = part if tried is None else tried.unionByName(part)

    def measured(kept):
        """Of a document's blocks, joined where they are summed: none leaves its row."""
        every = F.array_join(kept, "")
        keys = F.array_distinct(F.transform(F.array_distinct(kept), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))))
        return F.struct(
            F.size(kept).alias("blocks"), F.length(every).alias("chars"), F.size(keys).alias("distinct"),
            (F.length(every) - F.length(F.replace(every, F.lit("�"), F.lit("")))).alias("garbled"),
        )

    kept = F.filter(F.transform(F.coalesce("b", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    g = tried.select("doc", "attempt", "backend", bound(kept, measured).alias("m")).select("doc", "attempt", "backend", "m.*")
    score = 1.0 - F.when(F.col("blocks") == 0, 0.7).otherwise(0.0) - F.least(F.col("garbled") / F.greatest("chars", F.lit(1)) * 5, F.lit(0.3)) - F.least((F.col("blocks") - F.col("distinct")) / F.greatest("blocks", F.lit(1)) * 0.5, F.lit(0.25))
    g = g.withColumn("score", F.round(F.greatest(F.lit(0.0), score - F.when(F.col("chars") < 160, 0.45).otherwise(0.0)), 6))
    return layout.first_accepted(g.select("doc", "attempt", "backend", "score", (F.col("score") >= 0.9).alias("accepted")))


_SEED = "(item_id * 7 + k * 13) % (SELECT count(*) FROM documents)"


@query(
    "structural_neighbours",
    f"""WITH {CHUNKS_SQL}, ch AS (SELECT chunk_id, tenant_id || '/' || source_id AS source_id, version_no AS version_id, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id AS VARCHAR) END AS parent_id, source_id || '#' || CAST(doc_id % 3 AS VARCHAR) AS heading, CASE WHEN doc_id % 5 <> 0 THEN idx END AS seq, chunk_text FROM chunks),
    seeds AS (SELECT item_id AS query_id, k AS seed_no, CAST({_SEED} AS VARCHAR) || ':0000' AS chunk_id, 0.9 - 0.1 * k AS rerank FROM benchmark, range(4) AS t(k)),
    s AS (SELECT query_id, min(seed_no) AS seed_no, chunk_id, max(rerank) AS rerank FROM seeds GROUP BY 1, 3),
    a AS (SELECT s.*, c.source_id, c.version_id, c.parent_id, c.heading, c.seq FROM s JOIN ch c USING (chunk_id)),
    cand AS (SELECT a.query_id, a.seed_no, a.chunk_id AS seed_id, a.rerank AS seed_rerank, c.chunk_id, CASE WHEN c.parent_id = a.parent_id THEN 0 ELSE 1 END AS relation, coalesce(abs(c.seq - a.seq), 1000) AS distance, c.chunk_text FROM a JOIN ch c ON c.source_id = a.source_id AND c.version_id IS NOT DISTINCT FROM a.version_id AND (c.parent_id = a.parent_id OR c.heading = a.heading)
      WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.query_id = a.query_id AND x.chunk_id = c.chunk_id)),
    near AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query_id, seed_no ORDER BY relation, distance, chunk_id) <= 3),
    f AS (SELECT *, CASE WHEN seed_no = min(seed_no) OVER (PARTITION BY query_id, chunk_id) THEN 1 ELSE 0 END AS new FROM near),
    tk AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY query_id ORDER BY seed_no RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
    terms AS (SELECT item_id AS query_id, string_split_regex(trim(regexp_replace(replace(lower(text), '_', ' '), '\\s+', ' ', 'g')), ' ') AS w FROM benchmark),
    sc AS (SELECT tk.*, least(1.0, list_sum(list_transform(list_distinct(w), lambda t: least(len(list_filter(w, lambda x: x = t)), len(list_filter(string_split_regex(trim(regexp_replace(replace(lower(chunk_text), '_', ' '), '\\s+', ' ', 'g')), ' '), lambda x: x = t))))) / len(w)) AS lexical, CASE WHEN distance < 1000 THEN 1.0 / (1 + distance) ELSE 0.25 END AS structural FROM tk JOIN terms USING (query_id) WHERE before < 5),
    rr AS (SELECT *, round(least(0.70 * seed_rerank + 0.15 * lexical + 0.15 * structural, greatest(0, seed_rerank * 0.95)), 9) AS rerank FROM sc),
    b AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rerank DESC, seed_no) = 1)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS rank, chunk_id, seed_id, CAST(round(structural, 6) AS DOUBLE) AS structural, CAST(round(lexical, 6) AS DOUBLE) AS lexical, CAST(round(rerank, 6) AS DOUBLE) AS rerank FROM b QUALIFY rank <= 5""",
)
def structural_neighbours(spark, d):
    """Four seed chunks a benchmark item, three neighbours each, five in all: the third seed mostly reaches that."""
    c = chunks(spark, d)
    words = whitespace_terms(F.col("chunk_text"))

    def counts(w):
        once = F.array_distinct(w)
        return F.map_from_arrays(once, F.transform(once, lambda t: F.size(F.filter(w, lambda x: x == t))))

    ch = c.select(
        "chunk_id", F.concat_ws("/", "tenant_id", "source_id").alias("source_id"), F.col("version_no").alias("version_id"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id").cast("string")).alias("parent_id"),
        F.array(F.concat(F.col("source_id"), F.lit("#"), (F.col("doc_id") % 3).cast("string"))).alias("heading"), F.when(F.col("doc_id") % 5 != 0, F.col("idx")).alias("seq"), "chunk_text",
    )
    n = documents(spark, d).count()
    b = table(spark, d, "benchmark")
    seeds = b.select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seed_no"))
    seeds = seeds.select("query_id", "seed_no", F.concat(((F.col("query_id") * 7 + F.col("seed_no") * 13) % n).cast("string"), F.lit(":0000")).alias("chunk_id"), (0.9 - 0.1 * F.col("seed_no")).alias("rerank"))
    seeds = seeds.groupBy("query_id", "chunk_id").agg(F.min("seed_no").alias("seed_no"), F.max("rerank").alias("rerank"))
    w = whitespace_terms(F.col("text"))
    return neighbours(ch, seeds, b.select(F.col("item_id").alias("query_id"), counts(w).alias("counts"), F.size(w).alias("n")), per_seed=3, most=5, text_terms=counts(words))


_GRAPH = """ment AS (SELECT 'supplier:' || CAST(s_suppkey AS VARCHAR) AS chunk_id, 'nation:' || CAST(s_nationkey AS VARCHAR) AS entity_id, s_suppkey % 5 <> 0 AS visible, lower(s_name) || ' ' || lower(n_name) AS text, s_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
rl AS (SELECT 'nation:' || CAST(n_nationkey AS VARCHAR) AS src, 'region:' || CAST(n_regionkey AS VARCHAR) AS dst, 'PART_OF' AS kind, (SELECT min(chunk_id) FROM ment WHERE ment.s_nationkey = n_nationkey) AS evidence FROM nation
  UNION ALL SELECT 'nation:' || CAST(n_nationkey AS VARCHAR), 'nation:' || CAST((n_nationkey + 7) % 25 AS VARCHAR), CASE WHEN n_nationkey % 2 = 0 THEN 'CONTAINS_SECTION' ELSE 'TRADES_WITH' END, (SELECT max(chunk_id) FROM ment WHERE ment.s_nationkey = n_nationkey) FROM nation),
seeds AS (SELECT item_id AS query_id, 'supplier:' || CAST(1 + (item_id * 3) % (SELECT count(*) FROM supplier) AS VARCHAR) AS chunk_id FROM benchmark),
seen AS (SELECT DISTINCT chunk_id, entity_id FROM ment WHERE visible), e0 AS (SELECT src, dst FROM rl WHERE kind <> 'CONTAINS_SECTION' AND evidence IN (SELECT chunk_id FROM seen)), e AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM e0 UNION ALL SELECT dst, src FROM e0)),
n0 AS (SELECT DISTINCT query_id, entity_id AS node FROM seeds JOIN seen USING (chunk_id)),
n1 AS (SELECT query_id, e.b AS node, min(n0.node) AS p FROM n0 JOIN e ON e.a = n0.node WHERE (query_id, e.b) NOT IN (SELECT query_id, node FROM n0) GROUP BY 1, 2),
n2 AS (SELECT n1.query_id, e.b AS node, min(n1.node) AS p FROM n1 JOIN e ON e.a = n1.node WHERE (n1.query_id, e.b) NOT IN (SELECT query_id, node FROM n0 UNION ALL SELECT query_id, node FROM n1) GROUP BY 1, 2),
met AS (SELECT query_id, node, 1 AS hop, [p, node] AS path FROM n1 UNION ALL SELECT n2.query_id, n2.node, 2, [n1.p, n1.node, n2.node] FROM n2 JOIN n1 ON n1.query_id = n2.query_id AND n1.node = n2.p),
nm AS (SELECT 'nation:' || CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation UNION ALL SELECT 'region:' || CAST(r_regionkey AS VARCHAR), r_name FROM region),
fd AS (SELECT met.*, s.chunk_id, text FROM met JOIN seen s ON s.entity_id = met.node JOIN ment m ON m.chunk_id = s.chunk_id WHERE (query_id, s.chunk_id) NOT IN (SELECT query_id, chunk_id FROM seeds)),
asked AS (SELECT query_id, list_distinct(['supplier', 'nation', lower(n_name)]) AS t FROM seeds JOIN ment USING (chunk_id) JOIN nation ON n_nationkey = s_nationkey),
sc AS (SELECT fd.*, round(least(0.95, pow(0.72, hop) * (0.7 + 0.3 * len(list_intersect(t, string_split(text, ' '))) / greatest(len(t), 1))), 9) AS score FROM fd JOIN asked USING (query_id)),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, hop, node) = 1),
top_ AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM best QUALIFY rank <= 10)"""


def _graph(spark, d):
    s, n, r, b = (table(spark, d, t) for t in ("supplier", "nation", "region", "benchmark"))

    def key(kind, c):
        return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    m = s.join(n, s.s_nationkey == n.n_nationkey).select(key("supplier", "s_suppkey").alias("chunk_id"), key("nation", "s_nationkey").alias("entity_id"), (F.col("s_suppkey") % 5 != 0).alias("visible"), F.concat_ws(" ", F.lower("s_name"), F.lower("n_name")).alias("text"), F.lower("n_name").alias("nation"))
    ends = m.groupBy("entity_id").agg(F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))
    named = n.withColumn("entity_id", key("nation", "n_nationkey")).join(ends, "entity_id", "left")
    other = F.concat(F.lit("nation:"), ((F.col("n_nationkey") + 7) % 25).cast("string"))
    rel = named.select(F.col("entity_id").alias("src"), key("region", "n_regionkey").alias("dst"), F.lit("PART_OF").alias("kind"), F.col("first").alias("evidence")).unionByName(
        named.select(F.col("entity_id").alias("src"), other.alias("dst"), F.when(F.col("n_nationkey") % 2 == 0, "CONTAINS_SECTION").otherwise("TRADES_WITH").alias("kind"), F.col("last").alias("evidence"))
    )
    names = n.select(key("nation", "n_nationkey").alias("entity_id"), F.col("n_name").alias("name")).unionByName(r.select(key("region", "r_regionkey").alias("entity_id"), F.col("r_name").alias("name")))
    seeds = b.select(F.col("item_id").alias("query_id"), F.concat(F.lit("supplier:"), (1 + F.col("item_id") * 3 % s.count()).cast("string")).alias("chunk_id"))
    asked = seeds.join(m, "chunk_id").select("query_id", F.array_distinct(F.array(F.lit("supplier"), F.lit("nation"), F.col("nation"))).alias("asked"))
    return graph.graph_evidence(seeds, m, rel, m.select("chunk_id", F.split("text", " ").alias("terms")), asked, names), seeds, m


@query(
    "kg_evidence_paths",
    f"""WITH {_GRAPH} SELECT query_id, rank, chunk_id, round(score, 6) AS score, CAST(hop AS BIGINT) AS hops, array_to_string(list_transform(path, lambda x: coalesce(names[x], x)), ' > ') AS path FROM top_, (SELECT map(list(id), list(name)) AS names FROM nm)""",
)
def kg_evidence_paths(spark, d):
    """Suppliers as chunks that mention their nation, a fifth hidden from the caller; nations belong to regions
    and trade with each other, where the chunk that says so may be seen."""
    return _graph(spark, d)[0]


@query(
    "kg_merge_fallback",
    f"""WITH {_GRAPH}, direct AS (SELECT query_id, chunk_id, 0.5 AS score FROM seeds UNION ALL SELECT query_id, chunk_id, 0.4 FROM top_ WHERE rank % 2 = 0),
    g AS (SELECT query_id, chunk_id, round(score, 6) AS score FROM top_ WHERE query_id % 3 <> 0), st AS (SELECT query_id, 'near:' || chunk_id AS chunk_id, 0.3 AS score FROM seeds WHERE query_id % 2 = 0),
    x AS (SELECT query_id, chunk_id, score, CAST(NULL AS VARCHAR) AS warning FROM g UNION ALL SELECT query_id, chunk_id, score, 'graph_expansion:structural_fallback' FROM st WHERE query_id NOT IN (SELECT query_id FROM g)
      UNION ALL SELECT DISTINCT query_id, NULL, NULL, 'graph_expansion:no_neighbors' FROM seeds WHERE query_id NOT IN (SELECT query_id FROM g) AND query_id NOT IN (SELECT query_id FROM st)),
    u AS (SELECT query_id, chunk_id, score, 'direct' AS origin FROM direct UNION ALL SELECT query_id, chunk_id, score, 'graph' FROM x WHERE chunk_id IS NOT NULL),
    mx AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, origin) = 1)
    SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, origin, (SELECT max(warning) FROM x WHERE x.query_id = mx.query_id) AS warning FROM mx""",
)
def kg_merge_fallback(spark, d):
    """Direct hits and what the graph finds, each chunk with its higher score; where the graph finds nothing,
    structural neighbours serve, or a warning."""
    top, seeds, _ = _graph(spark, d)
    top = graph.settled(top)
    direct = seeds.select("query_id", "chunk_id", F.lit(0.5).alias("score")).unionByName(top.where("rank % 2 = 0").select("query_id", "chunk_id", F.lit(0.4).alias("score")))
    near = seeds.where("query_id % 2 = 0").select("query_id", F.concat(F.lit("near:"), F.col("chunk_id")).alias("chunk_id"), F.lit(0.3).alias("score"))
    found = graph.or_else(top.where("query_id % 3 <> 0").select("query_id", "chunk_id", "score"), near, seeds)
    told = found.groupBy("query_id").agg(F.max("warning").alias("warning"))
    return graph.merged_hits(direct, found.where("chunk_id IS NOT NULL")).join(told, "query_id", "left").select("query_id", "chunk_id", "score", "origin", "warning")
