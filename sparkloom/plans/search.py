"""Queries of retrieval: visibility, lexical scores, fusion, diversification, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.catalog import query
from sparkloom.functions.text import evidence_quote, has_marker, index_tokens, query_terms, whitespace_terms
from sparkloom.operators import evaluation, index
from sparkloom.operators.graph import held_in, scratch, settled
from sparkloom.operators.lexical import bm25, diversified, fused, ranked, term_overlap
from sparkloom.operators.retrieval import FIELDS, WEIGHTS, active_versions, hybrid_search, of_active_version, visible
from sparkloom.plans.overlay import CHUNKS_SQL, DOCS_SQL, VECTORS_SQL, chunks, documents, table, with_vectors

_ACC, _PLN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def _tok(x: str) -> str:
    return f"regexp_extract_all(translate(lower({x}), '{_ACC}', '{_PLN}'), '[\\p{{L}}\\p{{N}}]+')"


def _terms(x: str) -> str:
    return f"list_filter(string_split_regex(trim(regexp_replace(replace(lower({x}), '_', ' '), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"


_QTERMS = f"""qraw AS (SELECT item_id AS query_id, unnest(list_filter({_terms('text')}, lambda t, i: list_position({_terms('text')}, t) = i)[1:32]) AS raw FROM benchmark),
qterms AS (SELECT DISTINCT query_id, {_tok('raw')}[1] AS term FROM qraw WHERE len({_tok('raw')}) > 0),
qcounts AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_terms('text')}) AS term FROM benchmark) GROUP BY ALL)"""

_INDEX = f"""rows_ AS (SELECT *, 'chunk:' || CAST(idx AS VARCHAR) AS locator FROM chunks),
toks AS (SELECT chunk_id, unnest({_tok('chunk_text')}) AS term, 1.0 AS w FROM rows_ UNION ALL SELECT chunk_id, unnest({_tok('source_id')}), 0.25 FROM rows_
  UNION ALL SELECT chunk_id, unnest({_tok('locator')}), 0.15 FROM rows_ UNION ALL SELECT chunk_id, unnest({_tok('tenant_id')}), 0.35 FROM rows_),
lens AS (SELECT chunk_id, count(*) AS length FROM toks GROUP BY 1), stats AS (SELECT count(*) AS n_all, avg(length) AS mean FROM lens),
tf AS (SELECT chunk_id, term, CAST(sum(w) AS DOUBLE) AS tf FROM toks WHERE term IN (SELECT term FROM qterms) GROUP BY 1, 2),
idf AS (SELECT term, CASE WHEN ln((n_all - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_all - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT term, count(*) AS n FROM tf GROUP BY 1), stats),
bm AS (SELECT query_id, chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM qterms JOIN tf USING (term) JOIN idf USING (term) JOIN lens USING (chunk_id), stats GROUP BY 1, 2)"""


def _chunks(spark, d):
    return chunks(spark, d).withColumns({"locator": F.concat(F.lit("chunk:"), F.col("idx").cast("string")), "metadata_text": F.col("tenant_id")})


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _query_terms(spark, d):
    raw = _queries(spark, d).select("query_id", F.explode(query_terms(F.col("text"))).alias("raw"))
    return raw.select("query_id", F.element_at(index_tokens(F.col("raw")), 1).alias("term")).where("term IS NOT NULL").distinct()


# DuckDB text of diversification: a step a hit over lists of what was taken and put aside, then over the latter
def _diversified(hits: str, k: int) -> str:
    return f"""one AS (SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS took, CAST([] AS VARCHAR[]) AS openings, CAST([] AS VARCHAR[]) AS groups_, CAST([] AS BIGINT[]) AS aside FROM {hits} GROUP BY 1
      UNION ALL SELECT query_id, next_pos, CASE WHEN fits AND NOT old THEN list_append(took, next_pos) ELSE took END, CASE WHEN fits AND NOT old THEN list_append(openings, opening) ELSE openings END,
        CASE WHEN fits AND NOT old THEN list_append(groups_, grp) ELSE groups_ END, CASE WHEN fits AND old THEN list_append(aside, next_pos) ELSE aside END
        FROM (SELECT o.*, h.pos AS next_pos, h.opening, h.grp, len(took) < {k} AND NOT list_contains(openings, h.opening) AS fits, list_contains(groups_, h.grp) AS old FROM one o JOIN {hits} h ON h.query_id = o.query_id AND h.pos = o.pos + 1)),
    end1 AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos DESC) = 1),
    two AS (SELECT query_id, CAST(0 AS BIGINT) AS i, took, openings, aside FROM end1
      UNION ALL SELECT query_id, i + 1, CASE WHEN fits THEN list_append(took, pos) ELSE took END, CASE WHEN fits THEN list_append(openings, opening) ELSE openings END, aside
        FROM (SELECT t.*, h.pos, h.opening, len(took) < {k} AND NOT list_contains(openings, h.opening) AS fits FROM two t JOIN {hits} h ON h.query_id = t.query_id AND h.pos = t.aside[t.i + 1])),
    end2 AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1),
    placed AS (SELECT query_id, place, took[place] AS pos FROM end2, unnest(range(1, len(took) + 1)) AS t(place))"""


_OPENING = r"array_to_string(string_split(trim(regexp_replace(lower({}), '\s+', ' ', 'g')), ' ')[1:24], ' ')"


def _hybrid_ctes(dense: bool) -> str:
    wv, wl, wm, wr = WEIGHTS["dense" if dense else "hash"]
    cos = "round(coalesce(list_cosine_similarity(qv.vector, cv.vector), 0), 9)"
    near = f"""cvec AS (SELECT chunk_id, vector FROM (SELECT chunk_id, (doc_id * 7 + idx) % (SELECT n FROM nvec) AS slot FROM vis) JOIN vec USING (slot)),
    qvec AS (SELECT query_id, vector FROM (SELECT item_id AS query_id, (item_id * 3 + 1) % (SELECT n FROM nvec) AS slot FROM benchmark) JOIN vec USING (slot)),
    near AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, {cos} AS cos FROM cvec cv, qvec qv) QUALIFY rank <= 24),"""
    return f"""WITH RECURSIVE {CHUNKS_SQL}, {VECTORS_SQL}, {_QTERMS}, {_INDEX},
    vis AS (SELECT * FROM rows_ WHERE len(acl) = 0 OR list_has_any(acl, ['group:a'])),
    lex AS (SELECT * FROM (SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm SEMI JOIN vis USING (chunk_id)) WHERE rank <= 24 AND score > 0),
    mt AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_terms("source_id || ' ' || locator || ' ' || tenant_id")}) AS term FROM vis) GROUP BY ALL),
    mov AS (SELECT query_id, chunk_id, CAST(sum(least(qtf, tf)) AS BIGINT) AS overlap FROM qcounts JOIN mt USING (term) GROUP BY 1, 2),
    met AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, chunk_id) AS rank FROM mov WHERE overlap > 0) WHERE rank <= 24), {near}
    rrf AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS rrf FROM (SELECT query_id, chunk_id, rank FROM lex UNION ALL SELECT query_id, chunk_id, rank FROM met{" UNION ALL SELECT * FROM near" if dense else ""}) GROUP BY 1, 2),
    allb AS (SELECT query_id, rrf.chunk_id, rrf, coalesce(lex.score, 0.0) AS lexical, coalesce(mov.overlap, 0) AS metadata, vis.source_id, vis.page, chunk_text, {cos} AS cos
      FROM rrf JOIN vis USING (chunk_id) LEFT JOIN lex USING (query_id, chunk_id) LEFT JOIN mov USING (query_id, chunk_id) JOIN cvec cv USING (chunk_id) JOIN qvec qv USING (query_id)),
    norm AS (SELECT *, lexical / greatest(max(lexical) OVER (PARTITION BY query_id), 1e-12) AS nl, greatest(coalesce((SELECT max(overlap) FROM met WHERE met.query_id = allb.query_id), 0), 1) AS top FROM allb),
    rr AS (SELECT *, round({wv} * cos + {wl} * nl + {wm} * metadata / top + {wr} * 60 * rrf, 9) AS rerank FROM norm),
    hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS pos, {_OPENING.format("chunk_text")} AS opening, source_id || '/' || CAST(page AS VARCHAR) AS grp FROM rr),
    {_diversified("hits", 6)}"""


def _hybrid_sql(dense: bool) -> str:
    return f"""{_hybrid_ctes(dense)}
    SELECT query_id, place AS rank, chunk_id, round(cos, 6) AS vector, round(nl, 6) AS lexical, metadata, round(rrf, 6) AS rrf, round(rerank, 6) AS rerank FROM placed JOIN hits USING (query_id, pos)"""


def _hybrid(spark, d, profile):
    """Chunks name one of the given vectors, questions have theirs."""
    table_ = table(spark, d, "embeddings")
    n = table_.count()
    chunks = _chunks(spark, d).withColumn("vector_id", F.pmod(F.col("doc_id") * 7 + F.col("idx"), F.lit(n)).cast("long"))
    queries = with_vectors(_queries(spark, d), table_, F.col("query_id") * 3 + 1)
    return hybrid_search(chunks, queries, 6, ["group:a"], profile, vectors=table_.select(F.col("vec_id").cast("long").alias("vector_id"), F.col("embedding").alias("vector")))


@query("hybrid_search", _hybrid_sql(True))
def hybrid(spark, d):
    """Vectors, words and metadata; chunks and questions have given vectors."""
    return _hybrid(spark, d, "dense")


@query("hybrid_search_hash", _hybrid_sql(False))
def hybrid_hash(spark, d):
    """The profile of hashed vectors, which have no branch and no weight."""
    return _hybrid(spark, d, "hash")


@query("bm25_scores", f"WITH {CHUNKS_SQL}, {_QTERMS}, {_INDEX} SELECT query_id, chunk_id, round(score, 6) AS score FROM bm")
def bm25_scores(spark, d):
    terms = _query_terms(spark, d)
    return bm25(_chunks(spark, d), "chunk_id", FIELDS, terms).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(
    "bm25_topk",
    f"WITH {CHUNKS_SQL}, {_QTERMS}, {_INDEX} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm) WHERE rank <= 20",
)
def bm25_topk(spark, d):
    """On the written index, of which blocks that can't reach the twentieth score are not unpacked."""
    built = index.build(_chunks(spark, d), "chunk_id", FIELDS, scratch(spark))
    found = index.search(built, index.phrases(_queries(spark, d)), 20)
    return found.select("query_id", F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"), "rank")


_PHRASE = f"""WITH {DOCS_SQL}, b AS (SELECT item_id AS query_id, {_tok("text")} AS w FROM benchmark),
ph AS (SELECT DISTINCT query_id, unnest([w[2:3], w[5:7], w[4:4]]) AS p FROM b), ask AS (SELECT DISTINCT p FROM ph WHERE len(p) > 0),
t AS (SELECT doc_id, {_tok("text")} AS tt, {_tok("source_id")} AS ts FROM docs), stats AS (SELECT count(*) AS n_all, avg(len(tt) + len(ts)) AS mean FROM t),
at_ AS (SELECT doc_id, 1.0 AS w, i, tt AS toks, tt[i] AS first FROM t, unnest(range(1, len(tt) + 1)) AS u(i) UNION ALL SELECT doc_id, 0.25, i, ts, ts[i] FROM t, unnest(range(1, len(ts) + 1)) AS u(i)),
tf AS (SELECT p, doc_id, CAST(sum(w) AS DOUBLE) AS tf FROM ask JOIN at_ ON first = p[1] WHERE toks[i : i + len(p) - 1] = p GROUP BY 1, 2),
idf AS (SELECT p, CASE WHEN ln((n_all - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_all - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT p, count(*) AS n FROM tf GROUP BY 1), stats),
sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(tt) + len(ts)) / mean))), 9) AS score FROM ph JOIN tf USING (p) JOIN idf USING (p) JOIN t USING (doc_id), stats GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 10"""


@query("phrase_topk", _PHRASE)
def phrase_topk(spark, d):
    """Documents by two phrases and a word of each benchmark item: its tokens 2-3, 5-7 and 4."""
    built = index.build(documents(spark, d), "doc_id", {"text": 1.0, "source_id": 0.25}, scratch(spark))
    w = index_tokens(F.col("text"))
    raw = _queries(spark, d).select("query_id", F.explode(F.array(F.slice(w, 2, 2), F.slice(w, 5, 3), F.slice(w, 4, 1))).alias("tokens")).where(F.size("tokens") > 0)
    asked = raw.select("query_id", F.array_join("tokens", " ").alias("phrase"), "tokens").distinct()
    return index.search(built, asked, 10).select("query_id", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("term_counts", f"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY term")
def term_counts(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(whitespace_terms(F.col("text"))).alias("term"))
    per_doc = t.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("n_docs"))


@query(
    "lexical_overlap",
    f"""WITH {_QTERMS}, dc AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_terms('text')}) AS term FROM documents) GROUP BY ALL)
    SELECT query_id, doc_id, CAST(sum(least(qtf, tf)) AS BIGINT) AS overlap FROM qcounts JOIN dc USING (term) GROUP BY 1, 2""",
)
def lexical_overlap(spark, d):
    counts = _queries(spark, d).select("query_id", F.explode(whitespace_terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return term_overlap(table(spark, d, "documents"), "doc_id", F.col("text"), counts)


@query(
    "tenant_acl_visible",
    f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE tenant_id = 'en' AND (len(acl) = 0 OR list_has_any(acl, ['group:a', 'group:z']))",
)
def tenant_acl_visible(spark, d):
    return visible(documents(spark, d), "en", ["group:a", "group:z"]).select("doc_id")


@query(
    "active_version_visible",
    f"""WITH {DOCS_SQL}, act AS (SELECT tenant_id, source_id, max(version_no) AS active FROM docs WHERE version_no IS NOT NULL GROUP BY 1, 2)
    SELECT doc_id, version_no FROM docs LEFT JOIN act USING (tenant_id, source_id) WHERE version_no = active OR (version_no IS NULL AND active IS NULL)""",
)
def active_version_visible(spark, d):
    docs = documents(spark, d)
    return of_active_version(docs, active_versions(docs)).select("doc_id", "version_no")


@query(
    "quote_verified",
    f"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS t FROM documents), q AS (SELECT item_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS t FROM benchmark)
    SELECT item_id, doc_id FROM q JOIN n ON contains(n.t, q.t)""",
)
def quote_verified(spark, d):
    """Equi-join on five-word shingles finds candidates; `contains` on normalised texts decides."""
    def norm(c):
        return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))

    def opening(c):
        return F.split(c, " ")

    q = table(spark, d, "benchmark").select("item_id", norm(F.col("text")).alias("quote")).withColumn("w", opening(F.col("quote")))
    # the quote's second to fifth words stand whole in any text that holds it
    q = q.withColumn("key", F.when(F.size("w") >= 6, F.xxhash64(F.slice("w", 2, 4))))
    n = table(spark, d, "documents").select("doc_id", norm(F.col("text")).alias("t"))
    w = n.select("doc_id", opening(F.col("t")).alias("w"))
    hashes = F.transform(F.when(F.size("w") >= 4, F.sequence(F.lit(1), F.size("w") - 3)), lambda i: F.xxhash64(F.slice("w", i, 4)))
    keys = w.select("doc_id", F.explode(F.array_distinct(hashes)).alias("key"))
    # texts are met again only where a key is shared
    asked = settled(q.where("key IS NOT NULL").select("item_id", "key"))
    pairs = settled(held_in(keys, asked, "key", "inner").select("item_id", "doc_id").distinct())
    hit = pairs.join(held_in(n, pairs, "doc_id"), "doc_id").join(q.select("item_id", "quote"), "item_id").where(F.contains("t", F.col("quote"))).select("item_id", "doc_id")
    short = q.where("key IS NULL").select("item_id", "quote", F.explode(F.array_distinct(F.filter("w", lambda x: F.length(x) > 0))).alias("word"))
    # a short quote has its longest word in common with a word of the text, which may go on before and after it
    longest = short.groupBy("item_id", "quote").agg(F.max_by("word", F.struct(F.length("word"), "word")).alias("word"))
    words = w.select("doc_id", F.explode(F.array_distinct("w")).alias("text_word"))
    near = words.join(longest, F.contains("text_word", F.col("word"))).select("item_id", "doc_id", "quote").distinct()
    return hit.unionAll(near.join(n, "doc_id").where(F.contains("t", F.col("quote"))).select("item_id", "doc_id"))


@query(
    "evidence_quotes",
    """WITH c AS (SELECT doc_id, text, instr(lower(text), 'the') AS a, instr(lower(text), 'die') AS b FROM documents),
    s AS (SELECT doc_id, text, greatest(0, least(CASE WHEN a > 0 THEN a ELSE 1000000000 END, CASE WHEN b > 0 THEN b ELSE 1000000000 END) % 1000000000 - 1 - 100) AS s0, a, b FROM c),
    t AS (SELECT doc_id, text, CASE WHEN a = 0 AND b = 0 THEN 0 ELSE s0 END AS s1 FROM s)
    SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substring(text, CAST(CASE WHEN length(text) - s1 < 300 THEN greatest(0, length(text) - 300) ELSE s1 END + 1 AS BIGINT), 300) END AS quote FROM t""",
)
def evidence_quotes(spark, d):
    return table(spark, d, "documents").select("doc_id", evidence_quote(F.col("text"), F.array(F.lit("the"), F.lit("die"))).alias("quote"))


_BRANCHES = """a AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
b AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY length(source) DESC, doc_id) AS rank FROM documents)"""


@query(
    "rrf_branches",
    f"WITH {_BRANCHES} SELECT lang, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM (SELECT * FROM a WHERE rank <= 50 UNION ALL SELECT * FROM b WHERE rank <= 50) GROUP BY 1, 2",
)
def rrf_branches(spark, d):
    docs = table(spark, d, "documents").withColumn("m", F.length("source"))
    a, b = (ranked(docs, ["lang"], s, "doc_id", "rank", limit=50) for s in ("n_chars", "m"))
    return fused([a, b], ["lang", "doc_id"]).withColumn("rrf", F.round("rrf", 9))


@query(
    "rrf_variants",
    """WITH v AS (SELECT doc_id, lang, n_chars, k, row_number() OVER (PARTITION BY lang, k ORDER BY (doc_id * (k + 7)) % 101 DESC, doc_id) AS rank, ((doc_id * (k + 7)) % 101) / 101.0 AS rerank FROM documents, range(3) AS t(k))
    SELECT lang, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, round(max(rerank), 6) AS best FROM v WHERE rank <= 20 GROUP BY 1, 2""",
)
def rrf_variants(spark, d):
    v = table(spark, d, "documents").select("doc_id", "lang", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).withColumn("s", (F.col("doc_id") * (F.col("k") + 7)) % 101)
    v = ranked(v, ["lang", "k"], "s", "doc_id", "rank", limit=20)
    best = v.groupBy("lang", "doc_id").agg(F.round(F.max(F.col("s") / 101.0), 6).alias("best"))
    return fused([v], ["lang", "doc_id"]).withColumn("rrf", F.round("rrf", 9)).join(best, ["lang", "doc_id"])


@query("max_normalised_branch", "SELECT doc_id, round(n_chars / greatest(1.0, max(n_chars) OVER (PARTITION BY lang)), 6) AS score FROM documents")
def max_normalised_branch(spark, d):
    top = F.greatest(F.lit(1.0), F.max("n_chars").over(Window.partitionBy("lang")))
    return table(spark, d, "documents").select("doc_id", F.round(F.col("n_chars") / top, 6).alias("score"))


@query(
    "rank_scores_positive",
    "SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY quality DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id) WHERE quality > 0) WHERE rank <= 5",
)
def rank_scores_positive(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return ranked(j, ["source"], "quality", "doc_id", "rank", positive=True, limit=5).select("doc_id", "rank")


@query(
    "diversified_topk",
    f"""WITH RECURSIVE {DOCS_SQL}, hits AS (SELECT tenant_id AS query_id, doc_id, row_number() OVER (PARTITION BY tenant_id ORDER BY n_chars DESC, doc_id) AS pos, {_OPENING.format("text")} AS opening, source_id || '/' || CAST(page AS VARCHAR) AS grp FROM docs QUALIFY pos <= 60),
    {_diversified("hits", 10)} SELECT query_id AS tenant_id, place, doc_id FROM placed JOIN hits USING (query_id, pos)""",
)
def diversified_topk(spark, d):
    docs = documents(spark, d)
    hits = ranked(docs, ["tenant_id"], "n_chars", "doc_id", "rank", limit=60)
    return diversified(hits, "tenant_id", "rank", F.col("text"), ["source_id", "page"], "doc_id", 10)


@query(
    "query_coverage_gate",
    f"""{_hybrid_ctes(True)}, fin AS (SELECT query_id, chunk_id, rerank, chunk_text FROM placed JOIN hits USING (query_id, pos)),
    ev AS (SELECT query_id, unnest(regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank, 6) DESC, chunk_id) AS n FROM fin) WHERE n <= 5),
    et AS (SELECT DISTINCT query_id, t FROM ev WHERE length(t) > 1), qt AS (SELECT DISTINCT query_id, t FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM benchmark) WHERE length(t) > 1),
    c AS (SELECT qt.query_id, count(et.t) / count(*) AS coverage FROM qt LEFT JOIN et ON et.query_id = qt.query_id AND et.t = qt.t GROUP BY 1), bst AS (SELECT query_id, max(round(rerank, 6)) AS best FROM fin GROUP BY 1),
    a AS (SELECT item_id, coalesce(best, 0.0) AS best, coalesce(coverage, 0.0) AS coverage FROM benchmark LEFT JOIN bst ON bst.query_id = item_id LEFT JOIN c ON c.query_id = item_id)
    SELECT item_id, round(best, 6) AS best, round(coverage, 6) AS coverage, round(least(1.0, 0.65 * best + 0.35 * coverage), 6) AS confidence, best >= 0.2 AND coverage >= 0.25 AS sufficient FROM a""",
)
def query_coverage_gate(spark, d):
    """Each benchmark item against what hybrid search finds for it."""
    from sparkloom.operators.orchestrate import gate

    hits = settled(_hybrid(spark, d, "dense").select("query_id", "chunk_id", "rerank"))
    g = gate(hits, _chunks(spark, d), _queries(spark, d))
    return g.select(F.col("query_id").alias("item_id"), F.round("best", 6).alias("best"), F.round("coverage", 6).alias("coverage"), F.round("confidence", 6).alias("confidence"), "sufficient")


_EVAL = f"""{CHUNKS_SQL}, {_QTERMS}, {_INDEX}, rel AS (SELECT item_id AS query_id, source AS source_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL),
res AS (SELECT query_id, source_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm JOIN chunks USING (chunk_id) QUALIFY rank <= 5)"""


@query(
    "eval_recall_mrr_ndcg",
    f"""WITH {_EVAL}, n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1),
    h AS (SELECT query_id, count(DISTINCT source_id) AS found, min(rank) AS best, sum(1.0 / log2(rank + 1)) AS dcg FROM res SEMI JOIN rel USING (query_id, source_id) GROUP BY 1),
    q AS (SELECT n.query_id, coalesce(found, 0) / n_rel AS recall, coalesce(1.0 / best, 0) AS rr, coalesce(dcg, 0) / (SELECT sum(1.0 / log2(i + 1)) FROM range(1, 1 + least(n_rel, 5)) AS t(i)) AS ndcg FROM n LEFT JOIN h USING (query_id))
    SELECT count(*) AS n_answerable, round(avg(recall), 6) AS recall_at_5, round(avg(rr), 6) AS mrr_at_5, round(avg(ndcg), 6) AS ndcg_at_5 FROM q""",
)
def eval_recall_mrr_ndcg(spark, d):
    relevant, results = _golden(spark, d)
    return evaluation.macro(evaluation.per_query(relevant, results, 5), 5)


@query(
    "eval_duplicate_unauthorized",
    f"""WITH {_EVAL} SELECT query_id, round(1 - count(DISTINCT source_id) / count(*), 6) AS duplicate_rate, round(avg(CASE WHEN source_id IN ('src1', 'src3') THEN 1.0 ELSE 0.0 END), 6) AS unauthorized_rate FROM res GROUP BY 1""",
)
def eval_duplicate_unauthorized(spark, d):
    _, results = _golden(spark, d)
    return results.groupBy("query_id").agg(
        F.round(1 - F.countDistinct("source_id") / F.count("*"), 6).alias("duplicate_rate"), F.round(F.avg(F.col("source_id").isin("src1", "src3").cast("double")), 6).alias("unauthorized_rate")
    )


def _golden(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    found = quote_plain(spark, d)
    relevant = found.join(docs.select("doc_id", F.col("source").alias("source_id")), "doc_id").select(F.col("item_id").alias("query_id"), "source_id").distinct()
    c = _chunks(spark, d)
    built = index.build(c, "chunk_id", FIELDS, scratch(spark))
    found = index.search(built, index.phrases(_queries(spark, d)), 5).withColumnRenamed("id", "chunk_id")
    found = settled(found)
    results = found.join(held_in(c.select("chunk_id", "source_id"), found, "chunk_id"), "chunk_id").select("query_id", "source_id", "rank")
    return relevant, results


def quote_plain(spark, d):
    return quote_verified(spark, d)


@query(
    "route_markers",
    """SELECT item_id, contains(lower(text), 'cause') OR contains(lower(text), 'why') OR contains(lower(text), 'across') OR contains(lower(text), 'between') OR contains(lower(text), 'compare') OR contains(lower(text), 'related') OR contains(lower(text), 'depend') OR contains(lower(text), 'impact') OR contains(lower(text), 'relationship') OR contains(lower(text), 'multi-hop') AS relational, contains(lower(text), 'it') OR contains(lower(text), 'they') AS ambiguous FROM benchmark""",
)
def route_markers(spark, d):
    from sparkloom.functions.text import AMBIGUITY_MARKERS, RELATIONAL_MARKERS

    return table(spark, d, "benchmark").select("item_id", has_marker(F.col("text"), RELATIONAL_MARKERS).alias("relational"), has_marker(F.col("text"), AMBIGUITY_MARKERS).alias("ambiguous"))
