"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


_LOW = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str, separators: str) -> str:
    return f"list_filter(string_split_regex({_LOW.format(text)}, '[{separators}]+'), lambda x: x <> '')"


_ALNUM = r"\x00-\x2F\x3A-\x60\x7B-\x7F"

CONTAMINATION_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", _ALNUM)} AS w FROM documents),
i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_words("text", _ALNUM)} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[j : j + n - 1], ' ') AS win FROM i, unnest(range(1, len(w) - n + 2)) AS t(j)),
dw AS (SELECT r, j, s.n, array_to_string(w[j : j + s.n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM win) s, unnest(range(1, len(w) - s.n + 2)) AS t(j)),
hit AS (SELECT r, j, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.win = win.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(j, j + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN pos USING (r) LEFT JOIN ids USING (r)"""

COMPONENTS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words("text", r" \x09-\x0D")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[j : j + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS t(j)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1) USING (doc_id)"""

# crc32 of decimal digits: eight steps a byte, without a table
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))"""
_CENTS = "CASE WHEN abs(100.0 * {0}) < 9e15 THEN CAST(floor(100.0 * {0} + 0.5) AS BIGINT) ELSE 0 END"

FEATURES_SQL = f"""WITH c AS (SELECT click_id, client_id, kind, epoch_us(ts) AS ts, greatest(epoch_us(ts), epoch_us(arrived_at) + 14400000000) AS beg, {_CENTS.format("value")} AS cents
  FROM (SELECT DISTINCT * FROM clicks) WHERE client_id IS NOT NULL AND ts IS NOT NULL AND arrived_at IS NOT NULL),
s AS (SELECT row_number() OVER () AS r, sale_id, client_id, epoch_us(sold_at) AS sold, CASE WHEN arrived_at IS NOT NULL THEN greatest(epoch_us(sold_at), epoch_us(arrived_at) + 14400000000) END AS beg,
  {_CENTS.format("total")} AS cents, epoch_us(sold_at) + 1000000 * (xor({_CRC.format("sale_id")}, 4294967295::BIGINT) % 259200) AS t FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
l AS (SELECT s.client_id, s.sold, greatest(s.beg, epoch_us(shipped_at)) AS beg, item_id, {_CENTS.format("amount")} AS cents FROM s JOIN sale_lines USING (sale_id) WHERE s.beg IS NOT NULL AND shipped_at IS NOT NULL),
p AS (SELECT r, sale_id, client_id, t, d, t - d * 86400000000 AS since FROM s, (VALUES (2), (14)) AS w(d)),
pc AS (SELECT r, d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(cents) AS click_cents, arg_max_null(click_id, {{'a': c.ts, 'b': coalesce(click_id, -9223372036854775807)}}) AS last_click_id
  FROM p JOIN c ON c.client_id = p.client_id AND c.ts > since AND c.beg <= t GROUP BY ALL),
ps AS (SELECT p.r, d, count(*) AS n_sales, sum(s.cents) AS sale_cents FROM p JOIN s USING (client_id) WHERE s.sold > since AND s.beg <= p.t GROUP BY p.r, d),
pl AS (SELECT r, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(cents) AS line_cents FROM p JOIN l USING (client_id) WHERE l.sold > since AND l.beg <= t GROUP BY ALL),
pn AS (SELECT DISTINCT p.r FROM p JOIN s USING (client_id) WHERE d = 2 AND s.sold > p.t AND s.sold <= p.t + 604800000000)
SELECT sale_id, CAST(d AS INTEGER) AS d, t AS t_us, pn.r IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents,
  last_click_id, coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM p LEFT JOIN pc USING (r, d) LEFT JOIN ps USING (r, d) LEFT JOIN pl USING (r, d) LEFT JOIN pn ON pn.r = p.r"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


@register("op1_html_extract")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op3_decontaminate", CONTAMINATION_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


@register("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.packing import pack

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op6_jaccard_join", COMPONENTS_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


@register("op7_ann")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.ann import search

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"), 10)


@register("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.quality import score_held_out

    return score_held_out(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


@register("op9_lm_score")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.lm_score import score_held_out

    return score_held_out(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.language_id import predict_held_out

    return predict_held_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@register("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


@register("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.periodic_runs import digests, find_runs, looped

    docs = table(spark, sf_dir, "documents")
    return digests(find_runs(docs.select("doc_id", looped(docs["doc_id"], docs["text"]).alias("text"))))


@register("op13_point_in_time", FEATURES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.point_in_time import features, with_probe

    sales = table(spark, sf_dir, "sales")
    return features(table(spark, sf_dir, "clicks"), sales, table(spark, sf_dir, "sale_lines"), with_probe(sales))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
