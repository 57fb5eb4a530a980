"""Layout payloads as JSON: blocks and assets with places, running lines, and the quality gate over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import label_kind, page_number_like
from sparkloom.operators.blocks import HIDDEN

BBOX = "struct<left: double, top: double, right: double, bottom: double>"
# Kinds of assets, those that show something, and the gate's limits.
ASSETS, VISUAL = ["table", "image", "formula"], ["image", "table", "chart", "formula"]
ACCEPTED, MIN_PAGE_CHARS, MIN_TABLE_CHARS = 0.58, 160, 160


def _text(v: Column, *paths: str) -> Column:
    """The first of the paths that holds a non-empty string."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths])


def bbox(v: Column) -> Column:
    """A box given as a list of four, or by the names l t r b or left top right bottom; null if it is none."""
    def number(path):
        return F.try_variant_get(v, path, "double")

    schemes = [[f"$.{key}[{i}]" for i in range(4)] for key in ("block_bbox", "bbox")]
    schemes += [[f"$.bbox.{n}" for n in names] for names in (("l", "t", "r", "b"), ("left", "top", "right", "bottom"))]
    whole = []
    for paths in schemes:
        box = [number(p) for p in paths]
        fits = box[0].isNotNull() & box[1].isNotNull() & box[2].isNotNull() & box[3].isNotNull()
        whole.append(F.when(fits, F.struct(*[x.alias(n) for x, n in zip(box, ("left", "top", "right", "bottom"), strict=True)])))
    return F.coalesce(*whole).cast(BBOX)


def payload_blocks(pages: DataFrame) -> DataFrame:
    """(doc, page, reading_order, locator, kind, label, text, bbox) of pages(doc, page, payload).

    A payload lists its blocks under parsing_res_list, or layout_parsing_result (itself, or its blocks). Blocks
    without text are left out but keep their number; a page without any gives the paragraphs of its markdown
    or text. What is no JSON or no object gives none. Reading order runs on over the pages of a document."""
    v = pages.select("doc", "page", F.try_parse_json("payload").alias("v"))
    listed = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$.parsing_res_list", "$.layout_parsing_result", "$.layout_parsing_result.blocks")])
    raw = v.select("doc", "page", F.posexplode(listed).alias("at", "b"))
    told = raw.select(
        "doc", "page", (F.col("at") + 1).cast("long").alias("offset"), F.trim(_text(F.col("b"), "$.block_content", "$.text")).alias("text"),
        F.lower(F.coalesce(_text(F.col("b"), "$.block_label", "$.type"), F.lit("paragraph"))).alias("label"), bbox(F.col("b")).alias("bbox"),
    ).where("text <> ''")
    told = told.withColumn("kind", label_kind(F.col("label")))
    bare = v.join(told.select("doc", "page").distinct(), ["doc", "page"], "left_anti").select("doc", "page", _text(F.col("v"), "$.markdown", "$.text").alias("text"))
    parts = bare.select("doc", "page", F.posexplode(F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("at", "text"))
    plain = parts.select("doc", "page", (F.col("at") + 1).cast("long").alias("offset"), "text", F.lit(None).cast("string").alias("label"), F.lit(None).cast(BBOX).alias("bbox"), F.lit("paragraph").alias("kind"))
    every = told.unionByName(plain)
    sizes = every.groupBy("doc", "page").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = every.join(sizes.select("doc", "page", before.alias("before")), ["doc", "page"])
    locator = F.concat(F.lit("page:"), F.col("page").cast("string"), F.lit(":ocr-block:"), F.col("offset").cast("string"))
    return out.select("doc", "page", (F.col("before") + F.col("offset")).cast("long").alias("reading_order"), locator.alias("locator"), "kind", "label", "text", "bbox")


def assets(blocks: DataFrame) -> DataFrame:
    """(doc, asset_id, asset_type, locator, page, text) of the blocks that are tables, images or formulas."""
    return blocks.where(F.col("kind").isin(ASSETS) & F.col("label").isNotNull()).select("doc", F.substring(F.sha2("locator", 256), 1, 24).alias("asset_id"), F.col("kind").alias("asset_type"), "locator", "page", "text")


def linked(given: DataFrame, blocks: DataFrame) -> DataFrame:
    """given(doc, asset_id, locator, ...) with the page and box of the block at that place, if there is one."""
    where = blocks.select("doc", "locator", F.col("page").alias("block_page"), F.col("bbox").alias("block_bbox"))
    return given.join(where, ["doc", "locator"], "left").withColumn("place", F.when(F.col("block_page").isNull(), "unknown").otherwise("block"))


def running_lines(blocks: DataFrame, least_pages: int = 3, share: float = 0.6, longest: int = 160, header: float = 0.2) -> DataFrame:
    """blocks with the kind of those whose short text stands on most pages: page_number by its form,
    running_header where its box begins in the top fifth, else running_footer."""
    key = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    rows = blocks.withColumn("_key", key)
    pages = rows.where("page IS NOT NULL").groupBy("doc").agg(F.countDistinct("page").alias("_all")).where(F.col("_all") >= least_pages)
    short = rows.where(F.col("page").isNotNull() & (F.length("text") <= longest)).groupBy("doc", "_key").agg(F.countDistinct("page").alias("_n"))
    hit = short.join(pages, "doc").where(F.col("_n") / F.col("_all") >= share).select("doc", "_key", F.lit(True).alias("_hit"))
    kind = F.when(page_number_like(F.col("_key")), "page_number").when(F.col("bbox.top") <= header, "running_header").otherwise("running_footer")
    out = rows.join(hit, ["doc", "_key"], "left").withColumn("kind", F.when(F.col("_hit"), kind).otherwise(F.col("kind")))
    return out.select(*blocks.columns)


def quality(blocks: DataFrame, given: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each of documents(doc, is_pdf, page_count, empty_pages, scanned): measures, issues, score and
    the gate's decision, from its blocks(doc, kind, text) and assets given(doc, asset_type, text)."""
    shown = blocks.where(~F.col("kind").isin(HIDDEN) & (F.trim("text") != "")).withColumn("t", F.trim("text"))
    norm = F.trim(F.regexp_replace(F.lower("t"), r"\s+", " "))
    b = shown.groupBy("doc").agg(
        F.count("*").alias("blocks"), F.sum(F.length("t")).alias("chars"), F.sum(F.length("t") - F.length(F.replace("t", F.lit("�"), F.lit("")))).alias("garbled"),
        (F.count("*") - F.countDistinct(norm)).alias("repeats"), F.sum(F.when(F.col("kind") == "table", F.length("t")).otherwise(0)).alias("table_block"),
    )
    a = given.groupBy("doc").agg(
        F.count("*").alias("assets"), F.count(F.when(F.col("asset_type").isin(VISUAL), 1)).alias("visual_assets"), F.count(F.when(F.col("asset_type") == "table", 1)).alias("tables"),
        F.sum(F.when(F.col("asset_type") == "table", F.length(F.trim(F.coalesce("text", F.lit(""))))).otherwise(0)).alias("table_asset"),
    )
    d = documents.select("doc", "is_pdf", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("empty_pages", F.lit(0)).alias("empty_pages"), "scanned")
    g = d.join(b, "doc", "left").join(a, "doc", "left").fillna(0, ["blocks", "chars", "garbled", "repeats", "table_block", "assets", "visual_assets", "tables", "table_asset"])
    pages = F.greatest("page_count", F.lit(1))
    g = g.withColumns({
        "garbled": F.col("garbled") / F.greatest("chars", F.lit(1)), "duplicate": F.col("repeats") / F.greatest("blocks", F.lit(1)), "empty": F.col("empty_pages") / pages,
        "table_chars": F.greatest("table_block", "table_asset"), "chars_per_page": F.col("chars") / pages,
    })
    g = g.withColumns({
        "sparse_visual": F.col("is_pdf") & (F.col("visual_assets") > 0) & (F.col("chars_per_page") < MIN_PAGE_CHARS),
        "sparse_table": F.col("is_pdf") & ((F.col("table_block") > 0) | (F.col("tables") > 0)) & (F.col("table_chars") < MIN_TABLE_CHARS),
    })
    ocr = F.col("scanned") | ((F.col("page_count") > 0) & (F.col("empty") >= 0.5)) | F.col("sparse_visual") | F.col("sparse_table")
    # Issue codes in their order.
    codes = [
        ("NO_INDEXABLE_TEXT", F.col("blocks") == 0), ("HIGH_GARBLED_CHARACTER_RATIO", F.col("garbled") > 0.02), ("HIGH_DUPLICATE_BLOCK_RATIO", F.col("duplicate") > 0.35),
        ("LOW_TEXT_COVERAGE_WITH_VISUAL_ASSETS", F.col("sparse_visual")), ("SPARSE_TABLE_EXTRACTION", F.col("sparse_table")), ("OCR_REQUIRED", F.col("needs_ocr")),
    ]
    score = 1.0 - F.when(F.col("blocks") == 0, 0.7).otherwise(0.0) - F.least(F.col("garbled") * 5, F.lit(0.3)) - F.least(F.col("duplicate") * 0.5, F.lit(0.25)) - F.least(F.col("empty") * 0.5, F.lit(0.45))
    score = score - F.when(F.col("sparse_visual"), 0.45).otherwise(0.0) - F.when(F.col("sparse_table"), 0.25).otherwise(0.0)
    g = g.withColumns({"needs_ocr": ocr, "score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)})
    fine = (F.col("score") >= ACCEPTED) & ~F.col("needs_ocr")
    return g.select(
        "doc", "blocks", "chars", F.round("chars_per_page", 6).alias("chars_per_page"), F.round("garbled", 6).alias("garbled"), F.round("duplicate", 6).alias("duplicate"), F.round("empty", 6).alias("empty"),
        "assets", "visual_assets", "table_chars", F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in codes]), lambda x: x.isNotNull()), ",").alias("issues"),
        "score", "needs_ocr", fine.alias("accepted"), (~fine & ~F.col("needs_ocr")).alias("needs_review"),
    )


def first_accepted(attempts: DataFrame) -> DataFrame:
    """(doc, attempt, backend, needs_review) of attempts(doc, attempt, backend, score, accepted, needs_ocr): the
    first that the gate accepts; where none is, the one of highest score, ties to the earlier, for review."""
    best = F.min_by(F.struct("attempt", "backend", "accepted"), F.struct(~F.col("accepted"), F.when(F.col("accepted"), 0.0).otherwise(-F.col("score")), "attempt"))
    return attempts.groupBy("doc").agg(best.alias("b")).select("doc", "b.attempt", "b.backend", (~F.col("b.accepted")).alias("needs_review"))
