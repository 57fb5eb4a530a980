"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every `span - k + 1` consecutive k-gram hashes of a text the smallest is its fingerprint, so any two
texts that share `span` consecutive words share a fingerprint at the same place of that stretch. The
fingerprints of texts and benchmark windows are joined, and a hit is extended to the whole window word
by word. A constant bitmap of fixed size keeps fingerprints that no benchmark has from being joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.native_text import bitmap_literal, in_bitmap, log2_size, runs, words
from sparkloom.llm.store import cut, unique_ids

SPAN, K = 13, 9
PLACE = 27  # low bits of a fingerprint hold its place


def _placed(hashes: Column) -> Column:
    """Hashes with their places in the low bits."""
    return F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~((1 << PLACE) - 1))).bitwiseOR(i.cast("bigint")))


def _winnowed(placed: Column, width: int) -> Column:
    """The smallest of every `width` consecutive values (leftmost of equals), each once."""
    n = F.size(placed)
    return F.when(
        n >= width,
        F.array_distinct(F.transform(F.sequence(F.lit(0), n - width), lambda i: F.array_min(F.slice(placed, i + 1, F.lit(width))))),
    ).otherwise(F.array().cast("array<bigint>"))


def _hash_of(value: Column) -> Column:
    return F.shiftright(value, PLACE)


def _place_of(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")


def benchmark_windows(items: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """(len, fp, off, win, items): the distinct windows of all items, each with the sorted ids of those that
    hold it; fp is the window's fingerprint and off its place in it; of windows shorter than span, fp is
    the hash of the whole."""
    w = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(span)))
    wins = w.select(
        "item_id", "len", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - F.col("len")), lambda i: F.slice("w", i + 1, F.col("len")))).alias("win")
    )
    wins = wins.groupBy("len", "win").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    wins = wins.withColumn("h", F.transform("win", lambda x: F.xxhash64(x)))
    wins = wins.withColumn("best", F.array_min(_placed(runs(F.col("h"), k))))
    full = F.col("len") == span
    return wins.select(
        "len", "win", "items",
        F.when(full, _hash_of(F.col("best"))).otherwise(_hash_of(F.xxhash64("h"))).alias("fp"),
        F.when(full, _place_of(F.col("best"))).otherwise(F.lit(0)).alias("off"),
    )


def _candidates(prints: Column, bits: Column, log2: int, length: int, left: int, right: int) -> Column:
    """Fingerprints that the bitmap lets pass, each with the words around it that a window may reach."""

    def hit(v: Column) -> Column:
        begin = F.greatest(_place_of(v) - left, F.lit(0))
        return F.struct(
            F.lit(length).alias("len"), _hash_of(v).alias("fp"), _place_of(v).alias("at"), begin.alias("begin"),
            F.slice("w", begin + 1, _place_of(v) + right - begin).alias("around"),
        )

    return F.transform(F.filter(prints, lambda v: in_bitmap(bits, _hash_of(v), log2)), hit)


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, parts: int = 20) -> DataFrame:
    """One row for each row of docs(doc_id, text), against items(item_id, text): doc_id, n_words, n_hit
    (words inside an occurrence of an item's window of `span` consecutive words), n_items, items_sha256
    (of the sorted item ids, comma-joined) and contaminated (n_hit > 0 and parts * n_hit >= n_words).

    An item of fewer words than span is one window; one without words, or without id, is none. A null
    or empty text has no words. Repeated rows give a row each; other columns are ignored. Items equal
    in text share their windows. A text's words are an array, which the JVM holds to 2**31 - 1 elements
    and a row to 2 GB: texts come nowhere near the 2**27 words that places have room for."""
    wins = benchmark_windows(items, span, k)
    sets = cut(wins.select("items").distinct().withColumn("set", F.monotonically_increasing_id()))
    wins = cut(wins.join(sets, "items").drop("items"))
    lengths = {r["len"]: r["n"] for r in wins.groupBy("len").agg(F.count("*").alias("n")).collect()}
    rows = docs.select("doc_id", words(F.col("text")).alias("w"))
    rows = rows.withColumns({"n": F.size("w"), "h": F.transform("w", lambda x: F.xxhash64(x))})
    # each array is a column of its own projection, so that it is computed once a row
    rows = rows.withColumns({f"p{length}": _placed(runs(F.col("h"), k if length == span else length)) for length in lengths})
    if span in lengths:
        rows = rows.withColumn(f"p{span}", _winnowed(F.col(f"p{span}"), span - k + 1))
    found = []
    for length in sorted(lengths):
        log2 = log2_size(lengths[length])
        bits = bitmap_literal(wins.where(F.col("len") == length), "fp", log2)
        left, right = (span - k, span) if length == span else (0, length)
        prints = F.col(f"p{length}")
        found.append(_candidates(prints, bits, log2, length, left, right))
    empty = F.array().cast("array<struct<len:int,fp:bigint,at:int,begin:int,around:array<string>>>")
    table = cut(
        rows.select(
            "doc_id", F.col("n").cast("long").alias("n_words"), (F.concat(*found) if found else empty).alias("hits"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    hits = table.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    start = F.col("at") - F.col("off")
    match = hits.join(wins, ["len", "fp"]).withColumn("start", start)
    match = match.where((F.col("start") >= F.col("begin")) & (F.slice("around", F.greatest(F.col("start") - F.col("begin"), F.lit(0)) + 1, F.col("len")) == F.col("win")))
    places = match.select("row", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    past = F.coalesce(F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_hit = places.select("row", F.greatest(F.lit(0), F.col("end") - F.greatest("start", past)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    # windows of one passage have the same items: rows hold sets of items, and items are listed once for
    # all rows that hold the same sets
    combos = match.select("row", "set").distinct().groupBy("row").agg(F.sort_array(F.collect_set("set")).alias("sets"))
    ids = combos.select("sets").distinct().select("sets", F.explode("sets").alias("set")).join(sets, "set")
    ids = ids.select("sets", F.explode("items").alias("item")).groupBy("sets").agg(F.sort_array(F.collect_set("item")).alias("ids"))
    ids = ids.select("sets", F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    out = table.select("row", "doc_id", "n_words").join(n_hit.join(combos, "row").join(ids, "sets"), "row", "left")
    hit_words = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        hit_words.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((hit_words > 0) & (parts * hit_words >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of docs that are not contaminated; columns are those of docs, whatever they are called. Null and
    empty texts stay, repeated rows go or stay together, long texts are read whole; without documents or
    items nothing goes."""
    rows, _, row = unique_ids(docs)
    dirty = contamination(rows.select(F.col(row).alias("doc_id"), "text"), items).where("contaminated")
    return rows.join(dirty.select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)
