"""Expressions about evidence: citations, metadata of chunks, places, times and attributes that are safe to keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import bound, evidence_quote

DAY = 86_400


def clean_path(path: Column) -> Column:
    """A heading path without blank names; of null, none."""
    return F.filter(F.transform(F.coalesce(path, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def search_text(path: Column, block_type: Column, caption: Column) -> Column:
    """What of the metadata can be searched: heading path, type of block, caption."""
    return F.trim(F.concat_ws(" ", path, F.coalesce(block_type, F.lit("")), F.coalesce(caption, F.lit(""))))


def merged(*maps: Column) -> Column:
    """Maps as one, a later one's value winning; whatever the session says about repeated keys."""
    def over(first: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(later, k)), later)

    return reduce(over, maps)


def indexed_id(version: Column, chunk: Column) -> Column:
    return F.concat_ws(":", version, chunk)


def sequence(locator: Column, reading_order: Column) -> Column:
    """A chunk's number in its section: what ends its locator, else its reading order."""
    return F.coalesce(F.regexp_extract(locator, r":chunk:(\d{1,9})$", 1).try_cast("int"), reading_order)


def hit_key(chunk_id: Column, source: Column, text: Column) -> Column:
    """What makes a hit the same: its chunk, or source and text."""
    return F.coalesce(chunk_id, F.concat_ws(":", source, F.substring(F.sha2(text, 256), 1, 16)))


def citation(source: Column, name: Column, chunk_id: Column, text: Column, page: Column, locator: Column, block_id: Column, terms: Column, score: Column) -> Column:
    """Struct of a citation: its quote holds the first of the terms that is met; a page makes it a place in a
    paged file, else it is a place in a text."""

    def cited(quote):
        return F.struct(
            F.concat(F.lit("cit_"), F.substring(F.sha2(F.concat_ws(":", source, chunk_id, quote), 256), 1, 24)).alias("citation_id"),
            source.alias("source_id"), name.alias("source_name"), chunk_id.alias("chunk_id"), quote.alias("quote"), score.alias("score"),
            F.struct(
                F.when(page.isNotNull(), "pdf").otherwise("text").alias("kind"), page.cast("int").alias("page_number"),
                F.when(page.isNull(), locator).alias("locator"), F.coalesce(block_id, chunk_id).alias("block_id"),
            ).alias("location"),
        )

    return bound(evidence_quote(text, terms), cited)


# Words that open a list of sources.
_LISTED = ["Sources:", "来源："]


def with_footer(reply: Column, citations: Column) -> Column:
    """A reply with its sources below, a line each, unless there are none or it lists them itself.
    citations: array of structs name, page, locator, chunk_id."""
    def place(c):
        return F.coalesce(F.when(c["page"] != 0, F.concat(F.lit("p."), c["page"].cast("string"))), F.nullif(c["locator"], F.lit("")), F.nullif(c["chunk_id"], F.lit("")), F.lit("source"))

    lines = F.array_join(F.transform(citations, lambda c: F.concat(F.lit("- ["), c["name"], F.lit(" — "), place(c), F.lit("]"))), "\n")
    listed = F.contains(reply, F.lit(_LISTED[0])) | F.contains(reply, F.lit(_LISTED[1]))
    return F.when((F.size(citations) == 0) | listed, reply).otherwise(F.concat(F.regexp_replace(reply, r"\s+$", ""), F.lit("\n\nSources:\n"), lines))


def safe_attributes(attributes: Column) -> Column:
    """Of a map of variants those that are true or false, numbers or strings."""
    return F.map_filter(attributes, lambda k, v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY|VOID)"))


_ISO = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2}):(\d{2})(?:Z|([+-])(\d{2}):(\d{2}))?$"


def iso_seconds(raw: Column) -> Column:
    """Seconds since 1970 of an ISO time; one without a zone is UTC; null for anything else."""
    def part(i):
        return F.regexp_extract(raw, _ISO, i).try_cast("int")

    at = F.try_make_timestamp_ntz(part(1), part(2), part(3), part(4), part(5), part(6).cast("decimal(16,6)"))
    days = F.date_diff(F.to_date(at), F.lit("1970-01-01").cast("date"))
    seconds = days.cast("long") * DAY + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    away = (F.coalesce(part(8), F.lit(0)) * 3600 + F.coalesce(part(9), F.lit(0)) * 60) * F.when(F.regexp_extract(raw, _ISO, 7) == "-", -1).otherwise(1)
    return F.when(raw.rlike(_ISO), seconds - away)


def expired(updated: Column, now_seconds: int, ttl_seconds: int) -> Column:
    """Whether a record of this ISO time has outlived its time; so has one whose time can't be read."""
    return F.coalesce(F.lit(now_seconds) - iso_seconds(updated) >= ttl_seconds, F.lit(True))
