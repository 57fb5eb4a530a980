"""Text expressions: Column to Column, inside the JVM.

Regular expressions name Unicode classes explicitly, as Java's own \\w is ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers and patterns that query planning recognises.
NEGATIONS = ["must not", "do not", "does not", "not", "without", "exclude", "禁止", "不得", "不要", "不能", "不含", "未"]
RELATIONAL_MARKERS = [
    "compare", "comparison", "relationship", "related", "depend", "impact", "cause", "across", "between", "multi-hop", "why",
    "对比", "比较", "关系", "关联", "依赖", "影响", "导致", "原因", "跨章节", "多跳",
]
AMBIGUITY_MARKERS = ["it", "they", "this approach", "that system", "前者", "后者", "该方案", "这个", "上述"]
STOP_ENTITIES = ["the", "this", "that", "with", "from", "into", "using", "document", "section"]
QUOTED = r'["“]([^"”]{1,160})["”]'
ACRONYM = r"\b[A-Z][A-Z0-9_-]{1,20}\b"
VERSION = r"\b[vV]?\d+(?:\.\d+){1,4}\b"
IDENTIFIER = r"\b[\w]+(?:-[\w]+)+\b"
NUMBER_UNIT = r"(?i)\b\d+(?:\.\d+)?\s*(?:ms|s|min|h|kb|mb|gb|tb|%|hz|khz|mhz|ghz|v|a|w|°c)(?=\W|$)"

#: Letters and what they become when diacritics go.
ACCENTED, PLAIN = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def bound(value: Column, use) -> Column:
    """use(value), the value being computed once a row however often `use` names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def collapse_whitespace(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def whitespace_terms(s: Column) -> Column:
    """Lower-cased white-space terms, underscores read as spaces; none for a blank text."""
    flat = F.trim(F.regexp_replace(F.replace(F.lower(s), F.lit("_"), F.lit(" ")), r"\s+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def query_terms(s: Column, most: int = 32) -> Column:
    return F.slice(F.array_distinct(whitespace_terms(s)), 1, most)


def fold(s: Column) -> Column:
    return F.translate(F.lower(s), ACCENTED, PLAIN)


def index_tokens(s: Column) -> Column:
    """Tokens of the lexical index: runs of letters and digits, without case or diacritics."""
    return F.regexp_extract_all(fold(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def index_words(s: Column) -> Column:
    """index_tokens before their diacritics go: letters stay letters, so the runs are the same."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_tokens(s: Column) -> Column:
    """Unicode words and single ideographs, lower case."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def memory_tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.lower(s), F.lit(r"[A-Za-z0-9_]+|[\x{4e00}-\x{9fff}]"), F.lit(0))


def long_terms(s: Column) -> Column:
    return F.filter(word_tokens(s), lambda x: F.length(x) > 1)


def tokens_by_words(s: Column) -> Column:
    """Estimate of tokens: ASCII words, other characters, and a quarter of the punctuation; 1 at least."""
    wide = F.regexp_count(s, F.lit(r"[A-Za-z0-9_]+|[^\x00-\x7F]"))
    marks = F.regexp_count(s, F.lit(r"[\x21-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E]"))
    return F.greatest(F.lit(1), wide + F.floor(marks / 4)).cast("long")


def tokens_by_width(s: Column) -> Column:
    """Estimate of tokens: each wide character one, others four to one; 0 for an empty text."""
    wide = F.regexp_count(s, F.lit(r"[^\x{0}-\x{2E7F}]"))
    return (wide + F.ceil((F.length(s) - wide) / 4)).cast("long")


def char_windows(s: Column, size: int, overlap: int) -> Column:
    step = size - overlap
    return F.when(
        F.length(s) > 0, F.transform(F.sequence(F.lit(0), F.length(s) - 1, F.lit(step)), lambda i: F.substring(s, i + 1, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def tail_overlap(s: Column, n: int) -> Column:
    """The last n characters, from the first space among them on."""
    tail = F.right(s, F.lit(n))
    at = F.instr(tail, " ")
    return F.when(F.length(s) <= n, s).when(at > 0, F.substring(tail, at + 1, F.lit(n))).otherwise(tail)


def relation_type(s: Column) -> Column:
    """Upper case, other signs as single underscores, at most 100; RELATED_TO if nothing is left."""
    name = F.substring(F.btrim(F.regexp_replace(F.upper(s), r"[^A-Za-z0-9]+", "_"), F.lit("_")), 1, 100)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("RELATED_TO"))


def lexical_query(s: Column) -> Column:
    """Distinct lower-cased words in order; - . / join parts of one."""
    words = F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+(?:[-./][\p{L}\p{N}]+)*"), F.lit(0))
    return F.array_join(F.array_distinct(words), " ")


def protected_anchors(s: Column) -> Column:
    """What a rewrite must keep: quotes, acronyms, versions, identifiers, quantities, negations."""
    found = [F.regexp_extract_all(s, F.lit("(?U)" + p if p is not QUOTED else p), F.lit(1 if p is QUOTED else 0)) for p in (QUOTED, ACRONYM, VERSION, IDENTIFIER, NUMBER_UNIT)]
    low = F.lower(s)
    negations = F.filter(F.array(*[F.lit(x) for x in NEGATIONS]), lambda x: F.contains(low, x))
    trimmed = F.filter(F.transform(F.concat(*found), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.concat(trimmed, negations))


def comparison_key(s: Column) -> Column:
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", "")


def keeps_anchors(candidate: Column, anchors: Column) -> Column:
    return F.forall(anchors, lambda a: F.contains(comparison_key(candidate), comparison_key(a)))


def has_marker(s: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in markers]), lambda m: F.contains(F.lower(s), m))


def prefix_key(s: Column, tokens: int = 24) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.lower(s), r"\s+", " ")), " "), 1, tokens), " ")


def content_id(*parts: Column, size: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, size)


def evidence_quote(text: Column, terms: Column, most: int = 300) -> Column:
    """At most `most` characters, from a third of that before the first term found."""
    places = bound(F.lower(text), lambda low: F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0)))
    start = F.greatest(F.lit(0), F.coalesce(places, F.lit(1)) - 1 - most // 3)
    last = F.greatest(F.lit(0), F.length(text) - most)
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, F.least(start, last) + 1, F.lit(most)))


def label_kind(label: Column) -> Column:
    def has(*tokens):
        out = F.lit(False)
        for t in tokens:
            out = out | F.contains(label, F.lit(t))
        return out

    return (
        F.when(has("title", "heading", "section_header"), "heading").when(has("table"), "table").when(has("picture", "figure"), "image")
        .when(has("caption"), "caption").when(has("formula"), "formula").when(has("list"), "list_item").otherwise("paragraph")
    )


def page_number_like(key: Column) -> Column:
    return key.rlike(r"^(?:page\s*)?\d+(?:\s*(?:/|of)\s*\d+)?$")
