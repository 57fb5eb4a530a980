"""Token-bounded chunking: parents are sections, children keep to a budget, tables repeat their header."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD, _MARK = re.compile(r"[A-Za-z0-9_]+|[^\x00-\x7F]"), re.compile(r"[^\w\s]")


class Tokens:
    """Running sums of words and marks over consecutive pieces of text, from which the token estimate of any
    stretch of them follows: a word each, and a quarter of the marks, one at least."""

    def __init__(self, pieces: list[str]):
        self.words = [0, *accumulate(len(_WORD.findall(p)) for p in pieces)]
        self.marks = [0, *accumulate(len(_MARK.findall(p)) for p in pieces)]

    def between(self, lo: int, hi: int, more: tuple[int, int] = (0, 0)) -> int:
        return max(1, self.words[hi] - self.words[lo] + more[0] + (self.marks[hi] - self.marks[lo] + more[1]) // 4)

    def reach(self, lo: int, least: int, most: int, more: tuple[int, int] = (0, 0)) -> int:
        """The last end, `least` or later, to which the stretch from lo keeps to `most`."""
        ends = range(least, len(self.words))
        return least + max(bisect_right(ends, most, key=lambda hi: self.between(lo, hi, more)) - 1, 0)


def count_tokens(text: str) -> int:
    return Tokens([text]).between(0, 1)


def split_hard(text: str, most: int, overlap: int) -> list[str]:
    """Stretches of at most `most` tokens, cut after white space. Each but the first opens with as much of the
    one before as `overlap` allows, and has at least one piece of its own."""
    spans = [m.span() for m in re.finditer(r"\S+\s*", text)]
    tokens, out, start, end = Tokens([text[a:b] for a, b in spans]), [], 0, 0
    while end < len(spans):
        end = tokens.reach(start, end + 1, most)
        out.append(text[spans[start][0] : spans[end - 1][1]].strip())
        # token sums fall as the start moves on
        start = bisect_left(range(start, end), -overlap, key=lambda lo, end=end: -tokens.between(lo, end)) + start
    return out


def split_table(text: str, most: int) -> list[str]:
    """Runs of rows within the budget, the first row repeated on top of each; blank rows are left out. A table
    of one row below its head stays as it is."""
    rows = [row for row in text.splitlines() if row.strip()]
    if len(rows) <= 2:
        return [text]
    tokens, out, at = Tokens(rows), [], 1
    head = tokens.words[1], tokens.marks[1]
    while at < len(rows):
        end = tokens.reach(at, at + 1, most, head)
        out.append("\n".join([rows[0], *rows[at:end]]))
        at = end
    return out


def parent_child(rows: list[tuple[str, str]], target: int, most: int, overlap: int) -> list[tuple[int, str, str]]:
    """(section, kind, chunk) of a document's (kind, text) blocks in order. Headings open sections and
    stand, as a path, before each child of theirs; tables are split by rows; other blocks join up to the
    target, what is too long is split hard, and a child opens with the tail of the one before."""
    out, section, heading, held = [], 0, "", []

    def flush(carry: bool):
        nonlocal held
        if not held:
            return
        body = "\n\n".join(held)
        out.append((section, "text", body if not heading or body.startswith(heading) else f"{heading}\n{body}"))
        tail = split_hard(held[-1], overlap, 0)[-1] if carry and overlap else ""
        held = [tail] if tail and count_tokens(held[-1]) > overlap else []

    for kind, text in rows:
        if not text.strip():
            continue
        if kind == "heading":
            flush(False)
            held, section, heading = [], section + 1, text.strip()
            continue
        if kind == "table":
            flush(False)
            held = []
            out += [(section, "table", f"{heading}\n{part}" if heading else part) for part in split_table(text, most)]
            continue
        if count_tokens(text) > most:
            flush(False)
            held = []
            out += [(section, "text", f"{heading}\n{part}" if heading else part) for part in split_hard(text, target, overlap)]
            continue
        if held and count_tokens("\n\n".join([*held, text])) > target:
            flush(True)
        held.append(text)
    flush(False)
    return out


def parent_child_chunks(blocks: DataFrame, by: str, order: str, text: str, kind: str, target: int = 500, most: int = 650, overlap: int = 60) -> DataFrame:
    """(by, idx, section, kind, chunk) of blocks; a document's blocks are one row, which bounds the work."""
    fields = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            for lo in range(0, len(batch), 256):
                of, out = [], []
                for i in range(lo, min(lo + 256, len(batch))):
                    got = parent_child([(r["kind"], r["text"] or "") for r in rows[i].as_py()], target, most, overlap)
                    of += [i] * len(got)
                    out += [(at, *g) for at, g in enumerate(got)]
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of, pa.int64())), *(pa.array(x, t) for x, t in zip(cols, fields, strict=True))], [by, "idx", "section", "kind", "chunk"])

    one = F.struct(F.col(order).alias("at"), F.col(kind).alias("kind"), F.col(text).alias("text"))
    held = blocks.groupBy(by).agg(F.sort_array(F.collect_list(one)).alias("rows"))
    return held.select(by, F.transform("rows", lambda r: F.struct(r["kind"].alias("kind"), r["text"].alias("text"))).alias("rows")).mapInArrow(run, f"{by} {dict(blocks.dtypes)[by]}, idx long, section long, kind string, chunk string")
