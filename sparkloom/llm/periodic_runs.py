"""Stretches of a text in which words repeat with a period: word loops, copied lines, stuck generators.

Words are interned as numbers, text by text. A stretch is cut in the middle; Z-functions from the
midpoint, forwards and backwards, tell for each period how far words that far apart agree on both sides,
which are the repetitions that cross it (Main and Lorentz); then both halves are searched. Repetitions
that go on beyond the stretch were met whole further up, so only those that no neighbour extends are
kept; of several periods of an interval the smallest stays.

Most of a text never gets that far. In a run of period q, each word from the (q+1)st on stands at most q
places after the same word, and there are at least (times - 1) * q of them. Stretches of words that recur
within a (times - 1)th of the stretch's length are therefore all that can hold a run; cutting at the
other words shortens the stretches, so this is repeated until nothing changes, and again in each half.
No run is lost by it.

Rows are independent: no shuffle, memory by one megabyte of text or one longer row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import vec
from sparkloom.llm.store import arrow_map

SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class _Names(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def z_function(s: list[int], count: int) -> list[int]:
    """For each of the first `count` places how many numbers from there on equal those of the start."""
    s, n = [*s, -1], len(s)
    out, left, right = [0] * count, 0, 0
    if count:
        out[0] = n
    for i in range(1, count):
        k = 0
        if i < right:
            k = out[i - left]
            if k < right - i:
                out[i] = k
                continue
            k = right - i
        while s[k] == s[i + k]:  # the last number equals no other
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def recurrence(ids: np.ndarray) -> np.ndarray:
    """How far back the same number stands; len(ids) where it is new."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids), dtype=np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[1:][same]] = order[1:][same] - order[:-1][same]
    return out


def stretches(back: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Parts [lo, hi) that hold every run: maximal stretches whose words all recur within a
    (times - 1)th of the stretch, with the words before them that a first period takes."""
    shortest = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    edges = np.array([0, len(back)])
    first, last = edges[:-1], edges[1:]
    while len(first):
        size = last - first
        keep = size >= shortest
        first, last, size = first[keep], last[keep], size[keep]
        if not len(first):
            break
        ok = np.zeros(len(back) + 2, dtype=np.int8)
        place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        ok[place + 1] = back[place] * (times - 1) <= np.repeat(size, size)
        step = np.diff(ok)
        new_first, new_last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(new_first) == len(first) and (new_first == first).all() and (new_last == last).all():
            break
        first, last = new_first, new_last
    return [(max(0, lo - (hi - lo) // (times - 1)), hi) for lo, hi in zip(first.tolist(), last.tolist(), strict=True)]


def _crossing(ids: list[int], lo: int, mid: int, hi: int, times: int):
    """(start, end, period) of repetitions of at least `times` periods within [lo, hi) that have a word
    on either side of mid, by periods; both ways of measuring, so some come twice."""
    most = (hi - lo) // times
    left, right = ids[lo:mid][::-1], ids[mid:hi]
    q = np.arange(1, most + 1)
    # a period to the right of mid: words from mid on against those a period later, and words before mid
    # against those a period later
    after = np.array(z_function(right, min(most + 1, len(right))), dtype=np.int64)
    n = min(most, len(right))
    ahead = ids[mid : mid + n][::-1] + left
    before = np.array(z_function([*left, -2, *ahead], len(left) + 1 + n)[len(left) + 1 :], dtype=np.int64)[::-1]
    reach = np.zeros(n, dtype=np.int64)
    reach[: len(after) - 1] = after[1 : n + 1]
    one = (mid - before, mid + q[:n] + reach)
    # the same to its left
    after = np.array(z_function(left, min(most + 1, len(left))), dtype=np.int64)
    m = min(most, len(left))
    behind = ids[mid - m : mid] + right
    before = np.array(z_function([*right, -2, *behind], len(right) + 1 + m)[len(right) + 1 :], dtype=np.int64)[::-1]
    reach = np.zeros(m, dtype=np.int64)
    reach[: len(after) - 1] = after[1 : m + 1]
    two = (mid - q[:m] - reach, mid + before)
    for start, end in (one, two):
        period = q[: len(start)]
        good = end - start >= times * period
        yield from zip(start[good].tolist(), end[good].tolist(), period[good].tolist(), strict=True)


def runs_of(ids: np.ndarray, back: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    words, n = None, len(ids)
    todo = stretches(back, least, times)
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least:
            continue
        words = ids.tolist() if words is None else words
        mid = (lo + hi) // 2
        for start, end, q in _crossing(words, lo, mid, hi, times):
            if end - start < least or (start > 0 and words[start - 1] == words[start - 1 + q]) or (end < n and words[end] == words[end - q]):
                continue
            found[start, end] = min(q, found.get((start, end), q))
        for a, b in ((lo, mid), (mid, hi)):
            part = np.minimum(back[a:b], b - a)
            todo += [(a + x, a + y) for x, y in stretches(part, least, times)]
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def _row_runs(least: int, times: int):
    def rows(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            data, offsets = vec.text_bytes(batch.column("text"))
            for lo, hi in vec.chunks(offsets):
                names, texts = _Names(), [data[offsets[i] : offsets[i + 1]].tobytes().split() for i in range(lo, hi)]
                ids = [np.fromiter(map(names.__getitem__, words), dtype=np.int64, count=len(words)) for words in texts]
                sizes = np.array([len(x) for x in texts], dtype=np.int64)
                row = np.repeat(np.arange(hi - lo), sizes)
                back = recurrence(np.concatenate(ids) + row * len(names)) if len(row) else np.zeros(0, np.int64)
                ends = np.cumsum(sizes).tolist()
                runs, collapsed = [], []
                for i, words in enumerate(texts):
                    spans = runs_of(ids[i], back[ends[i] - len(words) : ends[i]], least, times)
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in spans])
                    if spans:
                        change = np.zeros(len(words) + 1, dtype=np.int64)
                        for s, n, q in spans:
                            change[s + q] += 1
                            change[s + n] -= 1
                        words = [words[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(words))
                doc = batch.column("doc_id").slice(lo, hi - lo)
                text = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([doc, pa.array(sizes), pa.array(runs, kind), text], ["doc_id", "n_words", "runs", "collapsed"])

    return rows


def find_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_words, runs and collapsed.

    Words are what ASCII white space separates, numbered from 0. A run is a stretch with smallest period
    q, of at least max(least, times * q) words, that no neighbouring word extends with that period; runs
    come by start, then period. `collapsed` is the text, its words joined by one space, without the words
    that a run holds after its first period. times is 2 or more.

    Null and empty texts have no word and collapse to ''; null and repeated ids, repeated rows and other
    columns make no difference; long texts are taken whole; an empty table gives an empty one."""
    if times < 2 or least < 2:
        raise ValueError("a run takes two periods and two words at least")
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = text.select("doc_id").schema
    for field in T.StructType.fromDDL(SCHEMA).fields:
        schema = schema.add(field)
    return text.transform(arrow_map, _row_runs(least, times), schema)


def looped(doc_id: Column, text: Column) -> Column:
    """A text whose words from some place on repeat with a period, as the contract of the query has it,
    where the crc32 of the id (as text) is divisible by ten; else the text itself."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def loop(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(place, lambda i: F.get(w, i.cast("int"))), " ")

    looping = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, loop(w)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, F.get(looping, 0)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query from those of find_runs."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed", lines.alias("lines")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat("lines", F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
