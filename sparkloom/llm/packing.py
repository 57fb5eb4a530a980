"""Sequence packing as a cutting-stock problem, solved by column generation.

Texts are tokenised once and written. What is left of a text after its full sequences is a piece, and
pieces are counted by length class (16 tokens wide, so at most 256 numbers whatever the input). A linear
program over patterns - how many pieces of which class share a sequence - is grown column by column: a
knapsack dynamic program over the dual prices finds the pattern that helps most, until none does. Whole
multiples of the patterns are filled with the texts of each class in the order of their rank, computed
from salted counts, so no class is ever sorted in one task.

Room that rounding leaves is filled with pieces cut from the texts without a place (and, while these
are too short, from dissolved patterns): both are laid on one axis by prefix sums and overlaid. The rest
of that axis makes full sequences and, at its end, sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.store import arrow_map, cut

LENGTH, UNIT, SALTS = 4096, 16, 256
END_ID = 2

#: Characters for which lowering, composing and classes are the same everywhere, and no special token hides.
_ODD = r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]|<\|"
#: Within those, what the vocabulary's file splits into words.
_WORDS = r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+"


class Encoder:
    """Ids of texts. In this vocabulary words are independent, and white space always ends one: ids are
    looked up by the hash of what stands between white space (equal hashes of different pieces are as
    unlikely as 2**-64 a pair), and for what is new by its words. Texts with unusual characters are
    encoded whole."""

    LIMIT, WORDS, CELLS = 1_000_000, 400_000, 1 << 21  # some 50 MB of pieces, 80 of words

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.odd, self.split = re.compile(_ODD), re.compile(_WORDS)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, bytes] = {}
        # hashes and slots of pieces, the latest of those with equal low bits; the ids of slot i are
        # ids[first[i] : first[i] + size[i]]
        self.known, self.slots, self.n_slots = np.zeros(self.CELLS, dtype=np.uint64), np.zeros(self.CELLS, dtype=np.int32), 1
        self.ids, self.n_ids = np.zeros(1 << 16, dtype=np.uint32), 1
        self.first, self.size = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)  # size -1: unusual
        self.ids[0], self.size[0] = END_ID, 1

    def _learn(self, new: list[str]) -> None:
        """Put pieces into the next slots."""
        odd, split = self.odd.search, self.split.findall
        words = list(map(split, new))
        if odd("\n".join(new)):
            words = [[] if odd(x) else parts for x, parts in zip(new, words, strict=True)]
        fresh = list(set(chain.from_iterable(words)).difference(self.words))
        for at in range(0, len(fresh), 4096):  # as one text: each word ends in an id that marks its end
            part = fresh[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            data, begin = ids.tobytes(), 0
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            for word, end in zip(part, ends, strict=True):
                self.words[word] = data[begin:end]
                begin = end
        get = self.words.__getitem__
        found = [get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts)) for parts in words]
        ids = np.frombuffer(b"".join(found), dtype="<u4")
        at, count = self.n_slots, len(new)
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while at + count > len(self.first):
            self.first, self.size = np.append(self.first, np.zeros_like(self.first)), np.append(self.size, np.zeros_like(self.size))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=count) // 4
        self.first[at : at + count] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[at : at + count] = np.where(sizes, sizes, -1)  # no other piece is without ids
        self.n_ids += len(ids)
        self.n_slots += count

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a column, END_ID last in each, row after row, and the number of each text's."""
        data, offsets = vec.text_bytes(column)
        starts, ends, counts = vec.words(data, offsets, vec.SPACED)
        place, distinct = pd.factorize(vec.word_hashes(data, starts, ends))
        if self.n_slots > self.LIMIT:
            self._clear()
        if len(self.words) > self.WORDS:
            self.words.clear()
        cell = (distinct & np.uint64(self.CELLS - 1)).astype(np.int64)
        slots = np.where(self.known[cell] == distinct, self.slots[cell], 0).astype(np.int64)
        new = np.flatnonzero(slots == 0)
        if len(new):
            where = np.zeros(len(distinct), dtype=np.int64)
            where[place[::-1]] = np.arange(len(place))[::-1]
            raw = data.tobytes()
            slots[new] = np.arange(self.n_slots, self.n_slots + len(new))
            self._learn([raw[x:y].decode("utf-8", "replace").lower() for x, y in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            self.known[cell[new]], self.slots[cell[new]] = distinct[new], slots[new]
        row = np.repeat(np.arange(len(counts)), counts)
        slot = slots[place]
        whole = np.unique(row[self.size[slot] < 0])
        slot = np.insert(slot, np.cumsum(counts), 0)
        row = np.insert(row, np.cumsum(counts), np.arange(len(counts)))
        n = np.maximum(self.size[slot], 0).astype(np.int64)
        ids = self.ids[np.repeat(self.first[slot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        lengths = np.bincount(row, weights=n, minlength=len(counts)).astype(np.int64)
        if len(whole):
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i in whole.tolist():
                parts[i] = np.array([*self.tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, END_ID], dtype=np.uint32)
                lengths[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, lengths


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _token_rows(path: str):
    def run(batches):
        encoder = Encoder(path)  # of this task, so that its memory is free when the worker gives that back
        for batch in batches:
            _, offsets = vec.text_bytes(batch.column(1))
            for lo, hi in vec.chunks(offsets):
                ids, n = encoder.encode(batch.column(1).slice(lo, hi - lo))
                if ids.max() < 1 << 16:  # 2 bytes an id where they hold it
                    ends = np.concatenate(([0], np.cumsum(2 * n))).astype(np.int32)
                    packed = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])
                else:
                    packed = pa.array([b"\0" + x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(n)[:-1])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), packed], ["doc_id", "n", "ids"])

    return run


def _unpack(packed: bytes) -> np.ndarray:
    """uint32 ids: an odd size marks 4-byte ids."""
    return np.frombuffer(packed[1:], dtype="<u4") if len(packed) % 2 else np.frombuffer(packed, dtype="<u2").astype("<u4")


def best_pattern(prices: np.ndarray, units: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of largest price that fits in room."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for u in range(1, room + 1):
        ok = units <= u
        gain = np.where(ok, prices + value[np.maximum(u - units, 0)], -1.0)
        c = int(gain.argmax()) if len(gain) else -1
        if c >= 0 and gain[c] > value[u - 1] + 1e-12:
            value[u], choice[u] = gain[c], c
        else:
            value[u] = value[u - 1]
    pattern, u = np.zeros(len(units), dtype=np.int64), room
    while u > 0:
        if choice[u] >= 0:
            pattern[choice[u]] += 1
            u -= units[choice[u]]
        else:
            u -= 1
    return float(value[room]), pattern


def column_generation(units: np.ndarray, demand: np.ndarray, room: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces of each class) and their whole multiples, rounded down from the linear program
    min sum(x) with every class's demand met."""
    m = len(units)
    if not m:
        return []
    patterns = [np.where(np.arange(m) == c, room // units[c], 0) for c in range(m)]
    basis = np.array(patterns, dtype=np.float64).T
    inverse = np.linalg.inv(basis)
    x = inverse @ demand
    for step in range(rounds):
        prices = inverse.sum(0)
        value, column = best_pattern(np.maximum(prices, 0), units, room)
        if value <= 1 + 1e-9:
            break
        direction = inverse @ column
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, direction, 1), np.inf)
        out = int(ratio.argmin())
        patterns[out] = column
        x = x - ratio[out] * direction
        x[out] = ratio[out]
        pivot = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, pivot)
        inverse[out] = pivot
        if step % 200 == 199:  # rounding errors don't pile up
            inverse = np.linalg.inv(np.array(patterns, dtype=np.float64).T)
            x = np.maximum(inverse @ demand, 0)
    return [(p, int(np.floor(v + 1e-7))) for p, v in zip(patterns, x, strict=True) if v >= 1 - 1e-7]


def allot(units: np.ndarray, demand: np.ndarray, patterns) -> list[tuple[int, int, int, int, int]]:
    """(class place, pattern, first rank, last rank, pieces a sequence): which ranks of a class a
    pattern takes. A class's ranks beyond its demand aren't there: those slots stay room."""
    at, out = np.zeros(len(units), dtype=np.int64), []
    for p, (pattern, times) in enumerate(patterns):
        for c in np.flatnonzero(pattern):
            end = min(int(at[c]) + int(pattern[c]) * times, int(demand[c]))
            if end > at[c]:
                out.append((int(c), p, int(at[c]), end, int(pattern[c])))
                at[c] = end
    return out


def _running(df: DataFrame, amount: str, key: str, name: str) -> DataFrame:
    """df with `name`: the sum of `amount` over all rows before, in an order by salt and key. Every salt
    is a task of its own; the driver's part is SALTS rows."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    each = salted.groupBy("_salt").agg(F.sum(amount).alias("_own"))
    before = F.sum("_own").over(Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_own")
    first = each.select("_salt", before.alias("_base"))
    inside = F.sum(amount).over(Window.partitionBy("_salt").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    joined = salted.withColumn("_inside", inside).join(F.broadcast(first), "_salt")
    return joined.withColumn(name, F.col("_base") + F.col("_inside")).drop("_salt", "_base", "_inside")


def _cut_pieces(batches):
    for batch in batches:
        cols = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
        ids, pieces = batch.column("ids"), batch.column("pieces")
        for i in range(len(batch)):
            tokens = _unpack(ids[i].as_py())
            for p in pieces[i].as_py():
                part = tokens[p["start"] : p["start"] + p["length"]]
                for c, v in zip(cols, (i, p["start"], p["length"], zlib.crc32(part.tobytes()), len(tokens), p["sequence_id"], p["offset"]), strict=True):
                    cols[c].append(v)
        doc = batch.column("doc_id").take(pa.array(cols.pop("doc_id"), pa.int64()))
        yield pa.RecordBatch.from_arrays([doc, *(pa.array(v, pa.int64()) for v in cols.values())], ["doc_id", *cols])


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all rows of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. Every id lies in one piece; pieces of a sequence lie gapless from 0; sequences
    hold `length` ids, or, the last few, a power of two of them.

    `path` is a tokenizers file. Null texts are empty; each text's ids end in END_ID, so none is without.
    Repeated rows and ids, null ids and other columns make no difference; an empty table gives no piece."""
    spark = docs.sparkSession
    text = docs.select("doc_id", "text")
    schema = text.select("doc_id").schema.add("n", "long").add("ids", "binary")
    tokens = cut(text.transform(arrow_map, _token_rows(path or tokenizer_path()), schema).withColumn("row", F.monotonically_increasing_id()))
    rows = tokens.select("row", F.floor(F.col("n") / length).alias("full"), (F.col("n") % length).alias("r"))
    rows = rows.withColumn("class", F.ceil(F.col("r") / UNIT).cast("int"))
    counts = rows.where("r > 0").groupBy("class").count().orderBy("class").collect()
    units, demand = np.array([r["class"] for r in counts], dtype=np.int64), np.array([r["count"] for r in counts], dtype=np.int64)
    patterns = column_generation(units, demand, length // UNIT)
    table = [(int(units[c]), p, lo, hi, a) for c, p, lo, hi, a in allot(units, demand, patterns)]
    # at most one row for each class of each pattern
    allotted = spark.createDataFrame(table, "class int, pattern int, lo long, hi long, each long")

    rest = rows.where("r > 0").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    each = rest.groupBy("class", "salt").agg(F.count("*").alias("own"))  # at most 256 * SALTS rows
    first = each.select("class", "salt", (F.sum("own").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).alias("base"))
    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy("row")) - 1
    ranked = rest.withColumn("rank", rank).join(F.broadcast(first), ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    a = F.broadcast(allotted)
    placed = cut(
        ranked.join(a, (ranked["class"] == a["class"]) & (ranked["rank"] >= a["lo"]) & (ranked["rank"] < a["hi"]), "left").select(
            "row", "r", "full", "pattern",
            F.floor((F.col("rank") - F.col("lo")) / F.col("each")).alias("copy"),
        )
    )
    totals = {r["pattern"]: r for r in placed.groupBy("pattern").agg(F.sum("r").alias("tokens"), F.countDistinct("copy").alias("copies")).collect()}
    loose = totals.pop(None)["tokens"] if None in totals else 0
    room = {p: t["copies"] * length - t["tokens"] for p, t in totals.items()}
    missing, dissolved = sum(room.values()) - loose, []
    for p in sorted(totals, key=lambda p: -room[p] / totals[p]["copies"]):
        if missing <= 0:
            break
        dissolved.append(p)
        missing -= room[p] + totals[p]["tokens"]
        loose += totals[p]["tokens"]
    kept = [p for p in sorted(totals) if p not in dissolved]
    base, sequences = {}, 0
    for p in kept:
        base[p] = sequences
        sequences += patterns[p][1]
    bases = spark.createDataFrame([(p, b) for p, b in base.items()], "pattern int, base long")
    placed = placed.join(F.broadcast(bases), "pattern", "left")

    # pieces in patterns
    order = Window.partitionBy("sequence_id").orderBy(F.desc("r"), "row").rowsBetween(Window.unboundedPreceding, 0)
    in_bins = placed.where("base is not null").withColumn("sequence_id", F.col("base") + F.col("copy"))
    in_bins = in_bins.withColumn("offset", F.sum("r").over(order) - F.col("r"))
    bins = in_bins.groupBy("sequence_id").agg(F.sum("r").alias("filled")).where(F.col("filled") < length)
    bins = bins.select("sequence_id", "filled", (length - F.col("filled")).alias("space"))

    # full sequences of long texts
    long_rows = _running(rows.where("full > 0"), "full", "row", "before")
    whole = long_rows.select("row", "before", F.posexplode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("i", "j"))
    whole = whole.select("row", (F.col("i") * length).alias("start"), F.lit(length).alias("length"), (F.lit(sequences) + F.col("before") + F.col("i")).alias("sequence_id"), F.lit(0).alias("offset"))
    sequences += rows.agg(F.coalesce(F.sum("full"), F.lit(0)).alias("n")).first()["n"]

    # what has no place, on one axis with the room of the bins and then whole new sequences
    tape = _running(placed.where("base is null"), "r", "row", "at")
    spaces = _running(bins, "space", "sequence_id", "at").select("sequence_id", "filled", "space", "at")
    used = sum(room[p] for p in kept)
    beyond = max(0, loose - used)
    new = spark.range(beyond // length).select(
        (F.lit(sequences) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("filled"), F.lit(length).cast("long").alias("space"), (F.lit(used) + F.col("id") * length).alias("at")
    )
    tail, at, number = [], used + beyond // length * length, sequences + beyond // length
    for bit in reversed(range(length.bit_length())):
        if (beyond % length) >> bit & 1:
            tail.append((number, 0, 1 << bit, at))
            number, at = number + 1, at + (1 << bit)
    spaces = spaces.unionAll(new).unionAll(spark.createDataFrame(tail, "sequence_id long, filled long, space long, at long"))

    def blocks(df: DataFrame, size: str) -> DataFrame:
        return df.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / length), F.floor((F.col("at") + F.col(size) - 1) / length))))

    left = blocks(tape.select("row", "r", "full", "at"), "r").alias("t")
    right = blocks(spaces, "space").alias("s")
    begin, end = F.greatest("t.at", "s.at"), F.least(F.col("t.at") + F.col("t.r"), F.col("s.at") + F.col("s.space"))
    filling = (
        left.join(right, "block")
        .where((begin < end) & (F.floor(begin / length) == F.col("block")))
        .select(
            "t.row", (F.col("t.full") * length + begin - F.col("t.at")).alias("start"), (end - begin).alias("length"), "s.sequence_id", (F.col("s.filled") + begin - F.col("s.at")).alias("offset")
        )
    )
    pieces = in_bins.select("row", (F.col("full") * length).alias("start"), F.col("r").alias("length"), "sequence_id", "offset")
    names = ["row", "start", "length", "sequence_id", "offset"]
    every = None
    for part in (pieces, whole, filling):
        part = part.select("row", *(F.col(c).cast("long").alias(c) for c in names[1:]))
        every = part if every is None else every.unionAll(part)
    by_row = every.groupBy("row").agg(F.collect_list(F.struct(*names[1:])).alias("pieces"))
    out = tokens.select("doc_id", "ids", "row").join(by_row, "row").select("doc_id", "ids", "pieces")
    schema = text.select("doc_id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    return out.transform(arrow_map, _cut_pieces, schema)
