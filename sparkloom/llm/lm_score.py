"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels, level q standing for counts of BASE**(q-1) to
BASE**q. An n-gram of level q is put into a Bloom filter q times, once with each level from 1 to q, and
its count is read back by probing level after level until one is missing. Texts are scored from
probes alone:

    p(w | v) = a(v) c(v w) / c(v) + (1 - a(v)) (c(w) + 0.5) / (N + 0.5 (V + 1))

where a(v) = min(0.7, 0.3 + 0.1 log10 c(v)), and 0 for words v never seen. A pair found more often than
its words is a false positive and counts as unseen.

All n-grams of the training text enter the filter, which grows with them and is made and written in
shards of some million n-grams. While all shards together take MAX_MB at most they are broadcast to the
workers; beyond that, what the texts ask is shuffled to the shards and back. Either way the same probes are
made in the same bits, so scores don't depend on the way.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import vec
from sparkloom.llm.language_id import fold
from sparkloom.llm.store import arrow_map, cut, drop, mix

BASE, BITS_PER_KEY = 1.5, 8
MAX_MB = 96  # of the filter where it is broadcast
FREQUENT = 100_000  # words whose exact counts are broadcast for the base score; the rest are joined
SHARD = 16_000_000  # bytes of training text to a shard of the filter
BEGIN, END = np.uint64(2), np.uint64(1)


def _tokens(data, offsets):
    """Token hashes of each row, the end of text included, the token before each, and row sizes."""
    starts, ends, counts = vec.words(data, offsets, vec.SPACED)
    hashes = vec.word_hashes(data, starts, ends)
    token = np.insert(hashes, np.cumsum(counts), END)
    sizes = counts + 1
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(sizes) - sizes] = BEGIN
    return token, before, sizes


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(3) + token + np.uint64(1 << 40))


def _chunks(batch: pa.RecordBatch, column: int):
    data, offsets = vec.text_bytes(batch.column(column))
    for lo, hi in vec.chunks(offsets):
        yield lo, hi, *_tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def _placed(grams: np.ndarray, kind: int, shards: int):
    """N-grams in the order of their shards, the shards (those of words first, then those of pairs) and
    where each begins and ends."""
    shard = (grams % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    begins = np.flatnonzero(np.diff(shard[order], prepend=-1))
    return order, shard[order[begins]] + np.int32(kind * shards), list(zip(begins.tolist(), [*begins[1:].tolist(), len(shard)], strict=False))


def _counts(shards: int):
    """(shard, grams, n): packed n-grams of a shard and their counts in some megabytes of text."""

    def run(batches):
        held: list[list[np.ndarray]] = [[], []]

        def flush(limit):
            for kind, parts in enumerate(held):
                if sum(map(len, parts)) > limit:
                    grams, n = np.unique(np.concatenate(parts), return_counts=True)
                    parts.clear()
                    order, names, ends = _placed(grams, kind, shards)
                    packed = [pa.array([x[lo:hi].tobytes() for lo, hi in ends], pa.binary()) for x in (grams[order], n[order].astype(np.uint32))]
                    yield pa.RecordBatch.from_arrays([pa.array(names), *packed], ["shard", "grams", "n"])

        for batch in batches:
            for _, _, token, before, _ in _chunks(batch, 0):
                held[0].append(token)
                held[1].append(_pair(before, token))
                yield from flush(1_500_000)
        yield from flush(0)

    return run


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


#: Count that a level stands for.
_VALUES = np.array([0, 1, 2, 3, *(BASE ** (q - 0.5) for q in range(4, 200))])


def _keys(grams: np.ndarray) -> np.ndarray:
    """What the filter holds of n-grams within a shard. 32 bits add less than a thousandth of false
    positives to a shard of some million."""
    return (grams >> np.uint64(32)).astype(np.uint32)


def _places(keys: np.ndarray, q: int, width) -> tuple[np.ndarray, np.ndarray]:
    """For level q of each key the word, of so many 64-bit words of its shard, and its four bits there."""
    h = mix(keys.astype(np.uint64) + np.uint64(q * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    one, low = np.uint64(1), np.uint64(63)
    bits = one << (h & low)
    for by in (6, 12, 18):
        bits |= one << ((h >> np.uint64(by)) & low)
    return (((h >> np.uint64(32)) * width) >> np.uint64(32)).astype(np.int64), bits


def _filled(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Filter words of a shard that holds these n-grams so often."""
    q, keys = level(n), _keys(grams)
    bits = np.zeros(max(1, -(-int(q.sum()) * BITS_PER_KEY // 64)), dtype=np.uint64)
    for j in range(1, int(q.max(initial=0)) + 1):
        np.bitwise_or.at(bits, *_places(keys[q >= j], j, np.uint64(len(bits))))
    return bits


def _probed(keys: np.ndarray, bits: np.ndarray, first, width) -> np.ndarray:
    """Levels found by probing, 0 for keys that are not there; first and width are those of each key's shard."""
    q = np.zeros(len(keys), dtype=np.uint8)
    alive = np.flatnonzero(width > 0)
    keys, first, width = keys[alive], first[alive], width[alive]
    level = 1
    while len(alive):
        at, mask = _places(keys, level, width)
        there = (bits[first + at] & mask) == mask
        alive, keys, first, width = alive[there], keys[there], first[there], width[there]
        q[alive] = level
        level += 1
    return q


def _build(shards: int):
    def run(key, table):
        """One shard from its rows (shard, grams, n): its bits, and the counts of words."""
        grams, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=t) for c, t in (("grams", np.uint64), ("n", np.uint32)))
        order = np.argsort(grams)
        grams, n = grams[order], n[order]
        at = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        grams, n = grams[at], np.add.reduceat(n.astype(np.int64), at)
        words = key[0].as_py() < shards
        listed = [pa.array([x.tolist() if words else []], pa.list_(pa.int64())) for x in (grams.view(np.int64), n)]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([_filled(grams, n).tobytes()], pa.binary()), "grams": listed[0], "n": listed[1]})

    return run


class Filter:
    """Shards of words and pairs, some of which may be missing, laid one after the other in one array."""

    def __init__(self, parts: dict[int, bytes], shards: int):
        self.shards = shards
        laid = [parts.get(i, b"") for i in range(2 * shards)]
        sizes = np.array([len(x) // 8 for x in laid], dtype=np.int64)
        self.first, self.width = np.cumsum(sizes) - sizes, sizes.astype(np.uint64)
        self.bits = np.frombuffer(b"".join(laid), dtype=np.uint64)

    def levels(self, grams: np.ndarray, kind: int) -> np.ndarray:
        """Levels of words (kind 0) or pairs (1)."""
        shard = (grams % np.uint64(self.shards)).astype(np.int64) + kind * self.shards
        return _probed(_keys(grams), self.bits, self.first[shard], self.width[shard])


def log_probabilities(at, words, token, before, sizes, levels, tokens: int, distinct: int) -> np.ndarray:
    """log10 of each token's probability; levels(grams, kind) tells counts' levels, words are the distinct
    tokens and at says which of them each is."""
    q_words = levels(words, 0)
    q_word = q_words[at]
    first, last = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
    q_before = np.empty_like(q_word)
    q_before[1:] = q_word[:-1]
    q_before[first] = q_word[last]  # a text begins where another has ended
    pairs = _pair(before, token)
    q_pair = levels(pairs, 1)
    q_pair[q_pair > np.minimum(q_word, q_before)] = 0
    c = np.maximum(_VALUES[q_before], 1)
    a = np.where(q_before > 0, np.minimum(0.7, 0.3 + 0.1 * np.log10(c)), 0.0)
    p = (_VALUES[q_word] + 0.5) / (tokens + 0.5 * (distinct + 1))
    return np.log10(a * np.minimum(1.0, _VALUES[q_pair] / c) + (1 - a) * p)


class Model(NamedTuple):
    """What training leaves: a written table of shards (shard, bits), the exact counts (gram,
    n) of words, the tokens and distinct tokens of the training text, and the filter where it is broadcast."""

    shards: int
    table: DataFrame
    words: DataFrame
    tokens: int
    distinct: int
    held: Filter | None


def train(docs: DataFrame, max_mb: float = MAX_MB) -> Model:
    """The model of docs(text). Null texts count as empty."""
    text = docs.select("text")
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(16, size // SHARD)
    rows = text.transform(arrow_map, _counts(shards), "shard int, grams binary, n binary")
    built = cut(rows.groupBy("shard").applyInArrow(_build(shards), "shard int, bits binary, grams array<long>, n array<long>"))
    drop()
    table = built.select("shard", "bits")
    words = built.select(F.explode(F.arrays_zip("grams", "n")).alias("w")).select("w.grams", "w.n").toDF("gram", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    held = None
    if (table.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) <= max_mb * 1e6:
        rows = table.toArrow()
        held = Filter(dict(zip(rows.column("shard").to_pylist(), rows.column("bits").to_pylist(), strict=True)), shards)
    return Model(shards, table, words, total["tokens"], total["distinct"], held)


def _numbered(batches):
    """Rows with the number of their chunk, of about a megabyte of text, in a first column."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 33
    for batch in batches:
        _, offsets = vec.text_bytes(batch.column(2))
        ends = [hi for _, hi in vec.chunks(offsets)]
        numbers = np.repeat(chunk + np.arange(len(ends)), np.diff([0, *ends]))
        chunk += len(ends)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], ["chunk", *batch.schema.names])


def _asked(shards: int):
    """(chunk, shard, keys): packed keys that scoring the texts of rows (chunk, text) asks of a shard, in
    the order of their n-grams."""

    def run(batches):
        for number, (token, before, _) in _whole_chunks(batches):
            for kind, grams in enumerate(_distinct(token, before)):
                order, names, ends = _placed(grams, kind, shards)
                keys = _keys(grams[order])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), number)), pa.array(names), pa.array([keys[lo:hi].tobytes() for lo, hi in ends], pa.binary())], ["chunk", "shard", "keys"])

    return run


def _distinct(token, before) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(token), np.unique(_pair(before, token))


def _whole_chunks(batches):
    """(number, (tokens, tokens before, sizes)) of every chunk of rows (chunk, text) that follow each other."""
    held, last = [], None
    for batch in batches:
        numbers = batch.column(0).to_numpy()
        begins = [*np.flatnonzero(np.diff(numbers, prepend=numbers[:1] - 1)).tolist(), len(numbers)] if len(numbers) else [0]
        for lo, hi in zip(begins, begins[1:], strict=False):
            if held and numbers[lo] != last:
                yield last, _joined(held)
                held = []
            last = numbers[lo]
            held.append(batch.column(1).slice(lo, hi - lo))
    if held:
        yield last, _joined(held)


def _joined(columns):
    return _tokens(*vec.text_bytes(pa.chunked_array(columns)))


def _answered(asked, shard):
    """(chunk, shard, q): the levels, a byte each, of what is asked of one shard."""
    chunk, keys = asked.column("chunk"), [np.frombuffer(x, dtype=np.uint32) for x in asked.column("keys").to_pylist()]
    name, out = pa.array([], pa.int32()), [np.zeros(len(x), np.uint8) for x in keys]
    if len(asked):
        name = asked.column("shard")
        if len(shard):
            bits = np.frombuffer(shard.column("bits")[0].as_py(), dtype=np.uint64)
            for i, x in enumerate(keys):
                out[i] = _probed(x, bits, np.zeros(len(x), np.int64), np.full(len(x), len(bits), np.uint64))
    return pa.table({"chunk": chunk, "shard": name, "q": pa.array([x.tobytes() for x in out], pa.binary())})


def _lookup(answers: pa.Table, distinct: tuple[np.ndarray, np.ndarray], shards: int):
    """levels() from answers (shard, q) to what _asked() asked for these words and pairs."""
    given, held = dict(zip(answers.column("shard").to_pylist(), answers.column("q").to_pylist(), strict=True)), []
    for kind, grams in enumerate(distinct):
        order, names, _ = _placed(grams, kind, shards)
        q = np.zeros(len(grams), dtype=np.uint8)
        q[order] = np.frombuffer(b"".join(given[x] for x in names.tolist()), dtype=np.uint8)
        held.append(q)

    def levels(grams, kind):
        return held[kind][np.searchsorted(distinct[kind], grams)]

    return levels


_SCORED = ["doc_id", "held_out", "n_tokens", "n_hit", "base", "score", "rest"]


def _scores(batch: pa.RecordBatch, levels, known, logs, tokens: int, distinct: int):
    """Scored rows of a batch (doc_id, held_out, text): those words' share of the base score that are among
    the known, and the other words' hashes."""
    for lo, hi, token, before, sizes in _chunks(batch, 2):
        n = hi - lo
        rows = np.repeat(np.arange(n), sizes)
        at, words = pd.factorize(token)
        score = np.bincount(rows, weights=log_probabilities(at, words, token, before, sizes, levels, tokens, distinct), minlength=n)
        place = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
        known_word = known[place] == words if len(known) else np.zeros(len(words), bool)
        hit, place = known_word[at], place[at]
        base = np.bincount(rows[hit], weights=logs[place[hit]], minlength=n) if len(known) else np.zeros(n)
        n_hit = np.bincount(rows[hit], minlength=n)
        ends = np.concatenate(([0], np.cumsum(sizes - n_hit))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(sizes.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
                pa.array(base.astype(np.float64)), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), pa.array(token[~hit].view(np.int64))),
            ],
            _SCORED,
        )


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs(doc_id, held_out, text)."""
    spark = docs.sparkSession
    frequent = model.words.orderBy(F.desc("n"), "gram").limit(FREQUENT).toArrow()
    known, times = frequent.column("gram").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
    order = np.argsort(known)
    known = known[order]
    shards, tokens, distinct = model.shards, model.tokens, model.distinct
    whole = tokens + 0.5 * (distinct + 1)
    logs = np.log10((times[order] + 0.5) / whole)
    shared = spark.sparkContext.broadcast((model.held, known, logs))

    def run(batches):
        held, known, logs = shared.value
        for batch in batches:
            yield from _scores(batch, held.levels, known, logs, tokens, distinct)

    def run_chunk(texts, answers):
        _, known, logs = shared.value
        (batch,) = texts.select(["doc_id", "held_out", "text"]).combine_chunks().to_batches()
        token, before, _ = _joined([batch.column(2)])
        levels = _lookup(answers, _distinct(token, before), shards)
        return pa.Table.from_batches(list(_scores(batch, levels, known, logs, tokens, distinct)))

    docs = docs.select("doc_id", "held_out", "text")
    schema = docs.select("doc_id", "held_out").schema
    for name, kind in (("n_tokens", "long"), ("n_hit", "long"), ("base", "double"), ("score", "double"), ("rest", T.ArrayType(T.LongType()))):
        schema = schema.add(name, kind)
    if model.held is not None:
        scored = docs.transform(arrow_map, run, schema)
    else:
        texts = cut(docs.transform(arrow_map, _numbered, T.StructType([T.StructField("chunk", T.LongType()), *docs.schema])))
        asked = texts.select("chunk", "text").transform(arrow_map, _asked(shards), "chunk long, shard int, keys binary")
        answers = cut(asked.groupBy("shard").cogroup(model.table.groupBy("shard")).applyInArrow(_answered, "chunk long, shard int, q binary"))
        drop()
        scored = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run_chunk, schema)
    table = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = table.select("row", F.explode("rest").alias("gram")).groupBy("row", "gram").agg(F.count("*").alias("times"))
    rare = rare.join(model.words, "gram", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(whole))).alias("more"),
    )
    return table.drop("rest").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_hit") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def score_held_out(docs: DataFrame, max_mb: float = MAX_MB) -> DataFrame:
    """Learn from four folds of five of docs(doc_id, text), score all rows. Words are
    `[^\\x20\\x09-\\x0D]+` with A-Z lowered; every text ends in an end token. Null texts are empty ones:
    just the end. Rows with a null id are scored, never learned from, and not held out. Repeated rows
    count each; texts may be of any length, and equal texts get equal scores; an empty table gives an
    empty result. Columns beyond the two are ignored."""
    part = fold("doc_id", 5)
    model = train(docs.where(part != 1), max_mb)
    return score_texts(docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "text"), model)
