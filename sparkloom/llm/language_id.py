"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent letter n-grams (n = 1..3, words bounded by a mark) of a language's
training texts, most frequent first. A text is given the language whose profile its own most frequent
n-grams are least out of place in: each n-gram costs the difference of its two ranks, or the profile
size if the profile lacks it. N-grams that are equally frequent within a text keep the order that they
have in all training texts together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.store import arrow_map, mix

RANKS = 400  # n-grams of a profile and of a text
PIECE = 1 << 18  # bytes of text taken at once: their n-grams take some 200 times that
MARK = 1
_MAPS: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point -> 2 + lowered code point for letters, else MARK."""
    if not _MAPS:
        table = np.full(0x110000, MARK, dtype=np.int64)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = 2 + (ord(low) if len(low) == 1 else c)
        _MAPS["letters"] = table
    return _MAPS["letters"]


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single marks of each row (each row starts and ends with a mark), and row offsets."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    codes = _letters()[points]
    n = len(offsets) - 1
    codes = np.insert(codes, np.concatenate((heads[:-1], heads[1:])), MARK) if n else codes
    heads = heads + 2 * np.arange(n + 1)
    first = np.zeros(len(codes), dtype=bool)
    first[heads[:-1]] = True
    before = np.empty_like(codes)
    before[1:], before[:1] = codes[:-1], 0
    keep = (codes != MARK) | first | (before != MARK)
    return codes[keep], np.concatenate(([0], np.cumsum(keep)))[heads]


def _ngrams(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of every n-gram; marks stand only at ends, and no n-gram is a mark alone."""
    n = len(codes)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    letter = codes != MARK
    out_rows, out = [rows[letter]], [codes[letter]]
    if n > 1:
        ok = (rows[1:] == rows[:-1]) & (letter[1:] | letter[:-1])
        out_rows.append(rows[:-1][ok])
        out.append(((codes[:-1] << 21) | codes[1:])[ok])
    if n > 2:
        ok = (rows[2:] == rows[:-2]) & letter[1:-1]
        out_rows.append(rows[:-2][ok])
        out.append(((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[ok])
    return np.concatenate(out_rows), np.concatenate(out)


def _short(codes: np.ndarray) -> np.ndarray:
    """40-bit names of n-grams."""
    return (mix(codes.astype(np.uint64)) >> np.uint64(24)).astype(np.int64)


def _counted(part_rows: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.sort((part_rows << 40) | names)
    if not len(keys):
        return keys, keys, keys
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.concatenate((at, [len(keys)])))
    keys = keys[at]
    return keys >> 40, keys & ((1 << 40) - 1), counts


def _training_rows(batches):
    """(lang, gram, n): counts of a task, summed up before they leave it."""
    langs: dict[str, int] = {}
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list = []

    def merge():
        nonlocal keys, counts
        all_keys = np.concatenate([keys, *(k for k, _ in held)])
        all_counts = np.concatenate([counts, *(c for _, c in held)])
        order = np.argsort(all_keys, kind="stable")
        all_keys, all_counts = all_keys[order], all_counts[order]
        at = np.flatnonzero(np.concatenate(([True], all_keys[1:] != all_keys[:-1]))) if len(all_keys) else np.zeros(0, np.int64)
        keys, counts = all_keys[at], (np.add.reduceat(all_counts, at) if len(at) else all_counts)
        held.clear()

    def flush():
        names = np.array(list(langs) or [""], dtype=object)
        for at in range(0, len(keys), 1 << 16):
            part = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[part >> 40], pa.string()), pa.array(part & ((1 << 40) - 1)), pa.array(counts[at : at + (1 << 16)])],
                ["lang", "gram", "n"],
            )

    for batch in batches:
        numbers = np.array([langs.setdefault(x, len(langs)) for x in batch.column(1).to_pylist()], dtype=np.int64)
        data, offsets = vec.text_bytes(batch.column(0))
        for lo, hi in vec.chunks(offsets, PIECE):
            codes, ends = _symbols(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            rows, grams = _ngrams(codes, ends)
            row, name, n = _counted(numbers[lo:hi][rows], _short(grams))
            held.append(((row << 40) | name, n))
            if len(held) >= 32:
                merge()
                if len(keys) > 1_000_000:
                    yield from flush()
                    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    merge()
    yield from flush()


class Profiles:
    """Ranks of n-grams in each language's profile, and in all languages together."""

    def __init__(self, langs: list[str], grams: np.ndarray, ranks: np.ndarray, order: np.ndarray, size: int):
        self.langs, self.grams, self.ranks, self.order, self.size = langs, grams, ranks, order, size

    def distances(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean place difference (over the profile size, so 0 to 1) of each row to each language, and
        whether the row has a letter."""
        n = len(offsets) - 1
        codes, ends = _symbols(data, offsets)
        rows, grams = _ngrams(codes, ends)
        row, name, count = _counted(rows, _short(grams))
        place = np.minimum(np.searchsorted(self.grams, name), max(len(self.grams) - 1, 0))
        known = self.grams[place] == name if len(self.grams) else np.zeros(len(name), bool)
        tie = np.where(known, self.order[place], len(self.order)) if len(self.grams) else np.zeros(len(name), np.int64)
        rank_order = np.lexsort((name, tie, -count, row))
        row, place, known = row[rank_order], place[rank_order], known[rank_order]
        sizes = np.bincount(row, minlength=n)
        rank = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        top = rank < self.size
        row, place, known, rank = row[top], place[top], known[top], rank[top]
        cost = np.full((len(row), len(self.langs)), self.size, dtype=np.float64)
        if len(self.grams):
            there = self.ranks[place[known]]
            cost[known] = np.where(there >= 0, np.abs(there - rank[known, None]), self.size)
        total = np.zeros((n, len(self.langs)))
        for j in range(len(self.langs)):
            total[:, j] = np.bincount(row, weights=cost[:, j], minlength=n)
        held = np.bincount(row, minlength=n)
        return total / np.maximum(held[:, None] * self.size, 1), held > 0


def train(docs: DataFrame, size: int = RANKS) -> Profiles:
    """Profiles of every non-null lang of docs(text, lang), over all rows. The driver receives `size`
    n-grams a language and nothing that grows with the rows."""
    counts = (
        docs.where("text is not null and lang is not null")
        .select("text", "lang")
        .transform(arrow_map, _training_rows, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1)
    rows = ranked.where(F.col("rank") < size).toPandas().sort_values(["lang", "rank"])
    langs = sorted(rows["lang"].unique())
    grams = np.unique(rows["gram"].to_numpy(dtype=np.int64))
    ranks = np.full((len(grams), len(langs)), -1, dtype=np.int64)
    at = np.searchsorted(grams, rows["gram"].to_numpy(dtype=np.int64))
    ranks[at, np.searchsorted(langs, rows["lang"])] = rows["rank"]
    # order in all languages together, each language weighing the same
    weight = np.where(ranks >= 0, ranks, size).sum(1) if len(langs) else np.zeros(0)
    order = np.empty(len(grams), dtype=np.int64)
    order[np.lexsort((grams, weight))] = np.arange(len(grams))
    return Profiles(langs, grams, ranks, order, size)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score: the nearest profile's language (ties: the first by name) and 1
    less its relative distance. Texts that are null or have no letter, and all texts if no language
    was learned, get `und` and 0. Columns of these two names are replaced; all others stay."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_col)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        model = shared.value
        names = np.array([*model.langs, "und"], dtype=object)
        for batch in batches:
            data, offsets = vec.text_bytes(batch.column(at))
            best, score = np.full(len(batch), len(model.langs)), np.zeros(len(batch))
            for lo, hi in vec.chunks(offsets, PIECE) if model.langs else ():
                distance, has = model.distances(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                best[lo:hi] = np.where(has, distance.argmin(1), len(model.langs))
                score[lo:hi] = np.where(has, 1 - distance.min(1), 0.0)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], [*kept, "lang_pred", "score"])

    return docs.transform(arrow_map, run, schema)


def fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def predict_held_out(docs: DataFrame) -> DataFrame:
    """Learn from the two folds of three, predict every row: (doc_id, held_out, lang_pred, score).
    Rows with a null id are predicted, never learned from, and not held out. Texts of any length count
    whole; ties of distance go to the first language by name; other columns are not read; rows that repeat
    are learned from, and predicted, as often as they stand there."""
    part = fold("doc_id", 3)
    profiles = train(docs.where(part != 1))
    rows = docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "text")
    return identify(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of docs(text, lang, ...) that are given a language by profiles learned from all rows of docs; only
    texts without a letter (null and empty ones too) go, also where no row names its lang. Columns are those
    of docs; repeated rows are judged one by one, an empty table stays empty."""
    profiles = train(docs)
    if not profiles.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return identify(rows, profiles).where("lang_pred <> 'und'").select("row.*")
