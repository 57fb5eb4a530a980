"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a logistic model that minimises the non-negative
unbiased risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)),  pi being the estimated share of positives in
the unlabelled text. The score of a text is the model's probability that it is a positive.

Inputs of the model are drawn from the whole text alone: frequencies of runs of three character
classes, lengths, and how much of the text repeats itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import vec
from sparkloom.llm.language_id import fold

#: Bounds of the sample that the model is fitted on, in rows; the driver receives no more.
POSITIVES, UNLABELLED = 5000, 10000
CLASSES = 11
STATS = 10
WIDTH = CLASSES**3 + STATS

_CLASS = np.full(256, 8, dtype=np.int64)  # other signs
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[32] = 0, 1, 2, 3
_CLASS[[9, 10, 11, 12, 13]] = 4
_CLASS[[ord("."), ord("!"), ord("?")]] = 5
_CLASS[[ord(","), ord(";"), ord(":"), ord("'"), ord("-")]] = 6
_CLASS[[ord("|"), ord("<"), ord(">"), ord("{"), ord("}"), ord("="), ord("/"), ord("\\")]] = 7
_CLASS[0xC0:] = 9  # first byte of a character beyond ASCII
_CLASS[0x80:0xC0] = 10

_LINES = np.ones(256, dtype=bool)
_LINES[[10, 13]] = False


def _repeats(data, offsets, table):
    """For each row: number of pieces, distinct pieces, share of the most frequent piece."""
    starts, ends, counts = vec.words(data, offsets, table)
    hashes = vec.word_hashes(data, starts, ends)
    n = len(counts)
    rows = np.repeat(np.arange(n), counts)
    order = np.lexsort((hashes, rows))
    hashes, sorted_rows = hashes[order], rows[order]
    head = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (sorted_rows[1:] != sorted_rows[:-1]))) if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    runs = np.diff(np.concatenate((at, [len(hashes)])))
    distinct = np.bincount(sorted_rows[at], minlength=n) if len(at) else np.zeros(n, np.int64)
    most = np.zeros(n)
    if len(at):
        np.maximum.at(most, sorted_rows[at], runs)
    return counts, distinct, most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    kinds = _CLASS[data]
    rows = np.repeat(np.arange(n), sizes)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    if len(kinds) > 2:
        ok = rows[2:] == rows[:-2]
        code = (kinds[:-2] * CLASSES + kinds[1:-1]) * CLASSES + kinds[2:]
        grams = np.bincount(rows[:-2][ok] * CLASSES**3 + code[ok], minlength=n * CLASSES**3).reshape(n, -1)
        out[:, : CLASSES**3] = np.sqrt(grams / np.maximum(sizes - 2, 1)[:, None])
    w, w_distinct, w_most = _repeats(data, offsets, vec.SPACED)
    lines, l_distinct, l_most = _repeats(data, offsets, _LINES)
    some = np.maximum(w, 1)
    out[:, CLASSES**3 :] = np.stack(
        [
            np.log1p(sizes), np.log1p(w), sizes / some / 8, w_distinct / some, w_most / some,
            np.log1p(lines), l_distinct / np.maximum(lines, 1), l_most / np.maximum(lines, 1),
            np.log1p(w / np.maximum(lines, 1)), w == 0,
        ],
        axis=1,
    )
    return out


def _feature_rows(batches):
    for batch in batches:
        data, offsets = vec.text_bytes(batch.column(1))
        for lo, hi in vec.chunks(offsets):
            x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            kept = [batch.column(i).slice(lo, hi - lo) for i in (0, 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([r.tobytes() for r in x], pa.binary())], ["positive", "place", "x"])


class Model:
    def __init__(self, mean, scale, weights, bias, prior):
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 30, penalty: float = 1e-3, seed: int = 7) -> Model:
    """Non-negative risk by Adam over shuffled mini-batches. When a batch's estimate of the negatives'
    risk falls below 0, the step goes against it instead, so that the model can't overfit by
    driving it lower."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), float(np.log(prior / (1 - prior))), prior)
    n = len(positive) + len(unlabelled)
    mean = sum(x.sum(0, dtype=np.float64) for x in (positive, unlabelled)) / n
    square = sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (positive, unlabelled)) / n
    scale = (np.sqrt(np.maximum(square - mean**2, 0)) + 0.01).astype(np.float32)
    mean = mean.astype(np.float32)
    p, u = positive - mean, unlabelled - mean
    p /= scale
    u /= scale
    rng = np.random.default_rng(seed)
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v, step = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    batches = max(1, len(u) // 512)
    for _ in range(epochs):
        pi, ui = rng.permutation(len(p)), rng.permutation(len(u))
        for i in range(batches):
            xp, xu = p[pi[i::batches]] if len(p) >= batches else p, u[ui[i::batches]]
            short = w.astype(np.float32)
            zp, zu = (xp @ short + b).astype(np.float64), (xu @ short + b).astype(np.float64)
            negatives = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            # gradients of the logistic loss with regard to z, for each part of the risk
            gp_plus, gp_minus, gu_minus = -sigmoid(-zp) / len(zp), sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
            if negatives >= 0:
                gp, gu = prior * (gp_plus - gp_minus), gu_minus
            else:
                gp, gu = prior * gp_minus, -gu_minus
            g = np.concatenate((gp.astype(np.float32) @ xp + gu.astype(np.float32) @ xu + penalty * w, [gp.sum() + gu.sum()]))
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            d = 0.005 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - d[:-1], b - d[-1]
    return Model(mean, scale, w, b, prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, trust: float = 0.1) -> float:
    """Share of positives in the unlabelled from scores of both that the model was not fitted on. Above any
    threshold the unlabelled hold at least that share of what the positives hold there. The least such bound
    is sought, where bound and sampling error together are least; as it errs upwards, and a risk with too large
    a prior takes negatives for positives, its lower confidence limit is returned."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(positive)
    above = 1 - np.searchsorted(positive, cuts) / len(positive)
    share = 1 - np.searchsorted(unlabelled, cuts) / len(unlabelled)
    off_p, off_u = (np.sqrt(np.log(4 / trust) / 2 / len(x)) for x in (positive, unlabelled))
    best = np.argmin((share + off_p + off_u) / above)
    return float(np.clip((share[best] - off_u) / (above[best] + off_p), 0.02, 0.98))


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most `positives` trusted rows (quality 1) and of at most `unlabelled` rows of all docs,
    drawn by the hash of their id, ids once each: of texts with the same id the first in order counts. Of
    labels with the same id the greatest does."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    chosen = marks.where("quality = 1").join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id")
    web = ids.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled)
    rows = [
        docs.join(F.broadcast(x), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).select(F.lit(mark).alias("positive"), "text", F.xxhash64("doc_id").alias("place"))
        for mark, x in ((True, chosen), (False, web))
    ]
    got = rows[0].unionAll(rows[1]).mapInArrow(_feature_rows, "positive boolean, place long, x binary").toArrow()
    x = np.frombuffer(b"".join(v for chunk in got.column("x").chunks for v in chunk.to_pylist()), dtype=np.float32).reshape(-1, WIDTH)
    order = np.argsort(got.column("place").to_numpy(), kind="stable")
    mark = got.column("positive").to_numpy()[order].astype(bool)
    return x[order[mark]], x[order[~mark]]


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs(doc_id, text) and labels(doc_id, quality), of which only the rows with quality 1 are used: they are
    the trusted positives, all docs the unlabelled text, each up to its bound (see sample()). The class prior
    is estimated from scores of one half of both by a model fitted on the other half."""
    p, u = sample(docs, labels, positives, unlabelled)
    half = fit(p[::2], u[::2], 0.5, epochs=10)
    prior = class_prior(half.score(p[1::2]), half.score(u[1::2]))
    return fit(p, u, prior)


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without text_col, with score (0 to 1). Null and empty texts are scored as empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    kept = [c for c in docs.columns if c not in (text_col, "score")]
    schema = docs.select(*kept).schema.add("score", "double")

    def run(batches):
        for batch in batches:
            data, offsets = vec.text_bytes(batch.column(at))
            scores = [np.zeros(0)]
            for lo, hi in vec.chunks(offsets):
                scores.append(shared.value.score(features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate(scores))], [*kept, "score"])

    return docs.mapInArrow(run, schema)


def score_held_out(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Learn from four folds of five, score all rows: (doc_id, held_out, score, predicted). Rows with
    a null id are scored, never learned from, and not held out. Texts of any length count whole, null ones as
    empty; a score equal to the threshold predicts 1; other columns are not read; rows that repeat are scored
    alike. Without positives or texts to learn from, every score is the prior."""
    part = fold("doc_id", 5)
    model = train(docs.where(part != 0).select("doc_id", "text"), labels.where(part != 0).select("doc_id", "quality"))
    rows = docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text")
    return score_texts(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
