"""Approximate nearest neighbours on randomly rotated one-bit codes.

A vector less its cluster's centre, normed, is padded and turned by a random orthogonal map; only the
signs are kept, packed to bits, with the residual's norm and the inner product of the vector with its
own code. From these an estimate of the inner product with any (turned) query follows, whose error is
of the order sqrt((1 - f*f) / (f*f * (bits - 1))), f being that inner product. A vector is reranked on
its original components only if its distance, less `SIGMAS` such errors, could enter the ten best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 256  # length of a code; the vectors are padded to it
SIGMAS = 3.0
CENTRES, SAMPLE = 32, 4096  # centres, and the most rows that they are fitted on
BLOCK = 1024  # queries that are broadcast at a time


def rotation(dim: int, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """`dim` orthonormal rows in `bits` dimensions: a random rotation of padded vectors."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((max(bits, dim), dim)))
    return np.ascontiguousarray(q.T)


def fit_centres(x: np.ndarray, centres: int = CENTRES, rounds: int = 8, seed: int = 5) -> np.ndarray:
    if not len(x):
        return np.zeros((1, x.shape[1] if x.ndim == 2 else 1))
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[: min(centres, len(x))]].astype(np.float64)
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * x @ c.T).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


class Coder:
    def __init__(self, centres: np.ndarray, turn: np.ndarray):
        self.centres, self.turn, self.bits = centres, turn, turn.shape[1]

    def encode(self, x: np.ndarray):
        """cluster, packed code, residual norm, inner product of residual direction and code."""
        cluster = ((self.centres**2).sum(1)[None] - 2 * x @ self.centres.T).argmin(1)
        residual = x - self.centres[cluster]
        norm = np.sqrt((residual**2).sum(1))
        turned = (residual / np.maximum(norm, 1e-30)[:, None]) @ self.turn
        code = turned >= 0
        fit = np.abs(turned).sum(1) / np.sqrt(self.bits)
        return cluster.astype(np.int32), np.packbits(code, axis=1), norm, np.where(norm > 0, fit, 1.0)

    def bounds(self, queries: np.ndarray, cluster, codes, norm, fit, sigmas: float):
        """Estimated squared distances [queries x rows], and the lower bounds of them."""
        estimate = np.empty((len(queries), len(cluster)))
        slack = np.empty_like(estimate)
        for j in np.unique(cluster):
            rows = np.flatnonzero(cluster == j)
            away = queries - self.centres[j]
            far = np.sqrt((away**2).sum(1))
            turned = (away / np.maximum(far, 1e-30)[:, None]) @ self.turn
            signs = np.unpackbits(codes[rows], axis=1, count=self.bits).astype(np.float32) * 2 - 1
            dot = (turned.astype(np.float32) @ signs.T) / np.sqrt(self.bits) / fit[rows][None]
            error = np.sqrt(np.maximum(1 - fit[rows] ** 2, 0) / (fit[rows] ** 2 * (self.bits - 1)))
            scale = 2 * far[:, None] * norm[rows][None]
            estimate[:, rows] = far[:, None] ** 2 + norm[rows][None] ** 2 - scale * dot
            slack[:, rows] = scale * sigmas * error[None]
        return estimate, estimate - slack


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there, is not zero, and has neither null nor non-finite components."""
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(v.isNotNull() & F.coalesce(sound, F.lit(False)) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def index(vectors: DataFrame, coder: Coder, dim: int) -> DataFrame:
    """The index: every usable row with its code and scalars beside the original vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(coder)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            cluster, codes, norm, fit = shared.value.encode(_matrix(batch.column(1), dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cluster), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(fit)],
                ["vec_id", "embedding", "cluster", "code", "norm", "fit"],
            )

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(
        run, "vec_id long, embedding array<double>, cluster int, code binary, norm double, fit double"
    )


def _scan(queries, coder: Coder, dim: int, k: int, sigmas: float):
    """Of one task's rows, the k nearest to each query: codes first, originals where a bound allows."""

    def run(batches):
        ids, q = queries.value
        best_d = np.full((len(ids), k), np.inf)
        best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                vec_id, x = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                codes = np.frombuffer(b"".join(part.column(3).to_pylist()), dtype=np.uint8).reshape(len(part), -1)
                estimate, lower = coder.value.bounds(q, *(part.column(2).to_numpy(), codes, part.column(4).to_numpy(), part.column(5).to_numpy()), sigmas)
                for i in range(len(ids)):
                    # nearest by estimate first, so that the bar is low when the rest is looked at
                    rows = np.flatnonzero(lower[i] <= best_d[i, -1] ** 2 * (1 + 1e-12))
                    rows = rows[np.argsort(estimate[i, rows])]
                    done = 0
                    while done < len(rows):
                        take = rows[done : done + 64]
                        done += 64
                        take = take[(lower[i, take] <= best_d[i, -1] ** 2 * (1 + 1e-12)) & (vec_id[take] != ids[i])]
                        if not len(take):
                            continue
                        exact = np.sqrt(((x[take] - q[i]) ** 2).sum(1))
                        d, v = np.concatenate((best_d[i], exact)), np.concatenate((best_i[i], vec_id[take]))
                        order = np.lexsort((v, d))[:k]
                        best_d[i], best_i[i] = d[order], v[order]
        rows, cols = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(best_i[rows, cols]), pa.array(best_d[rows, cols])], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, sigmas: float = SIGMAS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest rows, itself (by id) left out.

    vectors and queries: (vec_id bigint, embedding array). Rows whose vector is null, zero, or holds
    null or non-finite components take no part; nor do vectors of another length than the most usual
    one. Ties go to the smaller vec_id; repeated ids are rows of their own. Centres are fitted on at
    most SAMPLE rows; every row is coded. Queries are taken `block` at a time (a stated number of
    vectors, so they may be broadcast) against all rows; each task returns k rows a query at most."""
    spark = vectors.sparkSession
    vectors, queries = _usable(vectors), _usable(queries)
    sizes = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes["d"]
    vectors, queries = (x.where(F.size("embedding") == dim) for x in (vectors, queries))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    coder = Coder(fit_centres(np.array(sample["embedding"].tolist(), dtype=np.float64)), rotation(dim))
    shared = spark.sparkContext.broadcast(coder)
    coded = index(vectors, coder, dim)
    found, after = None, None
    ordered = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["vec_id"])
    while True:
        rest = ordered if after is None else ordered.where(F.col("vec_id") > after)
        rows = rest.orderBy("vec_id").limit(block).toPandas()
        if not len(rows):
            break
        after = int(rows["vec_id"].iloc[-1])
        ids, q = rows["vec_id"].to_numpy(np.int64), np.array(rows["embedding"].tolist(), dtype=np.float64)
        part = coded.mapInArrow(_scan(spark.sparkContext.broadcast((ids, q)), shared, dim, k, sigmas), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionAll(part)
        if len(rows) < block:
            break
    if found is None:
        return spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
