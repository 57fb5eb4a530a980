"""Nearest vectors by cosine: products of matrix blocks in Arrow batches, a bounded top-k of each, merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS, QUERIES = 8192, 256


def _matrix(block: pa.StructScalar, name: str) -> tuple[pa.Array, np.ndarray]:
    """Ids, and vectors of length one (zero where they are)."""
    rows = block.values
    ids, vectors = rows.field(name), rows.field("vector")
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return ids, np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _codes(m: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For each band the signs of a vector along its planes, as a number."""
    bands, bits, dim = planes.shape
    signs = (m @ planes.reshape(-1, dim).T).reshape(len(m), bands, bits) > 0
    return (signs << np.arange(bits)).sum(axis=2)


def _alike(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Of all pairs those that agree in some band but for one bit at most."""
    out = np.zeros((len(q), len(r)), bool)
    for band in range(q.shape[1]):
        apart = q[:, band, None] ^ r[None, :, band]
        out |= apart & (apart - 1) == 0
    return out


def _best(k: int, digits: int, planes: np.ndarray | None = None):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids, m = _matrix(batch.column("rows")[i], "id")
                asked, q = _matrix(batch.column("queries")[i], "query_id")
                order = ids.to_numpy(zero_copy_only=False).argsort(kind="stable")
                m = m[order]
                score = np.round(q @ m.T, digits)
                if planes is not None:
                    fits = m.shape[1] == planes.shape[2]
                    score = np.where(_alike(_codes(q, planes), _codes(m, planes)), score, -np.inf) if fits else np.full_like(score, -np.inf)
                n = min(k, score.shape[1])
                least = -np.partition(-score, n - 1, axis=1)[:, n - 1 : n]
                row, col = np.nonzero((score >= least) & (score > -np.inf))  # ties with the last stay until they are ranked by id
                value = score[row, col]
                by = np.lexsort((col, -value, row))
                row, col, value = row[by], col[by], value[by]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                keep = place < n
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(row[keep])), ids.take(pa.array(order[col[keep]])), pa.array(value[keep])], ["query_id", "id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, digits: int = 9, but_self: bool = False, planes: np.ndarray | None = None) -> DataFrame:
    """(query_id, id, score, rank): for each of queries(query_id, vector) the k rows(id, vector) of highest
    cosine, rounded to `digits` places, ties to the smaller id; without the row of the query's own id if
    but_self. Zero vectors score 0; null vectors and those of another length take no part. With planes (bands,
    bits, dimensions) only pairs that lie on the same side of all planes of some band, or all but one, are met.

    Both sides are dealt to blocks of fixed size, every block of queries meets every block of rows in an
    equi-join on the block's number, and a product is one call; each pair of blocks gives k rows a query."""
    def blocks(df: DataFrame, key: str, size: int) -> tuple[DataFrame, int]:
        whole = df.where("vector IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)").select(F.col(key), "vector")
        count = max(1, -(-whole.count() // size))
        dealt = whole.withColumn("block", F.pmod(F.xxhash64(key), F.lit(count)).cast("int")).groupBy("block", F.size("vector").alias("dim"))
        return dealt.agg(F.collect_list(F.struct(key, "vector")).alias("items")), count

    r, n = blocks(rows.select("id", "vector"), "id", ROWS)
    q, _ = blocks(queries.select("query_id", "vector"), "query_id", QUERIES)
    q = q.select("dim", F.col("items").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    pairs = r.select("block", "dim", F.col("items").alias("rows")).join(q, ["block", "dim"]).select("rows", "queries")
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    found = pairs.mapInArrow(_best(k + but_self, digits, planes), schema)
    if but_self:
        found = found.where("query_id <> id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long"))
    return found.where(F.col("rank") <= k)
