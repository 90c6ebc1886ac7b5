"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are quantised to int8 with a scale of their own; what quantisation took
off is kept as norms. Query and candidate vectors are cut into blocks, and every
query block meets every candidate block of its dimension in one tile: the tile's
int8 product, scaled back, lies within

    |r_q| |c'| + |q'| |r_c| + |r_q| |r_c|      (q = q' + r_q, c = c' + r_c)

of the true inner products. Pairs whose upper bound does not reach the tile's
k-th best lower bound can't be among the tile's k best; the others are computed
again in double precision from the original vectors, and a heap per query and
tile keeps the k best. The tiles' lists are merged by query the same way. So the
result is exact.

The query set is stated (a divisor of the id), blocks are cut by hash and their
number follows the row counts, so no key is hot and a tile's memory is bounded.
Every query block goes to each candidate block and every candidate block to each
query block; at one block of queries the candidates are shuffled once.

Defined results: vectors that are null, empty, all zero or hold null or
non-finite components take no part; vectors are compared within their own
dimension; candidates of the query's own id are left out; of several rows of a
query id the smallest vector asks; ties go to the smaller id; fewer candidates
than k give all; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import stage

K = 20
#: Vectors of a query block and of a candidate block, about.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 8192
#: int8 products are summed in single precision; it is exact for this many components.
EXACT_SPAN = 1024


def usable(vector: str):
    x = F.col(vector)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return x.isNotNull() & F.coalesce(F.forall(x, fine), F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the coded vector, norm of what is left, of each row."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    coded = codes * scale[:, None]
    norm = lambda v: np.sqrt((v * v).sum(axis=1))
    return codes.astype("i1"), scale, norm(coded), norm(x - coded)


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for lo in range(0, a.shape[1], EXACT_SPAN):
        total += a[:, lo : lo + EXACT_SPAN].astype("f4") @ b[:, lo : lo + EXACT_SPAN].astype("f4").T
    return total


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in the order of the components."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def tile_best(q_ids, q, c_ids, c, coded, k: int) -> list[tuple[int, int, float]]:
    """(query id, vec id, score) of the k best candidates of each query in the tile."""
    q_codes, q_scale, q_norm, q_rest = quantise(q)
    c_codes, c_scale, c_norm, c_rest = coded
    about = int8_product(q_codes, c_codes) * q_scale[:, None] * c_scale[None, :]
    error = (q_rest[:, None] * (c_norm + c_rest)[None, :] + q_norm[:, None] * c_rest[None, :]) * (1 + 1e-9) + 1e-9 * (q_norm[:, None] * c_norm[None, :])
    own = q_ids[:, None] == c_ids[None, :]
    low = np.where(own, -np.inf, about - error)
    keep = min(k, low.shape[1])
    kth = np.partition(low, low.shape[1] - keep, axis=1)[:, low.shape[1] - keep]
    row, col = np.nonzero((about + error >= kth[:, None]) & ~own)
    out: list[tuple[int, int, float]] = []
    # bounded slices: survivors may be many where vectors are alike
    bounds = np.searchsorted(row, np.arange(len(q) + 1))
    for i in range(len(q)):
        cols = col[bounds[i] : bounds[i + 1]]
        scores = np.concatenate([exact_products(np.broadcast_to(q[i], (len(s), q.shape[1])), c[s]) for s in np.array_split(cols, max(1, len(cols) // 4096))]) if len(cols) else []
        best = heapq.nsmallest(k, zip((-np.asarray(scores)).tolist(), c_ids[cols].tolist(), strict=True))
        out += [(int(q_ids[i]), vec, -score) for score, vec in best]
    return out


def _rows(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, "f8") for x in column.to_pylist()])


def _tiles(k: int):
    """Rows (q_block, c_block, is_query, id, vector), sorted so, queries last, to each tile's best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, coded = None, {0: [], 1: []}, {0: [], 1: []}, None

        def best() -> pa.RecordBatch:
            rows = []
            if ids[0] and ids[1]:
                c_ids, c = np.concatenate(ids[0]), np.concatenate(vectors[0])
                q_ids, q = np.concatenate(ids[1]), np.concatenate(vectors[1])
                coded = quantise(c)
                for lo in range(0, len(q), 256):
                    rows += tile_best(q_ids[lo : lo + 256], q[lo : lo + 256], c_ids, c, coded, k)
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)  # dim, q_block, c_block, is_query
            change = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(change, change[1:], strict=False):
                now, query = tuple(keys[lo, :3]), int(keys[lo, 3])
                if now != key:
                    if key is not None:
                        yield best()
                    key, ids, vectors = now, {0: [], 1: []}, {0: [], 1: []}
                ids[query].append(batch.column(4).slice(lo, hi - lo).to_numpy())
                vectors[query].append(_rows(batch.column(5).slice(lo, hi - lo)))
        if key is not None:
            yield best()

    return run


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.asarray(x, "f8").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) // 8 for v in vectors], pa.int32()), pa.array(vectors, pa.binary())], ["id", "dim", "vector"])


def nearest(vectors: DataFrame, *, query_divisor: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query.

    Queries are the rows whose id is divisible by ``query_divisor``; all usable
    rows are candidates.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable("vector"))
    base = stage(rows.mapInArrow(_as_bytes, "id long, dim int, vector binary"), "vectors")
    asked = F.pmod("id", F.lit(query_divisor)) == 0
    queries = base.filter(asked).groupBy("id", "dim").agg(F.min("vector").alias("vector"))
    counts = base.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asked, 1)).alias("q")).first()
    n_c, n_q = max(1, math.ceil(counts["n"] / candidate_block)), max(1, math.ceil(counts["q"] / query_block))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["dim", "q_block", "c_block", "is_query", "id", "vector"]
    left = queries.select("dim", "id", "vector", block(n_q).alias("q_block"), F.lit(1).alias("is_query"), every(n_c).alias("c_block")).select(*cols)
    right = base.select("dim", "id", "vector", block(n_c).alias("c_block"), F.lit(0).alias("is_query"), every(n_q).alias("q_block")).select(*cols)
    tiles = left.union(right).repartition("dim", "q_block", "c_block").sortWithinPartitions(*cols[:5])
    found = tiles.mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
