"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector; scores are integers. The kth best value of each query is located by
refining global histograms: a round counts the scores of each query in bins of the interval that is left, the bin that
holds the kth value becomes the next interval, until it is one value wide. Then each partition emits its own rows at or
above that value, at most k of them with the smallest ids first, and a rank over those few rows breaks ties.

A partition reports only the bins at or above its own kth best score: the global kth value can't be lower, so the
counts that decide are complete and a partition sends at most k bins a query and round. Scoring is repeated in each
round rather than stored. Queries are taken in blocks of at most ``BLOCK`` (a bounded broadcast), each block against all
rows; no row is compared with all others at once.

Defined results: vectors that are null or hold null or non-finite components take no part; an empty one
has only zeros; vectors of different
lengths are compared as if padded with zeros; scores are exact, and only those that a long can't hold count as the
largest or smallest one; components are taken up to 2^63; repeated ids are separate candidates, of which none with the query's own
id counts; ties go to the smaller id; fewer than k candidates give fewer rows; empty tables give no rows.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.session import save

BLOCK = 8192
BINS = 256
#: The largest double below 2^63: components beyond it count as that.
FARTHEST = float((1 << 63) - 1024)
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantise(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as integers; those beyond FARTHEST count as that."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(FARTHEST)), F.lit(-FARTHEST))).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(column), dims), np.int64)
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, those beyond a long as its ends (but for the smallest long, see _scores).
    Floating point is exact below 2^53; beyond, 64-bit products wrap around to the right sum wherever it fits, and floating
    point tells where it does; the few that it can't tell are summed in whole numbers."""
    near = a.astype(float) @ b.astype(float).T
    reach = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if reach < 2**53:
        return near.astype(np.int64)
    out = a @ b.T
    slack = reach * (a.shape[1] + 4) * 2.0**-52
    out[near > _MOST + slack] = _MOST
    out[near < _LEAST - slack] = _LEAST + 1
    for i, j in zip(*np.nonzero(np.abs(np.abs(near) - 2.0**63) <= slack), strict=True):
        out[i, j] = min(max(sum(map(operator.mul, a[i].tolist(), b[j].tolist())), _LEAST), _MOST)
    return np.maximum(out, _LEAST + 1)


def _places(score: np.ndarray) -> np.ndarray:
    """Scores as unsigned numbers in the same order, so that differences don't overflow."""
    return score.view(np.uint64) ^ np.uint64(1 << 63)


def _scores(batches: Iterator[pd.DataFrame], shared) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate ids and int64 scores [query, candidate]; a query's own id scores the least."""
    ids, matrix = shared.value
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.iloc[lo : lo + 512]
            score = _products(matrix, _matrix(part["vec"], matrix.shape[1]))
            score[ids[:, None] == part["vec_id"].to_numpy()[None, :]] = np.iinfo(np.int64).min
            yield part["vec_id"].to_numpy(), score


def _top(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k:] if values.shape[1] > k else values


def _histogram(vectors: DataFrame, shared, bounds, k: int) -> DataFrame:
    """Rows (query, bin, n): counts of scores in the BINS bins of each query's interval, and the count above it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, width = bounds.value
        best, counts = None, np.zeros((len(low), BINS + 1), np.int64)

        def bins(score: np.ndarray) -> np.ndarray:
            place = _places(np.ascontiguousarray(score))
            at = np.minimum((place - low[:, None]) // width[:, None], np.uint64(BINS)).astype(np.int64)
            return np.where((place < low[:, None]) | (score == _LEAST), -1, at)

        for _, score in _scores(batches, shared):
            best = _top(score if best is None else np.concatenate((best, score), axis=1), k)
            at = bins(score)
            rows, _ = np.nonzero(at >= 0)
            np.add.at(counts, (rows, at[at >= 0]), 1)
        if best is not None:
            floor = np.maximum(bins(best.min(axis=1, keepdims=True))[:, 0], 0) if best.shape[1] >= k else np.zeros(len(low), np.int64)
            counts[np.arange(BINS + 1)[None, :] < floor[:, None]] = 0
            q, b = np.nonzero(counts)
            yield pd.DataFrame({"query": q, "bin": b, "n": counts[q, b]})

    return vectors.mapInPandas(count, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _select(vectors: DataFrame, shared, threshold, k: int) -> DataFrame:
    """Each partition's rows at or above the threshold, at most k a query: higher scores first, then smaller ids."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, _ = shared.value
        kept: list[np.ndarray] = [np.zeros((0, 2), np.int64) for _ in ids]
        for candidate, score in _scores(batches, shared):
            rows, cols = np.nonzero(score >= threshold.value[:, None])
            edges = np.searchsorted(rows, np.arange(len(ids) + 1))
            for q in np.unique(rows):
                at = cols[edges[q] : edges[q + 1]]
                both = np.concatenate((kept[q], np.stack((score[q, at], candidate[at]), axis=1)))
                kept[q] = both[np.lexsort((both[:, 1], -both[:, 0]))[:k]]
        found = [np.column_stack((np.full(len(x), ids[q]), x)) for q, x in enumerate(kept) if len(x)]
        if found:
            yield pd.DataFrame(np.concatenate(found), columns=["query_id", "score", "vec_id"])

    return vectors.mapInPandas(pick, "query_id long, score long, vec_id long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries`` (both: vec_id, embedding): query_id, rank, vec_id, score."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = vectors.sparkSession
    prepared = [
        df.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
            F.col("vec_id").cast("long"), quantise(F.col("embedding")).alias("vec")
        )
        for df in (vectors, queries)
    ]
    vectors, queries = prepared[0], prepared[1].dropDuplicates(["vec_id"])
    n_queries = queries.count()
    n_blocks = max(1, -(-n_queries // block))
    queries = queries.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    dims, largest = vectors.agg(F.max(F.size("vec")), F.coalesce(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))), F.lit(0))).first()
    results = None
    for number in range(n_blocks):
        rows = queries.where(F.col("_block") == number).orderBy("vec_id").collect()  # about ``block`` rows by the hash
        if not rows or dims is None:
            continue
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        matrix = _matrix(pd.Series([r["vec"] for r in rows]), max([dims, *(len(r["vec"]) for r in rows)]))
        shared = spark.sparkContext.broadcast((ids, matrix))
        reach = [min(_MOST, sum(map(abs, row)) * int(largest)) for row in matrix.tolist()]
        low = _places(np.array([-x for x in reach], np.int64))
        width = np.array([2 * x // BINS + 1 for x in reach], np.uint64)
        while True:
            bounds = spark.sparkContext.broadcast((low, width))
            counts = np.zeros((len(ids), BINS + 1), np.int64)
            found = _histogram(vectors, shared, bounds, k).toArrow()  # at most BINS + 1 counts a query
            counts[found.column("query").to_numpy(), found.column("bin").to_numpy()] = found.column("n").to_numpy()
            reached = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] >= k
            at = np.where(reached.any(axis=1), BINS - np.argmax(reached[:, ::-1], axis=1), 0)
            low = low + at.astype(np.uint64) * width
            if (width == 1).all():
                break
            width = width // np.uint64(BINS) + (width % np.uint64(BINS) > 0).astype(np.uint64)
        threshold = spark.sparkContext.broadcast(np.where(reached.any(axis=1), _places(low.view(np.int64)).view(np.int64), _LEAST + 1))
        found = save(_select(vectors, shared, threshold, k), "topk-found")
        results = found if results is None else results.unionByName(found)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
