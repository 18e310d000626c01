"""Chunking, embedding and top-k retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.text import let, passage_id, words

CHUNK, OVERLAP, TOP_K = 256, 32, 3
#: Queries scored at once; a bounded broadcast. More queries are taken in blocks.
QUERY_BLOCK = 4096
#: Distances that a task holds at once, as (queries, corpus rows); distances this close are compared again one by one.
TILE, SLACK = (512, 512), 1e-9


def chunk_windows(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Sliding windows of words, until the last word is inside one; none for a blank text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than the chunk")

    def windows(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(t) - overlap - 1, F.lit(0)), F.lit(size - overlap))
        return F.when(F.size(t) > 0, F.transform(starts, lambda i: F.array_join(F.slice(t, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return let(words(text), windows)


def chunk_passages(passages: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(source_id, text) to (source_id, chunk_no, chunk)."""
    return passages.select("source_id", F.posexplode(chunk_windows(F.col("text"), size, overlap)).alias("chunk_no", "chunk"))


def hashing_encoder(dims: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """An encoder that needs no model: hashed word counts, scaled to unit length."""

    def make():
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dims), np.float32)
            for row, text in enumerate(texts):
                for word in (text or "").lower().split():
                    h = zlib.crc32(word.encode())
                    out[row, h % dims] += 1 if h >> 31 else -1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm == 0, 1, norm)

        return encode

    return make


def embed(df: DataFrame, text: str, encoder: Callable = hashing_encoder(), output: str = "embedding") -> DataFrame:
    """Adds vectors of a text column. ``encoder()`` is called once a task and returns a function of a list of texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for batch in batches:
            yield pd.Series(list(encode(batch.tolist())))

    udf = F.pandas_udf(run, "array<float>", F.PandasUDFType.SCALAR_ITER)
    return df.withColumn(output, udf(F.col(text)))


def cosine_top_k(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, exclude_self: bool = False) -> DataFrame:
    """The k corpus rows (doc_id, embedding) nearest to each query row (query_id, embedding) by cosine distance:
    query_id, rank, doc_id, distance. Ties go to the smaller id. Every task keeps its own k best for each query of the
    block, a rank over those picks the final ones."""
    spark = queries.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    numbered = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    found = None
    for number in range(blocks):
        rows = numbered.where(F.col("_block") == number).orderBy("query_id").collect()  # about QUERY_BLOCK rows by the hash
        if not rows:
            continue
        ids = np.array([r["query_id"] for r in rows])
        shared = spark.sparkContext.broadcast((ids, _unit(np.array([r["embedding"] for r in rows], np.float64))))

        def nearest(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            best = [_no_hits() for _ in range(0, len(ids), TILE[0])]
            for batch in batches:
                for lo in range(0, len(batch), TILE[1]):
                    part = batch.iloc[lo : lo + TILE[1]]
                    doc, m = part["doc_id"].to_numpy(), _unit(np.stack(part["embedding"].to_numpy()).astype(np.float64))
                    for block, known in enumerate(best):
                        own = slice(block * TILE[0], (block + 1) * TILE[0])
                        best[block] = _nearer(known, ids[own], matrix[own], doc, m, k, exclude_self)
            for block, (q, doc, distance) in enumerate(best):
                yield pd.DataFrame({"query_id": ids[block * TILE[0] + q], "doc_id": doc, "distance": distance})

        part = corpus.select("doc_id", "embedding").mapInPandas(nearest, "query_id long, doc_id long, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "distance")


def _no_hits() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)


def _nearer(known: tuple, ids: np.ndarray, queries: np.ndarray, doc: np.ndarray, m: np.ndarray, k: int, exclude_self: bool) -> tuple:
    """The k best of each query among the known hits (place of the query, doc_id, distance) and the rows of a tile. Those
    near the kth best are taken by a product of the whole tile, and their distances then one by one, so that equal vectors
    have equal distances wherever they stand."""
    rough = 1 - queries @ m.T
    if exclude_self:
        rough[ids[:, None] == doc[None, :]] = np.inf
    rough[np.isnan(rough)] = np.inf
    limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if rough.shape[1] >= k else np.full(len(ids), np.inf)
    places, counts = np.unique(known[0], return_counts=True)
    full = places[counts >= k]
    limit[full] = np.minimum(limit[full], np.maximum.reduceat(known[2], np.searchsorted(known[0], full)) if len(full) else 0)
    q, c = np.nonzero((rough <= limit[:, None] + SLACK) & np.isfinite(rough))
    distance = np.empty(len(q))
    for lo in range(0, len(q), TILE[0]):
        at = slice(lo, lo + TILE[0])
        distance[at] = 1 - (queries[q[at]] * m[c[at]]).sum(axis=1)
    q, found, distance = (np.concatenate(x) for x in zip(known, (q, doc[c], distance), strict=True))
    order = np.lexsort((found, distance, q))
    q, found, distance = q[order], found[order], distance[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], found[keep], distance[keep]


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def retrieve_batch(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Per query the documents of its hits, in rank order. ``documents``: doc_id, document."""
    joined = hits.join(documents, "doc_id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "document"))).alias("h"))
    return joined.select("query_id", F.transform("h", lambda x: x["document"]).alias("contexts"))


def retrieve_negative(retrieved: DataFrame) -> DataFrame:
    """Contexts of the query half a batch ahead, in a circle: rows (batch, pos, query_id, contexts)."""
    size = F.count("*").over(Window.partitionBy("batch"))
    source = F.pmod(F.col("pos") + F.greatest(F.lit(1), F.floor(F.col("n") / 2)), F.col("n"))
    ahead = retrieved.withColumn("n", size).select("batch", "query_id", source.alias("pos"))
    return ahead.join(retrieved.select("batch", "pos", F.col("contexts").alias("negative")), ["batch", "pos"]).select("batch", "query_id", "negative")


def upsert(store: DataFrame | None, passages: DataFrame) -> DataFrame:
    """The store (id, document, embedding, metadata) with passages (document, embedding, metadata, ordinal) added. An id
    is the hash of the document; what comes later replaces what was there. Empty metadata becomes {"_": "1"}."""
    given = F.coalesce(F.col("metadata"), F.create_map(F.lit("idx"), F.col("ordinal").cast("string")))
    metadata = F.when(F.size(given) == 0, F.create_map(F.lit("_"), F.lit("1"))).otherwise(given)
    new = passages.select(passage_id(F.col("document")).alias("id"), "document", "embedding", metadata.alias("metadata"), (F.col("ordinal") + 1).alias("_v"))
    every = new if store is None else store.withColumn("_v", F.lit(0).cast("long")).unionByName(new)
    latest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_v")))
    return every.withColumn("_r", latest).where("_r = 1").drop("_r", "_v")


def not_stored(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """Chunks whose passage id the store has not; only these need embedding."""
    return chunks.withColumn("id", passage_id(F.col("chunk"))).join(store.select("id"), "id", "left_anti")
