"""Vector similarity, exact and clustered top-k for a table of query vectors, and a semantic cache probe."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT_BYTES, table
from .bm25 import TopK, top_k

#: Rows that k-means is fitted on, chosen by hash of the id; every row is indexed.
FIT_ROWS = 20_000
#: Share of the clusters that a search reads.
PROBED = 14 / 32
#: Queries that are compared in one pass.
BLOCK_QUERIES = 2000


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    """Euclidean norm in double precision."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity: 0 where a norm is 0; an error where the dimensions differ."""
    value = dot(a, b) / (norm(a) * norm(b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in dimension"))).when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(value)


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def distance_score(d: Column) -> Column:
    """max(0, 1 / (1 + d)), rounded to 4 places."""
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) / (F.lit(1.0) + d)), 4)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(queries: DataFrame, limit: int) -> Iterator[tuple[list, np.ndarray]]:
    """The stated query set in blocks of at most BLOCK_QUERIES whose vectors fit `limit` bytes."""
    ids, rows, size = [], [], 0
    for r in queries.toLocalIterator():
        if ids and (size + 8 * len(r[1]) > limit or len(ids) >= BLOCK_QUERIES):
            yield ids, np.array(rows, np.float64)
            ids, rows, size = [], [], 0
        ids.append(r[0])
        rows.append(r[1])
        size += 8 * len(r[1])
    if ids:
        yield ids, np.array(rows, np.float64)


def nearest(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", limit: int = BROADCAST_LIMIT_BYTES, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """Exact top-k: (query_id, doc_id, rank, score) of `queries` (query_id, vector) over `corpus` (doc_id, vector).

    The query set is taken in blocks that fit `limit`; each task multiplies its rows with a block and hands on its own k best per
    query, so that the shuffle carries k rows per query and task, never the pairs. Null vectors are left out; ties go by doc_id.
    metric: cosine, l2 (score is the squared distance, ascending) or sign (share of coordinates of equal sign).
    """
    kind, qkind = corpus.schema["doc_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    sc, parts = corpus.sparkSession.sparkContext, []
    src = corpus.where(F.col("vector").isNotNull()).select("doc_id", "vector")
    for ids, matrix in _blocks(queries.where(F.col("vector").isNotNull()), limit):
        block = sc.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            ids, q = block.value
            qn = np.linalg.norm(q, axis=1)
            best = TopK(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = _matrix(part.column(1))
                    if metric == "cosine":
                        scale = qn[:, None] * np.linalg.norm(x, axis=1)[None]
                        s = np.where(scale == 0, 0.0, q @ x.T / np.where(scale == 0, 1, scale))
                    elif metric == "sign":
                        s = ((q[:, None, :] >= 0) == (x[None] >= 0)).mean(2) if len(ids) * x.size < 1 << 27 else np.stack([((v >= 0) == (x >= 0)).mean(1) for v in q])
                    else:
                        s = -(np.maximum(0, (q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T))
                    d = part.column(0).to_pylist()
                    if exclude_self:
                        s[np.array(ids, object)[:, None] == np.array(d, object)[None]] = -np.inf
                    best.add(np.round(s, digits), d)
            rows = [(ids[q], d, s) for q, d, s in best.rows()]
            yield pa.RecordBatch.from_pydict({"query_id": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "score": pa.array([float(r[2]) for r in rows], pa.float64())},
                                             schema=pa.schema([("query_id", _arrow(qkind)), ("doc_id", _arrow(kind)), ("score", pa.float64())]))

        parts.append(src.mapInArrow(run, f"query_id {qkind}, doc_id {kind}, score double"))
    if not parts:
        return corpus.sparkSession.createDataFrame([], f"query_id {qkind}, doc_id {kind}, rank int, score double")
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    ranked = top_k(scored, k)
    return ranked.select("query_id", "doc_id", "rank", F.when(F.lit(metric == "l2"), -F.col("score") + 0.0).otherwise(F.col("score")).alias("score"))


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


class ClusteredIndex:
    """Vectors clustered round k-means centroids; a search reads the clusters nearest to the query only."""

    def __init__(self, corpus: DataFrame, clusters: int | None = None, rounds: int = 12, spill: int = 2):
        """Centroids are fitted on at most FIT_ROWS rows (smallest id hashes); every row of `corpus` (doc_id, vector) belongs to its `spill` nearest.

        Without `clusters` there are as many as the root of the rows, 32 at least.
        """
        clusters = clusters or max(32, math.ceil(math.sqrt(corpus.count())))
        sample = corpus.where(F.col("vector").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("vector").collect()
        x = np.array([r[0] for r in sample], np.float64).reshape(len(sample), -1)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        self.centroids = x[:: max(1, len(x) // clusters)][:clusters].copy()
        for _ in range(rounds):
            owner = (x @ self.centroids.T).argmax(1)
            for j in range(len(self.centroids)):
                if (owner == j).any():
                    c = x[owner == j].mean(0)
                    self.centroids[j] = c / max(np.linalg.norm(c), 1e-12)
        self.members, self.spill = corpus.where(F.col("vector").isNotNull()).select("doc_id", "vector"), spill

    def search(self, queries: DataFrame, k: int, probes: int | None = None, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
        """Approximate cosine top-k of `queries` (query_id, vector), over the `probes` clusters nearest to each (PROBED of all, if not told).

        The query set is taken in blocks that fit `limit`. Each task multiplies its members of a cluster with the queries that probe that
        cluster and hands on its own k best per query: the shuffle carries k rows per query and task, never the pairs.
        """
        probes = probes or math.ceil(PROBED * len(self.centroids))
        parts = [self._best(ids, matrix, queries.schema["query_id"].dataType.simpleString(), k, probes) for ids, matrix in _blocks(queries.where(F.col("vector").isNotNull()).select("query_id", "vector"), limit)]
        if not parts:
            return self.members.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {self.members.schema['doc_id'].dataType.simpleString()}, rank int, score double")
        return top_k(reduce(DataFrame.unionByName, parts), k).select("query_id", "doc_id", "rank", "score")

    def _best(self, ids: list, matrix: np.ndarray, qkind: str, k: int, probes: int) -> DataFrame:
        """(query_id, doc_id, score): the k best of each task for each query of a block; a pair is scored once however many clusters it shares."""
        kind, spill = self.members.schema["doc_id"].dataType.simpleString(), self.spill
        probed = np.zeros((len(ids), len(self.centroids)), bool)
        np.put_along_axis(probed, np.argsort(-(matrix @ self.centroids.T), axis=1, kind="stable")[:, :probes], True, 1)
        block = self.members.sparkSession.sparkContext.broadcast((ids, matrix, probed, self.centroids))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, probed, centroids = block.value
            qn = np.linalg.norm(q, axis=1)
            best = TopK(len(ids), k)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = _matrix(part.column(1))
                    xn = np.linalg.norm(x, axis=1)
                    near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :spill]
                    s = np.full((len(ids), len(x)), -np.inf)
                    for j in range(len(centroids)):
                        asks, held = np.flatnonzero(probed[:, j]), np.flatnonzero((near == j).any(1))
                        scale = qn[asks, None] * xn[None, held]
                        s[np.ix_(asks, held)] = np.where(scale == 0, 0.0, q[asks] @ x[held].T / np.where(scale == 0, 1, scale))
                    best.add(np.round(s, 6), part.column(0).to_pylist())
            rows = [(ids[q], d, s) for q, d, s in best.rows()]
            yield pa.RecordBatch.from_pydict({"query_id": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "score": pa.array([float(r[2]) for r in rows], pa.float64())},
                                             schema=pa.schema([("query_id", _arrow(qkind)), ("doc_id", _arrow(kind)), ("score", pa.float64())]))

        return self.members.mapInArrow(run, f"query_id {qkind}, doc_id {kind}, score double")


def adapter_score(distance: Column) -> Column:
    """1 - d: a cosine where d is a cosine distance."""
    return F.lit(1.0) - distance


def text_similarity(a: Column, b: Column, embed) -> Column:
    """Cosine of the embeddings of two texts; `embed` maps a text column to a vector column."""
    return cosine(embed(a), embed(b))


def adjacent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each vector and the next, from their cosine distance."""
    v = _vectors(spark, sf_dir)
    pairs = v.select(F.col("doc_id"), F.col("vector").alias("a")).join(v.select((F.col("doc_id") - 1).alias("doc_id"), F.col("vector").alias("b")), "doc_id")
    return pairs.select("doc_id", F.round(adapter_score(F.lit(1.0) - cosine(F.col("a"), F.col("b"))), 6).alias("score"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 20."""
    return _vectors(spark, sf_dir).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")


def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of each query by cosine."""
    return nearest(_vectors(spark, sf_dir), query_vectors(spark, sf_dir), 10)


def dense_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of each query by squared distance."""
    return nearest(_vectors(spark, sf_dir), query_vectors(spark, sf_dir), 10, "l2")


def dense_topk_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten near vectors of each query from the clustered index."""
    return ClusteredIndex(_vectors(spark, sf_dir)).search(query_vectors(spark, sf_dir), 10)


def semantic_cache_probe(spark: SparkSession, sf_dir: str, threshold: float = 0.8) -> DataFrame:
    """Best other vector of each query, and whether its similarity makes it a hit."""
    best = nearest(_vectors(spark, sf_dir), query_vectors(spark, sf_dir), 1, exclude_self=True)
    return best.select("query_id", "doc_id", F.round("score", 4).alias("score"), (F.col("score") >= threshold).alias("hit"))


_PAIR = "SELECT q.vec_id AS query_id, d.vec_id AS doc_id, {} AS score FROM embeddings q JOIN embeddings d ON true WHERE q.vec_id % 20 = 0"
_COS = "round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(d.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6)"
_L2 = "round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 6)"
_SIGN = "round(list_sum(list_transform(list_zip(q.embedding, d.embedding), lambda x: CASE WHEN (x[1] >= 0) = (x[2] >= 0) THEN 1.0::DOUBLE ELSE 0.0 END)) / len(q.embedding), 6)"


def ranking_sql(score: str, k: int, order: str = "DESC", extra: str = "") -> str:
    """Oracle of `nearest`."""
    return f"SELECT query_id, doc_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, doc_id) AS rank FROM ({_PAIR.format(score)} {extra})) WHERE rank <= {k}"


COSINE_SQL, L2_SQL, SIGN_SQL = _COS, _L2, _SIGN
SQL = {
    "dense_topk_cosine": ranking_sql(_COS, 10),
    "dense_topk_l2": ranking_sql(_L2, 10, "ASC"),
    "adjacent_similarity": f"SELECT q.vec_id AS doc_id, {_COS} AS score FROM embeddings q JOIN embeddings d ON d.vec_id = q.vec_id + 1",
    "semantic_cache_probe": f"SELECT query_id, doc_id, round(score, 4) AS score, score >= 0.8 AS hit FROM ({ranking_sql(_COS, 1, extra='AND q.vec_id <> d.vec_id')})",
}
QUERIES = {"dense_topk_cosine": dense_topk_cosine, "dense_topk_l2": dense_topk_l2, "dense_topk_clustered": dense_topk_clustered, "semantic_cache_probe": semantic_cache_probe, "adjacent_similarity": adjacent_similarity}
