"""Fusion of ranked lists: reciprocal ranks, min-max weights, and many query variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from . import bm25, vectors
from .bm25 import top_k

RRF_K = 60


def _union(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    return dense.select("query_id", "doc_id", "rank", "score", F.lit("dense").alias("arm")).unionByName(sparse.select("query_id", "doc_id", "rank", "score", F.lit("sparse").alias("arm")))


def rrf(dense: DataFrame, sparse: DataFrame, k: int, alpha: float | None = 0.5, rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion: alpha / (K + dense rank) + (1 - alpha) / (K + sparse rank), 6 places; without alpha both weights are 1."""
    weight = F.lit(1.0) if alpha is None else F.when(F.col("arm") == "dense", F.lit(alpha)).otherwise(F.lit(1 - alpha))
    fused = _union(dense, sparse).groupBy("query_id", "doc_id").agg(
        F.round(F.sum(weight / (rrf_k + F.col("rank"))), 6).alias("score"), F.min(F.when(F.col("arm") == "dense", F.col("rank"))).alias("dense_rank"), F.min(F.when(F.col("arm") == "sparse", F.col("rank"))).alias("sparse_rank"))
    return top_k(fused, k).select("query_id", "doc_id", "rank", "score", "dense_rank", "sparse_rank")


def weighted(dense: DataFrame, sparse: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse of scores scaled to 0..1 within each query and arm (no spread gives 0), 4 places."""
    w = Window.partitionBy("query_id", "arm")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = _union(dense, sparse).withColumn("n", (F.col("score") - low) / F.when(high - low == 0, F.lit(1.0)).otherwise(high - low))
    weight = F.when(F.col("arm") == "dense", F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return top_k(scaled.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight * F.col("n")), 4).alias("score")), k).select("query_id", "doc_id", "rank", "score")


def multi_query(rankings: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Fusion over variants: `rankings` (root, variant, doc_id, rank) to (root, doc_id, rank, score, query_count, best_rank, matched).

    `matched` holds the variants that found the document, in order.

    A document that stands twice in one list counts twice.
    """
    fused = rankings.groupBy("root", "doc_id").agg(
        F.round(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))), 6).alias("score"), F.count_distinct("variant").alias("query_count"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_set("variant")).alias("matched"))
    return top_k(fused, k, by="root").select("root", "doc_id", "rank", "score", "query_count", "best_rank", "matched")


def unique_union(rankings: DataFrame, depth: int = 3) -> DataFrame:
    """(root, doc_id, best_rank): documents among the first `depth` of any variant, each once."""
    return rankings.where(F.col("rank") <= depth).groupBy("root", "doc_id").agg(F.min("rank").alias("best_rank"))


def within(hits: DataFrame, threshold: float, metric: str = "similarity") -> DataFrame:
    """Hits whose score is at least `threshold` (similarity), or at most (distance)."""
    if metric not in ("similarity", "distance"):
        raise ValueError(f"unknown metric {metric!r}")
    return hits.where(F.col("score") >= threshold if metric == "similarity" else F.col("score") <= threshold)


def hybrid(dense: DataFrame, sparse: DataFrame, k: int, method: str = "rrf", alpha: float = 0.5) -> DataFrame:
    """Fusion by name: `rrf` or `weighted`; anything else is refused."""
    if method not in ("rrf", "weighted"):
        raise ValueError(f"unknown fusion {method!r}")
    return (rrf if method == "rrf" else weighted)(dense, sparse, k, alpha)


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    corpus, queries = vectors._vectors(spark, sf_dir), vectors.query_vectors(spark, sf_dir)
    return vectors.nearest(corpus, queries, 20), vectors.nearest(corpus, queries, 20, "sign")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and sign-code rankings of each query vector fused by reciprocal rank."""
    return rrf(*_arms(spark, sf_dir), 5, 0.6)


def hybrid_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rankings fused by min-max weights."""
    return weighted(*_arms(spark, sf_dir), 5, 0.6)


def multiquery_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query vectors of one label as variants of one question."""
    ranked = vectors.nearest(vectors._vectors(spark, sf_dir), vectors.query_vectors(spark, sf_dir), 10)
    fused = multi_query(_variants(spark, sf_dir, ranked), 10)
    return fused.withColumn("matched", F.array_join(F.col("matched").cast("array<string>"), ","))


def _variants(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    root = vectors._vectors(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("label").alias("root"))
    return ranked.join(root, "query_id").select("root", F.col("query_id").alias("variant"), "doc_id", "rank")


def multiquery_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents among the three nearest of any query vector of a label."""
    return unique_union(_variants(spark, sf_dir, vectors.dense_topk_cosine(spark, sf_dir)))


def unit_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and sign-code rankings fused with weights of 1."""
    return rrf(*_arms(spark, sf_dir), 5, None)


def distance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by squared distance that lie within 100."""
    return within(vectors.dense_topk_l2(spark, sf_dir), 100.0, "distance")


def lexical_dense_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each question of qa the documents of a lexical arm (BM25) and of a dense one (length and date near the item's mean) fused by rank.

    The dense arm takes vectors of three figures of a text (characters, share of digits, share of capitals), which SQL can compute too.
    """
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & (F.length("text") > 0)).select("doc_id", "text")
    queries = table(spark, sf_dir, "qa").select(F.col("financebench_id").alias("query_id"), F.col("question").alias("query"))
    sparse = bm25.scan_search(docs, queries, 10)
    dense = vectors.nearest(docs.select("doc_id", _figures(F.col("text")).alias("vector")), queries.select("query_id", _figures(F.col("query")).alias("vector")), 10, "l2")
    return rrf(dense, sparse, 5, 0.5)


def _figures(text):
    n = F.length(text).cast("double")
    share = lambda p: F.length(F.regexp_replace(text, p, "")) / n
    return F.array(F.round(n / 100, 6), F.round(share("[^0-9]"), 6), F.round(share("[^A-Z]"), 6))


_D, _S = vectors.ranking_sql(vectors.COSINE_SQL, 20), vectors.ranking_sql(vectors.SIGN_SQL, 20)
_BOTH = f"WITH d AS ({_D}), s AS ({_S}), u AS (SELECT *, 'dense' AS arm FROM d UNION ALL SELECT *, 'sparse' AS arm FROM s)"
_TOP = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= {k}"
_FIG = "round(length({0}) / 100.0::DOUBLE, 6) AS a, round(length(regexp_replace({0}, '[^0-9]', '', 'g')) / length({0})::DOUBLE, 6) AS b, round(length(regexp_replace({0}, '[^A-Z]', '', 'g')) / length({0})::DOUBLE, 6) AS c"
SQL = {
    "hybrid_rrf": f"{_BOTH}, f AS (SELECT query_id, doc_id, round(sum(CASE arm WHEN 'dense' THEN 0.6::DOUBLE ELSE 1 - 0.6::DOUBLE END / (60 + rank)), 6) AS score, min(rank) FILTER (arm = 'dense') AS dense_rank, min(rank) FILTER (arm = 'sparse') AS sparse_rank FROM u GROUP BY ALL) " + _TOP.format(cols="query_id, doc_id, rank, score, dense_rank, sparse_rank", by="query_id", k=5),
    "hybrid_weighted": f"{_BOTH}, n AS (SELECT *, (score - min(score) OVER w) / CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE max(score) OVER w - min(score) OVER w END AS n FROM u WINDOW w AS (PARTITION BY query_id, arm)), f AS (SELECT query_id, doc_id, round(sum(CASE arm WHEN 'dense' THEN 0.6::DOUBLE ELSE 1 - 0.6::DOUBLE END * n), 4) AS score FROM n GROUP BY ALL) " + _TOP.format(cols="query_id, doc_id, rank, score", by="query_id", k=5),
    "multiquery_rrf": f"WITH d AS ({vectors.ranking_sql(vectors.COSINE_SQL, 10)}), f AS (SELECT e.label AS root, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, count(DISTINCT query_id) AS query_count, min(rank) AS best_rank, array_to_string(list_sort(list(DISTINCT query_id)), ',') AS matched FROM d JOIN embeddings e ON e.vec_id = d.query_id GROUP BY ALL) " + _TOP.format(cols="root, doc_id, rank, score, query_count, best_rank, matched", by="root", k=10),
    "multiquery_union": f"SELECT e.label AS root, doc_id, min(rank) AS best_rank FROM ({vectors.ranking_sql(vectors.COSINE_SQL, 10)}) d JOIN embeddings e ON e.vec_id = d.query_id WHERE rank <= 3 GROUP BY ALL",
    "unit_rrf": f"{_BOTH}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, min(rank) FILTER (arm = 'dense') AS dense_rank, min(rank) FILTER (arm = 'sparse') AS sparse_rank FROM u GROUP BY ALL) " + _TOP.format(cols="query_id, doc_id, rank, score, dense_rank, sparse_rank", by="query_id", k=5),
    "distance_threshold": f"SELECT * FROM ({vectors.ranking_sql(vectors.L2_SQL, 10, 'ASC')}) WHERE score <= 100",
    "lexical_dense_rrf": bm25.search_sql("documents WHERE text IS NOT NULL AND length(text) > 0", 10) + f""", v AS (SELECT doc_id, {_FIG.format('text')} FROM documents WHERE text IS NOT NULL AND length(text) > 0), w AS (SELECT financebench_id AS query_id, {_FIG.format('question')} FROM qa),
d AS (SELECT query_id, doc_id, rank FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(pow(v.a - w.a, 2) + pow(v.b - w.b, 2) + pow(v.c - w.c, 2), 6), doc_id) AS rank FROM v, w) WHERE rank <= 10),
u AS (SELECT query_id, doc_id, rank, 'dense' AS arm FROM d UNION ALL SELECT query_id, doc_id, rank, 'sparse' AS arm FROM ranked),
f AS (SELECT query_id, doc_id, round(sum(0.5::DOUBLE / (60 + rank)), 6) AS score, min(rank) FILTER (arm = 'dense') AS dense_rank, min(rank) FILTER (arm = 'sparse') AS sparse_rank FROM u GROUP BY ALL) """ + _TOP.format(cols="query_id, doc_id, rank, score, dense_rank, sparse_rank", by="query_id", k=5),
}
QUERIES = {f.__name__: f for f in (hybrid_rrf, hybrid_weighted, multiquery_rrf, multiquery_union, unit_rrf, distance_threshold, lexical_dense_rrf)}
