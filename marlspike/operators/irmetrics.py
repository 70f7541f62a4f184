"""Quality of rankings against judgments: precision, recall, hits, reciprocal rank, DCG family and average precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vectors


def gain(rel: Column, exponential: bool = True) -> Column:
    """2^rel - 1, or rel; nothing for grades that aren't positive."""
    return F.when(rel > 0, F.pow(F.lit(2.0), rel) - 1 if exponential else rel).otherwise(F.lit(0.0))


def evaluate(rankings: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), exponential: bool = True) -> DataFrame:
    """One row per query and k: precision, recall, hit, rr, dcg, ndcg, ap; every query of `qrels` or `rankings` comes out.

    `rankings` (query_id, rank, doc_id), `qrels` (query_id, doc_id, rel); relevant means rel > 0. Precision divides by k even where
    fewer were retrieved; recall and NDCG are at most 1; without relevant documents everything is 0. k below 1 is refused.
    """
    if any(k < 1 for k in ks):
        raise ValueError("k must be at least 1")
    positive = qrels.where(F.col("rel") > 0)
    judged = rankings.select("query_id", "rank", "doc_id").join(positive.select("query_id", "doc_id", F.col("rel").cast("double").alias("rel")), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0.0)))
    ideal = positive.select("query_id", F.col("rel").cast("double").alias("rel")).withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc()))).where(F.col("i") <= max(ks))
    total = positive.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    every = qrels.select("query_id").union(rankings.select("query_id")).distinct()
    return _metrics(judged, ideal, total, every, ks, exponential)


def evaluate_judged(judged: DataFrame, totals: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """As `evaluate`, for rankings whose rows carry their judgment: `judged` (query_id, rank, rel 0 or 1), `totals` (query_id, n_relevant).

    For judgments by a rule, such as an equal label, of which no table of pairs is wanted.
    """
    if any(k < 1 for k in ks):
        raise ValueError("k must be at least 1")
    ideal = totals.where(F.col("n_relevant") > 0).select("query_id", F.lit(1.0).alias("rel"), F.explode(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(max(ks))).cast("int"))).alias("i"))
    return _metrics(judged.select("query_id", "rank", F.col("rel").cast("double").alias("rel")), ideal, totals, totals.select("query_id"), ks, True)


def _metrics(judged: DataFrame, ideal: DataFrame, total: DataFrame, every: DataFrame, ks: tuple[int, ...], exponential: bool) -> DataFrame:
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = judged.withColumn("found", F.sum((F.col("rel") > 0).cast("int")).over(running)).where(F.col("rank") <= max(ks))
    discount = lambda r: F.log2(r + F.lit(1.0))
    at = lambda cond, value: F.sum(F.when(cond, value).otherwise(F.lit(0.0)))
    got = judged.groupBy("query_id").agg(*(a for k in ks for a in (
        F.sum(((F.col("rank") <= k) & (F.col("rel") > 0)).cast("int")).alias(f"hits_{k}"), F.min(F.when((F.col("rank") <= k) & (F.col("rel") > 0), F.col("rank"))).alias(f"first_{k}"),
        at(F.col("rank") <= k, gain(F.col("rel"), exponential) / discount(F.col("rank"))).alias(f"dcg_{k}"), at((F.col("rank") <= k) & (F.col("rel") > 0), F.col("found") / F.col("rank")).alias(f"ap_{k}"))))
    best = ideal.groupBy("query_id").agg(*(at(F.col("i") <= k, gain(F.col("rel"), exponential) / discount(F.col("i"))).alias(f"idcg_{k}") for k in ks))
    wide = every.join(got, "query_id", "left").join(best, "query_id", "left").join(total, "query_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    rows = F.array(*(F.struct(
        F.lit(k).alias("k"), (z(f"hits_{k}") / F.lit(float(k))).alias("precision"), F.least(F.lit(1.0), per(z(f"hits_{k}"), z("n_relevant"))).alias("recall"), (z(f"hits_{k}") > 0).cast("double").alias("hit"),
        F.coalesce(F.lit(1.0) / F.col(f"first_{k}"), F.lit(0.0)).alias("rr"), F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)).alias("dcg"), F.least(F.lit(1.0), per(F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)), F.coalesce(F.col(f"idcg_{k}"), F.lit(0.0)))).alias("ndcg"),
        per(F.coalesce(F.col(f"ap_{k}"), F.lit(0.0)), F.least(F.lit(k), z("n_relevant"))).alias("ap")) for k in ks))
    return wide.select("query_id", F.explode(rows).alias("m")).select("query_id", "m.*")


def summarise(per_query: DataFrame) -> DataFrame:
    """Means over queries for each k, 6 places."""
    return per_query.groupBy("k").agg(F.count("*").alias("n_queries"), *(F.round(F.avg(c), 6).alias(a) for c, a in (("precision", "precision"), ("recall", "recall"), ("hit", "hit_rate"), ("rr", "mrr"), ("ndcg", "ndcg"), ("ap", "map"))))


def _per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each query vector's ten nearest, a vector being relevant where it has the query's label."""
    v = vectors._vectors(spark, sf_dir).select("doc_id", "label")
    q = v.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("label").alias("wanted"))
    ranked = vectors.nearest(vectors._vectors(spark, sf_dir), vectors.query_vectors(spark, sf_dir), 10)
    judged = ranked.join(v, "doc_id").join(q, "query_id").select("query_id", "rank", F.coalesce(F.col("label") == F.col("wanted"), F.lit(False)).cast("int").alias("rel"))
    totals = q.join(v.groupBy(F.col("label").alias("wanted")).agg(F.count("*").alias("n_relevant")), "wanted").select("query_id", "n_relevant")
    return evaluate_judged(judged, totals)


def ir_metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each query vector's ranking, with the label as judgment."""
    out = _per_query(spark, sf_dir)
    return out.select("query_id", "k", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "hit", "rr", "dcg", "ndcg", "ap")))


def ir_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their means per k."""
    return summarise(_per_query(spark, sf_dir))


_PER = f"""
WITH d AS ({vectors.ranking_sql(vectors.COSINE_SQL, 10)}), j AS (SELECT d.*, (q.label = x.label)::INT AS rel FROM d JOIN embeddings q ON q.vec_id = d.query_id JOIN embeddings x ON x.vec_id = d.doc_id),
r AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS found FROM j), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
ks AS (SELECT unnest([1, 3, 5, 10]) AS k), ideal AS (SELECT k, m, sum(1 / log2(i + 1.0)) AS idcg FROM ks, (SELECT unnest(range(1, 11)) AS m), (SELECT unnest(range(1, 11)) AS i) WHERE i <= k AND i <= m GROUP BY ALL),
per AS (SELECT query_id, k, sum((rank <= k)::INT * rel) / k::DOUBLE AS precision, least(1.0, sum((rank <= k)::INT * rel) / any_value(n.n)::DOUBLE) AS recall, (sum((rank <= k)::INT * rel) > 0)::INT::DOUBLE AS hit,
  coalesce(1.0::DOUBLE / min(rank) FILTER (rel = 1 AND rank <= k), 0.0::DOUBLE) AS rr, sum((rank <= k)::INT * rel / log2(rank + 1.0)) AS dcg, sum((rank <= k)::INT * rel * found / rank) / least(k, any_value(n.n)) AS ap, least(any_value(n.n), 10) AS m
  FROM r, ks, embeddings q, n WHERE q.vec_id = query_id AND n.label = q.label GROUP BY query_id, k)
"""
SQL = {
    "ir_metrics_at_k": _PER + "SELECT query_id, p.k AS k, round(precision, 6) AS precision, round(recall, 6) AS recall, hit, round(rr, 6) AS rr, round(dcg, 6) AS dcg, round(least(1.0, dcg / idcg), 6) AS ndcg, round(ap, 6) AS ap FROM per p JOIN ideal i ON i.k = p.k AND i.m = p.m",
    "ir_metrics_summary": _PER + "SELECT p.k AS k, count(*) AS n_queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit_rate, round(avg(rr), 6) AS mrr, round(avg(least(1.0, dcg / idcg)), 6) AS ndcg, round(avg(ap), 6) AS map FROM per p JOIN ideal i ON i.k = p.k AND i.m = p.m GROUP BY p.k",
}
QUERIES = {"ir_metrics_at_k": ir_metrics_at_k, "ir_metrics_summary": ir_metrics_summary}
