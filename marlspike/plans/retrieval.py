"""Retrieval pipelines over a table of queries: variants, arms, fusion, reranking, context and answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import preview, query_lines, tokens
from ..operators import bm25, fusion, vectors
from ..operators.chunking import hashed_vector
from ..session import spread, table
from ..sources import loaders

#: A model call: prompt column to reply column, null where it fails. The default always fails, so that fallbacks apply.
Model = Callable[[Column], Column]
NO_MODEL: Model = lambda prompt: F.lit(None).cast("string")
TRANSFORMS = ("none", "multi_query", "rewrite", "hyde", "step_back", "decompose")


def overlap_score(query: Column, text: Column) -> Column:
    """Default reranker: share of the query's distinct terms that the text holds."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.array_distinct(tokens(text)))) / F.size(q)).otherwise(F.lit(0.0))


def variants(queries: DataFrame, transform: str = "none", model: Model = NO_MODEL) -> DataFrame:
    """(query_id, variant, query): the queries to search with; a failing model leaves the query itself."""
    if transform not in TRANSFORMS:
        raise ValueError(f"unknown transform {transform!r}")
    if transform == "none":
        return queries.select("query_id", F.lit(0).alias("variant"), "query")
    reply = model(F.concat(F.lit(f"{transform}: "), F.col("query")))
    if transform in ("multi_query", "decompose"):
        lines = F.filter(query_lines(reply), lambda x: F.lower(x) != F.lower(F.col("query")))
        keep = F.array_distinct(F.concat(F.array("query"), lines)) if transform == "multi_query" else F.when(F.size(lines) > 0, lines).otherwise(F.array("query"))
        return queries.where(F.trim("query") != "").select("query_id", F.posexplode(keep).alias("variant", "query"))
    one = F.coalesce(F.nullif(F.regexp_replace(F.trim(reply), r"^[\"']|[\"']$", ""), F.lit("")), F.col("query"))
    both = F.array("query", one) if transform == "step_back" else F.array(one)
    return queries.select("query_id", F.posexplode(F.array_distinct(both)).alias("variant", "query"))


@dataclass
class Corpus:
    """Documents to search, with their lexical index where there is one, and the embedding."""

    docs: DataFrame
    index: bm25.Index | None = None
    embed: Callable[[Column], Column] = field(default=hashed_vector)

    @staticmethod
    def of(docs: DataFrame, embed: Callable[[Column], Column] = hashed_vector) -> "Corpus":
        """`docs` has doc_id and text."""
        return Corpus(docs, None, embed)

    def dense(self, queries: DataFrame, k: int, where: DataFrame | None = None) -> DataFrame:
        pool = spread(self.docs) if where is None else self.docs.join(where, "doc_id", "left_semi")
        return vectors.nearest(pool.select("doc_id", self.embed(F.col("text")).alias("vector")), queries.select("query_id", self.embed(F.col("query")).alias("vector")), k, digits=4)

    def sparse(self, queries: DataFrame, k: int, where: DataFrame | None = None) -> DataFrame:
        if self.index is not None:
            return bm25.search(self.index, queries, k, where)
        if where is None:
            return bm25.scan_search(self.docs, queries, k)
        flagged = self.docs.join(where.select("doc_id", F.lit(True).alias("_wanted")).distinct(), "doc_id", "left")
        return bm25.scan_search(flagged, queries, k, where=F.col("_wanted"))


class HybridIndex:
    """A lexical index and a table of vectors over the same documents, kept below one folder and changed together."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] = hashed_vector):
        self.spark, self.path, self.embed = spark, path, embed

    def _read(self) -> tuple[bm25.Index, DataFrame]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        version = self.spark.read.text(f"{self.path}/current").first()[0] if fs.exists(at) else None
        if version is None:
            empty = self.spark.createDataFrame([], "doc_id string, text string")
            return bm25.build(empty), empty.select("doc_id", "text", self.embed(F.col("text")).alias("vector"))
        return bm25.Index.read(self.spark, f"{self.path}/{version}/lexical"), self.spark.read.parquet(f"{self.path}/{version}/dense")

    def _write(self, index: bm25.Index, dense: DataFrame) -> None:
        """Both tables in a new folder, which the last step makes the current one."""
        version = uuid.uuid4().hex
        index.write(f"{self.path}/{version}/lexical")
        dense.write.parquet(f"{self.path}/{version}/dense")
        self.spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("overwrite").text(f"{self.path}/current")

    def add(self, docs: DataFrame) -> None:
        """Index `docs` (doc_id STRING, text) in both arms; documents of the same id are replaced."""
        index, dense = self._read()
        fresh = docs.select("doc_id", "text", self.embed(F.col("text")).alias("vector"))
        self._write(index.upsert(docs), dense.join(docs.select("doc_id"), "doc_id", "left_anti").unionByName(fresh))

    def add_file(self, path: str) -> None:
        """Index the documents of a file or folder."""
        self.add(loaders.load(self.spark, path).select("doc_id", "text"))

    def delete(self, ids: DataFrame) -> None:
        """Drop the documents in `ids` (doc_id) from both arms."""
        index, dense = self._read()
        self._write(index.without(ids), dense.join(ids, "doc_id", "left_anti"))

    def reset(self) -> None:
        """Empty both arms."""
        index, dense = self._read()
        self._write(bm25.build(dense.limit(0).select("doc_id", "text")), dense.limit(0))

    def search(self, queries: DataFrame, k: int = 5, alpha: float | None = 0.5) -> DataFrame:
        """(query_id, doc_id, rank, score, dense_rank, sparse_rank): both arms fused by reciprocal rank."""
        index, dense = self._read()
        near = vectors.nearest(dense.select("doc_id", "vector"), queries.select("query_id", self.embed(F.col("query")).alias("vector")), max(4 * k, 10), digits=4)
        return fusion.rrf(near, bm25.search(index, queries, max(4 * k, 10)), k, alpha)


def retrieve(corpus: Corpus, queries: DataFrame, k: int = 5, mode: str = "hybrid", fuse: str = "rrf", alpha: float = 0.5, where: DataFrame | None = None, transform: str = "none", model: Model = NO_MODEL,
             rerank: Callable[[Column, Column], Column] | None = None, candidates: int = 30, floor: float = 0.0) -> DataFrame:
    """(query_id, doc_id, rank, score): one batched search of all queries and variants, fused, filtered and reranked.

    mode: dense, sparse or hybrid. `where` (doc_id) holds for every mode and transform. Reranked hits below `floor` are dropped,
    unless none of the query's hits reaches it.
    """
    if mode not in ("dense", "sparse", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    asked = variants(queries, transform, model)
    key = asked.select(F.concat_ws("#", F.col("query_id").cast("string"), "variant").alias("query_id"), F.col("query_id").alias("root"), "query")
    depth = max(4 * k, 10) if rerank is None else max(candidates, k)
    if mode == "hybrid":
        found = fusion.hybrid(corpus.dense(key, depth, where), corpus.sparse(key, depth, where), depth, fuse, alpha)
    else:
        found = (corpus.dense if mode == "dense" else corpus.sparse)(key, depth, where)
    ranked = found.join(key.select("query_id", "root"), "query_id").select("root", F.col("query_id").alias("variant"), "doc_id", "rank", "score")
    if transform == "none":
        merged = ranked.select(F.col("root").alias("query_id"), "doc_id", "rank", "score")
    else:
        merged = fusion.multi_query(ranked, depth).select(F.col("root").alias("query_id"), "doc_id", "rank", "score")
    if rerank is None:
        return merged.where(F.col("rank") <= k)
    scored = merged.join(queries.select("query_id", "query"), "query_id").join(corpus.docs.select("doc_id", "text"), "doc_id").withColumn("again", F.round(rerank(F.col("query"), F.col("text")), 4))
    good = scored.withColumn("any", F.max("again").over(Window.partitionBy("query_id")) >= floor).where(~F.col("any") | (F.col("again") >= floor))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("any"), F.col("again")).otherwise(F.lit(0.0)).desc(), "rank", "doc_id")
    return good.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("query_id", "doc_id", F.col("n").alias("rank"), F.col("again").alias("score"))


def contexts(hits: DataFrame, docs: DataFrame, sep: str = "\n\n---\n\n") -> DataFrame:
    """(query_id, context, sources, citations): numbered texts of the hits in rank order; at most the hits' k per query."""
    rows = hits.join(docs.select("doc_id", "text"), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "text"))).alias("h"))
    return rows.select("query_id", F.array_join(F.transform("h", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), sep).alias("context"),
                       F.array_distinct(F.transform("h", lambda x: x["doc_id"].cast("string"))).alias("sources"), F.transform("h", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), preview(x["text"]))).alias("citations"))


def answer(queries: DataFrame, hits: DataFrame, docs: DataFrame, model: Model = NO_MODEL) -> DataFrame:
    """(query_id, answer, sources, retrieved): the model's answer, or a note with the number of hits where it gives none."""
    ctx = queries.join(contexts(hits, docs), "query_id", "left")
    n = F.coalesce(F.size("sources"), F.lit(0))
    note = F.concat(F.lit("No model is set; "), n.cast("string"), F.lit(" documents were retrieved."))
    reply = model(F.concat_ws("\n\n", F.lit("Answer from the context only."), "context", "query"))
    return ctx.select("query_id", F.coalesce(reply, note).alias("answer"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), n.alias("retrieved"))


def _setup(spark: SparkSession, sf_dir: str) -> tuple[Corpus, DataFrame]:
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", "text")
    return Corpus.of(docs), table(spark, sf_dir, "qa").select(F.col("financebench_id").alias("query_id"), F.col("question").alias("query"))


def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents for each question of qa, lexical and vector arms fused and reranked by overlap."""
    corpus, queries = _setup(spark, sf_dir)
    return retrieve(corpus, queries, rerank=overlap_score, floor=0.05)


def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer records of all questions, without a model."""
    corpus, queries = _setup(spark, sf_dir)
    out = answer(queries, retrieve(corpus, queries, mode="sparse"), corpus.docs)
    return out.select("query_id", "answer", F.array_join("sources", ",").alias("sources"), "retrieved")


QUERIES = {f.__name__: f for f in (hybrid_retrieval, question_answers)}
SQL: dict[str, str] = {}
