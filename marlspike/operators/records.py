"""Record keeping round retrieval: page headers, graph upserts, hit rates, embedding-cache splits, latencies, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table
from . import bm25
from .filings import items_once


def page_header(company: Column, filing: Column, page: Column, total: Column, section: Column) -> Column:
    """The breadcrumb that a page's text is put under."""
    return F.concat(F.lit("[Company: "), company, F.lit(" | Filing: "), filing, F.lit(" | Page: "), page, F.lit("/"), total, F.lit(" | Section: "), section, F.lit("]"))


def graph_upsert(items: DataFrame, key: list[str], order: list[str], updated: list[str], kept: list[str]) -> DataFrame:
    """One row per key: `updated` columns from the latest row, `kept` columns from the first (an idempotent merge)."""
    at = F.struct(*order)
    return items.groupBy(*key).agg(*(F.max_by(c, at).alias(c) for c in updated), *(F.min_by(c, at).alias(c) for c in kept), F.count("*").alias("n_merged"))


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once or hold a null."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.greatest(*(F.col(k).isNull().cast("int") for k in [*key, key[0]])).cast("boolean"))


def cache_split(texts: DataFrame, cache: DataFrame, text_col: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose `prefix:sha256` key the cache (column key) holds, and those that it doesn't."""
    keyed = texts.withColumn("key", F.concat(F.lit(f"{prefix}:"), F.sha2(text_col, 256)))
    return keyed.join(cache.select("key").distinct(), "key", "left_semi"), keyed.join(cache.select("key").distinct(), "key", "left_anti")


def parse_instant(text: Column) -> Column:
    """A time written as ISO 8601 with Z, or as epoch seconds or milliseconds, or with a blank; null otherwise."""
    plain = F.regexp_replace(F.regexp_replace(text, "Z$", ""), "T", " ")
    return F.try_to_timestamp(plain.cast("string")).cast("timestamp_ntz")


def metrics_text(summary: DataFrame, name: Column, value: Column, prefix: str) -> DataFrame:
    """Lines of a text exposition: `prefix_metric{label="..."} value`."""
    return summary.select(F.concat(F.lit(f"{prefix}{{label=\""), F.regexp_replace(name, r'(["\\])', r"\\$1"), F.lit("\"} "), value.cast("string")).alias("line"))


def retrieval_hits(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per query: whether its document, and its page of that document, was retrieved, and the page's reciprocal rank.

    `ranked` (query_id, rank, doc_name, page), `wanted` (query_id, doc_name, pages ARRAY<INT>).
    """
    w = wanted.select("query_id", F.col("doc_name").alias("want"), "pages")
    j = w.join(ranked, "query_id", "left")
    doc = F.coalesce(F.col("doc_name") == F.col("want"), F.lit(False))
    page = doc & F.coalesce(F.array_contains("pages", F.col("page")), F.lit(False))
    return j.groupBy("query_id").agg(F.max(doc.cast("int")).alias("doc_hit"), F.max(page.cast("int")).alias("page_hit"), F.round(F.coalesce(F.lit(1.0) / F.min(F.when(page, F.col("rank"))), F.lit(0.0)), 6).alias("page_rr"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "financebench_docs").select("id", "content", "company", "metadata").distinct()


def page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose first line is, and is not, the header built from their metadata."""
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    built = page_header(F.col("company"), get("doc_name"), get("page"), get("total_pages"), get("section"))
    first = F.substring_index("content", "\n", 1)
    return _pages(spark, sf_dir).groupBy(F.coalesce(first == built, F.lit(False)).alias("same")).agg(F.count("*").alias("n_pages"))


def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items merged by filing, statement and name: latest value, first unit and category."""
    items = items_once(spark, sf_dir)
    return graph_upsert(items, ["doc_name", "statement", "raw_name"], ["extracted_at", "line_item_id"], ["value"], ["unit", "category"])


def graph_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing names that stand in more than one row, with their number."""
    return key_violations(table(spark, sf_dir, "filings"), ["doc_name"]).select("doc_name", "n")


def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts loaded from 2024 on that a cache of the earlier texts holds, and that it doesn't, per source."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    cut = F.lit("2024-01-01").cast("timestamp_ntz")
    cache = docs.where(F.col("loaded_at") < cut).select(F.concat(F.lit("doc:"), F.sha2("text", 256)).alias("key"))
    hit, miss = cache_split(docs.where(F.col("loaded_at") >= cut).select("source", "text"), cache, "text", "doc")
    both = hit.select("source", F.lit(1).alias("h")).unionByName(miss.select("source", F.lit(0).alias("h")))
    return both.groupBy("source").agg(F.sum("h").alias("hits"), F.sum(1 - F.col("h")).alias("misses"))


def request_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds from each request's receipt to its answer, joined by id, repeated rows once."""
    asked = table(spark, sf_dir, "chat_requests").select("request_id", "received_at").distinct()
    told = table(spark, sf_dir, "chat_responses").select("request_id", parse_instant(F.col("response_ts")).alias("at")).distinct()
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return told.where(F.col("at").isNotNull()).join(asked, "request_id").select("request_id", F.round((micros(F.col("at")) - micros(F.col("received_at"))) / F.lit(1000.0), 3).alias("latency_ms"))


def answer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all distinct responses as a stream of (request, position, word), counted per position."""
    told = table(spark, sf_dir, "chat_responses").where(F.col("response").isNotNull()).select("request_id", "response").distinct()
    return told.select(F.posexplode(F.split("response", " ")).alias("pos", "word")).groupBy("pos").agg(F.count("*").alias("n_words"), F.sum(F.length("word")).alias("n_chars"))


def exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts as exposition lines."""
    return metrics_text(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")), F.col("event_type"), F.col("n"), "events_total")


def qa_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and page hits of the five best pages for each question of qa."""
    pages = table(spark, sf_dir, "financebench_docs").groupBy("id").agg(F.max("content").alias("text"), F.max("metadata").alias("metadata"))
    qa = table(spark, sf_dir, "qa")
    ranked = bm25.scan_search(pages.select(F.col("id").alias("doc_id"), "text"), qa.select(F.col("financebench_id").alias("query_id"), F.col("question").alias("query")))
    named = ranked.join(pages.select(F.col("id").alias("doc_id"), F.get_json_object("metadata", "$.doc_name").alias("doc_name"), F.get_json_object("metadata", "$.page").cast("int").alias("page")), "doc_id")
    wanted = qa.select(F.col("financebench_id").alias("query_id"), "doc_name", F.transform("evidence", lambda e: e["evidence_page_num"]).alias("pages"))
    return retrieval_hits(named, wanted)


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user: events no more than six hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)) > 6 * 3600 * 1_000_000
    rows = table(spark, sf_dir, "events").withColumn("new", F.coalesce(gap, F.lit(True)).cast("int")).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("started"))


_ONCE = "(SELECT DISTINCT ON (line_item_id) * FROM extracted_line_items)"
_RANKED = bm25._SEARCH.format(where="").replace("FROM documents)", "FROM (SELECT id AS doc_id, max(content) AS text FROM financebench_docs GROUP BY id))")
SQL = {
    "page_headers": "SELECT coalesce(split_part(content, chr(10), 1) = '[Company: ' || company || ' | Filing: ' || (metadata->>'$.doc_name') || ' | Page: ' || (metadata->>'$.page') || '/' || (metadata->>'$.total_pages') || ' | Section: ' || (metadata->>'$.section') || ']', false) AS same, count(*) AS n_pages FROM (SELECT DISTINCT id, content, company, metadata FROM financebench_docs) GROUP BY 1",
    "graph_merge": f"SELECT doc_name, statement, raw_name, (list(value ORDER BY extracted_at DESC, line_item_id DESC))[1] AS value, (list(unit ORDER BY extracted_at, line_item_id))[1] AS unit, (list(category ORDER BY extracted_at, line_item_id))[1] AS category, count(*) AS n_merged FROM {_ONCE} GROUP BY ALL",
    "graph_constraints": "SELECT doc_name, count(*) AS n FROM filings GROUP BY doc_name HAVING count(*) > 1 OR doc_name IS NULL",
    "embedding_cache": "WITH d AS (SELECT source, loaded_at, sha256(text) AS k FROM documents WHERE text IS NOT NULL), c AS (SELECT DISTINCT k FROM d WHERE loaded_at < TIMESTAMP '2024-01-01') SELECT source, count(*) FILTER (k IN (SELECT k FROM c)) AS hits, count(*) FILTER (k NOT IN (SELECT k FROM c)) AS misses FROM d WHERE loaded_at >= TIMESTAMP '2024-01-01' GROUP BY source",
    "request_latency": "SELECT request_id, round((epoch_us(told_at) - epoch_us(received_at)) / 1000.0::DOUBLE, 3) AS latency_ms FROM (SELECT DISTINCT request_id, try_cast(replace(regexp_replace(response_ts, 'Z$', ''), 'T', ' ') AS TIMESTAMP) AS told_at FROM chat_responses) JOIN (SELECT DISTINCT request_id, received_at FROM chat_requests) USING (request_id) WHERE told_at IS NOT NULL",
    "answer_words": "SELECT pos, count(*) AS n_words, sum(length(word))::BIGINT AS n_chars FROM (SELECT unnest(range(len(w))) AS pos, unnest(w) AS word FROM (SELECT string_split(response, ' ') AS w FROM (SELECT DISTINCT request_id, response FROM chat_responses WHERE response IS NOT NULL))) GROUP BY pos",
    "exposition": "SELECT 'events_total{label=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type",
    "qa_hits": f"WITH r AS ({_RANKED}), m AS (SELECT id AS doc_id, max(metadata) AS metadata FROM financebench_docs GROUP BY id), j AS (SELECT q.financebench_id AS query_id, r.rank, m.metadata->>'$.doc_name' = q.doc_name AS doc, list_contains(list_transform(q.evidence, lambda e: e.evidence_page_num), (m.metadata->>'$.page')::INT) AS page FROM qa q LEFT JOIN r ON r.query_id = q.financebench_id LEFT JOIN m USING (doc_id)) SELECT query_id, max(coalesce(doc, false)::INT) AS doc_hit, max(coalesce(doc AND page, false)::INT) AS page_hit, round(coalesce(1.0::DOUBLE / min(rank) FILTER (doc AND page), 0), 6) AS page_rr FROM j GROUP BY query_id",
    "event_sessions": "SELECT user_id, session, count(*) AS n_events, min(ts) AS started FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600000000, true)::INT AS new FROM events)) GROUP BY user_id, session",
}
QUERIES = {f.__name__: f for f in (page_headers, graph_merge, graph_constraints, embedding_cache, request_latency, answer_words, exposition, qa_hits, event_sessions)}
