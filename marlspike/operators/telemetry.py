"""Rollups of request logs: latency, percentiles, counters, gauges, cache and token usage, rate limits, cache replays."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

PERCENTILES = (50, 90, 95, 99)


def rate(part: Column, whole: Column) -> Column:
    """Percentage, 0 where the whole is 0; 2 places."""
    return F.round(F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0)), 2)


def summary(log: DataFrame, by: list[str], value: str, failed: Column) -> DataFrame:
    """Requests, failures, failure rate and mean, least and largest value per group."""
    return log.groupBy(*by).agg(F.count("*").alias("n_requests"), F.count_if(failed).alias("n_errors"), rate(F.count_if(failed), F.count("*")).alias("error_rate"),
                                F.round(F.avg(value), 4).alias("avg_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


#: Buckets between the least and the largest value of a group in the first pass of `nearest_rank`.
RANK_BUCKETS = 4096


def nearest_rank(log: DataFrame, by: str, value: str, percents: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """Percentiles by the rule sorted[min(int(p / 100 * n), n - 1)], 2 places: one row per group and percentile.

    Two passes: a histogram of RANK_BUCKETS buckets a group, counted map-side, finds the bucket that holds each rank; only the values
    of those buckets are then counted and ordered. So a task sees a group's buckets, or one bucket's values. Null and NaN values are left out.
    """
    rows = log.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
    span = rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    at = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * (RANK_BUCKETS - 1))).otherwise(F.lit(0)).cast("int")
    placed = rows.join(span, "g").withColumn("b", at)
    w = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = placed.groupBy("g", "b").agg(F.count("*").alias("c"), F.first("n").alias("n")).withColumn("upto", F.sum("c").over(w))
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("percentile"), F.least(F.floor(F.lit(p) / F.lit(100.0) * F.col("n")), F.col("n") - 1).alias("at")) for p in percents)))
    hit = hist.select("g", "b", "c", "upto", wanted.alias("w")).where((F.col("upto") > F.col("w.at")) & (F.col("upto") - F.col("c") <= F.col("w.at")))
    hit = hit.select("g", "b", F.col("w.percentile").alias("percentile"), (F.col("w.at") - F.col("upto") + F.col("c")).alias("at"))
    inside = placed.join(hit.select("g", "b").distinct(), ["g", "b"], "left_semi").groupBy("g", "b", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("g", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = inside.withColumn("upto", F.sum("c").over(w)).join(hit, ["g", "b"]).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("c") <= F.col("at")))
    return ranked.select(F.col("g").alias(by), "percentile", F.round("v", 2).alias("latency"))


def last_value(log: DataFrame, by: str, value: str, order: list[str]) -> DataFrame:
    """Latest value per group (a gauge)."""
    return log.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias("last_value"), F.sum(value).alias("total"))


def over_limit(log: DataFrame, client: str, ts: str, width: str, limit: int) -> DataFrame:
    """Tumbling windows in which a client sent more than `limit` requests."""
    return log.groupBy(client, F.window(ts, width).alias("w")).agg(F.count("*").alias("n_requests")).where(F.col("n_requests") > limit).select(client, F.col("w.start").alias("window_start"), "n_requests")


def ttl_replay(log: DataFrame, key: list[str], ts: str, ttl_seconds: int) -> DataFrame:
    """Hits and misses of a cache in which an entry lives `ttl_seconds` from its last access."""
    w = Window.partitionBy(*key).orderBy(ts)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1e6)
    age = seconds(F.col(ts)) - seconds(F.lag(ts).over(w))
    return log.select(*key, F.coalesce(age <= ttl_seconds, F.lit(False)).alias("hit"))


def lru_replay(log: DataFrame, tenant: str, key: str, order: list[str], capacity: int) -> DataFrame:
    """(tenant, hits, misses, evictions) of one least-recently-used cache per tenant, replayed in order.

    Rows are hashed on the tenant and sorted within the task, through which they stream: the memory is one cache's keys. Order
    within a tenant is the definition of the result, so a tenant is not split.
    """
    kind = log.schema[tenant].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cache, tally, out = None, OrderedDict(), [0, 0, 0], []
        begun = False
        for batch in batches:
            for who, what in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not begun or who != now:
                    if begun:
                        out.append((now, *tally))
                    now, cache, tally, begun = who, OrderedDict(), [0, 0, 0], True
                if what in cache:
                    cache.move_to_end(what)
                    tally[0] += 1
                else:
                    cache[what] = None
                    tally[1] += 1
                    if len(cache) > capacity:
                        cache.popitem(last=False)
                        tally[2] += 1
        if begun:
            out.append((now, *tally))
        yield pa.RecordBatch.from_pydict({tenant: [r[0] for r in out], "hits": [r[1] for r in out], "misses": [r[2] for r in out], "evictions": [r[3] for r in out]},
                                         schema=pa.schema([(tenant, arrow), ("hits", pa.int64()), ("misses", pa.int64()), ("evictions", pa.int64())]))

    ordered = log.select(tenant, F.col(key).cast("string").alias("k"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order))).repartition(tenant).sortWithinPartitions(tenant, *(f"o{i}" for i in range(len(order))))
    return ordered.select(tenant, "k").mapInArrow(run, f"{tenant} {kind}, hits bigint, misses bigint, evictions bigint")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses, repeated rows once, models by one spelling."""
    return table(spark, sf_dir, "chat_responses").select("request_id", F.translate(F.lower("model_used"), "_", "-").alias("model"), "cached", "latency_ms", "processing_time_ms", "usage", "response").distinct()


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all events."""
    return summary(_events(spark, sf_dir), [], "value", F.col("event_type") == "error")


def requests_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per event type."""
    return summary(_events(spark, sf_dir), ["event_type"], "value", F.col("event_type") == "error")


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of value per event type."""
    return nearest_rank(_events(spark, sf_dir), "event_type", "value")


def gauges_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value and total per event type."""
    return last_value(_events(spark, sf_dir), "event_type", "value", ["ts", "event_id"]).select("event_type", "last_value", F.round("total", 4).alias("total"))


def rate_limit_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which a user sent more than two events."""
    return over_limit(_events(spark, sf_dir), "user_id", "ts", "1 hour", 2)


def cache_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, cache hits and hit rate per model."""
    hit = F.coalesce(F.col("cached"), F.lit(False))
    return _answers(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n_answers"), F.count_if(hit).alias("n_hits"), rate(F.count_if(hit), F.count("*")).alias("hit_rate"))


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and mean latency per model."""
    return _answers(spark, sf_dir).groupBy("model").agg(F.sum("usage.prompt_tokens").alias("prompt_tokens"), F.sum("usage.completion_tokens").alias("completion_tokens"), F.sum("usage.total_tokens").alias("total_tokens"), F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"))


def running_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that a session has used before each of its answers."""
    rows = table(spark, sf_dir, "chat_responses").where(F.col("session_id").isNotNull()).select("request_id", "session_id", F.coalesce("usage.total_tokens", F.lit(0)).alias("t")).distinct()
    w = Window.partitionBy("session_id").orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("request_id", "session_id", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("used_before"))


def ttl_cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits per event type of a six-hour cache keyed by type and props.k."""
    log = _events(spark, sf_dir).select("event_type", F.get_json_object("props", "$.k").alias("k"), "ts")
    return ttl_replay(log, ["event_type", "k"], "ts", 6 * 3600).groupBy("event_type").agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def lru_cache_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, misses and evictions of each user's cache of 16 keys."""
    log = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    return lru_replay(log, "user_id", "k", ["ts", "event_id"], 16)


_ANSWERS = "(SELECT DISTINCT request_id, replace(lower(model_used), '_', '-') AS model, cached, latency_ms, processing_time_ms, usage, response FROM chat_responses)"
_SUM = "count(*) AS n_requests, count(*) FILTER (event_type = 'error') AS n_errors, round(count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*), 2) AS error_rate, round(avg(value), 4) AS avg_value, min(value) AS min_value, max(value) AS max_value"
SQL = {
    "latency_summary": f"SELECT {_SUM} FROM events",
    "requests_by_type": f"SELECT event_type, {_SUM} FROM events GROUP BY event_type",
    "latency_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, p AS percentile, round(value, 2) AS latency FROM r, (SELECT unnest([50, 90, 95, 99]) AS p) WHERE i = least(floor(p / 100.0::DOUBLE * n)::BIGINT, n - 1)",
    "gauges_last_value": "SELECT event_type, (SELECT value FROM events x WHERE x.event_type = e.event_type ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_value, round(sum(value), 4) AS total FROM events e GROUP BY event_type",
    "rate_limit_hits": "SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n_requests FROM events GROUP BY ALL HAVING count(*) > 2",
    "cache_usage": f"SELECT model, count(*) AS n_answers, count(*) FILTER (cached) AS n_hits, round(count(*) FILTER (cached) * 100.0::DOUBLE / count(*), 2) AS hit_rate FROM {_ANSWERS} GROUP BY model",
    "token_usage": f"SELECT model, sum(usage.prompt_tokens)::BIGINT AS prompt_tokens, sum(usage.completion_tokens)::BIGINT AS completion_tokens, sum(usage.total_tokens)::BIGINT AS total_tokens, round(avg(latency_ms), 4) AS avg_latency_ms FROM {_ANSWERS} GROUP BY model",
    "running_tokens": "SELECT request_id, session_id, coalesce(sum(t) OVER (PARTITION BY session_id ORDER BY request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before FROM (SELECT DISTINCT request_id, session_id, coalesce(usage.total_tokens, 0) AS t FROM chat_responses WHERE session_id IS NOT NULL)",
    "ttl_cache_replay": "WITH a AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type, props->>'$.k' ORDER BY ts) AS age FROM events) SELECT event_type, count(*) FILTER (coalesce(age <= 21600000000, false)) AS hits, count(*) FILTER (NOT coalesce(age <= 21600000000, false)) AS misses FROM a GROUP BY event_type",
}
QUERIES = {f.__name__: f for f in (latency_summary, requests_by_type, latency_percentiles, gauges_last_value, rate_limit_hits, cache_usage, token_usage, running_tokens, ttl_cache_replay, lru_cache_replay)}
