"""Structured Streaming forms of the log rollups, ingestion and caches."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import ChunkStore
from ..session import shared_dir, table


def windowed(stream: DataFrame, ts: str, by: list[str], value: str, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums per tumbling event-time window; with `late`, rows later than that are dropped and state is freed."""
    src = stream.withWatermark(ts, late) if late else stream
    return src.groupBy(F.window(ts, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sliding(stream: DataFrame, ts: str, by: list[str], width: str, slide: str, late: str) -> DataFrame:
    """Counts per sliding window."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(stream: DataFrame, ts: str, by: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key: rows no more than `gap` apart."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def first_seen(stream: DataFrame, key: list[str], ts: str, late: str) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def over_limit(stream: DataFrame, client: str, ts: str, width: str, limit: int, late: str | None = None) -> DataFrame:
    """Clients that send more than `limit` requests in a tumbling window."""
    src = stream.withWatermark(ts, late) if late else stream
    return src.groupBy(F.window(ts, width).alias("w"), client).agg(F.count("*").alias("n_requests")).where(F.col("n_requests") > limit).select(client, F.col("w.start").alias("window_start"), "n_requests")


class CachedLookups:
    """Lookups of a stream in per-tenant caches, replayed batch by batch; `cached_lookups` says how."""

    def __init__(self, rows: DataFrame, capacity: int, ttl_seconds: float):
        """`rows` is a stream of tenant, k, t (seconds)."""
        self.rows, self.capacity, self.ttl_seconds = rows, capacity, ttl_seconds

    def replay(self, batch: DataFrame, caches: DataFrame | None) -> DataFrame:
        """(tenant, k, hit, place, expires) after the lookups of `batch` in the state `caches` of the same columns.

        Lookups have `hit`; the others are the caches afterwards, `place` counting from the least recently used key. Rows are hashed
        on the tenant and sorted within the task, through which they stream: the memory is one cache's keys.
        """
        tenant, capacity, ttl = batch.columns[0], self.capacity, self.ttl_seconds
        kind = batch.schema[tenant].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, cache, begun = None, OrderedDict(), False
            schema = None

            def emitted(out: list[tuple]) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

            def kept() -> list[tuple]:
                return [(now, k, None, i, x) for i, (k, x) in enumerate(cache.items())]

            for part in batches:
                schema = pa.schema([(tenant, part.schema.field(0).type), ("k", pa.string()), ("hit", pa.bool_()), ("place", pa.int32()), ("expires", pa.float64())])
                out = []
                for who, k, t, place, expires in zip(*(c.to_pylist() for c in part.columns)):
                    if not begun or who != now:
                        if begun:
                            out += kept()
                        now, cache, begun = who, OrderedDict(), True
                    if place is not None:
                        cache[k] = expires
                        continue
                    t = float("nan") if t is None else t
                    old = cache.pop(k, None)
                    hit = old is not None and (ttl <= 0 or t < old)
                    cache[k] = old if hit else t + ttl
                    if len(cache) > capacity:
                        cache.popitem(last=False)
                    out.append((who, k, hit, None, None))
                yield emitted(out)
            if begun:
                yield emitted(kept())

        lookups = batch.select(tenant, "k", "t", F.lit(None).cast("int").alias("place"), F.lit(None).cast("double").alias("expires"))
        rows = lookups if caches is None else lookups.unionByName(caches.where(F.col("place").isNotNull()).select(tenant, "k", F.lit(None).cast("double").alias("t"), "place", "expires"))
        ordered = rows.repartition(tenant).sortWithinPartitions(tenant, F.col("place").asc_nulls_last(), F.col("t").asc_nulls_last(), F.col("k").asc_nulls_last())
        return ordered.mapInArrow(run, f"{tenant} {kind}, k string, hit boolean, place int, expires double")

    def run_to_end(self, path: str) -> None:
        """Replay everything that is there now: lookups below `path`/rows, the caches after each batch below `path`/caches.

        Both are written by batch, so that a batch taken again after a failure replaces what it left.
        """

        def write(batch: DataFrame, n: int) -> None:
            spark, schema = batch.sparkSession, f"{batch.columns[0]} {batch.schema[0].dataType.simpleString()}, k string, hit boolean, place int, expires double"
            self.replay(batch, spark.read.schema(schema).parquet(f"{path}/caches/{n - 1}") if n else None).write.mode("overwrite").parquet(f"{path}/caches/{n}")
            done = spark.read.schema(schema).parquet(f"{path}/caches/{n}")
            done.where(F.col("hit").isNotNull()).select(batch.columns[0], "k", "hit").write.mode("overwrite").parquet(f"{path}/rows/batch={n}")
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/caches/{n - 2}")  # batch n may be taken again, n - 1 no more
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

        self.rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()


def cached_lookups(stream: DataFrame, tenant: str, key: str, ts: str, capacity: int, ttl_seconds: float) -> CachedLookups:
    """Hit or miss of each lookup in a per-tenant cache with least-recently-used eviction and time to live.

    State per tenant is at most `capacity` keys, kept in a table. Rows of one batch are taken in time order, over all of a tenant's
    rows; a batch is what has arrived by then, so that only rows that come later than a batch are taken after it. Times to live of 0
    or less never end.
    """
    return CachedLookups(stream.select(tenant, F.col(key).cast("string").alias("k"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t")), capacity, ttl_seconds)


def run_to_end(stream: DataFrame | CachedLookups, path: str, mode: str) -> None:
    """Process everything that is there now, each micro-batch written below `path`/rows; complete results replace earlier ones.

    Other results are written by batch, so that a batch taken again after a failure replaces what it left.
    """
    if isinstance(stream, CachedLookups):
        return stream.run_to_end(path)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={n}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()


def ingest(stream: DataFrame, store: ChunkStore, progress: str, order: str | None = None) -> None:
    """Upsert a stream of rows into a store, batch by batch, up to what is there now."""
    stream.writeStream.foreachBatch(lambda batch, n: store.upsert(batch, order)).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


def _scratch(spark: SparkSession) -> str:
    """A new folder in the folder that all executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/[e]vents.parquet")


def stream_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, by a stream over the events files."""
    path = _scratch(spark)
    run_to_end(windowed(_events(spark, sf_dir), "ts", ["event_type"], "value", "1 day"), path, "complete")
    return spark.read.parquet(f"{path}/rows").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which a user sent more than two events, by a stream."""
    path = _scratch(spark)
    run_to_end(over_limit(_events(spark, sf_dir), "user_id", "ts", "1 hour", 2), path, "complete")
    return spark.read.parquet(f"{path}/rows")


def stream_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses of each user's cache of 16 keys living a day, by a stateful stream."""
    path = _scratch(spark)
    log = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k"))
    run_to_end(cached_lookups(log, "user_id", "k", "ts", 16, 86400.0), path, "append")
    return spark.read.parquet(f"{path}/rows").groupBy("user_id").agg(F.count_if(F.col("hit")).alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


SQL = {
    "stream_window_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_rate_limit": "SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n_requests FROM events GROUP BY ALL HAVING count(*) > 2",
}
QUERIES = {f.__name__: f for f in (stream_window_counts, stream_rate_limit, stream_cache)}
