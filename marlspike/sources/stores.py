"""Chunk stores as parquet tables: upsert, delete, count, reset, filters, and clean metadata."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROMOTED = ("company", "filing_year", "doc_type")


def sanitise(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Metadata as strings: null to empty, nested values to JSON, NUL characters dropped."""
    kinds = dict(df.dtypes)
    nested = lambda c: F.to_json(F.col(c)) if kinds[c].startswith(("array", "struct", "map")) else F.col(c).cast("string")
    return df.withColumns({c: F.translate(F.coalesce(nested(c), F.lit("")), "\x00", "") for c in columns})


def where(conditions: dict, metadata: str = "metadata", any_of: bool = False) -> Column:
    """A predicate from equality conditions: promoted columns by name, others by a JSON path; `$and` and `$or` nest."""
    parts = []
    for key, value in conditions.items():
        if key in ("$and", "$or"):
            inner = [where(v, metadata) for v in value]
            out = inner[0]
            for c in inner[1:]:
                out = (out & c) if key == "$and" else (out | c)
            parts.append(out)
        elif key in ("year", "doc_period"):
            parts.append(F.col("filing_year") == int(value))
        elif key in PROMOTED:
            parts.append(F.col(key) == value)
        else:
            parts.append(F.get_json_object(metadata, f"$.{key}") == str(value))
    if not parts:
        return F.lit(True)
    out = parts[0]
    for c in parts[1:]:
        out = (out | c) if any_of else (out & c)
    return F.coalesce(out, F.lit(False))


class ChunkStore:
    """A table of rows keyed by `id`, kept in numbered versions below one folder; readers see the last complete one."""

    def __init__(self, spark: SparkSession, path: str, schema: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.schema, self.partition_by = spark, path, schema, partition_by

    def _fs(self, path: str):
        """The file system and path object of `path`, whatever storage it lies on."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _versions(self) -> list[int]:
        fs, root = self._fs(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[1]))

    def read(self) -> DataFrame:
        """Rows of the last version; none yet is an empty table."""
        versions = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{versions[-1]}") if versions else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame) -> None:
        n = (self._versions() or [0])[-1] + 1
        staged = f"{self.path}/.{n}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*self.partition_by) if self.partition_by else df.write
        writer.parquet(staged)
        fs, at = self._fs(staged)
        if not fs.rename(at, self._fs(f"{self.path}/{n}")[1]):
            raise RuntimeError(f"version {n} of {self.path} could not be put in place")

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Insert `rows`, replacing rows of the same id; of several new rows of one id the one greatest in `order` stands."""
        names = [c for c in self.read().columns if c != "id"]
        best = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*names), F.col(order) if order else F.lit(1)).alias("v")).select("id", *(F.col(f"v.{c}").alias(c) for c in names))
        self._write(self.read().join(best.select("id"), "id", "left_anti").unionByName(best))

    def delete(self, ids: DataFrame) -> None:
        """Drop the rows whose id is in `ids`."""
        self._write(self.read().join(ids.select("id").distinct(), "id", "left_anti"))

    def reset(self) -> None:
        """Empty the table."""
        self._write(self.spark.createDataFrame([], self.schema))

    def count(self) -> int:
        return self.read().count()
