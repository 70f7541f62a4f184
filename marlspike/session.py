"""Session helpers: tables, checkpoints, guarded broadcasts and input spread."""

from __future__ import annotations

import tempfile
import zipfile
from functools import reduce
from operator import add
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A derived side is broadcast only when its counted size stays under this many bytes.
BROADCAST_LIMIT_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of `spark.checkpoint.dir`; where it is unset, a temporary one in local mode, an error on a cluster."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`. A driver's own folder would do in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="marlspike-ckpt-")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """`df` with a broadcast hint if its measured size fits `limit`, otherwise `df` itself (a shuffle join).

    Measured: rows times `row_bytes` (the fixed part of a row), and the bytes of its text columns. `df` must be cheap to read: a
    checkpointed or written table.
    """
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    n, chars = df.agg(F.count("*"), F.coalesce(F.sum(reduce(add, texts, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n * row_bytes + chars <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a compute-heavy input only when its files give fewer splits than there are cores.

    Meant for plans without shuffles: of others, asking for the number of partitions would run stages.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    if have >= want:
        return df
    return df.repartition(want * 2, *keys)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application, so that they need no copy of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="marlspike-src-")) / "marlspike_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
