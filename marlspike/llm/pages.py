"""Pages counted once: helpers shared by the operators on financebench_docs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_LIMIT_BYTES, materialise


def pages_once(df: DataFrame, id_col: str, *others: str) -> DataFrame:
    """One row per non-null id with columns `id_col` and `others`.

    Only ids are shuffled to find those that come more than once; their rows alone are merged (largest values stand), all
    others pass through where they are. Where the repeated ids are too many to broadcast, every row is merged instead.
    """
    src = df.where(F.col(id_col).isNotNull()).select(id_col, *others)
    merge = lambda d: d.groupBy(id_col).agg(F.max(F.struct(*others)).alias("_v")).select(id_col, *(F.col(f"_v.{c}").alias(c) for c in others))
    again = materialise(df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col))
    if again.count() * 64 > BROADCAST_LIMIT_BYTES:
        return merge(src)
    again = F.broadcast(again)
    return src.join(again, id_col, "left_anti").unionByName(merge(src.join(again, id_col, "left_semi")))
