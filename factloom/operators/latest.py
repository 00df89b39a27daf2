"""Newest row per key, and de-duplication of facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    """One row per key with the values of its greatest ``order``; one aggregation, combined before the shuffle. The
    order columns should end in a unique one."""
    values = [c for c in df.columns if c not in keys] if values is None else list(values)
    kept = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    best = df.groupBy(*keys).agg(F.max(kept).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.v{i}").alias(c) for i, c in enumerate(values)])


def at_maximum(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """All rows whose ``order`` equals the greatest of their key, ties included."""
    top = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(order).alias("_top"))
    meet = F.col(order) == F.col("_top")
    for k in keys:
        meet = meet & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(top, meet).select(*df.columns)


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], exempt: Column | None = None) -> DataFrame:
    """First row per key in ``order``; rows that ``exempt`` marks all stay."""
    if exempt is None:
        return first_per(df, keys, order)
    # Asked for alone, the first of each key is cut down to before the shuffle; exempt rows need none.
    marked = df.withColumn("_exempt", F.coalesce(exempt, F.lit(False)))
    return first_per(marked, keys, order).where("NOT _exempt").unionByName(marked.where("_exempt")).drop("_exempt")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key in ``order``."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def pick_by_kind(df: DataFrame, keys: Sequence[str], kind: str, value: str, order: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """One row per key with the newest value of each kind in a column of its own."""
    def newest(k: str) -> Column:
        return F.max(F.when(F.col(kind) == k, F.struct(*order, F.col(value).alias("_v"))))["_v"].alias(k)

    return df.groupBy(*keys).agg(*[newest(k) for k in kinds])


def agreed(values: Column) -> Column:
    """The one distinct value of a group, or null if there are several."""
    seen = F.collect_set(values)
    return F.when(F.size(seen) == 1, F.get(seen, 0))
