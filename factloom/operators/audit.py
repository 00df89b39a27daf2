"""Audits: buckets that must add up, and orders that must hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets(df: DataFrame, named: Mapping[str, Column], rest: str = "unclassified") -> DataFrame:
    """Count of rows per bucket, each row in the first whose condition holds, and of all rows."""
    out = F.lit(None).cast("string")
    for i, (name, condition) in enumerate(named.items()):
        out = F.when(condition, F.lit(name)) if i == 0 else out.when(condition, F.lit(name))
    counts = df.select(out.alias("b")).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("b") == n).alias(n) for n in named], F.count_if(F.col("b").isNull()).alias(rest))
    return counts.withColumn("adds_up", sum((F.col(n) for n in named), F.col(rest)) == F.col("total"))


def descending_breaks(df: DataFrame, group: str, pos: str, score: str) -> DataFrame:
    """Rows that score higher than the one before them in their group."""
    before = F.lag(score).over(Window.partitionBy(group).orderBy(pos))
    return df.withColumn("_before", before).where(F.col(score) > F.col("_before")).drop("_before")


def first_misplaced(df: DataFrame, group: str, pos: str, good: Column) -> DataFrame:
    """Groups in which a good row comes after one that isn't: (group, first bad position, last good position)."""
    sides = df.groupBy(group).agg(F.min(F.when(~good, F.col(pos))).alias("first_bad"), F.max(F.when(good, F.col(pos))).alias("last_good"))
    return sides.where("last_good > first_bad")


def compared(stored: DataFrame, served: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, verdict, fields): what a table holds against what its pages say, row by row and cell by cell. ``not served`` and
    ``not stored`` for keys of one side; ``differs`` with the columns that do, nulls being equal to nulls only; else ``agrees``. A key that is there
    twice on a side is ``ambiguous``. Every key has one verdict, so that counts add up to all keys."""
    def side(df: DataFrame, mark: str) -> DataFrame:
        # Of a key's rows one is kept, with their number: they are combined before they meet.
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{mark}_n"), F.min(F.struct(*columns)).alias(mark))

    both = side(stored, "stored").join(side(served, "served"), key, "full")
    fields = F.array_compact(F.array(*[F.when(~F.col(f"stored.{c}").eqNullSafe(F.col(f"served.{c}")), F.lit(c)) for c in columns]))
    verdict = (
        F.when((F.col("stored_n") > 1) | (F.col("served_n") > 1), "ambiguous").when(F.col("served_n").isNull(), "not served").when(F.col("stored_n").isNull(), "not stored")
        .when(F.size(fields) > 0, "differs").otherwise("agrees")
    )
    return both.select(key, verdict.alias("verdict"), F.when(verdict == "differs", fields).otherwise(F.array().cast("array<string>")).alias("fields"))
