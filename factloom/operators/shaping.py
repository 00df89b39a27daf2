"""Shapes of results: nested facts, leftovers, orders with several keys, daily snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed, lists


def nested_json(parents: DataFrame, children: DataFrame, key: str, columns: Sequence[str], name: str = "facts") -> DataFrame:
    """Parents with their children as a JSON array, sorted; ``[]`` for those without. A parent's children are one value, so they must fit one."""
    told = children.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias(name))
    return parents.join(told, key, "left").withColumn(name, F.coalesce(name, F.lit("[]")))


def distinct_in_first(df: DataFrame, group: str, pos: str, value: str, n: int) -> DataFrame:
    """(group, distinct): different values, nulls aside, within the first ``n`` positions of each group."""
    return df.groupBy(group).agg(F.count_distinct(F.when(F.col(pos) < n, F.col(value))).alias("distinct"))


def first_per_source(df: DataFrame, source: str, order: Sequence[str]) -> DataFrame:
    """The row of each source, whatever its case, that is least in the columns of ``order``; rows without a source are dropped. One combined
    aggregation: a source with very many rows is no group of its own."""
    least = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in df.columns if c not in order])).alias("_first")
    firsts = df.where(F.col(source).isNotNull()).groupBy(F.lower(source).alias("_source")).agg(least)
    return firsts.select(*[F.col(f"_first.{c}") for c in df.columns])


def oldest_left(df: DataFrame, done: DataFrame, key: str, stamp: str) -> DataFrame:
    """One row: how many rows are not done, and the oldest stamp among them."""
    return df.join(done.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("left"), F.min(stamp).alias("oldest"))


def passed_over(offered: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """What was offered and not chosen; a null key was never chosen."""
    return offered.join(chosen.select(key).distinct(), key, "left_anti")


def violations(rows: DataFrame, array: str, amount: str, good: Column) -> DataFrame:
    """One row: entries of an array column that break a rule (``good`` over the entry ``x``), and the amount of all entries."""
    each = rows.select("*", F.explode(array).alias("x"))
    return each.agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("violations"), F.sum(F.coalesce(F.col("x")[amount], F.lit(0.0))).alias("total"))


def collapsed_totals(rows: DataFrame, group: str, name: str, amount: str) -> DataFrame:
    """(group, total, n): the amount of each group's foundations less those that are the vehicle of another one in the group, by
    name and vehicle word; null where only vehicles are left, n of all. Equal names are one row before they meet."""
    named = rows.groupBy(group, lists.plain_name(F.col(name)).alias("plain")).agg(F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("n"))
    ends = F.array(*[F.lit(f" {w}") for w in fixed.VEHICLE_WORDS])
    parents = F.transform(F.filter(ends, lambda e: F.col("plain").endswith(e)), lambda e: F.left("plain", F.length("plain") - F.length(e)))
    children = named.select(group, "plain", F.explode(parents).alias("parent")).where("parent <> ''")
    vehicles = children.join(named.select(group, F.col("plain").alias("parent")), [group, "parent"], "left_semi").select(group, "plain").distinct()
    told = named.join(vehicles.withColumn("vehicle", F.lit(True)), [group, "plain"], "left")
    return told.groupBy(group).agg(F.sum(F.when(F.col("vehicle").isNull(), F.col("amount"))).alias("total"), F.sum("n").alias("n"))


def by_chain(*keys: Column | tuple[Column, str]) -> list[Column]:
    """Sort keys of a chain: a column ascending with nulls first, or (column, "desc") descending with nulls last."""
    return [k[0].desc_nulls_last() if isinstance(k, tuple) else k.asc_nulls_first() for k in keys]


def by_name(score: Column, name: Column) -> list[Column]:
    """Highest score first, none last, then names in the order of a dictionary rather than of code points."""
    return [score.desc_nulls_last(), F.collate(name, "UNICODE").asc()]


def snapshot(old: DataFrame, new: DataFrame, key: str, day: str) -> DataFrame:
    """A table of daily snapshots with one more: a second run of a day replaces the first, other days stay."""
    return old.join(new.select(key, day).distinct(), [key, day], "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def mentioned_others(headlines: DataFrame, people: DataFrame) -> DataFrame:
    """(headline, person): people other than its own whom a headline (headline, person, title) names in full. Titles are cut into runs of
    words as long as some name, which meet names by equal text."""
    lengths = [r[0] for r in people.select(F.size(_words(F.col("name"))).alias("n")).distinct().collect() if r[0] > 0]
    said = headlines.select("headline", F.col("person").alias("own"), _words(F.col("title")).alias("w"))

    def runs_of(n: int) -> Column:
        heads = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(0)))
        return F.transform(heads, lambda i: F.when(i > 0, F.array_join(F.slice("w", i, F.lit(n)), " ")))

    runs = F.flatten(F.array(*map(runs_of, lengths)))
    names = people.select(F.col("person"), F.array_join(_words(F.col("name")), " ").alias("run")).where("run <> ''")
    # A title of fewer words than a name has a run from place 0, which is null and meets no name.
    met = said.select("headline", "own", F.explode(F.array_distinct(runs)).alias("run")).join(names, "run")
    return met.where(~F.col("person").eqNullSafe(F.col("own"))).select("headline", "person").distinct()


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")
