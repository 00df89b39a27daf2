"""Changes to tables as functions: each takes the table as it is and returns its next version.

Keys compare null-safe where that matters; callers write the result to a new place and switch over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new, list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_newest(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """The row of the greatest stamp per key wins; of equal stamps the later arrival, that is the new one."""
    both = old.select("*", F.lit(0).alias("_new")).unionByName(new.select(*old.columns, F.lit(1).alias("_new")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(stamp).desc_nulls_last(), F.desc("_new")))
    return both.withColumn("_rank", rank).where(F.col("_rank") == 1).select(*old.columns)


def superseded(old: DataFrame, new: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """New rows that a stored one of a later stamp shuts out."""
    seen = old.groupBy(*keys).agg(F.max(stamp).alias("_seen"))
    return new.join(seen, list(keys)).where(F.col(stamp) < F.col("_seen")).drop("_seen").select(*new.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add rows whose key is not there yet."""
    return old.unionByName(new.join(old, list(keys), "left_anti").select(*old.columns))


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str], attempted: DataFrame | None = None) -> DataFrame:
    """Drop all rows of the keys that were attempted (those of ``new`` unless given) and add the new rows. A key that was
    attempted and has no new row is so healed away."""
    gone = (new if attempted is None else attempted).select(*keys).distinct()
    return old.join(gone, list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def delete_where(old: DataFrame, condition: Column, guard: Column | None = None) -> DataFrame:
    """Drop rows that meet the condition unless the guard holds; unknown counts as not met and as not guarded."""
    doomed = F.coalesce(condition, F.lit(False))
    if guard is not None:
        doomed = doomed & ~F.coalesce(guard, F.lit(False))
    return old.where(~doomed)


def delete_keys(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone, list(keys), "left_anti").select(*old.columns)


def cascade(children: DataFrame, parents: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Children whose parent is still there; ``on`` maps child columns to parent columns."""
    condition = [children[c] == parents[p] for c, p in on.items()]
    return children.join(parents, condition, "left_semi")


def fill_missing(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Take over new values only where the old one is null or an empty array."""
    kinds = dict(old.dtypes)
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(fresh, list(keys), "left")

    def value(c: str) -> Column:
        missing = F.col(c).isNull() | (F.size(c) == 0) if kinds[c].startswith("array") else F.col(c).isNull()
        return F.when(missing, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) if c in columns else F.col(c) for c in old.columns])


def update_changed(old: DataFrame, new: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Take over a new value where it differs, and say in ``changed`` which rows did."""
    fresh = new.select(*keys, F.col(column).alias("_new"), F.lit(True).alias("_there"))
    joined = old.join(fresh, list(keys), "left")
    differs = F.coalesce(F.col("_there"), F.lit(False)) & ~F.col(column).eqNullSafe(F.col("_new"))
    return joined.select(*[F.when(differs, F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in old.columns], differs.alias("changed"))


def recount(parents: DataFrame, edges: DataFrame, key: str, parent_key: str, direction: str = "direction") -> DataFrame:
    """Parents with ``upvotes`` and ``downvotes`` counted anew from the vote edges."""
    counts = edges.groupBy(F.col(key).alias(parent_key)).agg(F.count_if(F.col(direction) > 0).alias("upvotes"), F.count_if(F.col(direction) < 0).alias("downvotes"))
    rest = parents.drop("upvotes", "downvotes").join(counts, parent_key, "left")
    return rest.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("upvotes", "downvotes")})


def patch(old: DataFrame, patches: DataFrame, key: str, columns: Sequence[str], net: int = 5) -> DataFrame:
    """Apply pending patches whose up-votes lead by ``net``: each brings values for some columns, null for the rest."""
    passed = patches.where((F.col("status") == "pending") & (F.col("upvotes") - F.col("downvotes") >= net))
    fresh = passed.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("upvotes") - F.col("downvotes"))).alias(f"_new_{c}") for c in columns])
    joined = old.join(fresh, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])


def set_badge(badges: Column, name: str, value: Column) -> Column:
    """A map of badges with one of them set."""
    others = F.map_filter(badges, lambda k, _: k != name)
    return F.map_concat(F.coalesce(others, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<boolean>"))), F.create_map(F.lit(name), value))


def overwrite_guarded(old_value: Column, old_source: Column, new_value: Column, source: str, most: float) -> Column:
    """Keep a value from another source; refuse new values that are not finite or above ``most``."""
    refused = new_value.isNull() | F.isnan(new_value) | (new_value > most)
    return F.when(old_value.isNotNull() & ~old_source.eqNullSafe(F.lit(source)), old_value).when(refused, old_value).otherwise(new_value)
