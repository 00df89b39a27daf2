"""Who a goal is for: places and fields by keyword, people by place, field and means."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import latest


def meant(text: Column, keywords: Mapping[str, str]) -> Column:
    """Array of the distinct values whose expressions a text meets."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(k), F.lit(v)) for k, v in keywords.items()])))


def matches(goals: DataFrame, people: DataFrame, most: int = 12, means: float = 10.0) -> DataFrame:
    """(goal, person, points, place): the ``most`` best people of each goal (goal, places, fields). Of people (person, place,
    fields, billions, score): two points for a place of the goal, one for each of its fields, one for ``means`` billions or
    more; none without points; then by billions, score and person. Null arrays are empty.

    Goals of equal places and fields have the same people, so each such kind is judged once. People meet kinds by equal places
    and by equal fields; who has nothing but means can only be among the best with the most of it, so ``most`` of those are held
    against every kind."""
    none = F.array().cast("array<string>")
    tidy = {c: F.array_sort(F.array_distinct(F.coalesce(c, none))) for c in ("places", "fields")}
    asked = goals.select("goal", *[v.alias(c) for c, v in tidy.items()]).withColumn("kind", F.struct("places", "fields"))
    kinds = asked.select("kind", "places", "fields").distinct()
    people = people.withColumn("fields", F.array_sort(F.array_distinct(F.coalesce("fields", none))))
    order = [F.coalesce("billions", F.lit(0.0)).desc(), F.coalesce("score", F.lit(0.0)).desc(), F.asc("person")]
    # People of one place, the same fields and like means have the same points for any goal: only the best of each such class count.
    people = latest.first_per(people.withColumn("_able", F.coalesce(F.col("billions") >= means, F.lit(False))), ["place", "fields", "_able"], order, most).drop("_able")
    by_place = kinds.select("kind", F.explode("places").alias("place")).join(people.select("person", "place"), "place").select("kind", "person")
    theirs = people.select("person", F.explode("fields").alias("field"))
    by_field = kinds.select("kind", F.explode("fields").alias("field")).join(theirs, "field").select("kind", "person")
    rich = [r["person"] for r in people.where(F.col("billions") >= means).orderBy(*order).limit(most).select("person").collect()]
    number = people.schema["person"].dataType
    of_means = kinds.select("kind", F.explode(F.array(*[F.lit(p).cast(number) for p in rich]).cast(f"array<{number.simpleString()}>")).alias("person"))
    pairs = by_place.unionByName(by_field).unionByName(of_means).distinct()
    both = pairs.join(people, "person").select("kind", "person", "place", "fields", "billions", "score")
    here = F.coalesce(F.array_contains("kind.places", F.col("place")), F.lit(False)).cast("int")
    able = F.coalesce(F.col("billions") >= means, F.lit(False)).cast("int")
    scored = both.withColumn("points", 2 * here + F.size(F.array_intersect("fields", "kind.fields")) + able).where("points > 0")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("points"), *order)).cast("long")
    best = scored.select("kind", "person", "points", place.alias("place")).where(F.col("place") <= most)
    # One row a kind, so that a kind of very many goals is no group of that size times its people.
    listed = best.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("place", "person", "points"))).alias("best"))
    return asked.where(F.col("goal").isNotNull()).select("goal", "kind").join(listed, "kind").select("goal", F.explode("best").alias("b")).select("goal", "b.person", "b.points", "b.place")
