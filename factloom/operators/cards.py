"""What a reader sees of a card: live figures over frozen ones, and nothing that the record can't bear.

A person's record is judged once per person, and the judgement joined to the cards: an impossible record withholds all political money, a person
without a grade has no score, on the card and in its text alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import dates, political, prose
from factloom.functions.money import currency
from factloom.functions.numeric import grade
from factloom.functions.text import event_signature
from factloom.operators.similarity import greedy_select, similar_pairs

#: Jaccard from which two headlines are one event to a reader, and cards among which the promoted ones are looked for.
ONE_EVENT, LOOKED_AT = 0.4, 400


def records(people: DataFrame, as_of_year: int) -> DataFrame:
    """(person, score, letter, political, withheld) of people (person, graded, score, total, first_year, born): the score and its letter
    only of those with a grade, the political total only where the record can be the person's, and the names of what is withheld."""
    impossible = dates.impossible_record(F.col("first_year"), F.col("born"), as_of_year)
    shown = F.when(F.coalesce("graded", F.lit(False)), F.col("score"))
    total = F.when(~impossible & (F.col("total") > 0), F.col("total"))
    withheld = F.array_compact(F.array(F.when(impossible, "political"), F.when(shown.isNull() & F.col("score").isNotNull(), "score")))
    return people.select("person", shown.alias("score"), grade(shown).alias("letter"), total.alias("political"), withheld.alias("withheld"))


def surfaced(cards: DataFrame, told: DataFrame) -> DataFrame:
    """(card, summary, chip, score, letter) of cards (card, person, tagged, summary, chip), with ``told`` of ``records``. The chip states the live
    total; the summary is empty where it would say what is withheld, else its political total and its score are the live ones, and an inside
    name that is left over withholds it. A card of a person who isn't there has neither score nor political money."""
    rows = cards.join(told, "person", "left")
    withheld = F.coalesce("withheld", F.array().cast("array<string>"))
    barred = F.array_contains(withheld, "political") | F.col("withheld").isNull()
    summary = F.when(barred, political.withhold_political(F.col("summary"))).otherwise(political.repair_total(F.col("summary"), F.col("chip"), F.col("political"), F.col("tagged")))
    rows = rows.withColumn("_said", F.when(F.col("score").isNull(), prose.withhold_any_score(summary)).otherwise(summary))
    rows = rows.withColumn("_said", prose.withhold_inside_score(prose.repair_score("_said", "score", "tagged")))
    chip = F.when(F.col("chip").isNotNull() & F.col("political").isNotNull(), F.concat(currency(F.col("political")), F.lit(" in political donations")))
    return rows.select("card", F.col("_said").alias("summary"), chip.alias("chip"), "score", "letter")


def beside(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """Two people of ``pairs`` (left, right) side by side, each with what may be said of them; a figure is compared (``larger``: left, right or
    even) only where both sides may state it."""
    def side(name: str) -> DataFrame:
        return told.select(*[F.col(c).alias(name if c == "person" else f"{name}_{c}") for c in told.columns])

    rows = pairs.join(side("left"), "left").join(side("right"), "right")

    def larger(c: str) -> Column:
        a, b = F.col(f"left_{c}"), F.col(f"right_{c}")
        return F.when(a > b, "left").when(a < b, "right").when(a == b, "even").alias(f"larger_{c}")

    return rows.select("left", "right", *[f"{s}_{c}" for c in ("score", "letter", "political", "withheld") for s in ("left", "right")], larger("score"), larger("political"))


def top_slice(cards: DataFrame, points: Column, count: int, looked_at: int = LOOKED_AT) -> DataFrame:
    """(id, place): the ``count`` cards (id, headline, stamp) with most points that tell of different events, newest first of equal points, then by id.
    A card like one promoted before it is passed over, not dropped. They are looked for among the ``looked_at`` best, a sorted limit; more are looked
    at only if these hold fewer events than asked for."""
    order = [F.desc("points"), F.desc(F.coalesce("stamp", F.lit(0).cast("timestamp"))), F.asc("id")]
    rows = cards.select("id", "headline", F.col("stamp").cast("timestamp").alias("stamp"), points.alias("points"))
    while True:
        best = rows.orderBy(*order).limit(looked_at).select("id", "headline", F.struct((-F.col("points")).alias("down"), (-F.unix_micros(F.coalesce("stamp", F.lit(0).cast("timestamp")))).alias("late"), "id").alias("rank")).checkpoint()
        sets = best.select(F.col("id").alias("key"), F.array_sort(event_signature(F.col("headline"))).alias("tokens"))
        taken = greedy_select(best.select(F.col("id").alias("key"), "rank"), similar_pairs(sets, ONE_EVENT))
        top = taken.join(best.select(F.col("id").alias("key"), "rank"), "key").orderBy("rank").limit(count).agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("all"))
        found = top.select(F.posexplode("all").alias("at", "x")).select(F.col("x.key").alias("id"), (F.col("at") + 1).alias("place"))
        if best.count() < looked_at or found.count() == count:
            return found
        looked_at *= 4


def with_facts(people: DataFrame, facts: DataFrame, key: str, kind: str, unwanted: Sequence[str]) -> DataFrame:
    """People with each of their facts of a kind that is wanted; who has no fact, or none that is wanted, isn't there."""
    return people.join(facts.where(~F.col(kind).isin(*unwanted)), key)
