"""Totals of contributions and filings: sums, maps by key, spans of days and sets of forms, in one pass over the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(rows: DataFrame, person: str, amount: str, party: str, form: str, day: str) -> DataFrame:
    """One row per person: ``total`` and ``n``; ``parties``, a map of amounts by party, those without one under Unknown; ``forms``, a map of
    how often each form was met; ``span``, first to last day, empty without a day.

    All levels are grouping sets of one aggregation, combined before the shuffle; what is gathered per person is one entry a party and a form,
    never a row. A null amount adds nothing, a null form is not counted."""
    told = rows.select(F.col(person).alias("person"), F.col(amount).alias("amount"), F.coalesce(party, F.lit("Unknown")).alias("party"), F.col(form).alias("form"), F.col(day).alias("day"))
    sets = told.groupingSets([["person"], ["person", "party"], ["person", "form"]], "person", "party", "form").agg(
        F.grouping_id().alias("level"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"), F.min("day").alias("first"), F.max("day").alias("last"),
    )
    whole, by_party, by_form = (F.col("level") == x for x in (3, 1, 2))
    parties = F.collect_list(F.when(by_party, F.struct("party", F.coalesce("amount", F.lit(0.0)).alias("amount"))))
    forms = F.collect_list(F.when(by_form & F.col("form").isNotNull(), F.struct("form", "n")))
    out = sets.groupBy("person").agg(
        F.coalesce(F.max(F.when(whole, F.col("amount"))), F.lit(0.0)).alias("total"), F.max(F.when(whole, F.col("n"))).alias("n"), F.map_from_entries(F.array_sort(parties)).alias("parties"),
        F.map_from_entries(F.array_sort(forms)).alias("forms"), F.max(F.when(whole, F.col("first"))).alias("first"), F.max(F.when(whole, F.col("last"))).alias("last"),
    )
    return out.select(F.col("person").alias(person), "total", "n", "parties", "forms", F.coalesce(F.concat(F.col("first").cast("string"), F.lit(" to "), F.col("last").cast("string")), F.lit("")).alias("span"))
