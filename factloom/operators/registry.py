"""Facts read by key: a registry says where a key's value is and of what type, and every fact is read once.

Values are JSON texts, or JSON texts in a JSON string, as they come when something was encoded twice. A value is taken only if it is of
its type as written: a number in quotes is no number, true is not 1. What can't be read goes to quarantine with a reason. All is one
aggregation, so the order in which facts arrive says nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.lists import collapsed_total

#: Largest whole number that a double holds without a gap.
SAFE = 2**53 - 1
_NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


@dataclass(frozen=True)
class Kind:
    """Where a fact's value is inside its JSON, its type (number, whole, text or list), and the least and greatest that it may be."""

    path: str
    type: str
    least: float | None = None
    most: float | None = None


def parsed(value: Column) -> Column:
    """A JSON text as a variant, decoded once more where it is a string that holds JSON; null for anything else."""
    once = F.try_parse_json(value)
    again = F.try_parse_json(F.try_variant_get(once, "$", "string"))
    return F.when(F.schema_of_variant(once) == "STRING", F.coalesce(again, once)).otherwise(once)


def number(json: Column, path: str) -> Column:
    """A number that is written as one; null for text, true and false."""
    kind = F.schema_of_variant(F.try_variant_get(json, path, "variant"))
    return F.when(kind.rlike(_NUMBER), F.try_variant_get(json, path, "double"))


def whole(json: Column, path: str) -> Column:
    """A whole number that is written as a number and that a double holds exactly."""
    x = number(json, path)
    return F.when((x == F.floor(x)) & (F.abs(x) <= SAFE), x.cast("long"))


def text(json: Column, path: str) -> Column:
    """A text, trimmed; null for an empty one and for numbers."""
    kind = F.schema_of_variant(F.try_variant_get(json, path, "variant"))
    return F.when(kind == "STRING", F.nullif(F.trim(F.try_variant_get(json, path, "string")), F.lit("")))


def _read(json: Column, kind: Kind) -> Column:
    if kind.type == "list":
        return F.try_variant_get(json, kind.path, "array<variant>")
    return {"number": number, "whole": whole, "text": text}[kind.type](json, kind.path)


def _reason(json: Column, kind: Kind) -> Column:
    """Why a fact can't be read; null if it can."""
    value = _read(json, kind)
    size = F.size(value) if kind.type == "list" else F.length(value) if kind.type == "text" else value
    out = F.when(json.isNull(), "not json").when(F.try_variant_get(json, kind.path, "variant").isNull(), "missing").when(value.isNull(), "wrong type")
    if kind.least is not None:
        out = out.when(size < kind.least, "too small")
    if kind.most is not None:
        out = out.when(size > kind.most, "too large")
    return out


def read(facts: DataFrame, kinds: Mapping[str, Kind], person: str = "person", key: str = "fact_key", value: str = "value", stamp: str = "stamp") -> tuple[DataFrame, DataFrame]:
    """(one row per person with a typed column for each key of the registry, the newest that can be read; quarantine: the facts
    that can't, with ``reason``). Of equal stamps the greater text counts. A person all of whose facts are in quarantine has a row of nulls."""
    json = facts.withColumn("_json", parsed(F.col(value)))
    reason = F.lit("unknown key")
    for name, kind in kinds.items():
        reason = F.when(F.col(key) == name, _reason(F.col("_json"), kind)).otherwise(reason)
    marked = json.withColumn("_reason", reason)

    def newest(name: str, kind: Kind) -> Column:
        good = (F.col(key) == name) & F.col("_reason").isNull()
        # Lists of variants can't be compared: the text they are in decides, and they come back out of it.
        return F.max(F.when(good, F.struct(F.col(stamp).alias("at"), F.col(value).alias("said"))))["said"].alias(name)

    said = marked.groupBy(person).agg(*[newest(name, kind) for name, kind in kinds.items()])
    typed = said.select(person, *[_read(parsed(F.col(name)), kind).alias(name) for name, kind in kinds.items()])
    return typed, marked.where("_reason is not null").withColumn("reason", F.col("_reason")).drop("_json", "_reason")


#: Smallest sum of curated giving that counts, and what a period looks like.
LEAST_CURATED, PERIOD = 1e6, r"^since \d{4}$"


def philanthropy(facts: DataFrame, person: str = "person", assets: str = "assets", grants: str = "grants") -> DataFrame:
    """One row per person of facts (person, fact_key, fact_type, value, stamp): ``pledge``; ``giving`` and ``held``, grants and assets
    of the newest foundations fact, vehicles counted once; ``foundations``, their number; and of the newest curated giving that is a
    number of a million at least over a period with a source: ``amount``, ``period``, ``source`` and ``annual``, null where that is no number above 0."""
    json = parsed(F.col("value"))
    rows = facts.select(
        person, "stamp", F.col("fact_key").alias("k"), F.col("fact_type").alias("t"), "value",
        number(json, "$.cumulativeGiving").alias("amount"), text(json, "$.periodLabel").alias("period"), text(json, "$.source").alias("source"), number(json, "$.annualGiving").alias("annual"),
        F.try_variant_get(json, "$.foundations", f"array<struct<name string, {assets} double, {grants} double>>").alias("list"),
        number(json, f"$.{assets}").alias("stored_assets"), number(json, f"$.{grants}").alias("stored_grants"),
    )
    pledged = (F.col("k") == "giving_pledge") | (F.col("t") == "giving_pledge")
    curated = ~pledged & (F.col("k") == "total_giving")
    good = curated & (F.col("amount") >= LEAST_CURATED) & (F.col("amount") < float("inf")) & F.col("period").rlike(PERIOD) & F.col("source").isNotNull()
    held, given = collapsed_total(F.col("list"), assets, F.col("stored_assets")), collapsed_total(F.col("list"), grants, F.col("stored_grants"))
    funds = ~pledged & ~curated & (F.col("t") == "philanthropy") & (F.col("list").isNotNull() | (held > 0) | (given > 0))
    annual = F.when((F.col("annual") > 0) & (F.col("annual") < float("inf")), F.col("annual"))
    told = rows.groupBy(person).agg(
        F.coalesce(F.bool_or(pledged), F.lit(False)).alias("pledge"),
        F.max(F.when(good, F.struct("stamp", "value", "amount", "period", "source", annual.alias("annual")))).alias("own"),
        F.max(F.when(funds, F.struct("stamp", "value", given.alias("giving"), held.alias("held"), F.coalesce(F.size("list"), F.lit(0)).alias("n")))).alias("funds"),
    )
    return told.select(
        person, "pledge", F.coalesce("funds.giving", F.lit(0.0)).alias("giving"), F.coalesce("funds.held", F.lit(0.0)).alias("held"),
        F.coalesce(F.when(F.col("funds.n") > 0, F.col("funds.n")), F.lit(0)).alias("foundations"), "own.amount", "own.period", "own.source", "own.annual",
    )


def counts_toward_score(value: Column) -> Column:
    """Whether a fact has verified records of its own: a whole number of one at least, and no more than the records there are, if their
    number is a number."""
    json = parsed(value)
    verified, n = whole(json, "$.employerVerifiedCount"), number(json, "$.count")
    return F.coalesce((verified >= 1) & (n.isNull() | (verified <= n)), F.lit(False))


def quarantine_entries(value: Column) -> Column:
    """The entries of a quarantine row, each with its section, candidate, what was kept and the number of its disagreements; null, never an
    empty list, where any of them can't be read."""
    entries = F.try_variant_get(parsed(value), "$.entries", "array<variant>")
    read_ = F.transform(entries, lambda e: F.struct(
        F.when(F.schema_of_variant(F.try_variant_get(e, "$.section", "variant")) == "STRING", F.try_variant_get(e, "$.section", "string")).alias("section"),
        F.when(F.schema_of_variant(F.try_variant_get(e, "$.candidate", "variant")) == "STRING", F.try_variant_get(e, "$.candidate", "string")).alias("candidate"),
        F.try_variant_get(e, "$.kept", "string").alias("kept"), F.size(F.try_variant_get(e, "$.disagreements", "array<variant>")).alias("disagreements"),
    ))
    good = F.forall(read_, lambda e: F.coalesce(e["section"].isNotNull() & e["candidate"].isNotNull() & e["kept"].isin("previous", "withheld") & (e["disagreements"] > 0), F.lit(False)))
    return F.when((F.size(entries) > 0) & good, read_)
