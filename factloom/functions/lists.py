"""Arrays, maps and JSON of one row: parties, foundations, receipts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions.money import exact_usd


def plain_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]", " "), " +", " "))


def vehicles(foundations: Column, name: str = "name") -> Column:
    """Per foundation of an array, whether it is the vehicle of another in it: that one's name and a vehicle word."""
    names = F.transform(foundations, lambda f: plain_name(f[name]))
    ends = F.array(*[F.lit(f" {w}") for w in fixed.VEHICLE_WORDS])
    return F.transform(names, lambda child: F.exists(names, lambda parent: (parent != "") & F.exists(ends, lambda end: child == F.concat(parent, end))))


def collapsed_total(foundations: Column, amount: str, stored: Column) -> Column:
    """Sum of an amount over an array less vehicles; the stored total only where there is no array."""
    marked = F.arrays_zip(foundations.alias("f"), vehicles(foundations).alias("v"))
    total = F.aggregate(marked, F.lit(0.0), lambda a, x: a + F.when(x["v"], 0.0).otherwise(F.coalesce(x["f"][amount].cast("double"), F.lit(0.0))))
    return F.when(F.size(foundations) > 0, total).otherwise(F.coalesce(stored.cast("double"), F.lit(0.0)))


def party_code(key: Column) -> Column:
    """One code for all spellings of a party."""
    low = F.lower(F.trim(key))
    return F.when(low.isin(*fixed.NO_PARTY), "Unknown").when(low == "pac/other", "PAC/Other").when(low.rlike("^[a-z]{3}$"), F.upper(low)).otherwise(F.trim(key))


def party_buckets(breakdown: Column) -> Column:
    """Array of (amount, code), largest first, equal ones in the order of the map, from a map of spellings to amounts; amounts that are no number are left out."""
    entries = F.transform(F.map_entries(breakdown), lambda e: F.struct(party_code(e["key"]).alias("code"), e["value"].cast("double").alias("amount")))
    good = F.filter(entries, lambda e: e["amount"].isNotNull() & ~F.isnan(e["amount"]) & (F.abs(e["amount"]) < float("inf")))
    codes = F.array_distinct(F.transform(good, lambda e: e["code"]))

    def total(code: Column) -> Column:
        return F.aggregate(F.filter(good, lambda e: e["code"] == code), F.lit(0.0), lambda a, e: a + e["amount"])

    ordered = F.array_sort(F.transform(codes, lambda c, i: F.struct((-total(c)).alias("down"), i.alias("at"), c.alias("code"))))
    return F.transform(ordered, lambda b: F.struct((-b["down"]).alias("amount"), b["code"].alias("code")))


def top_party(breakdown: Column) -> Column:
    """Code of the largest bucket that names a party and is above 0; null without."""
    leaning = F.filter(party_buckets(breakdown), lambda b: ~b["code"].isin(*fixed.NO_LEAN) & (b["amount"] > 0))
    return F.get(leaning, 0)["code"]


def adds_up(breakdown: Column, total: Column) -> Column:
    """Whether several buckets sum to the total, to half a cent."""
    both = F.aggregate(party_buckets(breakdown), F.lit(0.0), lambda a, b: a + b["amount"])
    return (F.size(party_buckets(breakdown)) > 1) & (F.abs(both - total) < 0.005)


def whole_number(json: Column, path: str) -> Column:
    """A whole number inside JSON; null for anything else, never an error."""
    x = F.try_variant_get(F.try_parse_json(json), path, "double")
    return F.when(x == F.floor(x), x.cast("long"))


def receipts(*labelled: tuple[str, Column]) -> Column:
    """Lines ``label: value`` for the values there are."""
    return F.concat_ws("\n", *[F.when(v.isNotNull(), F.concat(F.lit(f"{label}: "), v)) for label, v in labelled])


def send_tier(kind: Column, points: Column) -> Column:
    """Place in the queue, 0 to 4, by what the candidate was refused for before and by whether it is on topic."""
    on = points > 0
    return F.when(kind == "person", 4).when(on & (kind == "blind"), 1).when(on, 0).when(kind == "blind", 3).otherwise(2)


def headline_lead(*ladder: tuple[Column, Column]) -> Column:
    """The text of the first (condition, text) that holds; null if none does."""
    out = None
    for condition, text in ladder:
        out = F.when(condition, text) if out is None else out.when(condition, text)
    return out


def labelled_money(breakdown: Column) -> Column:
    """Map of party code to its amount in full, so that money is never read as a count."""
    return F.map_from_entries(F.transform(party_buckets(breakdown), lambda b: F.struct(b["code"], exact_usd(b["amount"]))))
