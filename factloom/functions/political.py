"""Political money in prose: stale totals restated, claims withheld, party amounts audited. Column functions only.

Each of them refuses on doubt: a text comes back as it was, or not at all.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions.lists import party_code
from factloom.functions.money import currency, one_digit, prose_amounts

#: Characters between a figure and the spending that it is taken to be, within a sentence.
REACH = 120
_END = "\u0000"


def _said(digits: Column, unit: Column) -> Column:
    """Struct of a written figure: its value, half of the place of its last digit, and its decimals; null for none and for 0."""
    plain = F.regexp_replace(digits, ",", "")
    scale = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.UNITS.items() for x in kv]), F.lower(unit)), F.lit(1.0))
    decimals = F.length(F.regexp_extract(plain, r"\.(\d+)$", 1))
    value = plain.try_cast("double") * scale
    return F.when(value > 0, F.struct(value.alias("value"), (F.pow(F.lit(10.0), -decimals) * scale / 2).alias("half"), decimals.alias("decimals")))


def _in_totals(part: Column) -> Column:
    """Figures of one sentence that are written as totals; none where it speaks of a relative."""
    shape = F.lit(rf"(?i)({fixed.TOTAL_BEFORE})?({fixed.MONEY_IN_PROSE})(?=({fixed.TOTAL_AFTER})?)")
    names = ("before", "whole", "digits", "gap", "unit", "after")
    found = F.arrays_zip(*[F.regexp_extract_all(part, shape, F.lit(i + 1)).alias(name) for i, name in enumerate(names)])
    totals = F.filter(found, lambda x: (x["before"] != "") | (x["after"] != ""))
    read = F.transform(totals, lambda x: F.struct(
        F.when(x["unit"] == "", F.rtrim(x["whole"])).otherwise(x["whole"]).alias("whole"), x["before"].alias("before"), x["unit"].alias("unit"),
        F.when(x["unit"] == "", "").otherwise(x["gap"]).alias("gap"), _said(x["digits"], x["unit"]).alias("said"),
    ))
    return F.when(part.rlike(rf"(?i){fixed.RELATIVES}"), F.slice(read, 1, 0)).otherwise(F.filter(read, lambda x: x["said"].isNotNull()))


def _sentences(text: Column) -> Column:
    """Sentences with the white space before them, so that together they are the text."""
    return F.split(text, r"(?<=[.!?])(?=\s)")


def total_figures(text: Column) -> Column:
    """Values that a text states as totals of political donations."""
    return F.coalesce(F.flatten(F.transform(_sentences(text), lambda s: F.transform(_in_totals(s), lambda x: x["said"]["value"]))), F.array().cast("array<double>"))


def frozen_total(chip: Column) -> Column:
    """The figure of a chip, as it was frozen; null for any other chip."""
    return _said(F.nullif(F.regexp_extract(chip, rf"(?i){fixed.TOTAL_CHIP}", 1), F.lit("")), F.regexp_extract(chip, rf"(?i){fixed.TOTAL_CHIP}", 2))


def _styled(live: Column, figure: Column) -> Column:
    """The live total as the author of the stale one would write it."""
    unit, gap, said = figure["unit"], figure["gap"], figure["said"]
    long = F.length(unit) > 1

    def large(scale: float, word: str, letter: str) -> Column:
        number = F.concat(F.lit("$"), F.regexp_replace(one_digit(live / scale), r"\.0$", ""))
        return F.concat(number, F.when(long, F.concat(gap, F.lit(word))).when(unit == "", f" {word}").otherwise(letter))

    thousands = F.format_string("$%.0f", live / 1e3)
    grouped = F.concat(F.lit("$"), F.format_number(F.round(live / 1e3) * 1e3, 0))
    digits = F.least(said["decimals"], F.lit(2))
    plain = F.when(digits == 0, F.format_number(live, 0)).when(digits == 1, F.format_number(live, 1)).otherwise(F.format_number(live, 2))
    return (
        F.when(live >= 1e9, large(1e9, "billion", "B"))
        .when(live >= 1e6, large(1e6, "million", "M"))
        .when(live < 1e3, currency(live))
        .when(F.lower(unit).isin("k", "thousand"), F.concat(thousands, F.when(long, F.concat(gap, F.lit("thousand"))).otherwise("K")))
        .when((said["value"] >= 1e3) & ((said["decimals"] == 0) | (unit != "")), grouped)
        .otherwise(F.concat(F.lit("$"), plain))
    )


def repair_total(text: Column, chip: Column, live: Column, people: Column) -> Column:
    """A text whose one total of political donations is the frozen chip's gets the live total, in the author's unit. It stays
    as it is unless one person is tagged; chip and live total are known and read differently; the text states one total and no relative's;
    neither its sentence nor the next judges a size; the total is the chip's within half a step of its last digit; and the new wording reads back as the live chip."""
    parts = F.transform(_sentences(text), lambda s: F.struct(s.alias("text"), _in_totals(s).alias("totals")))

    def of(parts: Column) -> Column:
        at = F.array_position(F.transform(parts, lambda p: F.size(p["totals"]) > 0), F.lit(True)).cast("int")
        sentence, follows = F.get(parts, at - 1)["text"], F.regexp_extract(F.coalesce(F.get(parts, at)["text"], F.lit("")), r"^\s*[^.!?]*[.!?]?", 0)
        figure = F.get(F.get(parts, at - 1)["totals"], 0)
        anchor, said = frozen_total(chip), figure["said"]
        new = _styled(live, figure)
        back = F.get(total_figures(F.concat(F.lit("political donations total "), new)), 0)
        alike = (currency(said["value"]) == currency(anchor["value"])) | (anchor["value"] < 1e3)
        near = F.abs(said["value"] - anchor["value"]) <= F.greatest(said["half"], F.lit(0.005)) * 1.0001
        judged = sentence.rlike(rf"(?i){fixed.SIZE_WORDS}") | follows.rlike(rf"(?i){fixed.SIZE_WORDS}")
        sure = (
            (people == 1) & live.isNotNull() & ~F.isnan(live) & (live > 0) & (live < float("inf")) & anchor.isNotNull() & (currency(anchor["value"]) != currency(live))
            & (F.aggregate(parts, F.lit(0), lambda n, p: n + F.size(p["totals"])) == 1) & ~judged & alike & near & (currency(back) == currency(live))
        )
        # The figure is put in at the place of its clause: after what stands before it, if that is what marks it.
        old, fresh = F.concat(figure["before"], figure["whole"]), F.concat(figure["before"], new)
        places = F.split(sentence, F.concat(F.lit(r"\Q"), old, F.lit(r"\E(?![\w,]|\.\d)")), -1)
        marked = F.when(figure["before"] != "", F.lit(0)).otherwise(F.array_position(F.transform(places, lambda x, i: (i > 0) & x.rlike(rf"(?i)^{fixed.TOTAL_AFTER}")), F.lit(True)).cast("int") - 2)
        n = F.greatest(marked, F.lit(0)) + 1
        ahead = F.substring(sentence, F.lit(1), F.aggregate(F.slice(places, F.lit(1), n), F.lit(0), lambda acc, x: acc + F.length(x)) + (n - 1) * F.length(old))
        restated = F.concat(ahead, fresh, F.substring(sentence, F.length(ahead) + F.length(old) + 1, F.length(sentence)))
        whole = F.array_join(F.transform(parts, lambda p, i: F.when(i == at - 1, restated).otherwise(p["text"])), "")
        return F.when(F.coalesce(sure, F.lit(False)), whole).otherwise(text)

    return F.coalesce(F.get(F.transform(F.array(parts), of), 0), text)


def withhold_political(text: Column) -> Column:
    """The empty text where a figure of money and political spending stand within reach of each other in one sentence."""
    marked = F.regexp_replace(text, r"([.!?])\s+(?=[A-Z])", f"$1{_END}")
    gap = rf"[^\x00]{{0,{REACH}}}"
    claim = rf"(?i)(?:{fixed.ANY_MONEY}{gap}{fixed.POLITICAL_SPENDING}|{fixed.POLITICAL_SPENDING}{gap}{fixed.ANY_MONEY})"
    return F.when(marked.rlike(claim), "").otherwise(text)


def _named(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out once, however often it is used: an array of one, transformed, is a name for its element."""
    return F.get(F.transform(F.array(value), of), 0)


def _taken(pool: Column, amount: Column) -> Column:
    """Struct of whether a pool of amounts has one, to half a cent, and the pool without its first such."""

    def of(at: Column) -> Column:
        rest = F.concat(F.slice(pool, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(pool, at + 1, F.size(pool)))
        return F.struct((at > 0).alias("ok"), F.when(at > 0, rest).otherwise(pool).alias("pool"))

    return _named(F.array_position(F.transform(pool, lambda v: F.abs(v - amount) < 0.005), F.lit(True)).cast("int"), of)


def party_groups(breakdown: Column) -> Column:
    """Array of (code, amount, members): spellings of one party together, refunds subtracted, in the order of the map."""
    entries = F.transform(F.map_entries(breakdown), lambda e: F.struct(party_code(e["key"]).alias("code"), e["value"].cast("double").alias("amount")))
    numbers = F.filter(entries, lambda e: e["amount"].isNotNull() & ~F.isnan(e["amount"]) & (F.abs(e["amount"]) < float("inf")))

    def grouped(good: Column) -> Column:
        def group(code: Column) -> Column:
            def of(own: Column) -> Column:
                return F.struct(code.alias("code"), F.aggregate(own, F.lit(0.0), lambda a, x: a + x).alias("amount"), F.filter(own, lambda x: x > 0).alias("members"))

            return _named(F.transform(F.filter(good, lambda e: e["code"] == code), lambda e: e["amount"]), of)

        return F.transform(F.array_distinct(F.transform(good, lambda e: e["code"])), group)

    return _named(numbers, grouped)


def party_prose(text: Column, breakdown: Column, total: Column) -> Column:
    """Struct of a verdict on how prose states the amounts of a breakdown, the codes that are missing, and their sum.

    Amounts of the text are a pool, each good for one claim: the total first, then each group's amount, or else all of its members.
    no-data, too-few-buckets, no-total-cited, clean, thin (the total and no bucket), or drops-bucket."""
    none = F.array().cast("array<struct<code:string,amount:double>>")

    def step(acc: Column, g: Column) -> Column:
        start = F.struct(F.lit(True).alias("ok"), acc["pool"].alias("pool"))

        def member(a: Column, m: Column) -> Column:
            return _named(_taken(a["pool"], m), lambda t: F.struct((a["ok"] & t["ok"]).alias("ok"), t["pool"].alias("pool")))

        def of(tries: Column) -> Column:
            merged, each = tries["merged"], tries["each"]
            apart = (F.size(g["members"]) > 0) & each["ok"]
            pool = F.when(merged["ok"], merged["pool"]).when(apart, each["pool"]).otherwise(acc["pool"])
            lost = F.concat(acc["missing"], F.array(F.struct(g["code"].alias("code"), g["amount"].alias("amount"))))
            return F.struct(pool.alias("pool"), F.when(merged["ok"] | apart, acc["missing"]).otherwise(lost).alias("missing"))

        return _named(F.struct(_taken(acc["pool"], g["amount"]).alias("merged"), F.aggregate(g["members"], start, member).alias("each")), of)

    def searched(x: Column) -> Column:
        missing = F.aggregate(x["groups"], F.struct(x["first"]["pool"].alias("pool"), none.alias("missing")), step, lambda acc: acc["missing"])
        return F.struct(F.size(x["groups"]).alias("n"), x["first"]["ok"].alias("cited"), missing.alias("missing"))

    def judged(x: Column) -> Column:
        usable = (F.trim(text) != "") & breakdown.isNotNull() & total.isNotNull() & ~F.isnan(total) & (F.abs(total) < float("inf"))
        verdict = (
            F.when(~F.coalesce(usable, F.lit(False)), "no-data").when(x["n"] < 2, "too-few-buckets").when(~x["cited"], "no-total-cited")
            .when(F.size(x["missing"]) == 0, "clean").when(F.size(x["missing"]) == x["n"], "thin").otherwise("drops-bucket")
        )
        return F.struct(verdict.alias("verdict"), x["missing"].alias("missing"))

    def told(x: Column) -> Column:
        lost = F.when(x["verdict"].isin("thin", "drops-bucket"), x["missing"]).otherwise(none)
        return F.struct(x["verdict"].alias("verdict"), F.transform(lost, lambda e: e["code"]).alias("missing"), F.aggregate(lost, F.lit(0.0), lambda a, e: a + e["amount"]).alias("gap"))

    both = F.struct(F.filter(party_groups(breakdown), lambda g: g["amount"] > 0).alias("groups"), _named(prose_amounts(text), lambda pool: _taken(pool, total)).alias("first"))
    return _named(_named(_named(both, searched), judged), told)
