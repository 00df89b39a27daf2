"""Amounts of money: reading them out of text, and writing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed

_NUMBER = r"([0-9][0-9,]*(?:\.[0-9]+)?)"
#: What an amount in text counts for, by the least amount of each tier.
TIERS = ((100e6, 3), (10e6, 2), (1e6, 1))


def _scale(unit: Column) -> Column:
    u = F.lower(unit)
    return (
        F.when(u.isin("t", "trillion"), 1e12).when(u.isin("b", "bn", "billion"), 1e9).when(u.isin("m", "mm", "million"), 1e6).when(u.isin("k", "thousand"), 1e3).otherwise(1.0)
    )


def parse_usd(text: Column) -> Column:
    """Dollars of the first figure of a text such as ``~$1.2B (est.)`` or ``$790 billion``, by the first letter of its unit; null for a text
    without a figure."""
    close = F.regexp_replace(text, r"[~$,\s]", "")
    shape = r"(?i)([0-9.]+)([bmt])?"
    number = F.regexp_extract(F.regexp_extract(close, shape, 1), r"^(\d*\.?\d+|\d+)", 1).try_cast("double")
    return number * _scale(F.regexp_extract(close, shape, 2))


def parse_listed_usd(text: Column) -> Column:
    """Dollars of a list's figure, which has neither commas nor spaces inside its number: of ``$1,000`` only the 1 is read. T, B and M count."""
    shape = r"(?i)\$?([0-9.]+)\s*([tbm])?"
    number = F.regexp_extract(F.regexp_extract(text, shape, 1), r"^(\d*\.?\d+|\d+)", 1).try_cast("double")
    return number * _scale(F.regexp_extract(text, shape, 2))


def parse_billions(text: Column) -> Column:
    """Billions of a text in B or M; trillions are not understood here, which goal matching relies on."""
    shape = rf"(?i)^\s*~?\s*\$?\s*{_NUMBER}\s*(b|m)\s*$"
    number = F.regexp_replace(F.regexp_extract(text, shape, 1), ",", "").try_cast("double")
    return F.when(F.lower(F.regexp_extract(text, shape, 2)) == "b", number).otherwise(number / 1000)


def amounts(text: Column) -> Column:
    """All dollar amounts of a text, in dollars."""
    shape = rf"\$\s?{_NUMBER}(?:\s?(trillion|billion|million|thousand|mm|bn|[kmbtKMBT])(?![A-Za-z]))?"
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(shape), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(shape), F.lit(2)).alias("u"))
    return F.transform(found, lambda x: F.regexp_replace(x["n"], ",", "").try_cast("double") * _scale(x["u"]))


def largest_amount(text: Column) -> Column:
    return F.array_max(amounts(text))


def money_points(text: Column, gate: Column) -> Column:
    """Points for the largest amount, less for a small one; 0 without an amount or with the gate shut."""
    most = largest_amount(text)
    out = F.when(~gate | most.isNull() | (most <= 0), 0)
    for least, points in TIERS:
        out = out.when(most >= least, points)
    return out.otherwise(-3)


def one_digit(x: Column) -> Column:
    """A number with one digit after the point, by its exact binary value: 1.45 is below the half and gives 1.4, 0.25 is one and gives 0.3."""

    def of(x: Column) -> Column:
        a, b = x * 16, x * 4  # both exact; what their sum loses tells on which side of a half the number is
        twenty = a + b
        lost = (a - (twenty - (twenty - a))) + (b - (twenty - a))
        below = (twenty == F.floor(twenty)) & (F.pmod(twenty, F.lit(2.0)) == 1) & (lost < 0)
        return F.format_string("%.1f", F.when(below, x - 0.01).otherwise(x))

    # An array of one, transformed, is a name for its element: the number is worked out once.
    return F.when(x.isNotNull(), F.get(F.transform(F.array(x.cast("double")), of), 0))


def currency(amount: Column) -> Column:
    """$1.2B, $3.4M, $5K; below a thousand in full, with what cents there are."""
    return (
        F.when(amount >= 1e9, F.concat(F.lit("$"), one_digit(amount / 1e9), F.lit("B")))
        .when(amount >= 1e6, F.concat(F.lit("$"), one_digit(amount / 1e6), F.lit("M")))
        .when(amount >= 1e3, F.concat(F.lit("$"), F.format_string("%.0f", amount / 1e3), F.lit("K")))
        .when(amount.isNotNull(), F.concat(F.lit("$"), F.regexp_replace(F.format_string("%,.3f", amount.cast("double")), r"\.?0+$", "")))
    )


def percent_label(percent: Column) -> Column:
    return F.when(percent.isNull(), F.lit(None)).when(percent < 0.1, "<0.1%").otherwise(F.concat(one_digit(percent), F.lit("%")))


def exact_usd(amount: Column) -> Column:
    """Dollars in full, grouped, with cents only where there are some."""
    cents = F.floor(F.abs(amount) * 100 + 0.5) % 100 != 0
    return F.concat(F.when(amount < 0, F.lit("-$")).otherwise(F.lit("$")), F.when(cents, F.format_number(F.abs(amount), 2)).otherwise(F.format_number(F.abs(amount), 0)))


def card_money(amount: Column) -> Column:
    """Coarser than ``currency``: whole millions and thousands, billions with one digit; empty for nothing, never "$0"."""
    small = F.when(amount == F.floor(amount), F.format_string("$%.0f", amount)).otherwise(F.format_string("$%.2f", amount))
    return (
        F.when(amount >= 1e9, F.concat(F.lit("$"), one_digit(amount / 1e9), F.lit("B"))).when(amount >= 1e6, F.format_string("$%.0fM", amount / 1e6))
        .when(amount >= 1e3, F.format_string("$%.0fK", amount / 1e3)).when(amount > 0, small).otherwise("")
    )


def assets_chip(assets: Column) -> Column:
    """What a foundation holds, in words; null below a million, which would say nothing or a false zero."""
    return (
        F.when(assets >= 1e9, F.concat(F.lit("$"), one_digit(assets / 1e9), F.lit("B in foundation assets"))).when(assets >= 1e6, F.format_string("$%.0fM in foundation assets", assets / 1e6))
    )


def compact_usd(amount: Column) -> Column:
    """At most one digit after the point, and none that is zero: $3.7B, $636M, $5K."""
    out = None
    for least, unit in ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"), (0.0, "")):
        said = F.concat(F.lit("$"), F.regexp_replace(one_digit(amount / max(least, 1.0)), r"\.0$", ""), F.lit(unit))
        out = F.when(amount >= least, said) if out is None else out.when(amount >= least, said)
    return out


def prose_amounts(text: Column) -> Column:
    """All money of a prose text as numbers, in order, as often as stated: after a dollar sign, with thousands set apart (by commas or
    odd spaces), or with cents; a bare whole number is no money."""
    plain = F.regexp_replace(F.translate(text, "\u00a0\u202f\u2009", "   "), r"(\d) (?=\d{3}\b)", "$1,")
    shapes = (r"\$\s?\d+(?:,\d{3})*(?:\.\d{1,2})?", r"\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?", r"\d+\.\d{2}\b")
    return F.transform(F.regexp_extract_all(plain, F.lit("|".join(shapes)), F.lit(0)), lambda x: F.regexp_replace(x, r"[$,\s]", "").try_cast("double"))


def sample_note(count: Column, reported: Column) -> Column:
    """What must be said of figures that cover only the newest contributions, as many as one answer holds; null for a whole record."""
    total = F.when(reported.isNotNull(), F.format_string(fixed.SAMPLE_REPORTED, reported.cast("string"))).otherwise(fixed.SAMPLE_UNREPORTED)
    return F.when(count >= fixed.SAMPLE_CAP, F.format_string(fixed.SAMPLE_NOTE, count.cast("string"), total))


def sampled(count: Column, reported: Column, span: Column) -> Column:
    """A record's count and span, under names that can't be read as the whole where the record is cut: struct of ``count``, ``span``,
    ``in_sample``, ``span_of_sample``, ``reported`` and ``note``."""
    cut = F.coalesce(count >= fixed.SAMPLE_CAP, F.lit(False))
    return F.struct(
        F.when(~cut, count).alias("count"), F.when(~cut, span).alias("span"), F.when(cut, count).alias("in_sample"), F.when(cut, F.nullif(span, F.lit(""))).alias("span_of_sample"),
        F.when(cut, reported).alias("reported"), sample_note(count, reported).alias("note"),
    )
