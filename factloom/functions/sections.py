"""Sections of a written profile, as maps of name to text: what is kept, withheld, and approved by hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(x: Column) -> Column:
    """The text, or null if there is nothing in it."""
    return F.when(F.trim(x) != "", x)


def blocked_sections(candidate: Column, previous: Column, blocked: Column) -> Column:
    """The candidate with blocked sections replaced by the previous text, or left out where there is none."""
    merged = F.transform_values(candidate, lambda k, v: F.when(F.array_contains(blocked, k), _text(F.try_element_at(previous, k))).otherwise(v))
    return F.map_filter(merged, lambda _, v: v.isNotNull())


def outcome(candidate: Column, previous: Column, blocked: Column) -> Column:
    """Map of blocked section to ``previous`` or ``withheld``."""
    hit = F.map_filter(candidate, lambda k, v: F.array_contains(blocked, k) & v.isNotNull())
    return F.transform_values(hit, lambda k, _: F.when(_text(F.try_element_at(previous, k)).isNotNull(), "previous").otherwise("withheld"))


def preserved_dates(kept: Column, dates: Column, written: Column) -> Column:
    """When each kept section was first written: its own date, else that of the whole."""
    own = F.transform_values(F.map_filter(kept, lambda _, v: v == "previous"), lambda k, _: F.coalesce(F.try_element_at(dates, k), written))
    return F.map_filter(own, lambda _, v: v.isNotNull())


def approval_defect(marker: Column) -> Column:
    """What is wrong with an approval (by, date, ruling); null if nothing is."""
    return (
        F.when(_text(marker["by"]).isNull(), "no by")
        .when(~F.coalesce(marker["date"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)), "no date")
        .when(_text(marker["ruling"]).isNull(), "no ruling")
    )


def approved_sections(candidate: Column, published: Column, markers: Column, names: Column) -> Column:
    """The candidate's known sections, with those approved by hand as they were published. An approval counts if it is
    well-formed and there is a text to keep."""
    own = F.map_filter(candidate, lambda k, _: F.array_contains(names, k))
    good = F.map_filter(markers, lambda k, m: F.array_contains(names, k) & approval_defect(m).isNull() & _text(F.try_element_at(published, k)).isNotNull())
    rest = F.map_filter(own, lambda k, _: ~F.map_contains_key(good, k))
    return F.map_concat(rest, F.transform_values(good, lambda k, _: F.try_element_at(published, k)))
