"""What must be said beside a figure: caveats, age, coverage, capped records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.dates import age_class
from factloom.functions.numeric import giving_ratio, zero_kind

SUMMARY_NOTE = "A net worth stated in this summary may be out of date."
#: Records that one answer holds at most; a full page may have been cut.
PAGE = 100


def headline_caveat(score: Column, component: Column, has_evidence: Column) -> Column:
    """Whether a grade must say that nothing is known of giving: there is a score, and its giving part is a zero without evidence."""
    return F.coalesce(score.isNotNull() & (zero_kind(F.coalesce(component, F.lit(0.0)), has_evidence) == "unevidenced"), F.lit(False))


def current_ratio(net_worth: Column, giving: Column, retrieved: Column, as_of: Column, datable: Column) -> Column:
    """Giving as percent of net worth, only of a net worth that is current."""
    return F.when(age_class(retrieved, as_of, datable) == "current", giving_ratio(net_worth, giving))


def outdated(written: Column, refreshed: Column) -> Column:
    """Whether a source was refreshed after the prose on it was written; false where either is unknown."""
    return F.coalesce(refreshed > written, F.lit(False))


def summary_note(retrieved: Column, written: Column, as_of: Column, datable: Column, known: Column) -> Column:
    """A note for a summary whose net worth is not current, or that was written before the figure was retrieved; null without a
    figure, or where the summary is newer."""
    fresh = (age_class(retrieved, as_of, datable) == "current") & (written >= retrieved)
    return F.when(known & ~F.coalesce(fresh, F.lit(False)), SUMMARY_NOTE)


def _day(text: Column) -> Column:
    said = F.trim(text)
    return F.when(said.rlike(r"^\d{4}-\d{2}-\d{2}$"), said)


def window_ends(window: Column) -> Column:
    """Struct of start and end of a window ``A to B``; null unless both are days."""
    parts = F.split(window, r"\s+to\s+")
    ends = F.struct(_day(F.get(parts, 0)).alias("start"), _day(F.get(parts, 1)).alias("end"))
    return F.when((F.size(parts) == 2) & ends["start"].isNotNull() & ends["end"].isNotNull(), ends)


def window_of(days: Column) -> Column:
    """The window that an array of days covers, a single day as itself; empty without any."""
    known = F.filter(F.transform(days, _day), lambda x: x.isNotNull())
    low, high = F.array_min(known), F.array_max(known)
    return F.when(F.size(known) == 0, "").when(low == high, low).otherwise(F.concat_ws(" to ", low, high))


def window_fix(window: Column, days: Column) -> Column:
    """Struct (kind, before, after) of a stated window that misstates its articles' days: BACKWARD, DEGENERATE (one day for
    several) or UNDERSTATED; null where it doesn't, or where there are fewer than two days to tell by."""
    ends, known = window_ends(window), F.filter(F.transform(days, _day), lambda x: x.isNotNull())
    low, high = F.array_min(known), F.array_max(known)
    kind = (
        F.when(ends.isNull() | (F.size(known) < 2), F.lit(None).cast("string"))
        .when(ends["end"] < ends["start"], "BACKWARD")
        .when((ends["start"] == ends["end"]) & (low != high), "DEGENERATE")
        .when((ends["start"] > low) | (ends["end"] < high), "UNDERSTATED")
    )
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), window.alias("before"), window_of(days).alias("after")))


def is_capped(count: Column, reported: Column, page: int = PAGE) -> Column:
    """Whether a record holds less than there is: by the reported total, else by a full page; false without a count."""
    return F.coalesce(F.when(reported.isNotNull(), reported > count).otherwise(count >= page), F.lit(False))


def newest_stamp(created: Column, published: Column) -> Column:
    """A card's own date before that of its article."""
    return F.coalesce(created, published)


def json_scalar(json: Column) -> Column:
    """The value of JSON that is a scalar, as text; null for null, arrays, objects and what is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    return F.when(~kind.rlike("^(ARRAY|OBJECT|VOID)"), F.try_variant_get(F.try_parse_json(json), "$", "string"))


def array_length(json: Column) -> Column:
    """Number of entries of JSON that is an array; null for anything else, so that a record of another shape is refused."""
    return F.json_array_length(json)
