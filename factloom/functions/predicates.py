"""Who and what may be shown: gates, filters and checks of arguments and names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import last_name, name_in_text


def visible(df: DataFrame, status: str = "status", shown: str = "approved", hidden: str | None = None) -> DataFrame:
    """Rows that moderation has passed, less those that a flag column ``hidden`` withholds; every public read goes through here."""
    rows = df.where(F.col(status) == shown)
    return rows.where(~F.coalesce(F.col(hidden), F.lit(False))) if hidden else rows


def living(df: DataFrame, died: str = "death_year") -> tuple[DataFrame, DataFrame]:
    """(rows without a year of death, one row with the number kept and the number dropped)."""
    counts = df.agg(F.count_if(F.col(died).isNull()).alias("kept"), F.count_if(F.col(died).isNotNull()).alias("dropped"))
    return df.where(F.col(died).isNull()), counts


def named_like(name: Column, part: str | None = None, place: Column | None = None, of_place: str | None = None, fields: Column | None = None, field: str | None = None) -> Column:
    """Filters of a list, each left out when not given: part of a name in any case, equal place, field among fields."""
    out = F.lit(True)
    if part:
        out = out & F.lower(name).contains(part.lower())
    if of_place and place is not None:
        out = out & place.eqNullSafe(F.lit(of_place))
    if field and fields is not None:
        out = out & F.coalesce(F.array_contains(fields, field), F.lit(False))
    return out


def one_of(value: Column, allowed: Sequence[str], fallback: str) -> Column:
    """The value if it is allowed, else the fallback; null counts as not allowed."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(fallback))


def suspicious_name(name: Column) -> Column:
    """Whether a name looks like none of a person: a title, an article, something made up, or hardly any letters."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (F.length(low) < 3) | low.contains("mr. ") | low.contains("mrs. ") | low.contains("the ") | low.contains("fictional")


def eligible_name(name: Column, common: Sequence[str]) -> Column:
    """Whether a name can be searched for: two words at least, the last of them no common one."""
    return (F.size(F.split(F.coalesce(name, F.lit("")), " ")) >= 2) & ~F.coalesce(last_name(name).isin(*common), F.lit(False))


def is_named(first: Column, last: Column, title: Column, body: Column) -> Column:
    """Whether an article is about someone: the last name in the title, the first name in title or body."""
    return F.coalesce(name_in_text(last, title) & name_in_text(first, F.concat_ws(" ", title, body)), F.lit(False))


def not_among(df: DataFrame, key: str, ids: Sequence) -> DataFrame:
    """Rows whose key is not listed; without a list all rows, null keys included."""
    return df.where(~F.coalesce(F.col(key).isin(*ids), F.lit(False))) if ids else df


def page_arguments(page: object = None, limit: object = None, most: int = 2000, usual: int = 20) -> tuple[int, int]:
    """(page, limit) as whole numbers: a page from 1, a limit from 1 to ``most``; what is no number is the first page, and the usual
    limit."""

    def number(x: object, low: int, high: int | None, default: int) -> int:
        try:
            n = int(str(x))
        except ValueError:
            return default
        return max(low, n if high is None else min(n, high))

    return number(page, 1, None, 1), number(limit, 1, most, usual)


def without(df: DataFrame, dropped: Sequence[str] = (), renamed: Mapping[str, str] | None = None) -> DataFrame:
    """A table as it is given out: internal columns dropped, others renamed; names that are not there are no error."""
    return df.drop(*dropped).withColumnsRenamed(dict(renamed or {}))
