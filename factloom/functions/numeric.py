"""Numbers and scores as column functions. A figure that cannot be stated is null, never zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lowest score of each grade above the last.
GRADES = (("A", 60.0), ("B", 45.0), ("C", 30.0), ("D", 15.0))
SOURCES_FOR_FULL_MARKS = 8


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Halves go up, on the binary value as it is (1.005 has two digits 1.00)."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def ratio(part: Column, whole: Column) -> Column:
    """Share of a whole; 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def giving_ratio(net_worth: Column, giving: Column) -> Column:
    """Giving as percent of net worth; null unless both are above 0."""
    return F.when((net_worth > 0) & (giving > 0), giving / net_worth * 100)


def generosity(net_worth: Column, giving: Column) -> Column:
    share = F.when((net_worth > 0) & (giving > 0), giving / net_worth).otherwise(0.0)
    return clamp(F.log10(1 + share * 5000) / 3)


def giving_scale(giving: Column) -> Column:
    return F.when(giving > 0, clamp((F.log10(giving) - 6) / 4)).otherwise(0.0)


def benefit_score(net_worth: Column, foundation_giving: Column, direct_giving: Column, pledged: Column, sources: Column) -> Column:
    """Struct of the 0-100 score and the features it is made of."""
    giving = F.greatest(F.coalesce(foundation_giving, F.lit(0.0)), F.coalesce(direct_giving, F.lit(0.0)))
    generous, scale = generosity(net_worth, giving), giving_scale(giving)
    good = clamp(0.15 * F.coalesce(pledged, F.lit(False)).cast("double") + 0.65 * generous + 0.2 * scale)
    open_ = clamp(sources / float(SOURCES_FOR_FULL_MARKS))
    return F.struct(
        round_half_up(100 * (0.65 * good + 0.35 * open_)).alias("score"),
        good.alias("philanthropy"), open_.alias("transparency"), generous.alias("generosity"), scale.alias("scale"),
    )


def grade(score: Column) -> Column:
    """Letter grade; null for a null score."""
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for letter, least in GRADES:
        out = out.when(score >= least, F.lit(letter))
    return out.otherwise(F.lit("F"))


def evidenced(keys: Column, evidence: Sequence[str]) -> Column:
    """Whether an array of fact keys has any that is evidence."""
    return F.arrays_overlap(keys, F.array(*[F.lit(k) for k in evidence]))


def zero_kind(score: Column, has_evidence: Column) -> Column:
    """What a zero stands for: nothing known, or something known to be nothing."""
    return F.when((score == 0) & ~has_evidence, "unevidenced").when(score == 0, "evidenced-zero")


def dominates(a: Column, b: Column, times: float = 10.0) -> Column:
    return F.coalesce((a > 0) & (b > 0) & (a >= times * b), F.lit(False))


def annualised(total: Column, since: Column, stated: Column, as_of_year: int) -> Column:
    """Yearly figure: the stated one if it is above 0, else the total over the years since, at least one."""
    return F.coalesce(F.when(stated > 0, stated), total / F.greatest(F.lit(1), F.lit(as_of_year) - since))


def figures_match(a: Column, b: Column, within: float = 0.01) -> Column:
    return F.when((a == 0) & (b == 0), True).otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)) <= within)


def significant_digits(x: Column) -> Column:
    """Digits of a whole number without its trailing zeros."""
    return F.length(F.rtrim(F.abs(x).cast("long").cast("string"), F.lit("0")))


def one_digit_edit(a: Column, b: Column) -> Column:
    """Equal length, and one digit differs or two neighbours are swapped."""
    differ = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first, last = F.get(differ, 0), F.get(differ, 1)
    swapped = (F.size(differ) == 2) & (last == first + 1) & (F.substring(a, first, F.lit(1)) == F.substring(b, last, F.lit(1))) & (F.substring(a, last, F.lit(1)) == F.substring(b, first, F.lit(1)))
    return F.when(F.length(a) != F.length(b), False).when(F.length(a) == 0, False).otherwise((F.size(differ) == 1) | swapped)


def curation_score(x: Column) -> Column:
    """0 to 100, where a missing score and 0 both count as 50."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.nullif(x, F.lit(0.0)), F.lit(50.0))))


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Price of a call at rates per million; null where a rate is missing."""
    return (tokens_in * rate_in + tokens_out * rate_out) / 1e6


def two_and_three_sums(figures: Column, most: int = 120) -> Column:
    """Distinct sums of two or three different places of an array; null for an array of more than ``most``."""
    n = F.size(figures)

    def from_(i: Column, carry: Column, deeper: bool) -> Column:
        def add(j: Column) -> Column:
            total = carry + F.get(figures, j)
            return F.concat(F.array(total), from_(j, total, False)) if deeper else F.array(total)

        rest = F.when(i + 1 < n, F.sequence(i + 1, n - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(rest, add))

    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(n <= most, F.array_sort(F.array_distinct(F.flatten(F.transform(starts, lambda i: from_(i, F.get(figures, i), True))))))
