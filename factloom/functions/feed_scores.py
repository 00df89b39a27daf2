"""What a card of a feed is worth showing: topic, kind, tension, hedges, money, source, and the punch they make together.

A word list holds beginnings of words; each entry counts once in a text, however often it occurs. Texts are marked where words
begin, once each, and entries are then looked for as plain strings, which costs far less than an expression an entry.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions.dates import recency
from factloom.functions.text import of_domain, url_host


def beginning(term: str) -> str:
    """Expression for a word that begins with ``term``, in any case."""
    return r"(?i)\b" + re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", term)


def any_beginning(terms: Iterable[str]) -> str:
    return r"(?i)\b(?:" + "|".join(beginning(t)[6:] for t in terms) + ")"


def _given(text: Column | None) -> Column:
    return F.lit("") if text is None else F.coalesce(text, F.lit(""))


#: What stands before every word of a marked text. A text may hold it: before a word it says the same, elsewhere no entry has it.
_MARK = "\u0001"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _marked(text: Column) -> Column:
    """A text with A-Z lower-cased and a mark where each word begins."""
    return F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"\b(?=\w)", _MARK)


def _marked_terms(terms: Iterable[str]) -> Column:
    """Array of entries, marked as texts are; each must begin with a letter or digit, as ``beginning`` needs a word there."""
    return F.array(*[F.lit(re.sub(r"\b(?=\w)", _MARK, t.lower(), flags=re.ASCII)) for t in terms])


def _named(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out once: an array of one, transformed, is a name for its element."""
    return F.get(F.transform(F.array(value), of), 0)


def _both(title: Column, body: Column) -> Column:
    return F.struct(_marked(title).alias("title"), _marked(body).alias("body"))


def _points(x: Column, terms: Iterable[str], in_title: int, in_body: int) -> Column:
    """Sum over entries: ``in_title`` for one in the marked title, else ``in_body`` for one in the marked body."""
    worth = lambda t: F.when(F.contains(x["title"], t), in_title).when(F.contains(x["body"], t), in_body).otherwise(0)
    return F.aggregate(_marked_terms(terms), F.lit(0), lambda total, t: total + worth(t))


def plain_words(text: Column) -> Column:
    """Lower case; runs of anything but ASCII letters, digits and dollar signs are one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9$]+", " "))


#: A listed company's sign in a plain text.
TICKER = r"\$[a-z]{2,5}\b"


def accountability(title: Column, body: Column | None = None) -> Column:
    """How much of a candidate is on topic: weighed words, double in the title, less four for a word of other subjects in the title
    and two in the body."""
    t, b = _given(title), _given(body)

    def signals(x: Column) -> Column:
        return reduce(lambda total, points: total + points, [_points(x, terms, 2 * weight, weight) for weight, terms in fixed.SIGNALS.values()])

    def noise(plain: Column) -> Column:
        tickers = F.when(plain["title"].rlike(TICKER), 4).when(plain["body"].rlike(TICKER), 2).otherwise(0)
        return tickers + _named(_both(plain["title"], plain["body"]), lambda x: _points(x, map(plain_term, fixed.NOISE), 4, 2))

    return _named(_both(t, b), signals) - _named(F.struct(plain_words(t).alias("title"), plain_words(b).alias("body")), noise)


def plain_term(term: str) -> str:
    return " ".join(re.findall("[a-z0-9$]+", term.lower()))


def _kind_of(text: Column) -> Column:
    """Kind with most weighed words; the first named of equals; null without any."""

    def of(marked: Column) -> Column:
        # The largest (score, place from the end) names it.
        n = len(fixed.SIGNALS)
        scores = [F.struct((_hits(marked, terms) * w).alias("score"), F.lit(n - i).alias("place"), F.lit(k).alias("kind")) for i, (k, (w, terms)) in enumerate(fixed.SIGNALS.items())]
        return _named(F.array_max(F.array(*scores)), lambda best: F.when(best["score"] > 0, best["kind"]))

    return _named(_marked(text), of)


def candidate_kind(title: Column, body: Column | None = None) -> Column:
    """Kind that the title speaks of; the body decides only for a title that says nothing."""
    return F.coalesce(_kind_of(_given(title)), _kind_of(_given(body)))


def kind_mix(candidates: DataFrame, kind_col: str = "kind") -> DataFrame:
    """(kind, n) with every kind, zeros and ``unclassified`` included, so that the parts sum to all rows."""
    names = F.array(*[F.lit(k) for k in (*fixed.SIGNALS, "unclassified")])
    zero = candidates.sparkSession.range(1).select(F.explode(names).alias("kind"), F.lit(0).cast("long").alias("n"))
    counted = candidates.groupBy(F.coalesce(kind_col, F.lit("unclassified")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(zero).groupBy("kind").agg(F.sum("n").alias("n"))


def _hits(marked: Column, terms: Iterable[str]) -> Column:
    """How many entries a marked text has."""
    return F.size(F.filter(_marked_terms(terms), lambda t: F.contains(marked, t)))


def tension(headline: Column, summary: Column | None = None) -> Column:
    """Words of conflict: three points each in the headline, else one in the summary, three of each at most."""

    def of(x: Column) -> Column:
        only_below = F.size(F.filter(_marked_terms(fixed.TENSION), lambda t: ~F.contains(x["title"], t) & F.contains(x["body"], t)))
        most = F.lit(fixed.TENSION_CAP)
        return F.least(_hits(x["title"], fixed.TENSION), most) * fixed.TENSION_WEIGHT + F.least(only_below, most)

    return _named(_both(_given(headline), _given(summary)), of)


def hedge(headline: Column) -> Column:
    """Penalty for a headline that says what may be."""
    return _named(_marked(_given(headline)), lambda x: F.least(_hits(x, fixed.HEDGES), F.lit(fixed.HEDGE_CAP)) * fixed.HEDGE_WEIGHT)


def headline_sum(text: Column) -> Column:
    """Largest dollar sum of a text; 0 without one."""
    shape = F.lit("(?i)" + fixed.HEADLINE_SUM)
    found = F.arrays_zip(F.regexp_extract_all(_given(text), shape, F.lit(1)).alias("n"), F.regexp_extract_all(_given(text), shape, F.lit(2)).alias("u"))
    scale = {"t": 1e12, "b": 1e9, "m": 1e6, "k": 1e3}

    def dollars(x: Column) -> Column:
        unit = F.lower(F.left(x["u"], F.lit(1)))
        times = F.when(F.lower(x["u"]) == "thousand", 1e3)
        for letter, by in scale.items():
            times = times.when(unit == letter, by)
        return F.replace(x["n"], F.lit(","), F.lit("")).try_cast("double") * times.otherwise(1.0)

    return F.coalesce(F.array_max(F.transform(found, dollars)), F.lit(0.0))


def headline_money(headline: Column, tension_points: Column) -> Column:
    """Points for a large sum, only beside tension or political spending; a small sum always costs three."""
    most = headline_sum(headline)
    earned = F.when(most >= 100e6, 3).when(most >= 10e6, 2).otherwise(1)
    gate = (tension_points > 0) | _given(headline).rlike("(?i)" + fixed.POLITICAL_MONEY)
    return F.when(most == 0, 0).when(most < 1e6, -3).when(gate, earned).otherwise(0)


def credibility_tier(source: Column) -> Column:
    """1 for a domain of low standing or one below it, else 0."""
    return of_domain(F.lower(F.trim(source)), fixed.LOW_CREDIBILITY).cast("int")


def source_quality(source: Column, url: Column) -> Column:
    """Penalties for sources that only pass on, and for those of low standing, by stored name or by host."""
    stored, host = F.lower(F.trim(_given(source))), F.coalesce(url_host(url), F.lit(""))
    passes_on = of_domain(stored, fixed.AGGREGATORS) | of_domain(host, fixed.AGGREGATORS)
    low = (credibility_tier(stored) + credibility_tier(host)) > 0
    return F.when(passes_on, -fixed.AGGREGATOR_PENALTY).otherwise(0) + F.when(low, -fixed.LOW_CREDIBILITY_PENALTY).otherwise(0)


def source_label(name: Column, url: Column) -> Column:
    """The stored name; of one that says nothing the URL's host; else that there is none."""
    said = F.trim(name)
    real = F.when((said != "") & ~F.lower(said).isin(*fixed.NO_SOURCE), said)
    return F.coalesce(real, F.nullif(url_host(url), F.lit("")), F.lit("Source not recorded"))


def reported_marker(headline: Column) -> Column:
    """The words by which a headline says that it is second-hand: of the first marker that it has; null without."""
    found = [F.nullif(F.regexp_extract(headline, f"(?i)({p})", 1), F.lit("")) for p in fixed.REPORTED]
    return F.lower(F.coalesce(*found))


def punch(headline: Column, summary: Column, source: Column, url: Column, created: Column, published: Column, as_of: Column) -> Column:
    """Where a card belongs: half its topic, rounded, tension less hedges, money, source and how new it is; its own date counts before
    that of its article."""
    pull = tension(headline, summary)
    topic = F.floor(accountability(headline, summary) * fixed.TOPIC_WEIGHT + 0.5)
    new = recency(F.coalesce(created, published), as_of)
    return (topic + pull - hedge(headline) + headline_money(headline, pull) + source_quality(source, url) + new).cast("int")
