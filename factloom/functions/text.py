"""Text as column functions: signatures, word lists, names, hosts, markup."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import fixed

STOP_WORDS = fixed.EVENT_STOP_WORDS
_NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def event_signature(title: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Distinct words of four ASCII letters or digits at least, lower-cased, stop words out."""
    words = F.split(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*stop)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def has_word(text: Column, word: str) -> Column:
    """Whether a lower-cased text has a word or phrase that stands between anything but ASCII letters and digits."""
    return text.contains(word) & text.rlike(rf"(^|[^a-z0-9]){word}($|[^a-z0-9])")


def lexicon_points(title: Column, body: Column, lexicon: Mapping[str, int], title_weight: int = 2) -> Column:
    """Sum of the points of words found, counted ``title_weight`` times in the title, else once in the body."""
    low_title, low_body = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(body, F.lit("")))
    total = F.lit(0)
    for word, points in lexicon.items():
        total = total + F.when(has_word(low_title, word), points * title_weight).when(has_word(low_body, word), points).otherwise(0)
    return total


def kind(text: Column, kinds: Mapping[str, Sequence[str]]) -> Column:
    """The kind with most of its words in a text; ties go to the first declared; null without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = {k: sum((has_word(low, w).cast("int") for w in words), F.lit(0)) for k, words in kinds.items()}
    most = F.greatest(*hits.values()) if len(hits) > 1 else next(iter(hits.values()))
    out = F.when(most == 0, F.lit(None).cast("string"))
    for k, n in hits.items():
        out = out.when(n == most, F.lit(k))
    return out


def url_host(url: Column) -> Column:
    """Lower-cased host without a leading ``www.``; null if the URL has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def of_domain(host: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of the domains or below it."""
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith(f".{d}")
    return F.coalesce(out, F.lit(False))


def html_text(html: Column, least: int = 100, most: int = 800) -> Column:
    """Plain text of a page without scripts and styles, white space squeezed, cut at ``most``; null if shorter than
    ``least``."""
    text = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style[^>]*>.*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, plain in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
    return F.when(F.length(text) >= least, F.substring(text, 1, most))


def name_tokens(name: Column) -> Column:
    """Words of a name, lower-cased, without generation suffixes and single letters."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*_NAME_SUFFIXES))


def normal_name(name: Column) -> Column:
    return F.array_join(name_tokens(name), " ")


def last_name(name: Column) -> Column:
    return F.try_element_at(name_tokens(name), F.lit(-1))


def generation(name: Column) -> Column:
    """jr, sr, ii ... of a name; null without."""
    return F.nullif(F.regexp_extract(F.lower(name), r"[ ,](jr|sr|ii|iii|iv|v)\.?$", 1), F.lit(""))


def core_tokens(name: Column) -> Column:
    """Words of letters in a name that make up who someone is: no suffixes, no single letters."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z ]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*fixed.NOT_CORE))


def generation_rank(name: Column) -> Column:
    """Rank of the first suffix word that stands anywhere in a name; 0 without."""
    word = F.regexp_extract(F.lower(name), r"\b(sr|jr|ii|iii|iv|v)\b", 1)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.GENERATIONS.items() for x in kv]), word), F.lit(0))


def name_in_text(name: Column, text: Column) -> Column:
    """Whether a text mentions a name as whole words."""
    def normal(c: Column) -> Column:
        return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), F.lit(" "))

    return normal(text).contains(normal(name))


def short_form_of(a: Column, b: Column, nicknames: Mapping[str, Sequence[str]] = fixed.NICKNAMES) -> Column:
    """Whether a first name is a short form of another: three letters at least that the other begins with, or a nickname of it."""
    other = F.create_map(*[x for k, v in nicknames.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    named = F.coalesce(F.array_contains(F.try_element_at(other, a), b), F.lit(False))
    return (a != b) & (((F.length(a) >= 3) & b.startswith(a)) | named)


def snake_case(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "([A-Z])", "_$1"))


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after . ! ? before white space, but not inside numbers or after common abbreviations."""
    safe = F.regexp_replace(text, r"\b(Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Co|Corp|St|vs|No|Jr|Sr|U\.S|e\.g|i\.e)\.", "$1\u0001")
    parts = F.split(F.regexp_replace(safe, r"([.!?]+[\"')\]]*)\s+", "$1\u0002"), "\u0002")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def first_sentences(text: Column, n: int) -> Column:
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def without_sentences(text: Column, pattern: str) -> Column:
    """A text less the sentences that match."""
    return F.array_join(F.filter(sentences(text), lambda s: ~s.rlike(pattern)), " ")


def speaks_of_itself(text: Column, patterns: Mapping[str, str]) -> Column:
    """Sentences that speak of their own making, each with the labels of the patterns (label: expression) it meets."""
    told = F.transform(
        sentences(text),
        lambda s: F.struct(s.alias("sentence"), F.filter(F.array(*[F.when(s.rlike(p), label) for label, p in patterns.items()]), lambda x: x.isNotNull()).alias("labels")),
    )
    return F.filter(told, lambda x: F.size(x["labels"]) > 0)


def commentary_labels(headline: Column, summary: Column) -> Column:
    """What a card's commentary on its own making is called, each label once, in the order of the list."""
    both = F.concat_ws("\n", F.coalesce(headline, F.lit("")), F.coalesce(summary, F.lit("")))
    return F.array_distinct(F.array_compact(F.array(*[F.when(both.rlike(f"(?i){p}"), label) for p, label in fixed.COMMENTARY])))


def _commented(sentence: Column, write_time: bool = False) -> Column:
    found = [p for p, _ in fixed.COMMENTARY] + [p for p, _, early in fixed.PROFILE_COMMENTARY if early or not write_time]
    return sentence.rlike("(?i)" + "|".join(found))


def has_commentary(text: Column, write_time: bool = False) -> Column:
    """Whether a sentence speaks of its own making; at ``write_time`` by the phrases that no honest sentence has."""
    return F.coalesce(F.exists(sentences(text), lambda s: _commented(s, write_time)), F.lit(False))


def without_commentary(text: Column) -> Column:
    """A text less such sentences, white space squeezed; null if nothing is left."""
    kept = F.array_join(F.filter(sentences(text), lambda s: ~_commented(s)), " ")
    return F.nullif(F.trim(F.regexp_replace(kept, r"\s+", " ")), F.lit(""))
