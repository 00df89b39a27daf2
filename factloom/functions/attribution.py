"""Whose record it is: employers, foundations, relatives, filings. On doubt a record belongs to nobody.

Word lists are arguments without defaults: what is a filler or a charity word is for a deployment's reviewers to say.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.money import amounts
from factloom.functions.numeric import figures_match

_SUFFIX = ("jr", "sr", "ii", "iii", "iv", "v")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; remarks in brackets are left out."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\([^()]*\)", " ")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def telling(text: Column, filler: Sequence[str]) -> Column:
    """Distinct words that can identify a company: three letters at least, and no filler."""
    return F.array_except(F.filter(words(text), lambda w: F.length(w) > 2), F.array(*[F.lit(f) for f in filler]).cast("array<string>"))


def _surname(name: Column) -> Column:
    return F.try_element_at(F.filter(words(name), lambda w: ~w.isin(*_SUFFIX)), F.lit(-1))


def affiliations(people: DataFrame, firms: DataFrame, filings: DataFrame, businesses: DataFrame, descriptions: DataFrame, filler: Sequence[str]) -> DataFrame:
    """(person, word): distinct words that tell a person's companies, from four kinds of facts (person, value). Words of the
    person's own name (people: person, name) tell nothing; an entity number is no firm's name; a description names what
    stands after its first of or at."""
    named = firms.where(~F.col("value").rlike("^Q[0-9]+$"))
    told = descriptions.select("person", F.get(F.split("value", r"(?i)\s(?:of|at)\s", 2), 1).alias("value"))
    rows = reduce(DataFrame.unionByName, [x.select("person", "value") for x in (named, filings, businesses, told)])
    told_words = rows.select("person", F.explode(telling(F.col("value"), filler)).alias("word")).distinct()
    own = people.select("person", F.explode(words(F.col("name"))).alias("word"))
    return told_words.join(own, ["person", "word"], "left_anti")


def employer_verdicts(records: DataFrame, people: DataFrame, known: DataFrame, filler: Sequence[str], none: Sequence[str]) -> DataFrame:
    """``records`` (record, person, employer) with a verdict: generic for an employer that is none (``none``: phrases of words) or
    says nothing, no-list for a person without known words (``affiliations``), affiliated if they share one, surname if the
    employer bears the person's own, else unaffiliated."""
    said = records.select("record", "person", telling(F.col("employer"), filler).alias("said"), F.array_join(words(F.col("employer")), " ").alias("whole"))
    shared = said.select("record", "person", F.explode("said").alias("word")).join(known, ["person", "word"]).select("record").distinct().withColumn("shares", F.lit(True))
    listed = known.select("person").distinct().withColumn("listed", F.lit(True))
    both = said.join(people.select("person", _surname(F.col("name")).alias("surname")), "person", "left").join(listed, "person", "left").join(shared, "record", "left")
    verdict = (
        F.when((F.size("said") == 0) | F.col("whole").isin(*none), "generic")
        .when(F.col("listed").isNull(), "no-list")
        .when(F.col("shares"), "affiliated")
        .when((F.length("surname") > 2) & F.array_contains("said", F.col("surname")), "surname")
        .otherwise("unaffiliated")
    )
    return records.join(both.select("record", verdict.alias("verdict")), "record")


def own_foundation(organisation: Column, person: Column, charity: str, institutions: Sequence[str], connecting: Sequence[str], legacy: Sequence[str] = ()) -> Column:
    """Whether a charity is plausibly a person's own: its name opens with one of theirs or has the whole of it, and up to the
    first word of ``charity`` (an expression) their surname is the last that is not ``connecting``. Names with a phrase of
    ``institutions``, and those listed in ``legacy``, are nobody's."""
    org = words(organisation)
    org = F.when(F.get(org, 0) == "the", F.slice(org, F.lit(2), F.size(org))).otherwise(org)
    line = F.concat(F.lit(" "), F.array_join(org, " "), F.lit(" "))
    name = F.filter(words(F.regexp_replace(F.lower(person), r"(&|\band)\s+family\s*$", "")), lambda w: ~w.isin(*_SUFFIX))
    first, last = F.get(name, 0), F.try_element_at(name, F.lit(-1))
    at = F.array_position(F.transform(org, lambda w: w.rlike(f"^(?:{charity})$")), F.lit(True)).cast("int")
    before = F.when(at > 1, F.slice(org, F.lit(1), at - 1)).otherwise(F.array().cast("array<string>"))
    bearer = F.try_element_at(F.concat(F.slice(before, 1, 1), F.filter(F.slice(before, F.lit(2), F.size(before)), lambda w: ~w.isin(*connecting))), F.lit(-1))
    institution = F.exists(F.array(*[F.lit(f" {i} ") for i in institutions]).cast("array<string>"), lambda i: line.contains(i))
    mine = F.get(org, 0).isin(first, last) | line.contains(F.concat_ws(" ", F.lit(""), first, last, F.lit("")))
    listed = F.trim(line).isin(*legacy) if legacy else F.lit(False)
    return F.coalesce((bearer == last) & mine & ~institution & ~listed, F.lit(False))


def ein(number: Column) -> Column:
    """Nine digits; numbers lose leading zeros."""
    return F.lpad(F.regexp_replace(number.cast("string"), "[^0-9]", ""), 9, "0")


def reviewed(candidates: Column, allowed: Column, field: str = "ein") -> Column:
    """An unreviewed person's candidates as they are; of a reviewed one only the allowed numbers."""
    return F.when(allowed.isNull(), candidates).otherwise(F.filter(candidates, lambda c: F.array_contains(allowed, ein(c[field]))))


def names_a_relative(title: Column, surname: Column, own_names: Column) -> Column:
    """Whether a capitalised word right before the surname is none of the person's own names."""
    said = F.regexp_extract_all(title, F.lit(r"[\p{L}'’-]+"), F.lit(0))
    pairs = F.arrays_zip(said.alias("w"), F.slice(said, F.lit(2), F.size(said)).alias("then"))

    def other(p: Column) -> Column:
        capital = (F.length(p["w"]) > 1) & (F.left(p["w"], F.lit(1)) != F.lower(F.left(p["w"], F.lit(1))))
        return (F.lower(p["then"]) == F.lower(surname)) & (F.left(p["then"], F.lit(1)) == F.upper(F.left(surname, F.lit(1)))) & capital & ~F.array_contains(own_names, F.lower(p["w"]))

    return F.coalesce(F.exists(pairs, other), F.lit(False))


def is_company(name: Column, company_words: Sequence[str]) -> Column:
    return F.arrays_overlap(words(name), F.array(*[F.lit(w) for w in company_words]))


def ticker(name: Column) -> Column:
    """Ticker in brackets after a display name; null without."""
    return F.nullif(F.regexp_extract(name, r"\(([A-Z]{1,5}(?:-[A-Z]{1,2})?)\)", 1), F.lit(""))


def bare_filer(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+\(CIK [0-9]+\)", ""))


def personal_id(filers: Column, person: Column, company_words: Sequence[str]) -> Column:
    """Id of the first of an array of (id, name) that is no company and has the person's first and last name."""
    own = words(person)
    ends = F.array(F.get(own, 0), F.try_element_at(own, F.lit(-1)))
    return F.get(F.filter(filers, lambda f: ~is_company(f["name"], company_words) & (F.size(F.array_except(ends, words(f["name"]))) == 0)), 0)["id"]


def label(code: Column, exact: Mapping[str, str], inside: Mapping[str, str] | None = None, default: str | None = None) -> Column:
    """Label of a code by table: exactly, else by the first key that the lower-cased code contains."""
    low = F.lower(F.trim(code))
    out = F.when(code.isNull(), F.lit(default))
    for key, name in exact.items():
        out = out.when(low == key.lower(), F.lit(name))
    for key, name in (inside or {}).items():
        out = out.when(low.contains(key.lower()), F.lit(name))
    return out.otherwise(F.lit(default))


def entity_id(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def thumbnail(url: Column, base: str, width: int = 300) -> Column:
    """Address of a smaller picture of the file that a URL ends in."""
    return F.concat(F.lit(base), F.replace(entity_id(url), F.lit(" "), F.lit("_")), F.lit(f"?width={width}"))


def suspect_drop(reason: Column, receipts: Column) -> Column:
    """Whether a figure that a judge called unsupported stands in its own receipts."""
    given = amounts(receipts)
    return F.exists(amounts(reason), lambda c: F.exists(given, lambda g: figures_match(c, g)))
