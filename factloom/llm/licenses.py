"""License scans by ordered signature rules, in DataFrame operations only.

A text is lower-cased (A-Z) and reduced to words, joined by single spaces. Rules (``license_rules``, written by hand) are regular
expressions over that form, each with a label, a weight and a keyword that a text must contain before the rule is tried; their
order is their priority. Detections are ordered by start, longest first, then by priority; one that lies inside an earlier one
is suppressed. Base phrases are looked up word by word and their labels always stay. The score is the weight of the best
detection kept, 0.5 for base phrases alone, 0 without any.

Edge cases: a null or empty text has no words and no labels; repeated rows stay and get equal results; an empty table
gives no rows; columns other than the two named are ignored. Whole texts are read; texts without any keyword are only
counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import matches
from factloom.llm.license_rules import GATE_WORDS, GATES, RULES

#: Characters that are not part of a word, after lower-casing.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word before lower-casing, which makes letters of A-Z and no word longer or shorter.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Phrases whose words stand consecutively, and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]


def rules() -> list[tuple[str, str, str, float]]:
    """(label, keyword, expression over a line, weight) of every rule, in order."""
    return [(label, f" {key}", f" {x}(?= )", weight) for label, key, weight, x in RULES]


def _places(words: Column, line: Column, phrase: str) -> Column:
    """Places of a phrase in the array of words, looked for only where the line contains it."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        return F.forall(F.array(*[F.element_at(words, i + (k + 1)) == F.lit(w) for k, w in enumerate(parts)]), lambda x: x)

    none = F.array().cast("array<int>")
    many = F.size(words) - len(parts)
    return F.when(line.contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), F.greatest(many, F.lit(0))), here)).otherwise(none)


def _detections(line: Column) -> Column:
    """Array of (start, -length, rank, label, weight) of every rule that the line has a detection of."""
    by_key: dict[str, list[Column]] = {}
    for n, (label, key, regex, weight) in enumerate(rules()):
        rule = F.struct(F.lit(label).alias("label"), F.lit(regex).alias("regex"), F.lit(n).alias("rank"), F.lit(weight).alias("weight"))
        # A constant expression is compiled once; only rules that are found are matched again, for their places.
        by_key.setdefault(key, []).append(F.when(line.rlike(regex), rule))
    # Each keyword is looked up once, for all its rules.
    tried = F.array_compact(F.flatten(F.array_compact(F.array(*[F.when(line.contains(key), F.array(*group)) for key, group in by_key.items()]))))

    def of(r: Column) -> Column:
        def make(start: Column, end: Column, *_: Column) -> Column:
            return F.struct(start.alias("start"), (start - end).alias("less"), r["rank"].alias("rank"), r["label"].alias("label"), r["weight"].alias("weight"))

        return matches(line, r["regex"], make, "struct<start:int,less:int,rank:int,label:string,weight:double>", ["start"])

    return F.flatten(F.transform(tried, of))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Lower case of all scripts finds no fewer gates than that of A-Z, and is quicker; only texts that pass are translated.
    rows = rows.select("id", "text", F.lower("text").alias("low"))
    gate = reduce(lambda a, b: a | b, [F.col("low").contains(g) for g in GATES])
    gate = reduce(lambda a, b: a | b, [F.col("low").contains(x) & F.col("low").rlike(f"{x}{GAP}{y}") for x, y in GATE_WORDS], gate)
    low = F.when(gate, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = rows.select("id", F.regexp_count("text", F.lit(ANY_WORD)).cast("long").alias("n_words"), low.alias("low"))
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace("low", GAP, " ")), F.lit(" "))
    rows = rows.select("id", "n_words", line.alias("line"))

    none = F.array().cast("array<int>")
    # A column of its own: inside the lambdas of ``_places`` the expression would be split anew for every word.
    based = reduce(lambda a, b: a | b, [F.col("line").contains(f" {p} ") for p, _ in BASE])
    rows = rows.withColumn("words", F.when(based, F.split(F.trim("line"), " ")))
    places = F.array(*[_places(F.col("words"), F.col("line"), p) for p, _ in BASE])
    detected = F.sort_array(_detections(F.col("line")))
    rows = rows.select(
        "id", "n_words",
        F.when(F.col("line").isNotNull(), places).otherwise(F.array(*[none] * len(BASE))).alias("places"),
        F.when(F.col("line").isNotNull(), detected).alias("detected"),
    )

    def keep(acc: Column, d: Column) -> Column:
        end = d["start"] - d["less"]
        fresh = end > acc["end"]
        return F.struct(
            F.greatest(acc["end"], end).alias("end"),
            F.when(fresh, F.array_union(acc["labels"], F.array(d["label"]))).otherwise(acc["labels"]).alias("labels"),
            F.when(fresh, F.greatest(acc["score"], d["weight"])).otherwise(acc["score"]).alias("score"),
        )

    first = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))
    kept = F.coalesce(F.aggregate("detected", first, keep), first)
    base = F.filter(F.array(*[F.when(F.size(F.col("places")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull())
    rows = rows.select("id", "n_words", F.flatten("places").alias("all"), base.alias("base"), kept.alias("kept"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("all").cast("long").alias("n_base"),
        F.array_min("all").cast("long").alias("first_word"),
        F.array_max("all").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "kept.labels")), ",").alias("labels"),
        F.greatest(F.col("kept.score"), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
