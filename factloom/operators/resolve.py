"""Finding the person a name means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import fixed
from factloom.functions.text import core_tokens, generation_rank, last_name, name_tokens, normal_name, short_form_of
from factloom.operators.similarity import greedy_select


def exact_then_initial(wanted: DataFrame, people: DataFrame) -> DataFrame:
    """(wanted_id, person_id, how): first by equal normal names, else by surname and first letter. Over all of ``people``
    the exact pass comes first; ties go to the lower id."""
    w = wanted.select(F.col("id").alias("wanted_id"), normal_name(F.col("name")).alias("n"), last_name(F.col("name")).alias("l"), F.substring(F.get(name_tokens(F.col("name")), 0), 1, 1).alias("i"))
    p = people.select(F.col("id").alias("person_id"), normal_name(F.col("name")).alias("n"), last_name(F.col("name")).alias("l"), F.substring(F.get(name_tokens(F.col("name")), 0), 1, 1).alias("i"))
    exact = w.join(p.select("n", "person_id"), "n").groupBy("wanted_id").agg(F.min("person_id").alias("person_id")).withColumn("how", F.lit("exact"))
    rest = w.join(exact, "wanted_id", "left_anti")
    loose = rest.join(p.select("l", "i", "person_id"), ["l", "i"]).groupBy("wanted_id").agg(F.min("person_id").alias("person_id")).withColumn("how", F.lit("initial"))
    return exact.unionByName(loose)


def first_row_match(wanted: DataFrame, people: DataFrame) -> DataFrame:
    """(wanted_id, person_id): the first person, by id, whose name or any alias equals the wanted one."""
    names = people.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    p = names.select(F.col("id").alias("person_id"), normal_name(F.col("name")).alias("n"))
    w = wanted.select(F.col("id").alias("wanted_id"), normal_name(F.col("name")).alias("n"))
    return w.join(p, "n").groupBy("wanted_id").agg(F.min("person_id").alias("person_id"))


#: Birth years this far apart part two people of one name, and those of different generations.
FAR, FAR_GENERATIONS = 8, 5
Pairs = Sequence[tuple[str, str]]


def _listed(a: Column, b: Column, pairs: Pairs) -> Column:
    pair = F.array_join(F.array_sort(F.array(F.lower(F.trim(a)), F.lower(F.trim(b)))), "|")
    return pair.isin(*["|".join(sorted(n.lower().strip() for n in p)) for p in pairs]) if pairs else F.lit(False)


def _first_forms(a: Column, b: Column) -> Column:
    return short_form_of(a, b) | short_form_of(b, a)


def candidates(a: Column, b: Column) -> Column:
    """Whether two names can be one person's at all: two core words at least, the last one equal, the first one equal or a short form."""
    x, y = core_tokens(a), core_tokens(b)
    first_a, first_b = F.get(x, 0), F.get(y, 0)
    return F.coalesce((F.size(x) > 1) & (F.size(y) > 1) & (F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1))) & ((first_a == first_b) | _first_forms(first_a, first_b)), F.lit(False))


def verdict(a: Column, b: Column, born_a: Column, born_b: Column, together: Pairs = (), never: Pairs = ()) -> Column:
    """merge or apart for two candidates; pairs of names listed as one, or as never one, come first. Years known and close outweigh suffixes that
    differ; names that only agree in short form need the same known year."""
    gap = F.abs(born_a - born_b)
    first_a, first_b = F.get(core_tokens(a), 0), F.get(core_tokens(b), 0)
    rank_a, rank_b = generation_rank(a), generation_rank(b)
    generations = (rank_a != rank_b) & (F.greatest(rank_a, rank_b) >= 2)
    short = F.coalesce((first_a != first_b) & _first_forms(first_a, first_b), F.lit(False))
    return (
        F.when(_listed(a, b, together), "merge")
        .when(_listed(a, b, never), "apart")
        .when(generations & (gap.isNull() | (gap >= FAR_GENERATIONS)), "apart")
        .when(gap >= FAR, "apart")
        .when(short & (gap.isNull() | (gap != 0)), "apart")
        .otherwise("merge")
    )


def _classes(people: DataFrame, order: str, listed: Pairs) -> DataFrame:
    """One row for all (``order``, name, born) that no rule tells apart, with the least ``order``: names meet as
    first and last word, generation and year, and in full only where a listed pair names them."""
    names = sorted({n.lower().strip() for p in listed for n in p})
    core = core_tokens(F.col("name"))
    named = F.when(F.lower(F.trim("name")).isin(*names), F.lower(F.trim("name"))) if names else F.lit(None).cast("string")
    rows = people.where(F.size(core) > 1).select(
        order, "name", "born", F.get(core, 0).alias("first"), F.try_element_at(core, F.lit(-1)).alias("last"), generation_rank(F.col("name")).alias("rank"), named.alias("named")
    )
    return rows.groupBy("first", "last", "rank", "born", "named").agg(F.min(F.struct(order, "name")).alias("_least")).select(
        "first", "last", "rank", "born", "named", F.col(f"_least.{order}").alias(order), F.col("_least.name").alias("name")
    )


def _keys(classes: DataFrame) -> DataFrame:
    """Classes with ``key``, one row for each first name that theirs may stand for: itself, its beginnings and what it is a nickname of."""
    long = F.create_map(*[x for k, v in fixed.NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    starts = F.when(F.length("first") > 3, F.transform(F.sequence(F.lit(3), F.length("first") - 1), lambda n: F.left("first", n)))
    none = F.array().cast("array<string>")
    keys = F.concat(F.array("first"), F.coalesce(starts, none), F.coalesce(F.try_element_at(long, "first"), none))
    return classes.withColumn("key", F.explode(F.array_distinct(keys)))


def _met(left: DataFrame, right: DataFrame, together: Pairs, never: Pairs) -> DataFrame:
    """(a, b, verdict) of classes (a of ``left``, b of ``right``) that are candidates. They meet on the last name and a first name that one of
    them has and the other may stand for, so that a common surname alone brings nobody together."""
    def keyed(df: DataFrame, name: str, own: str) -> DataFrame:
        return _keys(df).select("last", "key", F.col(own).alias(name), F.col("name").alias(f"{name}_name"), F.col("born").alias(f"{name}_born"), (F.col("key") == F.col("first")).alias(f"{name}_own"))

    pairs = keyed(left, "a", "a").join(keyed(right, "b", "b"), ["last", "key"]).where(F.col("a_own") | F.col("b_own")).dropDuplicates(["a", "b"])
    pairs = pairs.where(candidates(F.col("a_name"), F.col("b_name")))
    said = verdict(F.col("a_name"), F.col("b_name"), F.col("a_born"), F.col("b_born"), together, never)
    return pairs.select("a", "b", "a_name", "b_name", said.alias("verdict"))


def candidate_pairs(people: DataFrame, together: Pairs = (), never: Pairs = ()) -> DataFrame:
    """(a, b, verdict) of people (id, name, born) who may be one person: merge, or review where the rules keep candidates apart. Pairs
    listed as never one are left out; people that no rule tells apart are one node, that of the least id."""
    classes = _classes(people, "id", [*together, *never])
    met = _met(classes.withColumnRenamed("id", "a"), classes.withColumnRenamed("id", "b"), together, never).where("a < b")
    kept = met.where((F.col("verdict") == "merge") | ~_listed(F.col("a_name"), F.col("b_name"), never))
    return kept.select("a", "b", F.when(F.col("verdict") == "apart", "review").otherwise("merge").alias("verdict"))


def seeded(people: DataFrame, arrivals: DataFrame, together: Pairs = (), never: Pairs = ()) -> DataFrame:
    """What becomes of ``arrivals`` (at, name, born) taken in the order of ``at`` against ``people`` (id, name, born): (at, outcome,
    person_id, first_at). ``exact``: the name, "& family" aside, is a person's, of several the one of highest id. ``same``: it is the first person,
    by id, or else the first earlier insert, by ``at``, that it merges with. All others are ``inserted``, and later arrivals see them.

    The order is kept without going through it: arrivals that no rule tells apart are one node with the least ``at``; of those that no
    person matches, a node is inserted once all earlier nodes it would merge with are known to be no inserts (``greedy_select``). A null name
    has no core and is inserted."""
    def told(name: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"\s*&\s*family$", ""), r"\s+", " "))

    known = people.groupBy(told(F.col("name")).alias("told")).agg(F.max("id").alias("person_id"))
    rows = arrivals.withColumn("told", told(F.col("name"))).join(known, "told", "left")
    exact = rows.where("person_id is not null").select("at", F.lit("exact").alias("outcome"), "person_id", F.lit(None).cast(arrivals.schema["at"].dataType).alias("first_at"))
    rest = rows.where("person_id is null").select("at", "name", "born").checkpoint()

    listed = [*together, *never]
    nodes, own = _classes(rest, "at", listed).checkpoint(), _classes(people, "id", listed)
    merge = F.col("verdict") == "merge"
    persons = _met(nodes.withColumnRenamed("at", "a"), own.withColumnRenamed("id", "b"), together, never).where(merge).groupBy("a").agg(F.min("b").alias("person_id"))
    persons = persons.withColumnRenamed("a", "node").checkpoint()
    free = nodes.join(persons, nodes["at"] == persons["node"], "left_anti").checkpoint()
    edges = _met(free.withColumnRenamed("at", "a"), free.withColumnRenamed("at", "b"), together, never).where(merge & (F.col("b") < F.col("a"))).select("a", "b").checkpoint()
    inserted = greedy_select(free.select(F.col("at").alias("key"), F.col("at").alias("rank")), edges).withColumnRenamed("key", "b")
    before = edges.join(inserted, "b").groupBy("a").agg(F.min("b").alias("first_at")).withColumnRenamed("a", "node")
    before = before.join(inserted, before["node"] == inserted["b"], "left_anti")

    core = core_tokens(F.col("name"))
    same_as = ["first", "last", "rank", "born", "named"]
    keyed = rest.select("at", F.get(core, 0).alias("first"), F.try_element_at(core, F.lit(-1)).alias("last"), generation_rank(F.col("name")).alias("rank"), "born", (F.size(core) > 1).alias("whole"), "name")
    names = sorted({n.lower().strip() for p in listed for n in p})
    keyed = keyed.withColumn("named", F.when(F.lower(F.trim("name")).isin(*names), F.lower(F.trim("name"))) if names else F.lit(None).cast("string")).drop("name")
    node_of = nodes.select(F.col("at").alias("node"), *[F.col(c).alias(f"{c}_") for c in same_as])
    meet = F.col("whole")
    for c in same_as:
        meet = meet & F.col(c).eqNullSafe(F.col(f"{c}_"))
    placed = keyed.join(node_of, meet, "left").select("at", "node").join(persons, "node", "left").join(before, "node", "left")
    first = F.coalesce("first_at", F.when(F.col("node") != F.col("at"), F.col("node")))
    outcome = F.when(F.col("person_id").isNotNull() | first.isNotNull(), "same").otherwise("inserted")
    return exact.unionByName(placed.select("at", outcome.alias("outcome"), "person_id", F.when(F.col("person_id").isNull(), first).alias("first_at")))
