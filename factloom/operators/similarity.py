"""Similar titles: exact Jaccard joins on token sets, best matches, greedy suppression, clusters.

Titles with equal token sets are one node: copies are never paired with each other, only with what is different. A set
is compared on its rarest tokens first (two sets with Jaccard of at least t share a token among the first
n - ceil(t n) + 1 of each), so that common words don't bring everything together. Best matches need no pairs of sets at all: sets meet
in subsets that they share, of which each keeps only the best set that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import jaccard

#: Tokens of a set whose subsets are listed, at most; larger sets meet by prefixes.
LISTED = 12
#: Pairs of places that one long has bits for: those of the first eleven places.
_LOW = 55


def _prefixes(sets: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(key, token, n, i): the rarest tokens of each set, as many as the threshold asks for, their places and the set's size."""
    tokens = sets.select("key", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(frequency, "token", "left")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("f", F.lit(0)), "token"))
    n = F.col("n")
    return tokens.withColumn("i", rank).where(F.col("i") <= n - F.ceil(n * threshold - 1e-9) + 1).select("key", "token", "n", "i")


def jaccard_join(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_key, right_key, score) of all pairs from two tables (key, tokens) with Jaccard of ``threshold`` at least. Only keys and
    places meet at a token; token arrays are joined to the pairs that are left."""
    frequency = left.select("tokens").union(right.select("tokens")).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    a, b = _prefixes(left, frequency, threshold).alias("a"), _prefixes(right, frequency, threshold).alias("b")
    # Sizes too far apart cannot reach the threshold, nor can sets that have too few tokens beside those before this one.
    near = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9)
    shared = F.least("a.i", "b.i") + F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    enough = shared >= threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-9
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & near & enough).select(F.col("a.key").alias("left_key"), F.col("b.key").alias("right_key")).distinct()
    both = pairs.join(left.select(F.col("key").alias("left_key"), F.col("tokens").alias("x")), "left_key").join(right.select(F.col("key").alias("right_key"), F.col("tokens").alias("y")), "right_key")
    return both.select("left_key", "right_key", jaccard(F.col("x"), F.col("y")).alias("score")).where(F.col("score") >= threshold)


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score), a < b, of a table (key, tokens) with distinct token sets."""
    return jaccard_join(sets, sets, threshold).where("left_key < right_key").select(F.col("left_key").alias("a"), F.col("right_key").alias("b"), "score")


def _shift(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits.cast("int"))


def _pairs(sets: DataFrame) -> DataFrame:
    """(key, pair, at): a hash of every two tokens of a set, and the number of their places i < j, j (j - 1) / 2 + i."""

    def later(x: Column, i: Column) -> Column:
        return F.transform(F.slice("h", i + 2, F.size("h")), lambda y, k: F.struct(x.bitwiseXOR(y).alias("pair"), (F.floor((i + k + 1) * (i + k) / 2) + i).cast("int").alias("at")))

    hashed = sets.select("key", F.transform("tokens", lambda w: F.xxhash64(w)).alias("h"))
    return hashed.select("key", F.explode(F.flatten(F.transform("h", later))).alias("p")).select("key", "p.pair", "p.at")


def _subsets(sets: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """(key, n, shared, x, y): the subsets of each set that can be what it shares with one of ``others``, by 128 bits: those with as
    many tokens as the threshold asks for at least, and no two that none of the others has both."""
    met = _pairs(sets).join(_pairs(others).select("pair").distinct(), "pair", "left_semi")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    low = F.bit_or(F.when(F.col("at") < _LOW, _shift(one, F.col("at"))).otherwise(none)).alias("low")
    high = F.bit_or(F.when(F.col("at") >= _LOW, _shift(one, F.col("at") - _LOW)).otherwise(none)).alias("high")
    known = sets.join(met.groupBy("key").agg(low, high), "key", "left")

    def place(w: Column, j: Column) -> Column:
        # Of the places before j those whose tokens another set has together with this one.
        first = F.floor(j * (j - 1) / 2).cast("int")
        bits = F.when(j <= 10, F.call_function("shiftright", F.coalesce("low", none), first)).otherwise(F.coalesce("high", none))
        return F.struct(F.xxhash64(w).alias("x"), F.xxhash64(F.lit(1), w).alias("y"), _shift(one, j).alias("bit"), bits.bitwiseAND(_shift(one, j) - 1).alias("beside"))

    def grown(listed: Column, p: Column) -> Column:
        fit = F.filter(listed, lambda s: s["at"].bitwiseAND(p["beside"]) == s["at"])
        return F.concat(listed, F.transform(fit, lambda s: F.struct(s["x"].bitwiseXOR(p["x"]).alias("x"), s["y"].bitwiseXOR(p["y"]).alias("y"), s["at"].bitwiseOR(p["bit"]).alias("at"))))

    empty = F.array(F.struct(none.alias("x"), none.alias("y"), none.alias("at")))
    every = known.select("key", F.size("tokens").alias("n"), F.transform("tokens", place).alias("places"))
    listed = every.select("key", "n", F.explode(F.aggregate("places", empty, grown)).alias("s")).select("key", "n", F.bit_count("s.at").alias("shared"), "s.x", "s.y")
    return listed.where((F.col("shared") > 0) & (F.col("shared") >= threshold * F.col("n") - 1e-9))


def best_match(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """For every left key its most similar right key; ties go to the lower key; keys without a match are missing. Of the right sets that
    hold a subset of a left set the smallest is the most similar for all that the subset says; for the subset that is all they share that is
    their similarity. So one right set a subset is enough, and rows grow with the sets, not with the pairs. Tables are read several times."""
    size = F.size("tokens")
    short, few = left.where(size <= LISTED), right.where(size <= LISTED)
    least = _subsets(few, short, threshold).groupBy("x", "y").agg(F.min(F.struct("n", "key")).alias("least"))
    n, m, shared = F.col("n"), F.col("least.n"), F.col("shared")
    met = _subsets(short, few, threshold).join(least, ["x", "y"]).select(F.col("key").alias("left_key"), F.col("least.key").alias("right_key"), (shared / (n + m - shared)).alias("score"))
    found = met.where(F.col("score") >= threshold)
    long, many = left.where(size > LISTED), right.where(size > LISTED)
    if not long.isEmpty():
        found = found.union(jaccard_join(long, right, threshold))
    if not many.isEmpty():
        found = found.union(jaccard_join(short, many, threshold))
    best = found.groupBy("left_key").agg(F.max(F.struct("score", (-F.col("right_key")).alias("down"))).alias("best"))
    return best.select("left_key", (-F.col("best.down")).alias("right_key"), F.col("best.score").alias("score"))


def greedy_select(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys that survive when nodes (key, rank) are taken by rank and each taken one shuts out its later neighbours in
    ``edges`` (a, b). Rounds accept every open node without an earlier open neighbour and drop its neighbours; that is
    the same as going one by one, in as many rounds as the longest chain of decisions."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ranks = nodes.select("key", "rank")
    graph = both.join(ranks.select(F.col("key").alias("a"), F.col("rank").alias("ra")), "a").join(ranks.select(F.col("key").alias("b"), F.col("rank").alias("rb")), "b").checkpoint()
    state = ranks.select("key", F.lit("open").alias("state")).checkpoint()
    while True:
        live = state.where("state = 'open'").select("key")
        earlier = graph.where("rb < ra").join(live.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("key")).distinct()
        taken = live.join(earlier, "key", "left_anti")
        dropped = graph.join(taken.withColumnRenamed("key", "b"), "b").select(F.col("a").alias("key")).distinct()
        marked = state.join(taken.withColumn("_take", F.lit(True)), "key", "left").join(dropped.withColumn("_drop", F.lit(True)), "key", "left")
        state = marked.select("key", F.when(F.col("state") != "open", F.col("state")).when(F.col("_take"), "taken").when(F.col("_drop"), "dropped").otherwise("open").alias("state")).checkpoint()
        if state.where("state = 'open'").isEmpty():
            return state.where("state = 'taken'").select("key")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, cluster): the least key that each node is connected with through ``edges`` (a, b)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = nodes.select("key", F.col("key").alias("cluster")).checkpoint()
    while True:
        seen = both.join(labels, both["b"] == labels["key"]).select(F.col("a").alias("key"), "cluster")
        best = seen.union(labels).groupBy("key").agg(F.min("cluster").alias("cluster"))
        ends = labels.select(F.col("key").alias("cluster"), F.col("cluster").alias("next"))
        new = best.join(ends, "cluster").select("key", F.col("next").alias("cluster")).checkpoint()
        if new.join(labels, ["key", "cluster"], "left_anti").isEmpty():
            return new
        labels = new
