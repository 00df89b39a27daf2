"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a target number of words. Whole rounds of a source are taken first; what remains of its target is a
budget that a subset of its documents must fill. Documents are counted by exact length; from every length an equal
share is taken, the largest lengths that still fit follow, and a bounded-knapsack table over what is left picks the
lengths that fill the budget exactly or as nearly below it as can be. Of each length the documents with the lowest
seeded hash are taken.

Edge cases: a null text has length 0 and is taken for nothing; a null source is a source of its own, last in order; an
empty table gives no rows; sources of size 0 have target 0. Reruns agree, as all order comes from a seeded hash of the
id; rows that agree in id, source and length are interchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Cells of the knapsack table.
TABLE = 1 << 16
#: Documents of one source and length that one task ranks together, about.
RANKED = 200


def size_of(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: ``share`` times all sizes by weight; none gets over ``most`` times its
    size, and what is cut off is shared again by weight among the others until none is above. Sources are counted off in
    order of code points, null last, for their weights; a round costs one sum over them, and their number is not limited."""
    placed = sources.sort(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed, "sources")
    # Rows are numbered within the partitions of the sort: a partition's numbers go on where the one before ends.
    parts = placed.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    begins = dict(zip([r["part"] for r in parts], np.cumsum([0, *[r["n"] for r in parts[:-1]]]).tolist() if parts else [], strict=True))
    part = F.shiftright("at", 33)
    begin = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in begins.items() for x in kv]), part) if begins else F.lit(0)
    rank = begin + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    placed = cut(placed.select("source", "source_size", weight.alias("weight")), "weighed-sources")

    bound = F.col("source_size") * F.lit(float(most))
    budget = share * float(placed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    rate, at_bound = 0.0, -1
    while True:
        # Sources that a unit of weight brings above their bound stop there; the rest is shared by the others.
        over = bound < F.col("weight") * F.lit(rate)
        told = placed.agg(F.sum(F.when(over, bound)).alias("gone"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("n")).first()
        if told["n"] == at_bound or not told["weight"]:
            break
        at_bound, rate = told["n"], (budget - (told["gone"] or 0.0)) / told["weight"]
    target = F.when(over, bound).otherwise(F.col("weight") * F.lit(rate)) if told["weight"] else bound
    return placed.select("source", "source_size", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their lengths sum to ``budget`` or near it: the best sum below
    that the method finds, or one document more where that comes nearer. ``lengths`` are distinct."""
    take = _fill(lengths, counts, budget)
    rest = budget - int((take * lengths).sum())
    more = np.flatnonzero((counts > take) & (lengths > 0))
    if rest > 0 and len(more):
        i = more[np.argmin(np.abs(rest - lengths[more]))]
        take[i] += int(abs(rest - int(lengths[i])) < rest)
    return take


def _fill(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    # An equal share of every length, short of the budget by what the table can choose over.
    bulk = max(0, budget - TABLE // 2)
    positive = lengths > 0
    take[positive] = [int(c) * bulk // total for c in counts[positive]]
    left = budget - int((take * lengths).sum())
    for room in (TABLE // 2, 0):  # then the largest lengths, leaving the table something to fit, or all that goes in
        for i in np.argsort(-lengths, kind="stable"):
            if left < TABLE:
                break
            if lengths[i] > 0:
                more = min(int(counts[i] - take[i]), (left - room) // int(lengths[i]))
                take[i] += more
                left -= more * int(lengths[i])
    if left >= TABLE:  # every document that is left is longer than this rest
        return take
    # Bounded knapsack: made_by[v] is the first item with which the sum v can be made. Counts are split in powers of two.
    made_by = np.full(left + 1, -1, np.int64)
    reach = np.zeros(left + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        length, free = int(lengths[i]), int(counts[i] - take[i])
        if length <= 0 or length > left or free <= 0:
            continue
        free, part = min(free, left // length), 1
        while free > 0:
            part = min(part, free)
            step = part * length
            new = np.zeros(left + 1, bool)
            new[step:] = reach[:-step]
            new &= ~reach
            made_by[new] = len(items)
            reach |= new
            items.append((int(i), part))
            free -= part
            part *= 2
        if reach[left]:
            break
    v = int(np.flatnonzero(reach)[-1])
    while v > 0:
        i, part = items[made_by[v]]
        take[i] += part
        v -= part * int(lengths[i])
    return take


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies (how often the mix takes it), taken
    (words). Sources in order of code points, null last, have ``weights`` in turn; all targets sum to ``share`` times
    all sizes unless every source is at ``most`` times its size. No document is taken more often than ``most``, rounded up."""
    sized = cut(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size_of(F.col(f"`{text_col}`")).alias("size")), "sizes")

    counted = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted, "lengths")
    goals = targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        words, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        rounds = int(target // words) if words else 0
        extra = fit(group["size"].to_numpy(), group["n"].to_numpy(), int(round(target)) - rounds * words)
        return group[["source", "size", "n", "source_size", "target"]].assign(rounds=rounds, extra=extra)

    # A group is one source's table of lengths, at most as many rows as its longest document has words.
    planned = counted.join(goals, counted["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    planned = planned.groupBy("source").applyInPandas(plan, "source string, size long, n long, source_size long, target double, rounds long, extra long")
    planned = cut(planned, "plan")

    # Documents of one length are ranked by hash in parts of about RANKED; a part's ranks start where the parts of lower hash end.
    parts = F.least(F.ceil(F.col("n") / RANKED), F.lit(1 << 20)).cast("long")
    key = [F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("size")]
    left = sized.select("id", "source", "size", *[k.alias(f"k{i}") for i, k in enumerate(key)])
    right = planned.select(*[k.alias(f"k{i}") for i, k in enumerate(key)], "n", "source_size", "target", "rounds", "extra", parts.alias("parts"))
    rows = left.join(right, ["k0", "k1", "k2"])
    rows = rows.withColumn("hash", F.xxhash64("id", F.lit(seed)))
    rows = rows.withColumn("part", F.floor((F.shiftrightunsigned("hash", 33) / F.lit(float(1 << 31))) * F.col("parts")).cast("long"))
    whole = (F.col("extra") == 0) | (F.col("extra") >= F.col("n"))
    settled = rows.where(whole).withColumn("more", (F.col("extra") > 0).cast("long"))
    open_rows = rows.where(~whole)
    full = open_rows.groupBy("k0", "k1", "k2", "part").agg(F.count(F.lit(1)).alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy("k0", "k1", "k2").orderBy("part")) - F.col("in_part")
    full = full.select("k0", "k1", "k2", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("k0", "k1", "k2", "part").orderBy(F.shiftrightunsigned("hash", 1), "hash", "id"))
    ranked = open_rows.withColumn("rank", rank).join(full, ["k0", "k1", "k2", "part"])
    ranked = ranked.withColumn("more", (F.col("before") + F.col("rank") <= F.col("extra")).cast("long"))

    out = settled.unionByName(ranked.select(*settled.columns)).withColumn("copies", F.col("rounds") + F.col("more"))
    return out.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )
