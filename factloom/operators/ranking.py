"""Orders, pages, promoted slices, diversification, and the seeded daily order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Rows of one page, counted from 1; the order should end in a unique column."""
    if number < 1 or not 1 <= size <= 2000:
        raise ValueError("page counts from 1; size is 1 to 2000")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def graded_first(df: DataFrame, graded: Column, score: Column, name: str, descending: bool = True) -> list[Column]:
    """Order in which rows without a grade are last, whichever way the score goes."""
    return [graded.desc(), score.desc_nulls_last() if descending else score.asc_nulls_last(), F.col(name).asc()]


def promoted_first(df: DataFrame, order: Sequence[Column], points: Column, window: int, promoted: int) -> DataFrame:
    """``df`` with ``pos`` from 1: of the first ``window`` rows in ``order`` the ``promoted`` with most points come first,
    all others follow in ``order``. The window is cut by a sorted limit, so only so many rows are ranked together."""
    keyed = df.withColumn("_points", points)
    head = keyed.orderBy(*order).limit(window).withColumn("_in", F.row_number().over(Window.orderBy(*order)))
    head = head.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("_points"), "_in")))
    ahead = F.count_if(F.col("_rank") > promoted).over(Window.orderBy("_in"))
    return head.withColumn("pos", F.when(F.col("_rank") <= promoted, F.col("_rank")).otherwise(F.lit(promoted) + ahead)).drop("_points", "_in", "_rank")


def ranged(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df``, stored, in ranges of an order that are sorted apart: ``_part``, the range, and ``_at``, the place in it from 0. Ranges are cut
    at quantiles of the order, so that no task has all rows."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    return rows.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def _carried(rows: DataFrame, amount: Column, name: str) -> DataFrame:
    """(_part, ``name``): what the ranges before each one come to. One row a range: few enough to be added up together."""
    sums = rows.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    return F.broadcast(sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias(name)))


def placed(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with its rows' places from 1 in an order that should end in a unique column, as a column ``name``. A range's places go on
    where those before end; no window runs over the rows."""
    rows = ranged(df, order)
    return rows.join(_carried(rows, F.lit(1), "_before"), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def numbered(df: DataFrame, pos: str, name: str, first: Column | None = None) -> DataFrame:
    """``df`` with its rows' numbers from 1 in the order of ``first`` (a boolean, false first) and ``pos``, as a column ``name``."""
    return placed(df, [*([first.asc()] if first is not None else []), F.asc(pos)], name)


def under_budget(df: DataFrame, order: Sequence[Column], cost: Column, budget: float) -> DataFrame:
    """``df`` with ``spent``, what all rows before cost, and ``runs``: rows are taken in order until the budget is exceeded, so the
    last one may go beyond it. A null cost is none."""
    rows = ranged(df.withColumn("_cost", F.coalesce(cost, F.lit(0.0))), order)
    here = F.sum("_cost").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    spent = F.col("_before") + F.coalesce(here, F.lit(0.0))
    out = rows.join(_carried(rows, F.col("_cost"), "_before"), "_part").withColumn("spent", spent)
    return out.withColumn("runs", F.col("spent") <= budget).drop("_cost", "_part", "_at", "_before")


def diversify(df: DataFrame, pos: str, kind: str, cap: int) -> DataFrame:
    """``df`` with ``new_pos``: of every kind the first ``cap`` rows keep their turn, the rest go behind them; rows without a
    kind stay where they are. The slots of classified rows are filled again in the new order."""
    known = df.where(F.col(kind).isNotNull())
    nth = F.row_number().over(Window.partitionBy(kind).orderBy(pos))
    items = numbered(known.withColumn("_late", nth > cap), pos, "_slot", F.col("_late")).drop("_late")
    slots = numbered(known.select(F.col(pos).alias("new_pos")), "new_pos", "_slot")
    placed = items.join(slots, "_slot").select(*df.columns, "new_pos")
    return placed.unionByName(df.where(F.col(kind).isNull()).withColumn("new_pos", F.col(pos)))


# 32-bit FNV-1a, and the linear congruential generator of the daily order.
FNV_START, FNV_PRIME = 2166136261, 16777619
LCG_FACTOR, LCG_STEP, LCG_MASK = 1664525, 1013904223, 0x7FFFFFFF


def seed(text: Column) -> Column:
    """FNV-1a of an ASCII text, its lower 31 bits."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    folded = F.aggregate(codes, F.lit(FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))
    return folded.bitwiseAND(F.lit(LCG_MASK))


#: Ids that a day's order is drawn from, at most: its swaps are one array of two numbers an id.
DRAWN = 1_000_000


def drawn(start: Column, steps: Column) -> Column:
    """State of the generator after so many steps (under 2**20) from ``start``, by jumps of powers of two."""
    factor, step, state = LCG_FACTOR, LCG_STEP, start.cast("long")
    for bit in range(20):
        taken = F.shiftright(steps, bit).bitwiseAND(F.lit(1)) == 1
        state = (state * F.when(taken, factor).otherwise(1).cast("long") + F.when(taken, step).otherwise(0).cast("long")).bitwiseAND(F.lit(LCG_MASK))
        factor, step = factor * factor & LCG_MASK, (factor * step + step) & LCG_MASK
    return state


def daily_pick(pool: DataFrame, key: str, day: str, n: int = 10) -> DataFrame:
    """(key, place) of the first ``n`` ids of a pool in the order of a day: ids by key, shuffled from the end by Fisher and Yates with the
    generator seeded by the day. Swaps are made for all steps at once, and the places asked for are followed back through them."""
    ids = placed(pool.select(key), [F.asc(key)], "_from").checkpoint()
    size = ids.count()
    if size > DRAWN:
        raise ValueError(f"{size} ids are more than the {DRAWN} that a day's order is drawn from")
    # The swap at place i is the (size - i)th, so going back through time is going up through places.
    last = F.col("id")
    other = F.least(last, F.floor(drawn(seed(F.lit(day)), F.lit(size) - last) / F.lit(float(LCG_MASK)) * (last + 1)))
    swaps = pool.sparkSession.range(1, max(size, 1)).select(F.struct(last.alias("i"), other.alias("j")).alias("swap"))
    wanted = swaps.agg(F.array_sort(F.collect_list("swap")).alias("swaps")).select("swaps", F.explode(F.sequence(F.lit(0), F.lit(max(min(n, size), 1) - 1))).alias("at"))
    back = F.aggregate("swaps", F.col("at").cast("long"), lambda p, s: F.when(p == s["i"], s["j"]).when(p == s["j"], s["i"]).otherwise(p))
    found = wanted.select((back + 1).alias("_from"), (F.col("at") + 1).cast("int").alias("place"))
    return ids.join(F.broadcast(found), "_from").select(key, "place")


def pool(eligible: DataFrame, everyone: DataFrame, least: int = 10) -> DataFrame:
    """The eligible rows, or everyone if there are fewer than ``least``."""
    n = eligible.limit(least).agg(F.count(F.lit(1))).scalar()
    return eligible.where(n >= least).unionByName(everyone.where(n < least))


def tiers(df: DataFrame, key: str, order: Sequence[Column], run: int) -> DataFrame:
    """Rows due on a numbered run, with ``tier``: the first 100 always, the next 300 on every third, the rest on every
    tenth. Only the first 400, a sorted limit, are ranked together."""
    head = df.orderBy(*order).limit(400)
    ranked = head.withColumn("tier", F.when(F.row_number().over(Window.orderBy(*order)) <= 100, 1).otherwise(2))
    due = ranked if run % 3 == 0 else ranked.where("tier = 1")
    return due.unionByName(df.join(head.select(key), key, "left_anti").withColumn("tier", F.lit(3))) if run % 10 == 0 else due
