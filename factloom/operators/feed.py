"""The feed: which candidates go on, which stories are one, what guards drop.

Rules that depend on what was accepted before run per feed run, a bounded group of its own; everything that only
compares with what is published is a join before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import event_signature
from factloom.operators.ranking import placed
from factloom.operators.similarity import best_match, jaccard_join

#: Jaccard from which two titles tell of one event: within a run, against what is published; and where doubt begins.
SAME_RUN, PUBLISHED, DOUBT = 0.5, 0.4, 0.2
PER_PERSON, PICKED = 2, 20
#: Cards of one run or feed at most: a run is gone through in one task.
RUN = 100_000


def _bounded(cards: int) -> None:
    if cards > RUN:
        raise ValueError(f"{cards} cards in one run are more than the {RUN} that one task goes through")


def near_published(candidates: DataFrame, published: DataFrame) -> DataFrame:
    """(key, near, score), stored: the nearest published title of every candidate with one in doubt or above. Both have
    (key, title); candidates of one token set are compared once."""

    def titled(cards: DataFrame) -> DataFrame:
        return cards.select("key", F.array_sort(event_signature(F.col("title"))).alias("tokens"))

    def sets(titles: DataFrame) -> DataFrame:
        return titles.where(F.size("tokens") > 0).groupBy("tokens").agg(F.min("key").alias("key")).select("key", "tokens").checkpoint()

    c = titled(candidates).checkpoint()
    own, p = sets(c), sets(titled(published))
    best = best_match(own, p, DOUBT).join(own, F.col("left_key") == F.col("key")).select("tokens", F.col("right_key").alias("near"), "score")
    return c.join(best, "tokens").select("key", "near", "score").checkpoint()


def select_candidates(candidates: DataFrame, published: DataFrame, run: str = "run") -> DataFrame:
    """Candidates (run, key, rank, person, title) that go on, with ``place``, and ``near`` and ``score`` where a
    published title leaves doubt. In order of rank: at most two a person, none like an accepted one, none like a
    published one, twenty in all. A run of more than ``RUN`` cards is refused."""
    near = near_published(candidates, published)
    fresh = candidates.join(near, "key", "left").where(F.coalesce("score", F.lit(0.0)) < PUBLISHED)
    fresh = fresh.withColumn("tokens", event_signature(F.col("title")))
    kinds = dict(candidates.dtypes)

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        _bounded(len(group))
        counts: dict[object, int] = {}
        kept: list[tuple[object, set]] = []
        for key, person, tokens in group.sort_values(["rank", "key"])[["key", "person", "tokens"]].itertuples(index=False):
            own = set(tokens)
            if counts.get(person, 0) >= PER_PERSON or any(own and s and len(own & s) / len(own | s) >= SAME_RUN for _, s in kept):
                continue
            counts[person] = counts.get(person, 0) + 1
            kept.append((key, own))
            if len(kept) == PICKED:
                break
        return pd.DataFrame({run: group[run].iloc[0], "key": [k for k, _ in kept], "place": range(1, len(kept) + 1)})

    picked = fresh.select(run, "key", "rank", "person", "tokens").groupBy(run).applyInPandas(pick, f"{run} {kinds[run]}, key {kinds['key']}, place int")
    return picked.join(near, "key", "left").select(run, "key", "place", "near", "score")


def event_clusters(cards: DataFrame, feed: str = "feed") -> DataFrame:
    """(feed, key, cluster): cards (feed, key, rank, title, url) taken by rank join the cluster of an earlier card of
    the same URL, else the first whose founder's title is like theirs, else found one. The cluster is its founder. A feed of more than ``RUN`` cards is refused."""
    kinds = dict(cards.dtypes)

    def group_up(group: pd.DataFrame) -> pd.DataFrame:
        _bounded(len(group))
        founders: list[tuple[object, set]] = []
        by_url: dict[str, int] = {}
        out = []
        for key, url, tokens in group.sort_values(["rank", "key"])[["key", "url", "tokens"]].itertuples(index=False):
            own = set(tokens)
            at = by_url.get(url, -1) if url else -1
            if at < 0:
                at = next((i for i, (_, s) in enumerate(founders) if own and s and len(own & s) / len(own | s) >= PUBLISHED), -1)
            if at < 0:
                founders.append((key, own))
                at = len(founders) - 1
            if url:
                by_url[url] = at
            out.append((group[feed].iloc[0], key, founders[at][0]))
        return pd.DataFrame(out, columns=[feed, "key", "cluster"])

    rows = cards.select(feed, "key", "rank", "url", event_signature(F.col("title")).alias("tokens"))
    return rows.groupBy(feed).applyInPandas(group_up, f"{feed} {kinds[feed]}, key {kinds['key']}, cluster {kinds['key']}")


def cooldown(candidates: DataFrame, refusals: DataFrame, threshold: float = PUBLISHED) -> DataFrame:
    """(key, kind) of candidates (key, person, title): none, blind if a like title was refused for all, person if it was
    refused for this person, which is the stronger. Refusals are (key, person or null, title)."""
    c = candidates.select(F.col("key").alias("left_key"), "person", F.array_sort(event_signature(F.col("title"))).alias("tokens"))
    r = refusals.select(F.col("person").alias("refused"), F.array_sort(event_signature(F.col("title"))).alias("r_tokens")).distinct()
    left = c.groupBy("tokens").agg(F.min("left_key").alias("key")).select("key", "tokens")
    right = r.select(F.col("r_tokens").alias("tokens")).distinct().withColumn("key", F.xxhash64("tokens")).select("key", "tokens")
    pairs = jaccard_join(left, right, threshold)
    alike = pairs.join(left, F.col("left_key") == F.col("key")).select(F.col("tokens").alias("c_tokens"), "right_key").join(right, F.col("right_key") == F.col("key")).select("c_tokens", F.col("tokens").alias("r_tokens"))
    hits = c.join(alike, F.col("tokens") == F.col("c_tokens")).join(r, "r_tokens").where(F.col("refused").isNull() | (F.col("refused") == F.col("person")))
    found = hits.groupBy("left_key").agg(F.max(F.when(F.col("refused").isNotNull(), 2).otherwise(1)).alias("level"))
    kind = F.when(F.col("level") == 2, "person").when(F.col("level") == 1, "blind").otherwise("none")
    return c.join(found, "left_key", "left").select(F.col("left_key").alias("key"), kind.alias("kind"))


def first_per_person(cards: DataFrame, person: str, pos: str) -> DataFrame:
    """The first card of every person; cards of no person all stay."""
    known = cards.where(F.col(person).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(person).orderBy(pos)))
    return known.where("_n = 1").drop("_n").unionByName(cards.where(F.col(person).isNull()))


def guarded(items: DataFrame, guards: Mapping[str, Column], verdicts: DataFrame | None = None, enforced: bool = True) -> DataFrame:
    """Items with ``dropped_by``, the first guard that holds, or null. A verdict table (key, verdict, failed_open) adds
    ``judge``; a judge that failed open drops nothing but shows in ``failed_open``, and one that is not enforced only
    shows in ``verdict``."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(list(guards.items())):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    rows = items.withColumn("dropped_by", out)
    if verdicts is None:
        return rows
    rows = rows.join(verdicts.select("key", "verdict", "failed_open"), "key", "left").withColumn("failed_open", F.coalesce("failed_open", F.lit(False)))
    judged = F.lit(enforced) & (F.col("verdict") == "reject") & ~F.col("failed_open")
    return rows.withColumn("dropped_by", F.when(F.col("dropped_by").isNull() & F.coalesce(judged, F.lit(False)), "judge").otherwise(F.col("dropped_by")))


def spliced(listed: DataFrame, near: DataFrame, verdicts: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The list (key and what ``order`` needs) less the cards that tell of a published event, with ``place`` from 1, closed up after them, and ``asked``:
    cleared or failed open where a judge was asked. A published title of ``PUBLISHED`` or more (``near``: key, score) takes a card off at once; one
    in doubt takes it off if the verdict (key, verdict, failed_open) is ``duplicate``. A judge that failed open, or wasn't there, takes off nothing."""
    rows = listed.join(near.select("key", "score"), "key", "left").join(verdicts.select("key", "verdict", "failed_open"), "key", "left")
    score = F.coalesce("score", F.lit(0.0))
    doubt = (score >= DOUBT) & (score < PUBLISHED)
    answered = F.col("verdict").isNotNull() & ~F.coalesce("failed_open", F.lit(False))
    gone = (score >= PUBLISHED) | (doubt & answered & (F.col("verdict") == "duplicate"))
    kept = rows.where(~gone).withColumn("asked", F.when(doubt & answered, "cleared").when(doubt, "failed open"))
    return placed(kept.drop("score", "verdict", "failed_open"), order, "place")
