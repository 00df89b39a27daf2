"""Event time on Structured Streaming: last writer wins, fixed-window limits, bounded duplicates, recomputation."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators import latest


def last_writer_wins(stream: DataFrame, user: str, target: str, direction: str, stamp: str, horizon: str = "400 days") -> DataFrame:
    """One row per arriving vote: (user, target, direction, stamp, outcome). A vote is ``superseded`` if one of a later
    stamp is known; of equal stamps the later arrival wins. State is one stamp per (user, target), forgotten when votes
    of others are newer by the horizon."""
    kinds = dict(stream.dtypes)
    schema = f"{user} {kinds[user]}, {target} {kinds[target]}, {direction} {kinds[direction]}, {stamp} timestamp, outcome string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else None
        newest = seen
        for rows in batches:  # a key with very many votes is never held whole
            # Most keys have few votes: what is done per key counts, so rows go on as they came, with one column more.
            micros = rows[stamp].to_numpy().astype("datetime64[us]").astype("int64")
            outcome = "accepted" if seen is None else ["superseded" if m < seen else "accepted" for m in micros.tolist()]
            newest = int(micros.max()) if newest is None else max(newest, int(micros.max()))
            yield rows.assign(outcome=outcome)
        state.update((newest,))
        # The watermark lags behind the newest vote of all by the horizon.
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + 1)

    slim = stream.select(user, target, direction, F.col(stamp).cast("timestamp").alias(stamp)).withWatermark(stamp, horizon)
    return slim.groupBy(user, target).applyInPandasWithState(step, schema, "seen long", "append", GroupStateTimeout.EventTimeTimeout)


def over_limit(stream: DataFrame, key: str, ts: str, limit: int, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(key, minute, n): fixed windows in which a key has ``limit`` events or more."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counts = timed.groupBy(key, F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= limit).select(key, F.col("w.start").alias("minute"), "n")


def first_seen(stream: DataFrame, key: str, ts: str, horizon: str = "45 days") -> DataFrame:
    """Rows whose key was not seen within the horizon."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def cooled(stream: DataFrame, refusals: DataFrame, key: str, ts: str, days: int = 14) -> DataFrame:
    """Rows without a refusal of the same key in the days before; refusals are a static table (key, refused_at)."""
    r = refusals.groupBy(key).agg(F.max("refused_at").alias("_refused"))
    joined = stream.join(r, key, "left")
    blocked = F.coalesce(F.col("_refused") > F.col(ts) - F.make_dt_interval(F.lit(days)), F.lit(False))
    return joined.where(~blocked).drop("_refused")


def met_refusals(candidates: DataFrame, refusals: DataFrame, key: str, ts: str, refused_at: str, days: int = 14, late: str = "1 hour") -> DataFrame:
    """Candidates with each refusal of their key in the days before them, both of them streams. The bounds on both times and the two watermarks
    bound the state: a refusal is kept for the days, a candidate until no earlier refusal can come."""
    c = candidates.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).alias("c")
    r = refusals.select(F.col(key).alias("_key"), F.col(refused_at).cast("timestamp").alias(refused_at)).withWatermark(refused_at, late).alias("r")
    at, before = F.col(f"c.{ts}"), F.col(f"r.{refused_at}")
    near = (before <= at) & (before > at - F.make_dt_interval(F.lit(days)))
    return c.join(r, (F.col(f"c.{key}") == F.col("r._key")) & near).drop("_key")


def recompute(stream: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that, for the distinct keys of every batch, makes their rows anew and saves them. ``save`` gets the
    batch number, so that a batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        save(make(batch.select(key).distinct()), number)

    return stream.writeStream.foreachBatch(each)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over all that is there, and read back its rows with the ``batch`` they came in."""
    at = f"{folder}/stream-{uuid.uuid4().hex}"

    def each(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/n={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{at}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    fields = ", ".join(f"`{c}` {t}" for c, t in stream.dtypes)
    return stream.sparkSession.read.schema(f"{fields}, batch int").option("recursiveFileLookup", "true").parquet(f"{at}/out")


def settled(drained: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last update of every key."""
    return latest.latest_by(drained, keys, ["batch", *order])
