"""The same questions asked of ``events`` as a stream, drained once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.base import ORACLE_SQL, checkpoint_folder, query, table
from factloom.streaming import events


def _stream(spark: SparkSession, d: str) -> DataFrame:
    # As a pattern, the path may be one file or a folder of files.
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


@query(ORACLE_SQL["rate_limit_window"])
def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Minutes over the limit, counted in event time."""
    out = events.drain(events.over_limit(_stream(spark, d), "user_id", "ts", 2), checkpoint_folder(spark), "update")
    return events.settled(out, ["user_id", "minute"], ["n"]).select("user_id", F.col("minute").cast("timestamp_ntz").alias("minute"), "n")


@query("""SELECT c.event_id, max(r.ts) AS refused_at, count(*) AS refusals FROM events c JOIN events r ON r.user_id = c.user_id AND r.event_type = 'error' AND r.ts <= c.ts AND r.ts > c.ts - INTERVAL 14 DAY
  WHERE c.event_type = 'purchase' AND c.event_id % 5 = 0 GROUP BY c.event_id""")
def stream_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Purchases, every fifth, that errors of the same user within 14 days before them cool down; purchases and errors are two streams."""
    candidates = _stream(spark, d).where("event_type = 'purchase' AND event_id % 5 = 0").select("event_id", "user_id", "ts")
    refusals = _stream(spark, d).where("event_type = 'error'").select("user_id", F.col("ts").alias("refused_at"))
    out = events.drain(events.met_refusals(candidates, refusals, "user_id", "ts", "refused_at"), checkpoint_folder(spark))
    return out.groupBy("event_id").agg(F.max("refused_at").cast("timestamp_ntz").alias("refused_at"), F.count(F.lit(1)).alias("refusals"))


@query("SELECT user_id, event_type, max(ts) AS cast_at, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes by (user, kind) with per-key state: the last accepted stamp, and how many arrived."""
    votes = _stream(spark, d).withColumnRenamed("ts", "cast_at")
    out = events.drain(events.last_writer_wins(votes, "user_id", "event_type", "value", "cast_at"), checkpoint_folder(spark))
    accepted = F.max(F.when(F.col("outcome") == "accepted", F.col("cast_at"))).cast("timestamp_ntz")
    return out.groupBy("user_id", "event_type").agg(accepted.alias("cast_at"), F.count(F.lit(1)).alias("n"))
