"""Facts about people: events are facts, their type is the key, ``props`` the value, the user the person."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import dates, numeric
from factloom.operators import latest
from factloom.plans.base import query, table

AS_OF = "2024-01-31 00:00:00"


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS up, count(*) FILTER (WHERE event_type = 'error') AS down,
  CASE WHEN count(*) FILTER (WHERE event_type IN ('purchase', 'error')) > 0
       THEN count(*) FILTER (WHERE event_type = 'purchase') / count(*) FILTER (WHERE event_type IN ('purchase', 'error')) ELSE 0 END AS approval
  FROM events GROUP BY user_id""")
def vote_stats(spark: SparkSession, d: str) -> DataFrame:
    """Votes for and against, and the share in favour."""
    kind = F.col("event_type")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("up"), F.count_if(kind == "error").alias("down"))
    return rows.withColumn("approval", numeric.ratio(F.col("up"), F.col("up") + F.col("down")))


@query("""SELECT event_type, round(avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_k, round(avg(value), 6) AS mean_value,
  floor((avg(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) + avg(value)) / 2 * 100 + 0.5) / 100 AS mean_of_means FROM events GROUP BY event_type""")
def json_avg(spark: SparkSession, d: str) -> DataFrame:
    """Means of a number inside JSON and of a column, and the mean of the two."""
    k = F.avg(F.get_json_object("props", "$.k").try_cast("double"))
    return table(spark, d, "events").groupBy("event_type").agg(
        F.round(k, 6).alias("mean_k"), F.round(F.avg("value"), 6).alias("mean_value"), numeric.round_half_up((k + F.avg("value")) / 2).alias("mean_of_means")
    )


@query("SELECT event_type, CAST(user_id % 10 AS BIGINT) AS shard, count(*) AS n FROM events GROUP BY 1, 2")
def fact_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, user_id, event_type, ts FROM events
  QUALIFY event_type = 'error' OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) = 1""")
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest fact per person and key; errors are history and all stay."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return latest.dedup_latest(rows, ["user_id", "event_type"], [F.col("ts").desc_nulls_last(), F.desc("event_id")], F.col("event_type") == "error")


@query("""SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS click, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS "view",
  arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'signup') AS signup FROM events GROUP BY user_id""")
def fact_pivot(spark: SparkSession, d: str) -> DataFrame:
    """One row per person, the newest value of each key in its column."""
    return latest.pick_by_kind(table(spark, d, "events"), ["user_id"], "event_type", "value", ["ts", "event_id"], ["click", "view", "signup"])


@query("""SELECT user_id, count(DISTINCT event_type) FILTER (WHERE event_type <> 'view' OR value >= 50) + CAST(bool_or(value > 90) AS INT) AS sources FROM events GROUP BY user_id""")
def distinct_sources(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of facts known of a person, one kind only where it is verified, plus one for a picture."""
    counts = (F.col("event_type") != "view") | (F.col("value") >= 50)
    kinds = F.count_distinct(F.when(counts, F.col("event_type")))
    return table(spark, d, "events").groupBy("user_id").agg((kinds + F.bool_or(F.col("value") > 90).cast("int")).alias("sources"))


@query("""WITH t AS (SELECT o_custkey, l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY amount DESC, l_suppkey) AS place FROM t)
  SELECT o_custkey, string_agg(l_suppkey || ':' || amount, ',' ORDER BY place) AS top, CAST(sum(amount) AS DOUBLE) AS top_sum FROM r WHERE place <= 5 GROUP BY o_custkey""")
def top5_recipients(spark: SparkSession, d: str) -> DataFrame:
    """The five largest recipients of every giver, in order."""
    sums = (
        table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice"), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("o_custkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"))
    )
    order = Window.partitionBy("o_custkey").orderBy(F.desc("amount"), "l_suppkey")
    top = sums.withColumn("place", F.row_number().over(order)).where("place <= 5")
    listed = F.sort_array(F.collect_list(F.struct("place", F.concat_ws(":", "l_suppkey", "amount").alias("text"))))
    return top.groupBy("o_custkey").agg(F.array_join(listed["text"], ",").alias("top"), F.sum("amount").cast("double").alias("top_sum"))



@query("""WITH f AS (SELECT l_suppkey, CASE lower(l_returnflag) WHEN 'a' THEN 'DEM' WHEN 'r' THEN 'REP' END AS bucket, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY 1, 2)
  SELECT l_suppkey, CAST(sum(amount) FILTER (WHERE bucket = 'DEM') AS DOUBLE) AS dem, CAST(sum(amount) FILTER (WHERE bucket = 'REP') AS DOUBLE) AS rep,
         CAST(sum(amount) FILTER (WHERE bucket IS NULL) AS DOUBLE) AS none, arg_max(bucket, amount) FILTER (WHERE bucket IS NOT NULL) AS leading FROM f GROUP BY l_suppkey""")
def party_fold(spark: SparkSession, d: str) -> DataFrame:
    """Amounts under one code per party whatever the spelling, and the leading party; no lean leads nothing."""
    flag = F.lower("l_returnflag")
    bucket = F.when(flag == "a", "DEM").when(flag == "r", "REP")
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    sums = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*[F.sum(F.when(bucket.eqNullSafe(F.lit(b)), amount)).alias(n) for n, b in (("dem", "DEM"), ("rep", "REP"), ("none", None))])
    leading = F.when(F.col("rep").isNull() & F.col("dem").isNull(), None).when(F.col("rep").isNull() | (F.col("dem") >= F.col("rep")), "DEM").otherwise("REP")
    return sums.select("l_suppkey", *[F.col(c).cast("double").alias(c) for c in ("dem", "rep", "none")], leading.alias("leading"))


@query("""SELECT event_id, CASE WHEN e < 2 THEN 4 WHEN e < 4 THEN 3 WHEN e < 8 THEN 2 WHEN e < 15 THEN 1 WHEN e < 30 THEN 0 ELSE -5 END AS recency
  FROM (SELECT event_id, (epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 86400 AS e FROM events)""")
def recency_step(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", dates.recency(F.col("ts"), as_of).alias("recency"))


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'undated' WHEN (epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate)) / 86400 > 365 THEN 'stale' ELSE 'current' END AS age, count(*) AS n FROM orders GROUP BY 1""")
def age_bucket(spark: SparkSession, d: str) -> DataFrame:
    """How old figures are; those of one source cannot be dated."""
    as_of = F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")
    age = dates.age_class(F.col("o_orderdate"), as_of, F.col("o_orderstatus") != "P")
    return table(spark, d, "orders").groupBy(age.alias("age")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2""")
def rate_limit_window(spark: SparkSession, d: str) -> DataFrame:
    """Minutes in which a person did something more than once; fixed windows."""
    rows = table(spark, d, "events").groupBy("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"))
    return rows.agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("""SELECT user_id, event_type, arg_max(value, (cast_at, event_id)) AS value, max(cast_at) AS cast_at
  FROM (SELECT *, CASE WHEN event_id % 11 = 0 THEN ts ELSE ts - INTERVAL 4 MINUTE END AS cast_at FROM events) GROUP BY 1, 2""")
def cast_at_lww(spark: SparkSession, d: str) -> DataFrame:
    """The last cast vote wins; a client clock counts if it is within five minutes of the server's."""
    client = F.when(F.col("event_id") % 11 == 0, F.col("ts") - F.expr("INTERVAL 9 MINUTES")).otherwise(F.col("ts") - F.expr("INTERVAL 4 MINUTES"))
    rows = table(spark, d, "events").withColumn("cast_at", dates.trusted_stamp(client, F.col("ts")))
    return latest.latest_by(rows, ["user_id", "event_type"], ["cast_at", "event_id"], ["value", "cast_at"])


@query("""SELECT user_id, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS only_type, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE value > 95 GROUP BY user_id""")
def agreed_value(spark: SparkSession, d: str) -> DataFrame:
    """The one kind of a person's large facts, null where they differ, and their span of time."""
    return table(spark, d, "events").where("value > 95").groupBy("user_id").agg(latest.agreed(F.col("event_type")).alias("only_type"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS frequencies FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def frequency_map(spark: SparkSession, d: str) -> DataFrame:
    """How often each kind of fact occurs, per person."""
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("event_type", "n")))
    return counts.groupBy("user_id").agg(F.array_join(F.transform(listed, lambda x: F.concat_ws("=", x["event_type"], x["n"])), ",").alias("frequencies"))


@query("""SELECT user_id, sha256(string_agg(event_type || ':' || props, '|' ORDER BY event_type, props)) AS digest FROM (SELECT DISTINCT user_id, event_type, props FROM events) GROUP BY user_id""")
def facts_digest(spark: SparkSession, d: str) -> DataFrame:
    """A digest of all distinct facts of a person, whatever order they come in."""
    rows = table(spark, d, "events").select("user_id", "event_type", "props").distinct()
    listed = F.sort_array(F.collect_list(F.struct("event_type", "props")))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["event_type"], x["props"])), "|")
    return rows.groupBy("user_id").agg(F.sha2(text.cast("binary"), 256).alias("digest"))
