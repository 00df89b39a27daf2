"""Feed queries: titles are part titles, persons their numbers by remainder, runs five hundred parts each. Every part has a
role: candidate, or published or refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import feed, shaping
from factloom.plans.base import checkpoint_folder, query, table
from factloom.plans.texts import _JACCARD, _SIGNATURE

_TOKENS = f"list_sort({_SIGNATURE.format('concat_ws(chr(32), p_name, p_brand, p_type)')})"


def _cards(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), title.alias("title"), (F.col("p_partkey") % 7).alias("person"), F.col("p_partkey").alias("rank"), F.floor(F.col("p_partkey") / 500).alias("run"))


@query(f"""WITH t AS (SELECT p_partkey AS key, p_partkey % 7 AS person, {_TOKENS} AS tokens FROM part),
  c AS (SELECT * FROM t WHERE key % 10 <> 1), r AS (SELECT DISTINCT CASE WHEN key % 20 = 1 THEN NULL ELSE person END AS refused, tokens FROM t WHERE key % 10 = 1),
  h AS (SELECT a.key, max(CASE WHEN refused IS NULL THEN 1 ELSE 2 END) AS level FROM c a JOIN r b ON (refused IS NULL OR refused = person) AND {_JACCARD} >= 0.4 GROUP BY a.key)
  SELECT c.key, CASE level WHEN 2 THEN 'person' WHEN 1 THEN 'blind' ELSE 'none' END AS kind FROM c LEFT JOIN h ON c.key = h.key""")
def cooldown_kinds(spark: SparkSession, d: str) -> DataFrame:
    cards = _cards(spark, d)
    refusals = cards.where("key % 10 = 1").withColumn("person", F.when(F.col("key") % 20 != 1, F.col("person")))
    return feed.cooldown(cards.where("key % 10 <> 1"), refusals)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS person FROM orders
  QUALIFY o_orderstatus = 'P' OR row_number() OVER (PARTITION BY CASE WHEN o_orderstatus <> 'P' THEN o_custkey END ORDER BY o_orderdate, o_orderkey) = 1""")
def first_card_per_person(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("person", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey"))).withColumn("pos", F.struct("o_orderdate", "o_orderkey"))
    return feed.first_per_person(rows, "person", "pos").select("o_orderkey", "person")


@query("""WITH f AS (SELECT s_nationkey, 'fund ' || (s_suppkey // 25 % 3) || CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' trust' WHEN 2 THEN ' health plan trust' ELSE ' charitable trust' END AS name, s_acctbal FROM supplier)
  SELECT s_nationkey, round(sum(s_acctbal) FILTER (WHERE NOT EXISTS (SELECT 1 FROM f p WHERE p.s_nationkey = f.s_nationkey AND f.name IN (p.name || ' trust', p.name || ' charitable trust'))), 4) AS total,
         count(*) AS n FROM f GROUP BY s_nationkey""")
def endowment_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Assets by place without counting a vehicle beside its parent."""
    k = F.col("s_suppkey")
    end = F.when(k % 4 == 0, "").when(k % 4 == 1, " Trust").when(k % 4 == 2, " Health Plan Trust").otherwise(" Charitable Trust")
    name = F.concat(F.lit("Fund "), (F.floor(k / 25) % 3).cast("string"), end)
    told = shaping.collapsed_totals(table(spark, d, "supplier").withColumn("name", name), "s_nationkey", "name", "s_acctbal")
    return told.select("s_nationkey", F.round("total", 4).alias("total"), "n")


def _stories(spark: SparkSession, d: str) -> DataFrame:
    """Documents as cards, their first twelve words as titles: copies among them tell of one event. Every fifth is published already."""
    # The rest of the text stays in one piece.
    title = F.array_join(F.slice(F.split("text", r"\s+", 13), 1, 12), " ")
    key = F.col("doc_id")
    return table(spark, d, "documents").select(key.alias("key"), title.alias("title"), (key % 40).alias("person"), key.alias("rank"), F.floor(key / 100).alias("run"), (key % 5 == 0).alias("published"), F.length("text").alias("size"))


@query()
def candidate_selection(spark: SparkSession, d: str) -> DataFrame:
    """Twenty a run at most; what was accepted before decides, so there is no SQL. Tests hold a plain loop."""
    checkpoint_folder(spark)
    cards = _stories(spark, d)
    return feed.select_candidates(cards.where("NOT published").drop("published", "size"), cards.where("published").select("key", "title"))


@query()
def story_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Cards of one story; order decides, so there is no SQL. Tests hold a plain loop."""
    cards = _cards(spark, d).withColumn("url", F.when(F.col("key") % 3 == 0, F.concat(F.lit("u"), (F.col("key") % 90).cast("string")))).withColumnRenamed("run", "feed")
    return feed.event_clusters(cards)


_STORY = f"""list_sort({_SIGNATURE.format("array_to_string(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+')[1:12], ' ')")})"""


@query(f"""WITH t AS (SELECT doc_id AS key, length(text) AS size, {_STORY} AS tokens FROM documents),
  n AS (SELECT a.key, max(CASE WHEN len(a.tokens) > 0 AND len(b.tokens) > 0 AND {_JACCARD} >= 0.2 THEN {_JACCARD} ELSE 0 END) AS score FROM t a JOIN t b ON a.key % 5 <> 0 AND b.key % 5 = 0 GROUP BY a.key),
  k AS (SELECT t.key, size, coalesce(score, 0) AS score, key % 3 = 0 AS duplicate, key % 7 = 0 AS failed FROM t LEFT JOIN n USING (key) WHERE t.key % 5 <> 0)
  SELECT key, row_number() OVER (ORDER BY size DESC, key) AS place, CASE WHEN score < 0.2 THEN NULL WHEN key % 11 = 0 OR failed THEN 'failed open' ELSE 'cleared' END AS asked FROM k
  WHERE score < 0.4 AND NOT (score >= 0.2 AND duplicate AND NOT failed AND key % 11 <> 0)""")
def spliced_feed(spark: SparkSession, d: str) -> DataFrame:
    """The longest first, less what is published already and what a judge calls a duplicate of it; places close up."""
    checkpoint_folder(spark)
    cards = _stories(spark, d)
    near = feed.near_published(cards.where("NOT published").select("key", "title"), cards.where("published").select("key", "title"))
    verdicts = cards.where("key % 11 <> 0").select("key", F.when(F.col("key") % 3 == 0, "duplicate").otherwise("new").alias("verdict"), (F.col("key") % 7 == 0).alias("failed_open"))
    return feed.spliced(cards.where("NOT published").select("key", "size"), near, verdicts, [F.desc("size"), F.asc("key")]).select("key", "place", "asked")
