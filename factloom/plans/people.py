"""Leaderboards, pages and scores; persons are customers, snapshots are orders, giving is line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import numeric
from factloom.operators import audit, latest, ranking, resolve
from factloom.plans.base import query, table

AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"
_LATEST_SQL = "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS score, max(o_orderdate) AS scored_on FROM orders GROUP BY o_custkey"


def latest_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = latest.latest_by(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_totalprice", "o_orderdate"])
    return rows.withColumnsRenamed({"o_totalprice": "score", "o_orderdate": "scored_on"})


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return latest.latest_by(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice", "o_orderdate"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def latest_by_max_equality(spark: SparkSession, d: str) -> DataFrame:
    return latest.at_maximum(table(spark, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey", "o_totalprice")


@query(f"""WITH s AS ({_LATEST_SQL}),
  g AS (SELECT c_custkey, c_name, score, EXISTS (SELECT 1 FROM orders e WHERE e.o_custkey = c_custkey AND e.o_orderpriority = '1-URGENT') AS graded
        FROM customer JOIN s ON c_custkey = o_custkey)
  SELECT c_custkey, c_name, graded, CASE WHEN graded THEN score END AS score,
         row_number() OVER (ORDER BY graded DESC, CASE WHEN graded THEN score END DESC NULLS LAST, c_name) AS place
  FROM g ORDER BY place LIMIT 100""")
def graded_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best: people with evidence first, by latest score; without evidence no score is shown."""
    evidence = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("seen", F.lit(True))
    scores = latest_scores(spark, d).withColumnRenamed("o_custkey", "c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", "c_name").join(scores, "c_custkey").join(evidence, "c_custkey", "left")
    rows = rows.withColumn("graded", F.coalesce("seen", F.lit(False))).withColumn("score", F.when(F.col("graded"), F.col("score")))
    order = ranking.graded_first(rows, F.col("graded"), F.col("score"), "c_name")
    top = rows.orderBy(*order).limit(100)
    return top.select("c_custkey", "c_name", "graded", "score", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("""SELECT c_custkey, c_name, c_mktsegment, count(*) OVER () AS matching, (SELECT count(*) FROM customer) AS everyone
  FROM customer WHERE c_name ILIKE '%customer#0000001%' AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_name LIMIT 20 OFFSET 0""")
def directory_page(spark: SparkSession, d: str) -> DataFrame:
    """A filtered page with the number of matching rows and of all rows."""
    people = table(spark, d, "customer")
    found = people.where(F.col("c_name").ilike("%customer#0000001%") & F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    first = ranking.page(found.select("c_custkey", "c_name", "c_mktsegment"), [F.col("c_name")], 1, 20)
    n = F.count(F.lit(1))
    return first.withColumn("matching", found.agg(n).scalar()).withColumn("everyone", people.agg(n).scalar())


_SCORE_SQL = """
  giving AS (SELECT o_custkey, CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) * 100 AS given, count(DISTINCT l_suppkey) AS sources, bool_or(l_returnflag = 'R') AS pledged
             FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey),
  parts AS (SELECT c_custkey, c_acctbal * 10000 AS worth, coalesce(given, 0) AS given, coalesce(sources, 0) AS sources, coalesce(pledged, false) AS pledged FROM customer LEFT JOIN giving ON c_custkey = o_custkey),
  shares AS (SELECT *, greatest(0, least(1, log10(1 + (CASE WHEN worth > 0 AND given > 0 THEN given / worth ELSE 0 END) * 5000) / 3)) AS generosity,
             CASE WHEN given > 0 THEN greatest(0, least(1, (log10(given) - 6) / 4)) ELSE 0 END AS scale FROM parts),
  scored AS (SELECT c_custkey, worth, given, sources, pledged,
             floor(100 * (0.65 * greatest(0, least(1, 0.15 * CAST(pledged AS INT) + 0.65 * generosity + 0.2 * scale)) + 0.35 * greatest(0, least(1, sources / 8.0))) * 100 + 0.5) / 100 AS score FROM shares)"""
_GRADE_SQL = "CASE WHEN score >= 60 THEN 'A' WHEN score >= 45 THEN 'B' WHEN score >= 30 THEN 'C' WHEN score >= 15 THEN 'D' ELSE 'F' END"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Every person's score from worth, giving, pledge and number of sources."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag")
    given = F.sum((F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(18,4)")).cast("double") * 100
    giving = (
        table(spark, d, "orders").select("o_orderkey", "o_custkey").join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(given.alias("given"), F.count_distinct("l_suppkey").alias("sources"), F.bool_or(F.col("l_returnflag") == "R").alias("pledged"))
    )
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") * 10000).alias("worth")).join(giving, "c_custkey", "left")
    rows = rows.select("c_custkey", "worth", F.coalesce("given", F.lit(0.0)).alias("given"), F.coalesce("sources", F.lit(0)).alias("sources"), F.coalesce("pledged", F.lit(False)).alias("pledged"))
    made = numeric.benefit_score(F.col("worth"), F.col("given"), F.lit(0.0), F.col("pledged"), F.col("sources"))
    return rows.withColumn("made", made).withColumn("score", F.col("made.score"))


@query(f"WITH {_SCORE_SQL} SELECT c_custkey, score, {_GRADE_SQL} AS grade FROM scored")
def score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("c_custkey", "score", numeric.grade(F.col("score")).alias("grade"))


@query(f"WITH {_SCORE_SQL} SELECT {_GRADE_SQL} AS grade, count(*) AS n FROM scored GROUP BY 1")
def grade_histogram(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy(numeric.grade(F.col("score")).alias("grade")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_SCORE_SQL}, w AS (SELECT *, floor(score * 0.9 * 100 + 0.5) / 100 AS new_score FROM scored)
  SELECT c_custkey, score, new_score, {_GRADE_SQL} AS grade, {_GRADE_SQL.replace("score", "new_score")} AS new_grade FROM w
  WHERE {_GRADE_SQL} <> {_GRADE_SQL.replace("score", "new_score")} OR abs(score - new_score) > 0.5""")
def what_if_shift(spark: SparkSession, d: str) -> DataFrame:
    """Who would move if all scores lost a tenth."""
    rows = scored(spark, d).withColumn("new_score", numeric.round_half_up(F.col("score") * 0.9))
    rows = rows.select("c_custkey", "score", "new_score", numeric.grade(F.col("score")).alias("grade"), numeric.grade(F.col("new_score")).alias("new_grade"))
    return rows.where((F.col("grade") != F.col("new_grade")) | (F.abs(F.col("score") - F.col("new_score")) > 0.5))


@query("""WITH w AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders),
  h AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, rn) AS r FROM w WHERE rn <= 60)
  SELECT o_orderkey, o_totalprice, CASE WHEN r <= 6 THEN r ELSE 6 + count(*) FILTER (WHERE r > 6) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) END AS pos FROM h""")
def promoted_page(spark: SparkSession, d: str) -> DataFrame:
    """The newest sixty, the six highest of them first."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    ranked = ranking.promoted_first(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], F.col("o_totalprice"), 60, 6)
    return ranked.select("o_orderkey", "o_totalprice", F.col("pos").cast("long").alias("pos"))


@query("""WITH h AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END AS kind, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part ORDER BY pos LIMIT 60),
  k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY pos) > 3 AS late FROM h WHERE kind IS NOT NULL),
  i AS (SELECT *, row_number() OVER (ORDER BY late, pos) AS slot FROM k),
  s AS (SELECT pos AS new_pos, row_number() OVER (ORDER BY pos) AS slot FROM k)
  SELECT p_partkey, kind, pos, new_pos FROM i JOIN s USING (slot) UNION ALL SELECT p_partkey, kind, pos, pos FROM h WHERE kind IS NULL""")
def diversify(spark: SparkSession, d: str) -> DataFrame:
    """The sixty dearest parts with at most three of a kind before the rest."""
    order = [F.desc("p_retailprice"), F.asc("p_partkey")]
    head = table(spark, d, "part").orderBy(*order).limit(60)
    rows = head.select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_type")).alias("kind"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("pos"))
    return ranking.diversify(rows, "pos", "kind", 3)


@query("""WITH RECURSIVE days AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events),
  f(day, i, h) AS (SELECT day, 0, 2166136261::BIGINT FROM days UNION ALL
    SELECT day, i + 1, (xor(h, ascii(substr(day, i + 1, 1))::BIGINT) * 16777619) % 4294967296 FROM f WHERE i < length(day))
  SELECT day, h % 2147483648 AS seed FROM f WHERE i = length(day)""")
def daily_order_seed(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    return days.select("day", ranking.seed(F.col("day")).alias("seed"))


@query("""WITH k AS (SELECT c_custkey, c_mktsegment, c_acctbal > 5000 AS good, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS pos FROM customer)
  SELECT count(*) AS total, count(*) FILTER (WHERE good) AS rich, count(*) FILTER (WHERE NOT good AND pos <= 200) AS near, count(*) FILTER (WHERE NOT good AND pos > 200) AS unclassified, true AS adds_up FROM k""")
def cumulative_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every customer is in one bucket, and the buckets add up."""
    pos = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    rows = table(spark, d, "customer").withColumn("pos", pos)
    return audit.buckets(rows, {"rich": F.col("c_acctbal") > 5000, "near": F.col("pos") <= 200})


@query("""WITH w AS (SELECT s_suppkey AS id, replace(s_name, 'Supplier', 'customer') AS n FROM supplier),
  p AS (SELECT c_custkey AS id, c_name AS n FROM customer),
  norm AS (SELECT 'w' AS t, id, trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) AS n FROM w UNION ALL SELECT 'p', id, trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')) FROM p)
  SELECT a.id AS wanted_id, min(b.id) AS person_id, 'exact' AS how FROM norm a JOIN norm b ON a.n = b.n WHERE a.t = 'w' AND b.t = 'p' GROUP BY a.id""")
def person_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, written like customers, looked up among customers by normal name, then by surname and initial."""
    wanted = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.replace("s_name", F.lit("Supplier"), F.lit("customer")).alias("name"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return resolve.exact_then_initial(wanted, people)


@query("""WITH n AS (SELECT c_custkey AS id, translate(lpad(CAST(c_custkey % 500 AS VARCHAR), 3, '0'), '0123456789', 'abcdefghij') AS last, CASE WHEN c_custkey < 500 THEN 'alexander' WHEN c_custkey < 1000 THEN 'alex' ELSE 'albert' END AS first, CAST(1950 + c_custkey // 100 % 5 * 3 AS INT) AS born FROM customer),
  r AS (SELECT min(id) AS id, last, first, born FROM n GROUP BY last, first, born)
  SELECT a.id AS a, b.id AS b, CASE WHEN abs(a.born - b.born) >= 8 THEN 'review' WHEN a.first = b.first OR a.born = b.born THEN 'merge' ELSE 'review' END AS verdict
  FROM r a JOIN r b ON a.last = b.last AND a.id < b.id AND (starts_with(a.first, b.first) OR starts_with(b.first, a.first))""")
def name_match(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one surname whose first names may be one: merge, or review where years are far apart or don't bear out a short form."""
    first = F.when(F.col("c_custkey") < 500, "alexander").when(F.col("c_custkey") < 1000, "alex").otherwise("albert")
    last = F.translate(F.lpad((F.col("c_custkey") % 500).cast("string"), 3, "0"), "0123456789", "abcdefghij")
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", first, last).alias("name"), (1950 + F.floor(F.col("c_custkey") / 100) % 5 * 3).cast("int").alias("born"))
    return resolve.candidate_pairs(people)


@query("""WITH pp AS (SELECT c_custkey, c_acctbal, n_name, c_mktsegment FROM customer JOIN nation ON n_nationkey = c_nationkey),
  m AS (SELECT s_suppkey, c_custkey, 2 * CAST(s_nationkey = c_nationkey AS INT) + CAST(c_mktsegment = 'BUILDING' AS INT) + CAST(c_acctbal >= 9000 AS INT) AS points, c_acctbal
        FROM supplier JOIN customer ON s_nationkey = c_nationkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY points DESC, c_acctbal DESC, c_custkey) AS place FROM m)
  SELECT s_suppkey, c_custkey, CAST(points AS INT) AS points, place FROM r WHERE place <= 12""")
def goal_matches(spark: SparkSession, d: str) -> DataFrame:
    """Twelve best people for every goal: two points for the same place, one for the field, one for means."""
    goals = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("place_key"))
    people = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", F.col("c_nationkey").alias("place_key"))
    # Only the best twelve of a place can be among the best twelve of any goal there.
    points = 2 + (F.col("c_mktsegment") == "BUILDING").cast("int") + (F.col("c_acctbal") >= 9000).cast("int")
    order = [F.desc("points"), F.desc("c_acctbal"), F.asc("c_custkey")]
    best = latest.first_per(people.withColumn("points", points), ["place_key"], order, 12)
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy("place_key").orderBy(*order)).cast("long"))
    return goals.join(ranked, "place_key").select("s_suppkey", "c_custkey", F.col("points").cast("int").alias("points"), "place")




_ENRICHED_SQL = f"""s AS ({_LATEST_SQL}), ev AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'),
  talk AS (SELECT user_id, count(*) AS remarks, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS last_view FROM events GROUP BY user_id),
  card AS (SELECT o_orderkey AS card, o_custkey AS person FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)"""


def enriched(spark: SparkSession, d: str) -> DataFrame:
    """The newest fifty cards with their person's name, score (only with evidence), newest view and number of remarks. The
    page is cut first; all that is joined to it is reduced to its persons before it is aggregated."""
    orders = table(spark, d, "orders")
    cards = orders.select(F.col("o_orderkey").alias("card"), F.col("o_custkey").alias("person"), "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).drop("o_orderdate")
    of_page = cards.select("person").distinct()
    own = orders.withColumnRenamed("o_custkey", "person").join(of_page, "person", "left_semi")
    scores = latest.latest_by(own, ["person"], ["o_orderdate", "o_orderkey"], ["o_totalprice"]).withColumnRenamed("o_totalprice", "score")
    seen = own.where("o_orderpriority = '1-URGENT'").select("person").distinct().withColumn("evidence", F.lit(True))
    facts = table(spark, d, "events").withColumnRenamed("user_id", "person").join(of_page, "person", "left_semi")
    newest = F.max(F.when(F.col("event_type") == "view", F.struct("ts", "event_id", "value")))["value"]
    talk = facts.groupBy("person").agg(F.count(F.lit(1)).alias("remarks"), newest.alias("last_view"))
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.col("c_name").alias("name"))
    rows = cards.join(names, "person", "left").join(scores, "person", "left").join(seen, "person", "left").join(talk, "person", "left")
    return rows.select("card", "person", "name", F.when(F.col("evidence"), F.col("score")).alias("score"), F.coalesce("remarks", F.lit(0)).alias("remarks"), "last_view")


@query(f"""WITH {_ENRICHED_SQL}
  SELECT card, person, c_name AS name, CASE WHEN ev.o_custkey IS NOT NULL THEN score END AS score, coalesce(remarks, 0) AS remarks, last_view
  FROM card LEFT JOIN customer ON c_custkey = person LEFT JOIN s ON s.o_custkey = person LEFT JOIN ev ON ev.o_custkey = person LEFT JOIN talk ON user_id = person""")
def card_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return enriched(spark, d)


@query(f"""WITH {_SCORE_SQL}, one AS (SELECT c_custkey, score, {_GRADE_SQL} AS grade, CASE WHEN worth > 0 AND given > 0 THEN given / worth * 100 END AS percent FROM scored)
  SELECT a.c_custkey, a.score AS score_a, b.score AS score_b, a.grade AS grade_a, b.grade AS grade_b, a.percent AS percent_a, b.percent AS percent_b
  FROM one a JOIN one b ON a.c_custkey + 1 = b.c_custkey""")
def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Every person beside the next one; a ratio that cannot be stated is left out."""
    percent = numeric.giving_ratio(F.col("worth"), F.col("given"))
    one = scored(spark, d).select("c_custkey", "score", numeric.grade(F.col("score")).alias("grade"), percent.alias("percent"))
    a = one.withColumnsRenamed({c: f"{c}_a" for c in ("score", "grade", "percent")})
    b = one.withColumnsRenamed({c: f"{c}_b" for c in ("score", "grade", "percent")}).withColumn("c_custkey", F.col("c_custkey") - 1)
    return a.join(b, "c_custkey")
