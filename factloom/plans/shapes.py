"""Gates, notes, formats and shapes over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import money, notes, predicates
from factloom.operators import ranking, shaping
from factloom.plans.base import checkpoint_folder, query, table

_NOW = "TIMESTAMP '1998-06-01 00:00:00'"


def _now():
    return F.expr(_NOW)


def _moderated(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    status = F.when(c % 3 == 0, "pending").when(c % 11 == 5, F.lit(None)).otherwise("approved")
    return table(spark, d, "customer").withColumns({"status": status, "hidden": F.when(c % 5 > 0, c % 7 == 0), "death_year": F.when(c % 13 == 0, 1900 + c % 100)})


_MODERATED = """m AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'pending' WHEN c_custkey % 11 = 5 THEN NULL ELSE 'approved' END AS status,
  CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 7 = 0 END AS hidden, CASE WHEN c_custkey % 13 = 0 THEN 1900 + c_custkey % 100 END AS death_year FROM customer)"""


@query(f"WITH {_MODERATED} SELECT c_custkey, c_name FROM m WHERE status = 'approved' AND NOT coalesce(hidden, false)")
def visible_people(spark: SparkSession, d: str) -> DataFrame:
    """People that moderation has passed and no flag withholds."""
    return predicates.visible(_moderated(spark, d), hidden="hidden").select("c_custkey", "c_name")


@query(f"WITH {_MODERATED} SELECT count(*) FILTER (WHERE death_year IS NULL) AS kept, count(death_year) AS dropped FROM m")
def living_people(spark: SparkSession, d: str) -> DataFrame:
    """How many people a filter of the living keeps and drops."""
    return predicates.living(_moderated(spark, d))[1]


@query("SELECT c_custkey, lower(c_name) LIKE '%#0000000%' AND c_nationkey IS NOT DISTINCT FROM 3 AND c_mktsegment = 'BUILDING' AS listed, CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN c_mktsegment ELSE 'OTHER' END AS segment FROM customer")
def listed_people(spark: SparkSession, d: str) -> DataFrame:
    """Filters of a list, and a category with a fallback."""
    listed = predicates.named_like(F.col("c_name"), "#0000000", F.col("c_nationkey").cast("string"), "3", F.array("c_mktsegment"), "BUILDING")
    return table(spark, d, "customer").select("c_custkey", listed.alias("listed"), predicates.one_of(F.col("c_mktsegment"), ["BUILDING", "FURNITURE"], "OTHER").alias("segment"))


_NAME = "CASE p_partkey % 8 WHEN 0 THEN 'Mr. ' || p_name WHEN 1 THEN 'the ' || p_name WHEN 2 THEN 'ab' WHEN 3 THEN p_name || ' Smith' WHEN 4 THEN 'Fictional Bob' WHEN 5 THEN 'Solo' WHEN 6 THEN NULL ELSE p_name || ' jr' END"


@query(f"""WITH n AS (SELECT p_partkey, {_NAME} AS n FROM part) SELECT p_partkey,
  length(coalesce(n, '')) < 3 OR contains(lower(n), 'mr. ') OR contains(lower(n), 'the ') OR contains(lower(n), 'fictional') AS suspicious,
  len(string_split(coalesce(n, ''), ' ')) >= 2 AND NOT coalesce(regexp_extract(trim(regexp_replace(lower(n), ' jr$', '')), '([a-z]+)$', 1) IN ('smith', 'widget'), false) AS eligible FROM n""")
def checked_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that look like none, and names that can be searched for."""
    rows = table(spark, d, "part").select("p_partkey", F.expr(_NAME).alias("n"))
    return rows.select("p_partkey", predicates.suspicious_name(F.col("n")).alias("suspicious"), predicates.eligible_name(F.col("n"), ["smith", "widget"]).alias("eligible"))


_ARTICLE = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Bo' ELSE 'Cy' END AS first, 'Vessel' AS last, CASE WHEN p_partkey % 4 > 0 THEN 'VESSEL, of ' || p_name ELSE 'Vessels' END AS title, CASE WHEN p_partkey % 5 > 0 THEN 'says ann-bo to all' END AS body FROM part"


@query(f"SELECT p_partkey FROM ({_ARTICLE}) WHERE p_partkey % 4 > 0 AND p_partkey % 5 > 0 AND first <> 'Cy'")
def named_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles with the last name in the title and the first name anywhere."""
    rows = spark.sql(_ARTICLE.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    return rows.where(predicates.is_named(F.col("first"), F.col("last"), F.col("title"), F.col("body"))).select("p_partkey")


_FACT = f"""f AS (SELECT o_orderkey, o_totalprice AS worth, o_totalprice / 7 AS given, CASE WHEN o_orderkey % 6 > 0 THEN o_orderdate END AS retrieved, o_orderkey % 5 > 0 AS datable,
  CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL '10' DAY ELSE INTERVAL '-10' DAY END END AS written,
  CASE WHEN o_orderkey % 9 > 0 THEN 50.0 END AS score, CASE o_orderkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 END AS component, o_orderkey % 7 = 0 AS has_evidence, {_NOW} AS now FROM orders)"""


@query(f"""WITH {_FACT}, g AS (SELECT *, datable AND retrieved IS NOT NULL AND epoch(now - retrieved) / 86400 <= 365 AS fresh FROM f)
  SELECT o_orderkey, score IS NOT NULL AND coalesce(component, 0) = 0 AND NOT has_evidence AS caveat, CASE WHEN fresh AND worth > 0 AND given > 0 THEN given / worth * 100 END AS percent,
    coalesce(retrieved > written, false) AS outdated, CASE WHEN NOT coalesce(fresh AND written >= retrieved, false) THEN '{notes.SUMMARY_NOTE}' END AS note FROM g""")
def figure_notes(spark: SparkSession, d: str) -> DataFrame:
    """What must be said beside every figure: no evidence, no current ratio, prose older than its source."""
    rows = spark.sql(f"SELECT * FROM {_FACT[5:].replace('FROM orders', 'FROM {orders}')}", orders=table(spark, d, "orders"))
    c = {n: F.col(n) for n in ("worth", "given", "retrieved", "datable", "written", "score", "component", "has_evidence", "now")}
    return rows.select(
        "o_orderkey",
        notes.headline_caveat(c["score"], c["component"], c["has_evidence"]).alias("caveat"),
        notes.current_ratio(c["worth"], c["given"], c["retrieved"], c["now"], c["datable"]).alias("percent"),
        notes.outdated(c["written"], c["retrieved"]).alias("outdated"),
        notes.summary_note(c["retrieved"], c["written"], c["now"], c["datable"], F.lit(True)).alias("note"),
    )


_WINDOW = """w AS (SELECT o_custkey AS person, min(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))) AS low, max(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10))) AS high FROM orders GROUP BY o_custkey),
  s AS (SELECT *, CASE person % 6 WHEN 0 THEN concat(low, ' to ', high) WHEN 1 THEN concat(high, ' to ', low) WHEN 2 THEN concat(low, ' to ', low) WHEN 3 THEN concat(low, '  to 1997-01-01') WHEN 4 THEN 'long ago to now' END AS stated FROM w)"""


@query(f"""WITH {_WINDOW}, e AS (SELECT *, string_split(regexp_replace(stated, '\\s+to\\s+', '|'), '|') AS p FROM s WHERE person % 6 < 4),
  k AS (SELECT *, CASE WHEN low IS NULL THEN NULL WHEN p[2] < p[1] THEN 'BACKWARD' WHEN p[1] = p[2] AND low <> high THEN 'DEGENERATE' WHEN p[1] > low OR p[2] < high THEN 'UNDERSTATED' END AS kind FROM e)
  SELECT person, kind, stated AS before, CASE WHEN low = high THEN low ELSE concat(low, ' to ', high) END AS after FROM k WHERE kind IS NOT NULL""")
def window_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Stated windows of coverage that misstate their articles' days, and what they should say."""
    rows = spark.sql(f"WITH {_WINDOW.replace('FROM orders', 'FROM {orders}')} SELECT person, stated, array(low, high) AS days FROM s", orders=table(spark, d, "orders"))
    return rows.select("person", notes.window_fix(F.col("stated"), F.col("days")).alias("fix")).where("fix IS NOT NULL").select("person", "fix.kind", "fix.before", "fix.after")


@query("""WITH r AS (SELECT user_id, count(*) AS n, CASE WHEN user_id % 3 = 0 THEN 40 + user_id % 100 END AS reported FROM events GROUP BY user_id)
  SELECT user_id, CASE WHEN reported IS NOT NULL THEN reported > n ELSE n >= 60 END AS capped FROM r""")
def capped_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that hold less than there is."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    reported = F.when(F.col("user_id") % 3 == 0, 40 + F.col("user_id") % 100)
    return rows.select("user_id", notes.is_capped(F.col("n"), reported, 60).alias("capped"))


_JSON = """CASE event_id % 6 WHEN 0 THEN '"~$5B"' WHEN 1 THEN '12' WHEN 2 THEN '[1, 2]' WHEN 3 THEN props WHEN 4 THEN 'null' ELSE 'no json' END"""


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '~$5B' WHEN 1 THEN '12' END AS scalar, CAST(CASE WHEN event_id % 6 = 2 THEN 2 END AS INT) AS entries FROM events""")
def json_roots(spark: SparkSession, d: str) -> DataFrame:
    """Scalars and arrays at the root of JSON texts of any shape."""
    json = F.expr(_JSON)
    return table(spark, d, "events").select("event_id", notes.json_scalar(json).alias("scalar"), notes.array_length(json).alias("entries"))


_SUM = "CASE o_orderkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN o_totalprice WHEN 2 THEN round(o_totalprice) * 1000 + 1 WHEN 3 THEN round(o_totalprice) * 100000 + 1 ELSE round(o_totalprice / 1000) END"


@query(f"""WITH s AS (SELECT o_orderkey, {_SUM} AS v FROM orders)
  SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('$%.1fB', v / 1e9) WHEN v >= 1e6 THEN printf('$%.0fM', v / 1e6) WHEN v >= 1e3 THEN printf('$%.0fK', v / 1e3) WHEN v > 0 AND v = floor(v) THEN printf('$%.0f', v) WHEN v > 0 THEN printf('$%.2f', v) ELSE '' END AS card,
    CASE WHEN v >= 1e9 THEN printf('$%.1fB in foundation assets', v / 1e9) WHEN v >= 1e6 THEN printf('$%.0fM in foundation assets', v / 1e6) END AS chip FROM s""")
def money_labels(spark: SparkSession, d: str) -> DataFrame:
    """Sums as cards and chips write them. An exact half, of which larger tables have some (2500.00), goes up, as in the reference;
    the SQL's ``printf`` takes it to the even neighbour."""
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_SUM).alias("v"))
    return rows.select("o_orderkey", money.card_money(F.col("v")).alias("card"), money.assets_chip(F.col("v")).alias("chip"))


_PROSE = "concat('In 2024 he gave $', CAST(p_partkey % 900 + 100 AS VARCHAR(9)), ',', CAST(100 + p_partkey % 899 AS VARCHAR(9)), ' and 93 times ', CAST(p_partkey % 9 + 1 AS VARCHAR(9)), ' 500, or ', CAST(p_partkey AS VARCHAR(9)), '.25 each; $ ', CAST(p_partkey AS VARCHAR(9)), '.')"


@query("""SELECT p_partkey, [CAST((p_partkey % 900 + 100) * 1000 + 100 + p_partkey % 899 AS DOUBLE), CAST((p_partkey % 9 + 1) * 1000 + 500 AS DOUBLE), p_partkey + 0.25, CAST(p_partkey AS DOUBLE)] AS amounts FROM part""")
def prose_amounts(spark: SparkSession, d: str) -> DataFrame:
    """All money that a prose text states; years and counts are none."""
    return table(spark, d, "part").select("p_partkey", money.prose_amounts(F.expr(_PROSE)).alias("amounts"))


@query("""WITH t AS (SELECT c_custkey AS o_custkey FROM customer), o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY o_custkey)
  SELECT o_custkey, CASE WHEN k IS NULL THEN '[]' ELSE '[' || array_to_string(list_transform(k, lambda x: '{"o_orderkey":' || CAST(x AS VARCHAR) || '}'), ',') || ']' END AS facts FROM t LEFT JOIN o USING (o_custkey)""")
def nested_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every person with all their records as JSON, an empty array for those without."""
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return shaping.nested_json(people, table(spark, d, "orders"), "o_custkey", ["o_orderkey"])


@query("""WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS pos FROM events)
  SELECT user_id, count(DISTINCT CASE WHEN pos < 5 AND event_type <> 'error' THEN event_type END) AS "distinct" FROM p GROUP BY user_id""")
def kinds_in_window(spark: SparkSession, d: str) -> DataFrame:
    """How many kinds the newest five events of every user are of, errors aside."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")) - 1
    rows = table(spark, d, "events").select("user_id", pos.alias("pos"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"))
    return shaping.distinct_in_first(rows, "user_id", "pos", "kind", 5)


@query("""WITH s AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN upper(h) ELSE h END AS source FROM (SELECT page_id, nullif(lower(regexp_extract(url, '://([^/?#]*)', 1)), '') AS h FROM pages))
  SELECT min(page_id) AS page_id FROM s WHERE source IS NOT NULL GROUP BY lower(source)""")
def first_of_source(spark: SparkSession, d: str) -> DataFrame:
    """The first page of every host, whatever its case."""
    host = F.nullif(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.lit(""))
    rows = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.upper(host)).otherwise(host).alias("source"))
    return shaping.first_per_source(rows, "source", ["page_id"]).select("page_id")


@query("""SELECT count(*) AS "left", min(o_orderdate) AS oldest FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def leftovers(spark: SparkSession, d: str) -> DataFrame:
    """Orders that nothing was returned of, and the oldest of them."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return shaping.oldest_left(table(spark, d, "orders"), done, "o_orderkey", "o_orderdate")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45)")
def passed_over(spark: SparkSession, d: str) -> DataFrame:
    """Parts that were offered and never chosen in quantity."""
    chosen = table(spark, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return shaping.passed_over(table(spark, d, "part"), chosen, "p_partkey").select("p_partkey")


@query("""WITH e AS (SELECT l_extendedprice AS amount, l_discount FROM lineitem) SELECT count(*) FILTER (WHERE NOT l_discount <= 0.05) AS violations, round(sum(amount), 2) AS total FROM e""")
def broken_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of all orders that break a rule, and what all entries come to."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_extendedprice", "l_discount")).alias("entries"))
    told = shaping.violations(rows, "entries", "l_extendedprice", F.col("x.l_discount") <= 0.05)
    return told.select("violations", F.round("total", 2).alias("total"))


@query("""WITH s AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 > 0 THEN floor(c_acctbal / 1000) END AS score, CASE WHEN c_custkey % 6 > 0 THEN c_nationkey END AS tried, c_mktsegment = 'BUILDING' AS insider FROM customer)
  SELECT c_custkey, row_number() OVER (ORDER BY score DESC NULLS LAST, c_name) AS by_score, row_number() OVER (ORDER BY tried ASC NULLS FIRST, score DESC NULLS LAST, c_custkey) AS by_rotation,
    row_number() OVER (ORDER BY insider DESC, c_nationkey < 5 DESC, c_acctbal DESC, c_custkey) AS by_flags FROM s JOIN (SELECT c_custkey, c_nationkey, c_acctbal FROM customer) USING (c_custkey)""")
def ordered_people(spark: SparkSession, d: str) -> DataFrame:
    """Places in three orders: score then name, longest untried first, and flags before counts."""
    checkpoint_folder(spark)
    c = table(spark, d, "customer").withColumns({"score": F.when(F.col("c_custkey") % 4 > 0, F.floor(F.col("c_acctbal") / 1000)), "tried": F.when(F.col("c_custkey") % 6 > 0, F.col("c_nationkey"))})
    orders = {
        "by_score": shaping.by_name(F.col("score"), F.col("c_name")),
        "by_rotation": [*shaping.by_chain(F.col("tried"), (F.col("score"), "desc")), F.asc("c_custkey")],
        "by_flags": [*shaping.by_chain((F.col("c_mktsegment") == "BUILDING", "desc"), (F.col("c_nationkey") < 5, "desc"), (F.col("c_acctbal"), "desc")), F.asc("c_custkey")],
    }
    out = c
    for name, keys in orders.items():
        out = ranking.placed(out, keys, name)
    return out.select("c_custkey", *orders)


@query("""WITH s AS (SELECT o_custkey AS person, CAST(o_orderdate AS DATE) AS day, o_totalprice AS score, o_orderkey % 2 = 0 AS again FROM orders),
  f AS (SELECT person, day, max(score) AS score FROM s WHERE NOT again GROUP BY person, day), g AS (SELECT person, day, max(score) AS score FROM s WHERE again GROUP BY person, day)
  SELECT coalesce(g.person, f.person) AS person, coalesce(g.day, f.day) AS day, coalesce(g.score, f.score) AS score FROM f FULL JOIN g ON f.person = g.person AND f.day = g.day""")
def daily_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """A second run of a day replaces that day's snapshot of a person and no other."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("person"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("score"), (F.col("o_orderkey") % 2 == 0).alias("again"))
    first, second = (rows.where(c).groupBy("person", "day").agg(F.max("score").alias("score")) for c in ("NOT again", "again"))
    return shaping.snapshot(first, second, "person", "day")


@query("""WITH RECURSIVE pool AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)), size AS (SELECT count(*) AS n FROM pool),
  g(t, s) AS (SELECT 0::BIGINT, 181415291::BIGINT UNION ALL SELECT t + 1, (s * 1664525 + 1013904223) % 2147483648 FROM g, size WHERE t < n - 1),
  swaps AS (SELECT n - t AS i, least(n - t, CAST(floor(s / 2147483647.0 * (n - t + 1)) AS BIGINT)) AS j FROM g, size WHERE t > 0),
  back(step, place, p) AS (SELECT 0::BIGINT, place, place FROM range(10) r(place) UNION ALL SELECT step + 1, place, CASE WHEN p = i THEN j WHEN p = j THEN i ELSE p END FROM back JOIN swaps ON i = step + 1)
  SELECT c_custkey, c_name, CAST(place + 1 AS INT) AS place FROM back JOIN size ON step = n - 1 JOIN pool ON pool.i = p JOIN customer USING (c_custkey)""")
def daily_ten(spark: SparkSession, d: str) -> DataFrame:
    """Ten people of the day: scored ones with records, in the day's own order, names joined last."""
    checkpoint_folder(spark)
    pool = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    pool = pool.join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return ranking.daily_pick(pool, "c_custkey", "2026-09-12").join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("c_custkey", "c_name", "place")


_SAID = "SELECT o_orderkey AS headline, o_custkey AS person, concat('Nation, ', CAST(o_custkey % 25 AS VARCHAR(9)), ' meets nation ', CAST(o_orderkey % 40 AS VARCHAR(9)), '!') AS title FROM orders"


@query(f"""WITH h AS ({_SAID}), n AS (SELECT n_nationkey AS person, 'nation ' || CAST(n_nationkey AS VARCHAR) AS name FROM nation)
  SELECT headline, n.person FROM h JOIN n ON contains(' ' || trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || name || ' ') WHERE h.person <> n.person""")
def named_others(spark: SparkSession, d: str) -> DataFrame:
    """People whom a headline about somebody else names."""
    rows = spark.sql(_SAID.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))
    people = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("person"), F.concat(F.lit("Nation "), F.col("n_nationkey").cast("string")).alias("name"))
    return shaping.mentioned_others(rows, people).select("headline", F.col("person").cast("int").alias("person"))


@query("SELECT c_nationkey AS place FROM customer WHERE c_acctbal > 9000 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def places_of_means(spark: SparkSession, d: str) -> DataFrame:
    """Places that meet any of four patterns, each once."""
    c, s, n = table(spark, d, "customer"), table(spark, d, "supplier"), table(spark, d, "nation")
    found = [c.where("c_acctbal > 9000").select("c_nationkey"), s.where("s_acctbal > 9000").select("s_nationkey"), n.where("n_regionkey = 1").select("n_nationkey"), c.where("c_mktsegment = 'BUILDING'").select("c_nationkey")]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct().select(F.col("c_nationkey").alias("place"))


@query("""WITH c AS (SELECT card, headline FROM (SELECT p_partkey AS card, p_name AS headline FROM part)) SELECT card FROM c WHERE card NOT IN (SELECT p_partkey FROM part WHERE p_size = 7) AND card % 10 <> 3""")
def unsuperseded(spark: SparkSession, d: str) -> DataFrame:
    """Cards less those that a table of duplicates and a list of ids withhold."""
    cards = table(spark, d, "part").select(F.col("p_partkey").alias("card"))
    gone = table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("card"))
    return predicates.without(predicates.not_among(shaping.passed_over(cards, gone, "card").withColumn("digit", F.col("card") % 10), "digit", [3]), ["digit", "absent"])
