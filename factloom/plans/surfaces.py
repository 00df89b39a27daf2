"""Cards and comparisons as readers see them, and profiles' sections: what is kept, restated and withheld."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import attribution, sections
from factloom.functions.numeric import GRADES
from factloom.operators import audit, cards, ranking
from factloom.plans.base import checkpoint_folder, query, table

# Of a person by number: the record is impossible for every seventh, every third has no grade.
_IMPOSSIBLE, _GRADED, _SCORE, _TOTAL = "c_custkey % 7 = 0", "c_custkey % 3 > 0", "CAST(c_custkey * 7 % 89 + 1 AS INT)", "(c_custkey * 1000 + 2000)"
_LETTER = "CASE " + " ".join(f"WHEN {_SCORE} >= {least} THEN '{g}'" for g, least in GRADES) + " ELSE 'F' END"
# Exact halves go up; printf would send them to the even digit.
_ROUND = f"({_TOTAL} + CASE WHEN {_TOTAL} % 500000 = 250000 THEN 1000 ELSE 0 END)"
_CHIP = f"CASE WHEN {_TOTAL} >= 1000000 THEN '$' || printf('%.1f', {_ROUND} / 1e6) || 'M' ELSE '$' || CAST({_TOTAL} // 1000 AS VARCHAR) || 'K' END"
_LONG = f"CASE WHEN {_TOTAL} >= 1000000 THEN '$' || regexp_replace(printf('%.1f', {_ROUND} / 1e6), '\\.0$', '') || ' million' ELSE '$' || CAST({_TOTAL} // 1000 AS VARCHAR) || ',000' END"
_RECORDS = f"r AS (SELECT c_custkey AS person, {_IMPOSSIBLE} AS impossible, CASE WHEN {_GRADED} THEN {_SCORE} END AS score, CASE WHEN {_GRADED} THEN {_LETTER} END AS letter, {_TOTAL} AS total, {_CHIP} AS chip, {_LONG} AS long FROM customer)"
_SUMMARY = """CASE o_orderkey % 7 WHEN 0 THEN 'Gave $1,000 in political donations. He lives here.' WHEN 1 THEN 'Her PBS score of 70 is high.' WHEN 2 THEN 'Has a giving score of 12.' WHEN 3 THEN 'Plain text.'
  WHEN 4 THEN 'They gave $1,000 in political donations.' WHEN 5 THEN 'Holds a giving grade C (50 of 100).' ELSE NULL END"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(
        F.col("c_custkey").alias("person"), F.expr(_GRADED).alias("graded"), F.expr(_SCORE).cast("double").alias("score"), F.expr(_TOTAL).cast("double").alias("total"),
        F.lit(1980).alias("first_year"), F.expr(f"CASE WHEN {_IMPOSSIBLE} THEN 1970 WHEN c_custkey % 7 = 1 THEN NULL ELSE 1950 END").alias("born"),
    )
    return cards.records(people, 1998)


@query(f"""WITH {_RECORDS}, c AS (SELECT *, o_orderkey % 7 AS c, {_SUMMARY} AS told FROM orders LEFT JOIN r ON person = o_custkey)
  SELECT o_orderkey AS card, CASE WHEN c IN (0, 4) AND coalesce(impossible, true) THEN '' WHEN c = 0 THEN replace(told, '$1,000', long) WHEN c IN (1, 2, 5) AND score IS NULL THEN ''
      WHEN c = 1 THEN 'Her giving score of ' || score || ' is high.' WHEN c = 2 THEN 'Has a giving score of ' || score || '.' WHEN c = 5 THEN 'Holds a giving grade ' || letter || ' (' || score || ' of 100).' ELSE told END AS summary,
    CASE WHEN c IN (0, 4) AND NOT impossible THEN chip || ' in political donations' END AS chip, CAST(score AS DOUBLE) AS score, letter FROM c""")
def card_surfaces(spark: SparkSession, d: str) -> DataFrame:
    """Every card with its person's live figures; claims and scores that the record can't bear are withheld, on the chip and in the text."""
    c = F.col("o_orderkey") % 7
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("card"), F.col("o_custkey").alias("person"), F.when(c == 4, 2).otherwise(1).alias("tagged"), F.expr(_SUMMARY).alias("summary"),
        F.when(c.isin(0, 4), "$1,000 in political donations").alias("chip"),
    )
    return cards.surfaced(rows, _records(spark, d))


@query(f"""WITH {_RECORDS}, s AS (SELECT person, CAST(score AS DOUBLE) AS score, letter, CAST(CASE WHEN NOT impossible THEN total END AS DOUBLE) AS political, concat_ws(',', CASE WHEN impossible THEN 'political' END, CASE WHEN score IS NULL THEN 'score' END) AS withheld FROM r)
  SELECT a.person AS "left", b.person AS "right", a.score AS left_score, b.score AS right_score, a.letter AS left_letter, b.letter AS right_letter, a.political AS left_political, b.political AS right_political, a.withheld AS left_withheld, b.withheld AS right_withheld,
    CASE WHEN a.score > b.score THEN 'left' WHEN a.score < b.score THEN 'right' WHEN a.score = b.score THEN 'even' END AS larger_score, CASE WHEN a.political > b.political THEN 'left' WHEN a.political < b.political THEN 'right' WHEN a.political = b.political THEN 'even' END AS larger_political
  FROM s a JOIN s b ON b.person = a.person + 5""")
def people_beside(spark: SparkSession, d: str) -> DataFrame:
    """People beside those five numbers on: figures that one side may not state are compared by neither."""
    pairs = table(spark, d, "customer").select(F.col("c_custkey").alias("left"), (F.col("c_custkey") + 5).alias("right"))
    told = cards.beside(pairs, _records(spark, d))
    return told.withColumns({c: F.array_join(c, ",") for c in ("left_withheld", "right_withheld")})


@query("SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def people_with_facts(spark: SparkSession, d: str) -> DataFrame:
    """People with their facts but for two kinds; who has none of the others isn't there."""
    facts = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority")
    return cards.with_facts(table(spark, d, "customer").select("c_custkey"), facts, "c_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH"])


def headlines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as cards: their first ten words as headlines, some without a stamp."""
    stamp = F.when(F.col("doc_id") % 9 > 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("doc_id") % 50))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 10), " ").alias("headline"), stamp.alias("stamp"), (F.col("doc_id") * 7 % 23).alias("punch"))


@query()
def top_by_punch(spark: SparkSession, d: str) -> DataFrame:
    """Twenty cards of most punch that tell of different events; what was promoted before decides, so there is no SQL. Tests hold a plain loop."""
    checkpoint_folder(spark)
    return cards.top_slice(headlines(spark, d), F.col("punch"), 20)


_POS = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"""WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice, {_POS} AS pos, o_orderstatus <> 'P' AS good FROM orders), b AS (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY pos) AS before FROM p),
  m AS (SELECT o_custkey, min(pos) FILTER (WHERE NOT good) AS bad, max(pos) FILTER (WHERE good) AS last FROM p GROUP BY o_custkey)
  SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > before) AS breaks, coalesce(max(last) > max(bad), false) AS misplaced FROM b JOIN m USING (o_custkey) GROUP BY o_custkey""")
def order_checks(spark: SparkSession, d: str) -> DataFrame:
    """How often a person's orders rise instead of falling, and whether a settled one comes after a pending one."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderstatus", pos.alias("pos"))
    breaks = audit.descending_breaks(rows, "o_custkey", "pos", "o_totalprice").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("breaks"))
    wrong = audit.first_misplaced(rows, "o_custkey", "pos", F.col("o_orderstatus") != "P").select("o_custkey", F.lit(True).alias("misplaced"))
    people = rows.select("o_custkey").distinct().join(breaks, "o_custkey", "left").join(wrong, "o_custkey", "left")
    return people.select("o_custkey", F.coalesce("breaks", F.lit(0)).alias("breaks"), F.coalesce("misplaced", F.lit(False)).alias("misplaced"))


@query("""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer)
  SELECT c_custkey, CASE WHEN n <= 100 THEN 1 WHEN n <= 400 THEN 2 ELSE 3 END AS tier FROM r""")
def due_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Who is due on the thirtieth run: the first hundred of every run, the next three hundred of every third, all others of every tenth."""
    return ranking.tiers(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 30).select("c_custkey", "tier")


_MAPS = {
    "candidate": "map('overview', 'new a', 'business', 'new b', 'other', 'new c')", "published": "map('overview', CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'old a' END, 'business', 'old b')",
    "dates": "map('business', '2020-01-01')",
}
_BLOCKED = "CASE c_custkey % 4 WHEN 0 THEN array('overview') WHEN 1 THEN array('overview', 'business') WHEN 2 THEN array('philanthropy') ELSE array() END"
_MARKERS = """map('overview', named_struct('by', CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE 'x' END, 'date', CASE WHEN c_custkey % 5 = 1 THEN 'soon' ELSE '2024-05-01' END, 'ruling', CASE WHEN c_custkey % 5 = 2 THEN NULL ELSE 'ok' END))"""


@query("""WITH v AS (SELECT c_custkey AS k, c_custkey % 4 IN (0, 1) AS a, c_custkey % 4 = 1 AS b, c_custkey % 3 > 0 AS had, c_custkey % 5 AS m FROM customer)
  SELECT k AS c_custkey, CASE WHEN a AND had THEN 'old a' WHEN NOT a THEN 'new a' END AS overview, CASE WHEN b THEN 'old b' ELSE 'new b' END AS business, CASE WHEN a THEN CASE WHEN had THEN 'previous' ELSE 'withheld' END END AS outcome,
    CASE WHEN a AND had THEN '2024-06-01' END AS overview_date, CASE WHEN b THEN '2020-01-01' END AS business_date, CASE m WHEN 0 THEN 'no by' WHEN 1 THEN 'no date' WHEN 2 THEN 'no ruling' END AS defect,
    CASE WHEN m > 2 AND had THEN 'old a' ELSE 'new a' END AS approved, CAST(2 AS INT) AS n FROM v""")
def profile_sections(spark: SparkSession, d: str) -> DataFrame:
    """Blocked sections fall back to what was published, with its date, or are withheld; sections approved by hand stay as they were."""
    rows = table(spark, d, "customer").withColumns({**{n: F.expr(x) for n, x in _MAPS.items()}, "blocked": F.expr(_BLOCKED).cast("array<string>"), "markers": F.expr(_MARKERS)})
    c, p = F.col("candidate"), F.col("published")
    merged, outcome = sections.blocked_sections(c, p, F.col("blocked")), sections.outcome(c, p, F.col("blocked"))
    kept = sections.preserved_dates(outcome, F.col("dates"), F.lit("2024-06-01"))
    approved = sections.approved_sections(c, p, F.col("markers"), F.array(F.lit("overview"), F.lit("business")))
    at = F.try_element_at
    return rows.select(
        "c_custkey", at(merged, F.lit("overview")).alias("overview"), at(merged, F.lit("business")).alias("business"), at(outcome, F.lit("overview")).alias("outcome"), at(kept, F.lit("overview")).alias("overview_date"),
        at(kept, F.lit("business")).alias("business_date"), sections.approval_defect(at(F.col("markers"), F.lit("overview"))).alias("defect"), at(approved, F.lit("overview")).alias("approved"), F.size(approved).alias("n"),
    )


_EMPLOYER = "CASE o_orderkey % 6 WHEN 0 THEN 'Vessel Shipping LLC' WHEN 1 THEN 'Self-Employed' WHEN 2 THEN 'Quill Partners' WHEN 3 THEN concat('Harbor ', CAST(o_custkey AS VARCHAR(9)), ' Works') WHEN 4 THEN 'Inc.' ELSE NULL END"


@query("""SELECT o_orderkey AS record, CASE WHEN o_orderkey % 6 IN (1, 4, 5) THEN 'generic' WHEN o_custkey % 4 = 0 THEN 'no-list' WHEN o_orderkey % 6 = 0 AND o_custkey % 4 = 1 THEN 'affiliated' WHEN o_orderkey % 6 = 3 THEN 'affiliated' WHEN o_orderkey % 6 = 2 THEN 'surname' ELSE 'unaffiliated' END AS verdict
  FROM orders JOIN customer ON c_custkey = o_custkey""")
def employers(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record's employer is a company of the person's, bears their name, or tells nothing; companies come from four kinds of facts."""
    c = table(spark, d, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("person"))
    filler = ["llc", "inc", "partners", "works"]
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("person"), F.lit("Ann Quill Jr.").alias("name"))
    firms = c.select("person", F.when(F.col("person") % 4 == 1, "Vessel Holdings").otherwise("Q42").alias("value"))
    filings, businesses = c.select("person", F.lit("Harbor Inc").alias("value")), c.select("person", F.lit("Quill LLC").alias("value"))
    about = c.select("person", F.lit("founder of Lantern Works").alias("value"))
    known = attribution.affiliations(people, firms, filings, businesses, about, filler)
    orders = table(spark, d, "orders").join(people.select(F.col("person").alias("o_custkey")), "o_custkey", "left_semi")
    records = orders.select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("person"), F.expr(_EMPLOYER).alias("employer"))
    return attribution.employer_verdicts(records, people, known, filler, ["self employed"]).select("record", "verdict")


@query("""SELECT s_suppkey, s_suppkey % 6 IN (0, 1) AS own FROM supplier""")
def own_foundations(spark: SparkSession, d: str) -> DataFrame:
    """Charities that are plausibly a person's own: named after them before the first charity word, and no institution."""
    k = F.col("s_suppkey")
    name = (
        F.when(k % 6 == 0, "The Ann and Bo Quill Family Foundation").when(k % 6 == 1, "Quill Foundation").when(k % 6 == 2, "Quill University Foundation").when(k % 6 == 3, "Foundation for Quill")
        .when(k % 6 == 4, "Ann Vessel Foundation").otherwise(F.lit(None).cast("string"))
    )
    own = attribution.own_foundation(name, F.lit("Ann Quill Jr."), "foundation|fund|trust", ["university"], ["family", "and"])
    return table(spark, d, "supplier").select("s_suppkey", own.alias("own"))
