"""Column functions on values built from the driver tables, many a query, each column with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import attribution, dates, lists, money, numeric, text
from factloom.operators import tables
from factloom.plans.base import query, table
from factloom.sources import landed

_K = "o_orderkey"
_EDIT = "CASE o_orderkey % 4 WHEN 0 THEN a WHEN 1 THEN concat(substring(a, 1, 2), '0', substring(a, 4, 5)) WHEN 2 THEN concat(substring(a, 1, 1), substring(a, 3, 1), substring(a, 2, 1), substring(a, 4, 5)) ELSE concat(a, '1') END"


@query(f"""WITH v AS (SELECT *, CAST(12345678 + o_orderkey * 37 AS VARCHAR) AS a FROM orders), w AS (SELECT *, {_EDIT} AS b, CAST(round(o_totalprice / 100) * 100 AS BIGINT) AS r FROM v)
  SELECT o_orderkey, o_totalprice >= 10 * o_custkey AND o_custkey > 0 AS dominates, coalesce(CASE WHEN o_orderkey % 5 = 0 AND o_custkey > 0 THEN o_custkey * 1.0 END, o_totalprice / greatest(1, 1998 - (1990 + o_orderkey % 12))) AS yearly,
    o_orderkey % 5 < 3 AS alike, CAST(length(rtrim(CAST(r AS VARCHAR), '0')) AS INT) AS digits, length(a) = length(b) AND damerau_levenshtein(a, b) = 1 AS edited,
    CASE WHEN o_orderkey % 3 = 0 THEN 50.0 ELSE least(100.0, o_totalprice / 1000) END AS curation, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey * 2.5 + o_custkey * 10.0) / 1e6 END AS cost FROM w""")
def number_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("a", (12345678 + F.col(_K) * 37).cast("string")).withColumn("b", F.expr(_EDIT))
    k, price, who = F.col(_K), F.col("o_totalprice"), F.col("o_custkey")
    near = price * (1 + (k % 5) * 0.0049)
    return rows.select(
        _K,
        numeric.dominates(price, who.cast("double")).alias("dominates"),
        numeric.annualised(price, 1990 + k % 12, F.when(k % 5 == 0, who * 1.0), 1998).alias("yearly"),
        numeric.figures_match(price, near).alias("alike"),
        numeric.significant_digits(F.round(price / 100) * 100).alias("digits"),
        numeric.one_digit_edit(F.col("a"), F.col("b")).alias("edited"),
        numeric.curation_score(F.when(k % 3 > 0, price / 1000).otherwise(F.when(k % 2 == 0, 0.0))).alias("curation"),
        numeric.cost(k, who, F.when(k % 4 > 0, 2.5), F.lit(10.0)).alias("cost"),
    )


_STAMP = "CASE o_orderkey % 3 WHEN 0 THEN '19970412T101500' WHEN 1 THEN '1997' ELSE concat('1998', '0', CAST(1 + o_orderkey % 9 AS VARCHAR(2)), '15') END"
_BORN = "CASE o_orderkey % 5 WHEN 0 THEN concat('3/4/', CAST(10 + o_orderkey % 90 AS VARCHAR(2))) WHEN 1 THEN '12/31/1956' WHEN 2 THEN '1956-12-31' WHEN 3 THEN ' 1/2/03 ' ELSE NULL END"
_SERVER = "o_orderdate + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL '299' SECOND WHEN 1 THEN INTERVAL '301' SECOND ELSE INTERVAL '-300' SECOND END"


@query(f"""WITH v AS (SELECT *, {_STAMP} AS stamp, {_BORN} AS born, 10 + o_orderkey % 90 AS two FROM orders),
  b AS (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN two > 30 THEN 1900 + two WHEN 2000 + two > 1998 - 18 THEN 1900 + two ELSE 2000 + two END WHEN 1 THEN 1956 WHEN 3 THEN 1903 END AS y FROM v)
  SELECT o_orderkey, CASE WHEN length(stamp) >= 8 THEN concat(stamp[1:4], '-', stamp[5:6], '-', stamp[7:8]) ELSE '' END AS day, strftime(o_orderdate, 'as of %b %Y') AS month,
    CASE WHEN o_orderkey % 3 = 1 THEN {_SERVER} ELSE o_orderdate END AS trusted, CAST(CASE WHEN y > 1998 - 18 THEN y - 100 ELSE y END AS INT) AS born,
    CAST(CASE WHEN o_orderkey % 4 >= 2 THEN year(o_orderdate) END AS INT) AS precise, coalesce(CASE WHEN o_orderkey % 6 > 0 THEN 1950 + o_orderkey % 40 END BETWEEN 1850 AND 1980 AND 1980 < CASE WHEN o_orderkey % 6 > 0 THEN 1950 + o_orderkey % 40 END + 18, false) AS impossible,
    o_orderkey % 7 = 0 OR o_orderdate >= TIMESTAMP '1998-06-01 00:00:00' - to_days(400) AS recent FROM b""")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    rows, k = table(spark, d, "orders"), F.col(_K)
    when = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    as_of = F.lit("1998-06-01").cast("timestamp")
    return rows.select(
        _K,
        dates.compact_date(F.expr(_STAMP)).alias("day"),
        dates.month_label(F.col("o_orderdate")).alias("month"),
        dates.trusted_stamp(F.col("o_orderdate"), F.expr(_SERVER)).alias("trusted"),
        dates.birth_year(F.expr(_BORN), 1998).alias("born"),
        dates.precise_year(when, F.when(k % 4 == 1, F.lit(None)).otherwise(7 + k % 4)).alias("precise"),
        dates.impossible_record(F.lit(1980), F.when(k % 6 > 0, 1950 + k % 40), 1998).alias("impossible"),
        dates.recent(F.when(k % 7 > 0, F.col("o_orderdate")), as_of, 400).alias("recent"),
    )


_USD = "CASE o_orderkey % 8 WHEN 0 THEN concat('~$', CAST(n AS VARCHAR(9)), '.5B') WHEN 1 THEN concat('$', CAST(n AS VARCHAR(9)), ' million') WHEN 2 THEN concat(CAST(n AS VARCHAR(9)), 'M') WHEN 3 THEN concat('$', CAST(n AS VARCHAR(9)), ',000') WHEN 4 THEN 'none' WHEN 5 THEN concat('$', CAST(n AS VARCHAR(9)), ' bn') WHEN 6 THEN NULL ELSE concat('$', CAST(n AS VARCHAR(9)), 'T') END"


@query("""WITH v AS (SELECT *, CAST(o_orderkey % 900 + 1 AS DOUBLE) AS n FROM orders), e AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * (o_custkey * 1000 + CASE WHEN o_orderkey % 2 = 0 THEN 0.25 ELSE 0 END) AS exact FROM v)
  SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN (n + 0.5) * 1e9 WHEN 1 THEN n * 1e6 WHEN 2 THEN n * 1e6 WHEN 3 THEN n * 1000 WHEN 5 THEN n * 1e9 WHEN 7 THEN n * 1e12 END AS usd,
    CASE o_orderkey % 8 WHEN 0 THEN n + 0.5 WHEN 2 THEN n / 1000 END AS billions, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '<0.1%' ELSE printf('%.1f%%', n / 8 + 0.001) END AS share,
    CASE WHEN n * 1e7 >= 1e9 THEN printf('$%.1fB', n / 100 + 0.001) ELSE printf('$%.1fM', n * 10 + 0.01) END AS short,
    (CASE WHEN exact < 0 THEN '-$' ELSE '$' END) || CASE WHEN o_orderkey % 2 = 0 THEN format('{:,.2f}', abs(exact)) ELSE format('{:,.0f}', abs(exact)) END AS full FROM e""")
def money_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("n", F.col(_K) % 900 + 1)
    k, n = F.col(_K), F.col("n").cast("double")
    exact = F.when(k % 3 == 0, -1).otherwise(1) * (F.col("o_custkey") * 1000 + F.when(k % 2 == 0, 0.25).otherwise(0.0))
    return rows.select(
        _K,
        money.parse_usd(F.expr(_USD)).alias("usd"),
        money.parse_billions(F.expr(_USD)).alias("billions"),
        money.percent_label(F.when(k % 5 == 1, 0.05).when(k % 5 > 0, n / 8 + 0.001)).alias("share"),
        money.currency(n * 1e7 + F.when(n * 1e7 >= 1e9, 1e6).otherwise(1e4)).alias("short"),
        money.exact_usd(exact).alias("full"),
    )


_PERSON = "concat(CASE p_partkey % 4 WHEN 0 THEN 'Bill' WHEN 1 THEN 'Alexander' WHEN 2 THEN 'A. Bo' ELSE 'Cy' END, ' Vessel', CASE p_partkey % 5 WHEN 0 THEN ' Jr.' WHEN 1 THEN ', III' ELSE '' END)"
_STORY = "concat('Dr. Vessel gave $2.5 million. ', p_name, ' left! Was it ', p_brand, '? No. ', CAST(p_partkey AS VARCHAR(9)), ' knows')"


@query(f"""WITH v AS (SELECT p_partkey, p_name, p_brand, {_PERSON} AS person, CASE p_partkey % 4 WHEN 0 THEN 'bill' WHEN 1 THEN 'alexander' WHEN 2 THEN 'bo' ELSE 'cy' END AS first FROM part)
  SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'jr' WHEN 1 THEN 'iii' END AS generation, 'vessel' AS last, concat('p_', lower(replace(p_name, ' ', '_'))) AS snake,
    concat('Dr. Vessel gave $2.5 million. ', p_name, ' left!') AS start, concat('Dr. Vessel gave $2.5 million. Was it ', p_brand, '? No. ', CAST(p_partkey AS VARCHAR), ' knows') AS rest,
    p_partkey % 5 > 1 AND p_partkey % 4 <> 2 AS named, p_partkey % 4 IN (0, 1) AS short, p_partkey % 3 < 2 AS below FROM v""")
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").withColumns({"person": F.expr(_PERSON), "story": F.expr(_STORY)})
    k, person = F.col("p_partkey"), F.col("person")
    other = F.when(k % 4 == 0, "william").when(k % 4 == 1, "alexandria").otherwise("dora")
    host = F.when(k % 3 == 0, "example.org").when(k % 3 == 1, "www.example.org").otherwise("notexample.org")
    camel = F.concat(F.lit("p"), F.regexp_replace(F.initcap("p_name"), " ", ""))
    return rows.select(
        "p_partkey",
        text.generation(person).alias("generation"),
        text.last_name(person).alias("last"),
        text.snake_case(camel).alias("snake"),
        text.first_sentences(F.col("story"), 2).alias("start"),
        text.without_sentences(F.col("story"), "left").alias("rest"),
        text.name_in_text(person, F.concat(F.lit("Said bill vessel to ALEXANDER-Vessel; cy  Vessel"), F.lit("."))).alias("named"),
        text.short_form_of(F.when(k % 4 == 1, "alexand").otherwise(F.get(text.name_tokens(person), 0)), other).alias("short"),
        text.of_domain(host, ["example.org"]).alias("below"),
    )


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 4 WHEN c_custkey % 2 = 1 AND c_custkey % 3 = 1 THEN 1 WHEN c_custkey % 2 = 1 THEN 0 WHEN c_custkey % 3 = 1 THEN 3 ELSE 2 END AS tier,
    concat_ws(chr(10), 'name: ' || c_name, CASE WHEN c_custkey % 4 > 0 THEN 'segment: ' || c_mktsegment END) AS receipt, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_custkey % 2 = 0 THEN 'even' END AS lead,
    lpad(CAST(c_custkey * 7919 AS VARCHAR), 9, '0') AS ein, CASE WHEN c_custkey % 3 > 0 THEN 'T' || chr(65 + CAST(c_custkey % 26 AS INT)) END AS ticker, c_name AS filer,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Houses' WHEN 'AUTOMOBILE' THEN 'Cars' WHEN 'FURNITURE' THEN 'Things' ELSE 'Other' END AS label, 'https://x/' || replace(c_name, ' ', '_') || '?width=300' AS picture,
    CASE WHEN c_custkey % 5 = 0 THEN 'answer' WHEN c_custkey % 5 IN (1, 2) THEN 'empty' ELSE 'failed' END AS outcome FROM customer""")
def record_functions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = F.when(k % 3 == 2, "person").when(k % 3 == 1, "blind").otherwise("none")
    shown = F.concat("c_name", F.when(k % 3 > 0, F.concat(F.lit("  (T"), F.chr(65 + k % 26), F.lit(")"))).otherwise(""))
    status = F.when(k % 5 == 2, 404).when(k % 5 == 3, 500).otherwise(200)
    body = F.when(k % 5 == 0, '{"total_results": 1, "items": [1]}').when(k % 5 < 3, '{"total_results": 0, "items": []}').otherwise("<html>")
    segment = {"building": "Houses", "Automobile": "Cars"}
    return table(spark, d, "customer").select(
        "c_custkey",
        lists.send_tier(kind, k % 2).alias("tier"),
        lists.receipts(("name", F.col("c_name")), ("segment", F.when(k % 4 > 0, F.col("c_mktsegment")))).alias("receipt"),
        lists.headline_lead((F.col("c_acctbal") > 5000, F.lit("rich")), (k % 2 == 0, F.lit("even"))).alias("lead"),
        attribution.ein(k * 7919).alias("ein"),
        attribution.ticker(shown).alias("ticker"),
        attribution.bare_filer(F.concat("c_name", F.lit(" (CIK 000123)"))).alias("filer"),
        attribution.label(F.col("c_mktsegment"), segment, {"furni": "Things"}, "Other").alias("label"),
        attribution.thumbnail(F.concat(F.lit("http://y/z/"), "c_name"), "https://x/").alias("picture"),
        landed.classify_response(status, body, "items").alias("outcome"),
    )


@query("""WITH f AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag IN ('A', 'R')) AS n, list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_returnflag IN ('A', 'R')) AS k FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, CAST(n AS INT) AS n, coalesce(array_to_string(k[1:2], ','), '') AS first FROM f""")
def filing_forms(spark: SparkSession, d: str) -> DataFrame:
    """Lines of wanted forms out of parallel arrays: all counted, the first two kept."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    rows = rows.select("l_orderkey", F.col("x.l_returnflag").alias("forms"), F.col("x.l_linenumber").alias("lines"))
    n, kept = landed.filings("forms", ["lines"], ["A", "R"], 2)
    return rows.select("l_orderkey", n.alias("n"), F.array_join(F.transform(kept, lambda x: x["lines"].cast("string")), ",").alias("first"))


@query("""WITH old AS (SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 2 = 0), more AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 = 0),
  together AS (SELECT c_custkey, c_name, c_nationkey FROM old UNION ALL SELECT c_custkey, c_name, NULL FROM more),
  kept AS (SELECT * FROM together WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier))
  SELECT 'rows' AS what, count(*) AS n FROM kept UNION ALL SELECT 'places', count(c_nationkey) FROM kept UNION ALL SELECT 'with orders', count(*) FROM kept WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def appended_and_cascaded(spark: SparkSession, d: str) -> DataFrame:
    """Rows added with a column missing, some keys deleted, and rows whose parent is still there."""
    c = table(spark, d, "customer")
    both = tables.append(c.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_nationkey"), c.where("c_custkey % 5 = 0").select("c_custkey", "c_name"))
    kept = tables.delete_keys(both, table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey")), ["c_custkey"])
    having = tables.cascade(kept, table(spark, d, "orders"), {"c_custkey": "o_custkey"})
    counts = {"rows": kept.agg(F.count(F.lit(1)).alias("n")), "places": kept.agg(F.count("c_nationkey").alias("n")), "with orders": having.agg(F.count(F.lit(1)).alias("n"))}
    return reduce(DataFrame.union, [n.select(F.lit(what).alias("what"), "n") for what, n in counts.items()])


@query("""WITH p AS (SELECT o_custkey AS c_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS c_mktsegment, o_orderkey % 23 AS up, o_orderkey % 7 AS down FROM orders WHERE o_orderstatus = 'O'),
  w AS (SELECT c_custkey, arg_max(c_mktsegment, up - down) AS v, max(up - down) AS lead FROM p WHERE up - down >= 16 AND c_mktsegment IS NOT NULL GROUP BY c_custkey),
  t AS (SELECT c_custkey, lead, count(DISTINCT c_mktsegment) AS kinds FROM p JOIN w USING (c_custkey) WHERE p.up - p.down = lead AND p.c_mktsegment IS NOT NULL GROUP BY c_custkey, lead)
  SELECT count(*) AS people, count(*) FILTER (WHERE w.v IS NOT NULL) AS patched FROM customer LEFT JOIN w USING (c_custkey)""")
def patched_people(spark: SparkSession, d: str) -> DataFrame:
    """How many people an accepted patch changes."""
    patches = table(spark, d, "orders").where("o_orderstatus = 'O'").select(
        F.col("o_custkey").alias("c_custkey"), F.lit("pending").alias("status"), (F.col("o_orderkey") % 23).alias("upvotes"), (F.col("o_orderkey") % 7).alias("downvotes"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("patched "), "o_orderpriority")).alias("c_mktsegment"),
    )
    done = tables.patch(table(spark, d, "customer"), patches, "c_custkey", ["c_mktsegment"], net=16)
    return done.agg(F.count(F.lit(1)).alias("people"), F.count_if(F.col("c_mktsegment").startswith("patched")).alias("patched"))
