"""What texts claim about people, and what answers and records are worth: each query builds texts of every class that a rule tells apart, and
its SQL says class by class what must come of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates, lists, money, numeric, political, prose, text
from factloom.plans.base import query, table
from factloom.sources import landed

_K = "o_orderkey"
# A stale total in whole thousands, and the live one, beyond a million for every third order.
_THOUSANDS = "(3 + o_custkey % 900)"
_OLD = f"concat('$', CAST({_THOUSANDS} AS VARCHAR(9)), ',000')"
_LIVE = f"CASE WHEN {_K} % 3 = 0 THEN o_totalprice + 1000000 WHEN {_K} % 31 = 0 THEN floor(o_totalprice) / 100 ELSE o_totalprice END"


def _story(figure: str) -> str:
    """SQL of the text that an order's class makes of a figure; classes 0, 1, 10 and 11 are those that are restated."""
    return f"""CASE {_K} % 12 WHEN 0 THEN concat('She gave ', {figure}, ' in political donations. He lives here.') WHEN 1 THEN concat('Political donations total about ', {figure}, ' so far.')
      WHEN 2 THEN concat('Records show a modest ', {figure}, ' in political donations.') WHEN 3 THEN concat('She gave ', {figure}, ' in political donations. That is small next to others.')
      WHEN 4 THEN concat('Her husband gave ', {figure}, ' in political donations.') WHEN 5 THEN concat('He wrote a ', {figure}, ' check.')
      WHEN 6 THEN concat('Gave ', {figure}, ' in political donations. Political donations of $5 million follow.') WHEN 10 THEN concat('Gave ', {figure}, ' in total known political contributions!')
      WHEN 11 THEN concat('Gave ', {figure.replace("new_figure", _OLD)}, ' to a friend and ', {figure}, ' in reported political donations.') ELSE concat('He gave ', {figure}, ' in political donations.') END"""


_WORDED = f"CASE {_K} % 12 WHEN 8 THEN concat('$', CAST({_THOUSANDS} + 1 AS VARCHAR(9)), ',000') WHEN 10 THEN concat('$', CAST({_THOUSANDS} AS VARCHAR(9)), ' thousand') ELSE {_OLD} END"


@query(f"""WITH v AS (SELECT {_K}, o_custkey, {_K} % 12 AS c, {_THOUSANDS} AS old, {_LIVE} AS live, {_story(_WORDED)} AS told FROM orders),
  n AS (SELECT *, CASE WHEN live >= 1e6 THEN printf('%.1f', live / 1e6) WHEN live >= 1000 THEN CAST(CAST(round(live / 1000) AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.3f', live), '0'), '.') END AS num FROM v),
  f AS (SELECT *, CASE WHEN live >= 1e6 THEN '$' || regexp_replace(num, '\\.0$', '') || ' million' WHEN live < 1000 THEN '$' || num WHEN c = 10 THEN '$' || num || ' thousand' ELSE '$' || num || ',000' END AS new_figure,
    CASE WHEN live >= 1e6 THEN 0 WHEN live >= 1000 THEN CAST(num AS BIGINT) ELSE 0 END AS thousands FROM n)
  SELECT {_K}, CASE WHEN c IN (0, 1, 10, 11) AND thousands <> old AND thousands <> 1000 THEN {_story("new_figure")} ELSE told END AS said FROM f""")
def political_totals(spark: SparkSession, d: str) -> DataFrame:
    """Stale totals restated, and left where a guard holds: a judged size here or in the next sentence, a relative, no total, two totals, two
    people, a figure that isn't the chip's, no live total."""
    rows = table(spark, d, "orders").withColumns({"told": F.expr(_story(_WORDED)), "chip": F.expr(f"concat({_OLD}, ' in political donations')"), "live": F.expr(_LIVE)})
    c = F.col(_K) % 12
    return rows.select(_K, political.repair_total(F.col("told"), F.col("chip"), F.when(c != 9, F.col("live")), F.when(c == 7, 2).otherwise(1)).alias("said"))


_N = f"CAST({_THOUSANDS} AS VARCHAR(9))"
_CLAIM = f"""CASE {_K} % 8 WHEN 0 THEN concat('He contributed $', {_N}, ',000 to a hospital in an election year.') WHEN 1 THEN concat('She gave $', {_N}, ' million in total political donations.')
  WHEN 2 THEN concat('Donations to political campaigns reached $', {_N}, ',000.') WHEN 3 THEN concat('Political giving is unknown. He gave $', {_N}, ',000 to art.')
  WHEN 4 THEN concat('His political donations are unknown, but he gave $', {_N}, ' million away.') WHEN 5 THEN concat('Political donations', repeat(' are not on file', 9), ' but $', {_N}, ' is.')
  WHEN 6 THEN concat('By U.S. political spending rules $', {_N}, 'K counts.') ELSE NULL END"""


@query(f"SELECT {_K}, CASE WHEN {_K} % 8 IN (1, 2, 4, 6) THEN '' ELSE {_CLAIM} END AS said FROM orders")
def political_withheld(spark: SparkSession, d: str) -> DataFrame:
    """Texts that tie a figure to political spending within one sentence and 120 characters are withheld whole."""
    return table(spark, d, "orders").select(_K, political.withhold_political(F.expr(_CLAIM)).alias("said"))


# A score in whole hundredths, as it was and as it is.
_WAS, _IS = "CAST(c_custkey % 90 + 5 AS VARCHAR(9))", "CAST(c_custkey * 7 % 89 + 1 AS INT)"
_LETTER = "CASE WHEN s >= 80 THEN 'A' WHEN s >= 60 THEN 'B' WHEN s >= 40 THEN 'C' WHEN s >= 20 THEN 'D' ELSE 'F' END"


def _scored(number: str, name: str, letter: str) -> str:
    return f"""CASE c_custkey % 10 WHEN 0 THEN concat('Her {name} of ', {number}, ' is high') WHEN 1 THEN concat('with ', {number}, ' {name}.') WHEN 2 THEN concat('giving grade ', {letter}, ' (', {number}, ' of 100)')
      WHEN 3 THEN concat('Giving score was ', {number}, '.') WHEN 4 THEN concat('$', {_WAS}, ' PBS score') WHEN 5 THEN concat('a giving score of ', {_WAS}, '% here') WHEN 6 THEN 'PBS aired it'
      WHEN 7 THEN concat('a giving score of ', {number}) WHEN 8 THEN concat('the giving grade: ', {number}, '; and ', {number}, ' giving score') ELSE 'The public  benefit score is rising' END"""


_GRADES = "CASE " + " ".join(f"WHEN s >= {least} THEN '{g}'" for g, least in numeric.GRADES) + " ELSE 'F' END"


@query(f"""WITH v AS (SELECT c_custkey, {_scored(_WAS, "PBS score", "'B'")} AS told, {_IS} AS s, CAST({_IS} AS VARCHAR) AS i FROM customer), r AS (SELECT *, CASE WHEN c_custkey % 10 = 7 THEN told ELSE {_scored("i", "giving score", _GRADES)} END AS said FROM v)
  SELECT c_custkey, said, CASE WHEN c_custkey % 10 IN (4, 9) THEN '' ELSE said END AS shown, CASE WHEN c_custkey % 10 = 6 THEN told ELSE '' END AS ungraded,
    CASE c_custkey % 10 WHEN 2 THEN {_WAS} WHEN 3 THEN {_WAS} WHEN 7 THEN {_WAS} WHEN 8 THEN {_WAS} || ',' || {_WAS} ELSE '' END AS figures FROM r""")
def score_prose(spark: SparkSession, d: str) -> DataFrame:
    """Scores in texts: restated (not where two people are tagged), withheld under the inside name, withheld for people without a grade, and read
    out under the readers' names."""
    rows = table(spark, d, "customer").withColumns({"told": F.expr(_scored(_WAS, "PBS score", "'B'")), "live": F.expr(_IS).cast("double")})
    rows = rows.withColumn("said", prose.repair_score("told", "live", F.when(F.col("c_custkey") % 10 == 7, 2).otherwise(1)))
    figures = F.array_join(F.transform(prose.reader_facing_figures("told"), lambda x: x.cast("int").cast("string")), ",")
    return rows.select("c_custkey", "said", prose.withhold_inside_score(F.col("said")).alias("shown"), prose.withhold_any_score(F.col("told")).alias("ungraded"), figures.alias("figures"))


_DEM, _UNK, _NNE, _IND = "o_custkey % 50 * 10 + o_orderkey % 7", "o_orderkey % 11 * 20", "o_orderkey % 13 * 15", "o_orderkey % 17 * 12"


@query(f"""WITH b AS (SELECT {_K}, unnest([{{'at': 0, 'code': 'DEM', 'amount': {_DEM}}}, {{'at': 1, 'code': 'Unknown', 'amount': {_UNK}}}, {{'at': 2, 'code': 'NNE', 'amount': {_NNE}}}, {{'at': 3, 'code': 'PAC/Other', 'amount': 500}},
    {{'at': 4, 'code': 'IND', 'amount': {_IND}}}, {{'at': 5, 'code': 'none', 'amount': 1}}]) AS b FROM orders)
  SELECT {_K}, string_agg(b.code || '=' || CAST(b.amount AS VARCHAR), ';' ORDER BY b.amount DESC, b.at) AS buckets, arg_max(b.code, b.amount * 10 - b.at) FILTER (WHERE b.code IN ('DEM', 'IND', 'none') AND b.amount > 0) AS leads FROM b GROUP BY {_K}""")
def party_lean(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of parties folded into buckets, and the one that a person leans to: no party, a committee or NNE is no lean."""
    amounts = {"DEM": "o_custkey % 50 * 10", "Dem": "o_orderkey % 7", "unk": _UNK, "nne": _NNE, "pac/other": "500", "IND": _IND, " none ": "1"}
    breakdown = F.create_map(*[x for k, v in amounts.items() for x in (F.lit(k), F.expr(v).cast("double"))])
    rows = table(spark, d, "orders").withColumn("b", breakdown)
    told = F.transform(lists.party_buckets(F.col("b")), lambda x: F.concat_ws("=", x["code"], x["amount"].cast("long").cast("string")))
    return rows.select(_K, F.array_join(told, ";").alias("buckets"), lists.top_party(F.col("b")).alias("leads"))


_A, _R = "(1000 + o_custkey % 900)", "(500 + o_orderkey % 300)"
_BOTH, _PARTS, _REP, _TOTAL = (f"CAST({x} AS VARCHAR(9))" for x in (f"{_A} + 250", _A, _R, f"{_A} + 250 + {_R}"))
_PARTY_TEXT = f"""CASE {_K} % 8 WHEN 0 THEN concat('Of $', {_TOTAL}, ' $', {_BOTH}, ' went to one, $', {_REP}, ' to the other.') WHEN 1 THEN concat('Of $', {_TOTAL}, ' $', {_PARTS}, ', $250.00 and $', {_REP}, '.')
  WHEN 2 THEN concat('Of $', {_TOTAL}, ' $', {_BOTH}, ' went to one.') WHEN 3 THEN concat('In all $', {_TOTAL}, ' in ', {_REP}, ' gifts.') WHEN 4 THEN concat('$', {_BOTH}, ' and $', {_REP}) WHEN 5 THEN concat('Of $', {_TOTAL})
  WHEN 6 THEN '  ' ELSE concat('$', {_TOTAL}, ' and $', {_PARTS}, ' and $', {_REP}) END"""


@query(f"""SELECT {_K}, CASE {_K} % 8 WHEN 2 THEN 'drops-bucket' WHEN 3 THEN 'thin' WHEN 4 THEN 'no-total-cited' WHEN 5 THEN 'too-few-buckets' WHEN 6 THEN 'no-data' WHEN 7 THEN 'drops-bucket' ELSE 'clean' END AS verdict,
    CASE {_K} % 8 WHEN 2 THEN 'REP' WHEN 3 THEN 'DEM,REP' WHEN 7 THEN 'DEM' ELSE '' END AS missing, CAST(CASE {_K} % 8 WHEN 2 THEN {_R} WHEN 3 THEN {_A} + 250 + {_R} WHEN 7 THEN {_A} + 250 ELSE 0 END AS DOUBLE) AS gap FROM orders""")
def party_prose(spark: SparkSession, d: str) -> DataFrame:
    """How prose accounts for the amounts by party: six verdicts, what is missing, and the gap. A refund makes one group no claim."""
    rep = F.expr(f"CASE WHEN {_K} % 8 = 5 THEN 0 ELSE {_R} END").cast("double")
    breakdown = F.create_map(F.lit("DEM"), F.expr(_A).cast("double"), F.lit("Dem"), F.lit(250.0), F.lit("REP"), rep, F.lit("IND"), F.lit(40.0), F.lit("ind"), F.lit(-40.0))
    told = political.party_prose(F.expr(_PARTY_TEXT), breakdown, F.expr(f"{_A} + 250 + {_R}").cast("double"))
    return table(spark, d, "orders").select(_K, told.alias("x")).select(_K, "x.verdict", F.array_join("x.missing", ",").alias("missing"), "x.gap")


_BODY = """CASE c_custkey % 11 WHEN 0 THEN concat('{"total_results": 2, "organizations": [{"ein": ', CAST(c_custkey AS VARCHAR(9)), '}]}') WHEN 1 THEN '{"total_results": 0, "organizations": []}' WHEN 2 THEN '<html>' WHEN 3 THEN '{"total_results": 5, "organizations": []}'
  WHEN 4 THEN '{"total_results": 0, "organizations": [], "error": null}' WHEN 5 THEN '{"total_results": "0", "organizations": []}' WHEN 6 THEN '{"total_results": 0.5, "organizations": []}' WHEN 7 THEN '{"total_results": 0}' WHEN 8 THEN '[]'
  WHEN 9 THEN '{"total_results": 1, "organizations": {"ein": 1}}' ELSE NULL END"""
_FILINGS = """CASE c_custkey % 6 WHEN 0 THEN '{"filings_with_data": [{"tax_prd_yr": 2020}, {"tax_prd_yr": 2021}]}' WHEN 1 THEN '{"filings_with_data": []}' WHEN 2 THEN '{"filings_with_data": [{"tax_prd_yr": 2020}, {"tax_prd_yr": "2021"}]}'
  WHEN 3 THEN '{}' WHEN 4 THEN '{"filings_with_data": [{"tax_prd_yr": 2020}], "error": "x"}' ELSE '{"filings_with_data": [null]}' END"""
_STATUS = "CASE c_custkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 500 END"


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 3 = 0 THEN 'answer' WHEN c_custkey % 11 = 1 AND c_custkey % 3 < 2 THEN 'empty' ELSE 'failed' END AS search,
    CASE WHEN c_custkey % 6 < 2 AND c_custkey % 3 = 0 THEN 'answer' ELSE 'failed' END AS filings FROM customer""")
def search_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Answers told from failures: only a search answer that says itself how many results it has is empty or an answer."""
    rows = table(spark, d, "customer")
    search = landed.classify_response(F.expr(_STATUS), F.expr(_BODY), "organizations")
    return rows.select("c_custkey", search.alias("search"), landed.classify_filings(F.expr(_STATUS), F.expr(_FILINGS)).alias("filings"))


_BORN = f"CASE {_K} % 7 WHEN 0 THEN NULL WHEN 1 THEN 1849 WHEN 2 THEN 1995 WHEN 3 THEN 1980 ELSE 1940 + {_K} % 30 END"
_SPAN = f"CASE {_K} % 5 WHEN 0 THEN concat(CAST(1950 + {_K} % 45 AS VARCHAR(4)), '-01-02 to 1998-01-01') WHEN 1 THEN '1700-01-01 to 1998-01-01' WHEN 2 THEN '2005-01-01 to 2006-01-01' WHEN 3 THEN '1951-01-01' ELSE concat(CAST(1955 + {_K} % 9 AS VARCHAR(4)), '-05-05 to 1990-01-01') END"


@query(f"""WITH v AS (SELECT *, {_BORN} AS born, CASE {_K} % 5 WHEN 0 THEN 1950 + {_K} % 45 WHEN 4 THEN 1955 + {_K} % 9 END AS first FROM orders)
  SELECT {_K}, born IS NOT NULL AND born <= 1980 AND born >= 1850 AND first IS NOT NULL AND first < born + 18 AS impossible, coalesce(born < 1850 OR born > 1980, true) AS implausible,
    CASE WHEN {_K} % 4 = 0 AND o_custkey > 0 THEN o_custkey * 1.0 ELSE o_totalprice / greatest(1, 1998 - (1990 + {_K} % 12)) END AS yearly FROM v""")
def record_checks(spark: SparkSession, d: str) -> DataFrame:
    """Records that can't be a person's, and yearly figures: a stated one counts only above 0."""
    born, k = F.expr(_BORN), F.col(_K)
    stated = F.when(k % 4 == 0, F.col("o_custkey") * 1.0).when(k % 4 == 1, 0.0).when(k % 4 == 2, -1.0)
    return table(spark, d, "orders").select(
        _K, dates.impossible_record(dates.first_year_of(F.expr(_SPAN)), born, 1998).alias("impossible"), dates.implausible_birth(born, 1998).alias("implausible"),
        numeric.annualised(F.col("o_totalprice"), 1990 + k % 12, stated, 1998).alias("yearly"),
    )


_CENTS = "c_custkey * 7 % 1000 + c_custkey % 4 * 0.25"
_WORTH = "CASE c_custkey % 7 WHEN 0 THEN concat('~$', n, '.5B (est.)') WHEN 1 THEN concat('about ', n, ' million in 2020') WHEN 2 THEN concat('$ ', n, ',000') WHEN 3 THEN concat('worth $', n, ' T') WHEN 4 THEN 'not known' WHEN 5 THEN concat(n, 'k') ELSE NULL END"


@query(f"""WITH v AS (SELECT c_custkey, CAST(c_custkey % 900 + 1 AS DOUBLE) AS x, CAST({_CENTS} AS DOUBLE) AS c FROM customer)
  SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN (x + 0.5) * 1e9 WHEN 1 THEN x * 1e6 WHEN 2 THEN x * 1000 WHEN 3 THEN x * 1e12 WHEN 5 THEN x END AS worth, '$' || rtrim(rtrim(printf('%.2f', c), '0'), '.') AS small FROM v""")
def money_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The first figure of a text, and sums below a thousand, which keep their cents."""
    rows = table(spark, d, "customer").withColumn("n", (F.col("c_custkey") % 900 + 1).cast("string"))
    return rows.select("c_custkey", money.parse_usd(F.expr(_WORTH)).alias("worth"), money.currency(F.expr(_CENTS).cast("double")).alias("small"))


_COMMENT = """CASE p_partkey % 8 WHEN 0 THEN 'In the provided context he gave. He lives here.' WHEN 1 THEN 'He gave.  No news articles were available.' WHEN 2 THEN 'This profile argues much.' WHEN 3 THEN 'He gave. Based on the provided titles he left. She stayed.'
  WHEN 4 THEN 'Meta said the provided data was safe.' WHEN 5 THEN 'He gave.' WHEN 6 THEN 'It is listed in the provided data. So it lands lower.' ELSE NULL END"""


@query(f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'cites its working material (provided context)' WHEN 2 THEN 'summariser voice about the source, not the subject' WHEN 6 THEN 'narrates its own ranking decision to the reader;cites its working material (in the provided data)' ELSE '' END AS labels,
    p_partkey % 8 IN (0, 1, 2, 3, 4, 6) AS commented, p_partkey % 8 IN (0, 2, 3, 6) AS at_writing, CASE p_partkey % 8 WHEN 0 THEN 'He lives here.' WHEN 1 THEN 'He gave.' WHEN 3 THEN 'He gave. She stayed.' WHEN 5 THEN 'He gave.' END AS said FROM part""")
def commentary(spark: SparkSession, d: str) -> DataFrame:
    """Texts that speak of their own making: what each is called, what is seen when it is written, and what is left of it."""
    said = F.expr(_COMMENT)
    return table(spark, d, "part").select(
        "p_partkey", F.array_join(text.commentary_labels(F.lit(None).cast("string"), said), ";").alias("labels"), text.has_commentary(said).alias("commented"),
        text.has_commentary(said, write_time=True).alias("at_writing"), text.without_commentary(said).alias("said"),
    )


@query("""WITH v AS (SELECT c_custkey, 95 + c_custkey % 10 AS n, CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 10 END AS reported, CASE WHEN c_custkey % 4 > 0 THEN '2020-01-01 to 2021-01-01' ELSE '' END AS span FROM customer)
  SELECT c_custkey, CASE WHEN n < 100 THEN n END AS count, CASE WHEN n < 100 THEN span END AS span, CASE WHEN n >= 100 THEN n END AS in_sample, CASE WHEN n >= 100 THEN nullif(span, '') END AS span_of_sample, CASE WHEN n >= 100 THEN reported END AS reported,
    CASE WHEN n >= 100 THEN 'at least ' || n || CASE WHEN reported IS NULL THEN ' and the true total is unknown and higher' ELSE ' (the FEC reports ' || reported || ' in total)' END END AS says,
    CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN (c_custkey + 0.5) * 1e9 WHEN 2 THEN c_custkey * 1e12 END AS listed FROM v""")
def samples(spark: SparkSession, d: str) -> DataFrame:
    """Counts and spans of records that are cut, under names that say so; and figures as a list writes them."""
    k = F.col("c_custkey")
    told = money.sampled(95 + k % 10, F.when(k % 3 > 0, k * 10), F.when(k % 4 > 0, "2020-01-01 to 2021-01-01").otherwise(""))
    says = F.concat(F.lit("at least "), F.regexp_extract("x.note", r"AT LEAST (\d+) ", 1), F.regexp_extract("x.note", r"federal contributions(.*?)\. Every", 1))
    listed = F.when(k % 4 == 0, "$1,000").when(k % 4 == 1, F.concat(F.lit("$"), k.cast("string"), F.lit(".5 B"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit("T"))).otherwise("none")
    rows = table(spark, d, "customer").select("c_custkey", told.alias("x"), money.parse_listed_usd(listed).alias("listed"))
    return rows.select("c_custkey", "x.count", "x.span", "x.in_sample", "x.span_of_sample", "x.reported", F.when(F.col("x.note").isNotNull(), says).alias("says"), "listed")
