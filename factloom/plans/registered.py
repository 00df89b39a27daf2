"""Facts read by key, and people who arrive in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import registry, resolve
from factloom.plans.base import checkpoint_folder, query, table

#: What each kind of event holds: a whole number at ``k``; errors are not registered.
KINDS = {
    "purchase": registry.Kind("$.k", "whole", 0, 90), "click": registry.Kind("$.k", "whole"), "view": registry.Kind("$.k", "number", 5),
    "signup": registry.Kind("$.k", "number"), "login": registry.Kind("$.k", "whole"), "logout": registry.Kind("$.k", "whole"),
}
# A value as it may arrive: as it is, encoded twice, broken, with the number in quotes, without it.
_SHAPE = """CASE event_id % 6 WHEN 2 THEN substring(props, 1, 4) WHEN 3 THEN replace(replace(props, ': ', ': "'), '}', '"}') WHEN 4 THEN '{}' ELSE props END"""
_GOOD = {n: f"event_type = '{n}'" + (f" AND k >= {k.least:g}" if k.least is not None else "") + (f" AND k <= {k.most:g}" if k.most is not None else "") for n, k in KINDS.items()}
_REASON = (
    "CASE WHEN event_type NOT IN (" + ", ".join(f"'{n}'" for n in KINDS) + ") THEN 'unknown key' WHEN event_id % 6 = 2 THEN 'not json' WHEN event_id % 6 = 4 THEN 'missing' WHEN event_id % 6 = 3 THEN 'wrong type' "
    + " ".join(f"WHEN event_type = '{n}' AND k < {k.least:g} THEN 'too small'" for n, k in KINDS.items() if k.least is not None)
    + " ".join(f" WHEN event_type = '{n}' AND k > {k.most:g} THEN 'too large'" for n, k in KINDS.items() if k.most is not None) + " END"
)
_EVENTS = f"v AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), r AS (SELECT *, {_REASON} AS reason FROM v)"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("said", F.expr(_SHAPE))
    twice = F.concat(F.lit('"'), F.replace("said", F.lit('"'), F.lit('\\"')), F.lit('"'))
    return rows.select(F.col("user_id").alias("person"), F.col("event_type").alias("fact_key"), F.when(F.col("event_id") % 6 == 1, twice).otherwise(F.col("said")).alias("value"), F.struct("ts", "event_id").alias("stamp"), "event_id")


def _newest(name: str, kind: registry.Kind) -> str:
    cast = "BIGINT" if kind.type == "whole" else "DOUBLE"
    return f"CAST(arg_max(k, (ts, event_id)) FILTER (WHERE event_type = '{name}' AND reason IS NULL) AS {cast}) AS \"{name}\""


@query(f"WITH {_EVENTS} SELECT user_id AS person, {', '.join(_newest(n, k) for n, k in KINDS.items())} FROM r GROUP BY user_id")
def typed_facts(spark: SparkSession, d: str) -> DataFrame:
    """The newest fact of each registered key that can be read, one typed column a key."""
    return registry.read(_facts(spark, d), KINDS)[0]


@query(f"WITH {_EVENTS} SELECT event_id, user_id AS person, reason FROM r WHERE reason IS NOT NULL")
def quarantined_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that can't be read, and why."""
    return registry.read(_facts(spark, d), KINDS)[1].select("event_id", "person", "reason")


_P = "CAST(1000000 + o_custkey * 10 AS VARCHAR(12))"
_FACT = f"""CASE o_orderkey % 8 WHEN 0 THEN concat('{{"cumulativeGiving": ', {_P}, ', "periodLabel": " since 1990 ", "source": " x ", "annualGiving": ', CAST(o_custkey % 3 AS VARCHAR(3)), '}}')
  WHEN 1 THEN concat('{{"cumulativeGiving": ', {_P}, ', "periodLabel": "$21B+ lifetime", "source": "x"}}') WHEN 2 THEN concat('{{"cumulativeGiving": "', {_P}, '", "periodLabel": "since 1990", "source": "x"}}')
  WHEN 3 THEN '{{"cumulativeGiving": 999999, "periodLabel": "since 1990", "source": "x"}}' WHEN 4 THEN concat('{{"foundations": [{{"name": "Fund", "assets": ', {_P}, ', "grants": 5}}, {{"name": "Fund Trust", "assets": 7, "grants": 3}}, {{"name": "Other", "assets": 1}}]}}')
  WHEN 5 THEN concat('{{"assets": ', {_P}, ', "grants": 2.5}}') WHEN 6 THEN 'true' ELSE '{{"assets": 0}}' END""".replace("{{", "{").replace("}}", "}")
_TYPE = "CASE WHEN o_orderkey % 8 < 4 THEN 'profile' WHEN o_orderkey % 8 = 6 AND o_custkey % 2 = 0 THEN 'giving_pledge' ELSE 'philanthropy' END"


@query("""WITH v AS (SELECT *, o_orderkey % 8 AS c, 1000000 + o_custkey * 10 AS p, (o_orderdate, o_orderkey) AS w FROM orders),
  g AS (SELECT o_custkey AS person, max(p) AS p, bool_or(c = 6 AND o_custkey % 2 = 0) AS pledge, bool_or(c = 0) AS own, arg_max(c, w) FILTER (WHERE c IN (4, 5)) AS last FROM v GROUP BY o_custkey)
  SELECT person, pledge, CAST(CASE WHEN last = 4 THEN 5.0 WHEN last = 5 THEN 2.5 ELSE 0 END AS DOUBLE) AS giving, CAST(CASE WHEN last = 4 THEN p + 1 WHEN last = 5 THEN p ELSE 0 END AS DOUBLE) AS held,
    CAST(CASE WHEN last = 4 THEN 3 ELSE 0 END AS INT) AS foundations, CAST(CASE WHEN own THEN p END AS DOUBLE) AS amount, CASE WHEN own THEN 'since 1990' END AS period, CASE WHEN own THEN 'x' END AS source,
    CAST(CASE WHEN own THEN nullif(person % 3, 0) END AS DOUBLE) AS annual FROM g""")
def philanthropy_reading(spark: SparkSession, d: str) -> DataFrame:
    """All that a person's facts say of giving, read by key whatever their order."""
    rows = table(spark, d, "orders")
    key = F.expr("CASE WHEN o_orderkey % 8 < 4 THEN 'total_giving' ELSE 'foundation' END")
    return registry.philanthropy(rows.select(F.col("o_custkey").alias("person"), key.alias("fact_key"), F.expr(_TYPE).alias("fact_type"), F.expr(_FACT).alias("value"), F.struct("o_orderdate", "o_orderkey").alias("stamp")))


_VERIFIED = """CASE c_custkey % 9 WHEN 0 THEN '{"employerVerifiedCount": 2, "count": 2}' WHEN 1 THEN '{"employerVerifiedCount": 2, "count": 1}' WHEN 2 THEN '{"employerVerifiedCount": "2"}' WHEN 3 THEN '{"employerVerifiedCount": 1.5}'
  WHEN 4 THEN '{"employerVerifiedCount": 0}' WHEN 5 THEN '{"employerVerifiedCount": 1, "count": "0"}' WHEN 6 THEN '{"count": 5}' WHEN 7 THEN '[1]' ELSE NULL END"""
_ENTRY = '{"section": "overview", "candidate": "c", "kept": "previous", "disagreements": [1, 2]}'
_ENTRIES = f"""CASE c_custkey % 7 WHEN 0 THEN '{{"entries": [{_ENTRY}, {_ENTRY}]}}' WHEN 1 THEN '{{"entries": []}}' WHEN 2 THEN '{{"entries": [{_ENTRY}, {_ENTRY.replace("previous", "kept")}]}}' WHEN 3 THEN '{{"entries": [{_ENTRY.replace("[1, 2]", "[]")}]}}'
  WHEN 4 THEN '{{"entries": [{_ENTRY.replace('"c"', "5")}]}}' WHEN 5 THEN '{{"entries": [{_ENTRY.replace("previous", "withheld")}]}}' ELSE 'not json' END"""


@query("SELECT c_custkey, c_custkey % 9 IN (0, 5) AS counts, CAST(CASE c_custkey % 7 WHEN 0 THEN 2 WHEN 5 THEN 1 END AS INT) AS entries, CASE c_custkey % 7 WHEN 0 THEN 'previous' WHEN 5 THEN 'withheld' END AS kept FROM customer")
def score_facts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a fact counts toward the score, and quarantine rows, read whole or not at all; every second one is encoded twice."""
    rows = table(spark, d, "customer").withColumn("said", F.expr(_ENTRIES))
    twice = F.concat(F.lit('"'), F.replace("said", F.lit('"'), F.lit('\\"')), F.lit('"'))
    entries = registry.quarantine_entries(F.when(F.col("c_custkey") % 2 == 0, twice).otherwise(F.col("said")))
    return rows.select("c_custkey", registry.counts_toward_score(F.expr(_VERIFIED)).alias("counts"), entries.alias("e")).select("c_custkey", "counts", F.when(F.col("e").isNotNull(), F.size("e")).alias("entries"), F.get("e", 0)["kept"].alias("kept"))


_FIRST = ["Bill", "William", "Rob", "Robert", "Ann", "Annabel", "Alex", "Kate", "Katherine", "Jo"]


def _named(key: str) -> tuple:
    """Name and birth year of a person by number: few first names and sixty surnames, so that many are alike."""
    k = F.col(key)
    last = F.concat(F.lit("Ves"), F.translate((k * 7 % 60).cast("string"), "0123456789", "abcdefghij"))
    end = F.when(k % 9 == 0, " Jr.").when(k % 11 == 0, " III").when(k % 13 == 0, " & family").otherwise("")
    first = F.element_at(F.array(*map(F.lit, _FIRST)), (k * 3 % len(_FIRST) + 1).cast("int"))
    return F.concat(first, F.when(k % 5 == 0, " Q. ").otherwise(" "), last, end).alias("name"), F.when(k % 4 > 0, 1930 + k * 13 % 40).cast("int").alias("born")


def seeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """People who are known, and people who arrive."""
    known = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("id"), *_named("s_suppkey"))
    return known, table(spark, d, "customer").select(F.col("c_custkey").alias("at"), *_named("c_custkey"))


@query()
def seeded_people(spark: SparkSession, d: str) -> DataFrame:
    """Customers who arrive one by one against suppliers who are known, each seeing who was inserted before. Sequential by nature; tests hold a plain loop."""
    checkpoint_folder(spark)
    return resolve.seeded(*seeds(spark, d))
