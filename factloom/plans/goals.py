"""Goals and the people who could reach them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import goals
from factloom.plans.base import query, table

#: Expressions in a goal's text, and what they mean.
PLACES = {f"\\bnation_{n}\\b": f"NATION_{n}" for n in range(25)}
FIELDS = {"hous|homes": "BUILDING", "cars?\\b": "AUTOMOBILE", "tools|plant": "MACHINERY", "chairs|homes": "FURNITURE", "home\\b": "HOUSEHOLD"}
_TEXT = "concat('For ', {pick}, ' in nation_', CAST(s_nationkey AS VARCHAR(3)), ' and nation_', CAST((s_nationkey * 3) % 25 AS VARCHAR(3)))"
_WANTS = ("homes", "cars", "tools and chairs", "a home", "music")


def _case() -> str:
    return "CASE s_suppkey % 5 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WANTS)) + " END"


def _sql_list(text: str, keywords: dict[str, str]) -> str:
    return "list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{k}') THEN '{v}' END" for k, v in keywords.items()) + "], lambda x: x IS NOT NULL))"


_GOAL = _TEXT.format(pick=_case())


@query(f"""WITH g AS (SELECT s_suppkey AS goal, {_GOAL} AS t FROM supplier), goal AS (SELECT goal, {_sql_list('t', PLACES)} AS places, {_sql_list('t', FIELDS)} AS fields FROM g),
  p AS (SELECT c_custkey AS person, n_name AS place, c_mktsegment AS field, c_acctbal / 1000 AS billions FROM customer JOIN nation ON n_nationkey = c_nationkey),
  m AS (SELECT goal, person, 2 * CAST(list_contains(places, place) AS INT) + CAST(list_contains(fields, field) AS INT) + CAST(billions >= 9.5 AS INT) AS points, billions FROM goal CROSS JOIN p),
  r AS (SELECT goal, person, CAST(points AS INT) AS points, row_number() OVER (PARTITION BY goal ORDER BY points DESC, billions DESC, person) AS place FROM m WHERE points > 0)
  SELECT goal, person, points, place FROM r WHERE place <= 12""")
def goal_people(spark: SparkSession, d: str) -> DataFrame:
    """Twelve best people for every goal, by the places and fields that its text means, and by means."""
    text = F.expr(_GOAL)
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("goal"), goals.meant(text, PLACES).alias("places"), goals.meant(text, FIELDS).alias("fields"))
    people = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    people = people.select(
        F.col("c_custkey").alias("person"), F.col("n_name").alias("place"), F.array("c_mktsegment").alias("fields"), (F.col("c_acctbal") / 1000).alias("billions"), F.lit(None).cast("double").alias("score")
    )
    return goals.matches(asked, people, means=9.5)
