"""Next versions of tables: upserts, replacements, guarded deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import tables
from factloom.plans.base import query, table


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders split in a stored table and an arriving one, keyed by (customer, status)."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    return rows.where("o_orderkey % 3 <> 0"), rows.where("o_orderkey % 3 = 0")


_SPLIT = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_totalprice FROM orders WHERE o_orderkey % 3 = 0)"


@query(f"""WITH {_SPLIT}, b AS (SELECT *, 0 AS new FROM o UNION ALL SELECT *, 1 FROM n), m AS (SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM b GROUP BY 1),
  w AS (SELECT b.o_custkey, b.o_orderdate, max(new) AS new FROM b JOIN m ON b.o_custkey = m.o_custkey AND b.o_orderdate = m.o_orderdate GROUP BY 1, 2)
  SELECT o_custkey, o_orderdate, new = 1 AS fresh FROM w""")
def upsert_keep_newest(spark: SparkSession, d: str) -> DataFrame:
    """Stored and arriving rows by customer: the newest stays, an arriving one wins a tie."""
    old, new = _old_new(spark, d)
    kept = tables.upsert_newest(old, new, ["o_custkey"], "o_orderdate")
    return kept.select("o_custkey", "o_orderdate", (F.col("o_orderkey") % 3 == 0).alias("fresh"))


@query(f"WITH {_SPLIT}, s AS (SELECT o_custkey, max(o_orderdate) AS seen FROM o GROUP BY 1) SELECT o_orderkey, n.o_custkey, o_orderdate FROM n JOIN s ON n.o_custkey = s.o_custkey WHERE o_orderdate < seen")
def late_writes(spark: SparkSession, d: str) -> DataFrame:
    """Arriving rows that a stored later one shuts out."""
    old, new = _old_new(spark, d)
    return tables.superseded(old, new, ["o_custkey"], "o_orderdate").select("o_orderkey", "o_custkey", "o_orderdate")


@query(f"WITH {_SPLIT} SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n WHERE o_orderstatus = 'P') UNION ALL SELECT * FROM n WHERE o_orderstatus = 'P'")
def replace_by_key(spark: SparkSession, d: str) -> DataFrame:
    """All stored rows of a customer go when new ones of one status come."""
    old, new = _old_new(spark, d)
    return tables.replace_keys(old, new.where("o_orderstatus = 'P'"), ["o_custkey"])


@query(f"WITH {_SPLIT} SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n WHERE o_orderdate >= TIMESTAMP '2001-01-01')")
def self_heal(spark: SparkSession, d: str) -> DataFrame:
    """Keys that were asked for again and gave nothing lose their stored rows."""
    old, new = _old_new(spark, d)
    return tables.replace_keys(old, new.where("false"), ["o_custkey"], attempted=new.where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01 00:00:00'"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_custkey", "c_name")
    return tables.insert_absent(people.where("c_custkey % 2 = 0"), people.where("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0""")
def upsert_overwrite(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_custkey", "c_name")
    return tables.upsert(people.where("c_custkey % 2 = 0"), people.where("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_targeted(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the people a run is pinned to."""
    wanted = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(wanted, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')")
def anti_fresh(spark: SparkSession, d: str) -> DataFrame:
    """People that nothing was fetched for since a date."""
    fresh = table(spark, d, "orders").where("o_orderdate >= TIMESTAMP_NTZ '2001-01-01 00:00:00'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(fresh, "c_custkey", "left_anti")


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM lineitem WHERE NOT (l_quantity < 10 AND l_returnflag IS DISTINCT FROM 'R')""")
def guarded_delete(spark: SparkSession, d: str) -> DataFrame:
    """Small lines go unless their flag protects them."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return tables.delete_where(rows, F.col("l_quantity") < 10, F.col("l_returnflag").eqNullSafe(F.lit("R")))


@query("""SELECT p_partkey, p_name, coalesce(up, 0) AS upvotes, coalesce(down, 0) AS downvotes FROM part LEFT JOIN
  (SELECT l_partkey, count(*) FILTER (WHERE l_discount < 0.05) AS up, count(*) FILTER (WHERE l_discount > 0.05) AS down FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def recount_votes(spark: SparkSession, d: str) -> DataFrame:
    """Vote counters written back from the vote edges."""
    direction = F.when(F.col("l_discount") < 0.05, 1).when(F.col("l_discount") > 0.05, -1).otherwise(0)
    edges = table(spark, d, "lineitem").select("l_partkey", direction.alias("direction"))
    return tables.recount(table(spark, d, "part").select("p_partkey", "p_name"), edges, "l_partkey", "p_partkey").select("p_partkey", "p_name", "upvotes", "downvotes")


@query("""WITH x AS (SELECT c_custkey, c_nationkey AS stored, CASE WHEN c_custkey % 7 = 0 THEN (c_nationkey + 1) % 25 WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS told, c_custkey % 2 = 0 AS there FROM customer)
  SELECT c_custkey, CASE WHEN there AND stored IS DISTINCT FROM told THEN told ELSE stored END AS c_nationkey, there AND stored IS DISTINCT FROM told AS changed FROM x""")
def update_when_changed(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    told = F.when(F.col("c_custkey") % 7 == 0, ((F.col("c_nationkey") + 1) % 25).cast("int")).when(F.col("c_custkey") % 5 == 0, F.lit(None).cast("int")).otherwise(F.col("c_nationkey"))
    return tables.update_changed(people, people.where("c_custkey % 2 = 0").withColumn("c_nationkey", told), ["c_custkey"], "c_nationkey")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS brand FROM part)
  SELECT p_partkey, coalesce(brand, CASE WHEN p_partkey % 2 = 0 THEN 'filled' END) AS brand FROM p""")
def fill_if_missing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 != 0, F.col("p_brand")).alias("brand"))
    new = table(spark, d, "part").where("p_partkey % 2 = 0").select("p_partkey", F.lit("filled").alias("brand"))
    return tables.fill_missing(rows, new, ["p_partkey"], ["brand"])
