"""Rounds over sources: pages read to their end, who is due under a budget, totals of what was found, and what is served against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import audit, ranking, totals
from factloom.plans.base import checkpoint_folder, query, table
from factloom.sources import landed

_LINK = r'(?s)<a href="([^"]*)">([^<]*)</a>'
_EMPTY = "page_id % 31 = 17 OR page_id % 97 = 3"


@query(rf"""WITH p AS (SELECT page_id // 50 AS source, page_id % 50 + 1 AS page, CASE WHEN {_EMPTY} THEN [] ELSE regexp_extract_all(html, '{_LINK}', 1) END AS h, CASE WHEN {_EMPTY} THEN [] ELSE regexp_extract_all(html, '{_LINK}', 2) END AS t
    FROM pages WHERE page_id % 50 < 40 AND page_id % 101 <> 60),
  e AS (SELECT DISTINCT source, (SELECT min(n) FROM range(1, 42) r(n) WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.source = p.source AND q.page = n AND len(q.h) > 0)) AS stop FROM p),
  i AS (SELECT source, page, unnest(range(len(h))) AS pos, h, t FROM p JOIN e USING (source) WHERE page < stop), x AS (SELECT source, page, pos, h[pos + 1] AS href, t[pos + 1] AS label FROM i)
  SELECT source, CAST(page AS INT) AS page, CAST(pos AS INT) AS pos, href, label FROM x QUALIFY row_number() OVER (PARTITION BY source, href ORDER BY page, pos) = 1""")
def paged_links(spark: SparkSession, d: str) -> DataFrame:
    """Fifty pages a source: each source is read up to its first page without items or that is missing, forty at most; each target once."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(_LINK), F.lit(2)).alias("label"))
    rows = table(spark, d, "pages").where("page_id % 101 <> 60")
    rows = rows.select(F.floor(F.col("page_id") / 50).alias("source"), (F.col("page_id") % 50 + 1).alias("page"), F.when(~F.expr(_EMPTY), both).alias("items"))
    return landed.paged(rows, "source", "page", "items", "href")


@query("""WITH c AS (SELECT c_custkey, c_name, c_custkey % 50 + 1 AS cost, max(o_orderdate) AS tried FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
  s AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY tried NULLS FIRST, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c)
  SELECT c_custkey, CAST(spent AS DOUBLE) AS spent, spent <= 1000 AS runs FROM s""")
def rotation(spark: SparkSession, d: str) -> DataFrame:
    """Who runs when those longest untried come first and a budget ends the round; the rest is what is left for the next one."""
    checkpoint_folder(spark)
    tried = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("tried"))
    rows = table(spark, d, "customer").select("c_custkey").join(tried, "c_custkey", "left")
    due = ranking.under_budget(rows, [F.asc_nulls_first("tried"), F.asc("c_custkey")], (F.col("c_custkey") % 50 + 1).cast("double"), 1000.0)
    return due.select("c_custkey", "spent", "runs")


@query("""WITH v AS (SELECT *, CASE WHEN l_linenumber = 6 THEN 'Unknown' ELSE l_returnflag END AS party, CASE WHEN l_linenumber < 7 THEN l_linestatus END AS form FROM lineitem),
  p AS (SELECT l_suppkey, party, sum(CASE WHEN l_linenumber <> 5 THEN l_extendedprice ELSE 0 END) AS a FROM v GROUP BY ALL), f AS (SELECT l_suppkey, form, count(*) AS n FROM v WHERE form IS NOT NULL GROUP BY ALL),
  w AS (SELECT l_suppkey, round(sum(CASE WHEN l_linenumber <> 5 THEN l_extendedprice ELSE 0 END), 2) AS total, count(*) AS n, strftime(min(l_shipdate), '%Y-%m-%d') || ' to ' || strftime(max(l_shipdate), '%Y-%m-%d') AS span FROM v GROUP BY ALL)
  SELECT l_suppkey, total, n, span, (SELECT string_agg(party || '=' || CAST(CAST(round(a) AS BIGINT) AS VARCHAR), ';' ORDER BY party) FROM p WHERE p.l_suppkey = w.l_suppkey) AS parties,
    coalesce((SELECT string_agg(form || '=' || CAST(f.n AS VARCHAR), ';' ORDER BY form) FROM f WHERE f.l_suppkey = w.l_suppkey), '') AS forms FROM w""")
def contribution_totals(spark: SparkSession, d: str) -> DataFrame:
    """Total, sums by party, forms with their hits, and the span of days of every supplier, in one pass. Prices have cents: as decimals
    their sums are exact in any order, also where a sum ends in half a dollar, which is rounded up."""
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        "l_suppkey", F.when(line != 5, F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"), F.when(line != 6, F.col("l_returnflag")).alias("party"), F.when(line < 7, F.col("l_linestatus")).alias("form"), F.to_date("l_shipdate").alias("day"),
    )
    told = totals.summary(rows, "l_suppkey", "amount", "party", "form", "day")

    def said(column: str, whole: bool = False):
        value = (lambda e: F.round(e["value"]).cast("long")) if whole else (lambda e: e["value"])
        return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], value(e).cast("string"))), ";").alias(column)

    return told.select("l_suppkey", F.round("total", 2).alias("total"), "n", "span", said("parties", True), said("forms"))


_STORED_LANG = "nullif(regexp_extract(url, '://[^/?#]*/([a-z]+)/', 1), '')"


@query(rf"""WITH served AS (SELECT page_id, nullif(regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1), '') AS lang, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages WHERE page_id % 23 <> 5),
  stored AS (SELECT page_id, CASE WHEN page_id % 40 = 7 THEN 'xx' ELSE {_STORED_LANG} END AS lang, CASE WHEN page_id % 60 = 9 THEN NULL WHEN page_id % 40 = 7 AND page_id % 3 = 0 THEN 'other' ELSE nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') END AS title
    FROM pages WHERE page_id % 29 <> 4),
  b AS (SELECT coalesce(s.page_id, t.page_id) AS page_id, s.page_id IS NULL AS no_row, t.page_id IS NULL AS no_page, s.lang IS DISTINCT FROM t.lang AS l, s.title IS DISTINCT FROM t.title AS t FROM stored s FULL JOIN served t ON s.page_id = t.page_id)
  SELECT page_id, CASE WHEN page_id % 37 = 6 AND NOT no_row THEN 'ambiguous' WHEN no_page THEN 'not served' WHEN no_row THEN 'not stored' WHEN l OR t THEN 'differs' ELSE 'agrees' END AS verdict,
    CASE WHEN NOT (page_id % 37 = 6 AND NOT no_row) AND NOT no_page AND NOT no_row THEN concat_ws(',', CASE WHEN l THEN 'lang' END, CASE WHEN t THEN 'title' END) ELSE '' END AS fields FROM b""")
def served_audit(spark: SparkSession, d: str) -> DataFrame:
    """What the pages say of themselves against a table of them in which some rows are missing, doubled or wrong."""
    pages, k = table(spark, d, "pages"), F.col("page_id")
    served = landed.head(pages.where("page_id % 23 <> 5"))
    right = landed.head(pages).withColumnRenamed("lang", "page_lang").join(pages.select("page_id", F.expr(_STORED_LANG).alias("lang")), "page_id").where("page_id % 29 <> 4")
    title = F.when(k % 60 == 9, F.lit(None)).when((k % 40 == 7) & (k % 3 == 0), "other").otherwise(F.col("title"))
    stored = right.select("page_id", F.when(k % 40 == 7, "xx").otherwise(F.col("lang")).alias("lang"), title.alias("title"))
    told = audit.compared(stored.unionByName(stored.where("page_id % 37 = 6")), served, "page_id", ["lang", "title"])
    return told.select("page_id", "verdict", F.array_join("fields", ",").alias("fields"))
