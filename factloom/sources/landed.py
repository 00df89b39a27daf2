"""Sources: answers of web services and pages that were landed as files, literal tables, pins and run counters.

Nothing here calls the network; files are read by Spark, so that any store it knows will do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sparql_bindings(spark: SparkSession, path: str, variables: Sequence[str], key: str | None = None) -> DataFrame:
    """One row per binding of landed SPARQL answers, a string column per variable; with ``key`` the first row of each
    file order only."""
    binding = ", ".join(f"`{v}`: struct<value: string>" for v in variables)
    rows = spark.read.schema(f"results struct<bindings: array<struct<{binding}>>>").json(path, multiLine=True)
    rows = rows.select(F.input_file_name().alias("_file"), F.posexplode("results.bindings").alias("_pos", "b"))
    out = rows.select("_file", "_pos", *[F.col(f"b.`{v}`.value").alias(v) for v in variables])
    if key is not None:
        first = F.row_number().over(Window.partitionBy(key).orderBy("_file", "_pos"))
        out = out.withColumn("_n", first).where("_n = 1")
    return out.select(*variables)


def rest_results(spark: SparkSession, path: str, field: str, item: str) -> DataFrame:
    """One row per element of the array ``field`` in landed JSON answers, with the columns of the struct type ``item``."""
    rows = spark.read.schema(f"`{field}` array<{item}>").json(path, multiLine=True)
    return rows.select(F.explode(field).alias("item")).select("item.*")


def _whole(json: Column, path: str) -> Column:
    """A whole number inside JSON that is written as one; null for anything else, numbers in quotes included."""
    kind = F.schema_of_variant(F.try_variant_get(json, path, "variant"))
    value = F.try_variant_get(json, path, "double")
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (value == F.floor(value)), value)


def classify_response(status: Column, body: Column, field: str, total: str = "total_results") -> Column:
    """answer, empty, or failed. Only a search answer counts: an object with a whole number of results and a list of them, and without an
    error, whatever the status says. It is empty if the list is and the number too, by a 200 or a 404; a list comes by a 200 only."""
    json = F.try_parse_json(body)
    n, said = F.size(F.try_variant_get(json, f"$.{field}", "array<variant>")), _whole(json, f"$.{total}")
    shaped = F.try_variant_get(json, "$.error", "variant").isNull() & said.isNotNull() & (n >= 0) & status.isin(200, 404)
    told = F.when((n == 0) & (said == 0), "empty").when((n > 0) & (status == 200), "answer").otherwise("failed")
    return F.when(F.coalesce(shaped, F.lit(False)), told).otherwise("failed")


def classify_filings(status: Column, body: Column, field: str = "filings_with_data", year: str = "tax_prd_yr") -> Column:
    """answer or failed: a list of filings by a 200, without an error, each with a whole year. An empty list is an answer; a missing one is not."""
    json = F.try_parse_json(body)
    filings = F.try_variant_get(json, f"$.{field}", "array<variant>")
    good = F.forall(filings, lambda f: _whole(f, f"$.{year}").isNotNull())
    return F.when(F.coalesce((status == 200) & F.try_variant_get(json, "$.error", "variant").isNull() & good, F.lit(False)), "answer").otherwise("failed")


def zipped(arrays: Sequence[str]) -> Column:
    """Parallel arrays as one array of structs."""
    return F.arrays_zip(*[F.col(a).alias(a.split(".")[-1]) for a in arrays])


def filings(forms: str, others: Sequence[str], wanted: Sequence[str], keep: int = 10) -> tuple[Column, Column]:
    """Number of filings of the wanted forms, and the first ``keep`` of them, from parallel arrays."""
    found = F.filter(zipped([forms, *others]), lambda x: x[forms.split(".")[-1]].isin(*wanted))
    return F.size(found), F.slice(found, 1, keep)


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, href, label): links of every page, each target once, where it comes first."""
    shape = r'(?s)<a href="([^"]*)">([^<]*)</a>'
    both = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(shape), F.lit(1)).alias("href"), F.regexp_extract_all(html_col, F.lit(shape), F.lit(2)).alias("label"))
    rows = pages.select(id_col, F.posexplode(both).alias("pos", "x")).select(id_col, "pos", "x.href", "x.label")
    return rows.groupBy(id_col, "href").agg(F.min(F.struct("pos", "label")).alias("first")).select(id_col, F.col("first.pos").alias("pos"), "href", F.col("first.label").alias("label"))


def paged(pages: DataFrame, source: str, number: str, items: str, key: str, most: int = 40) -> DataFrame:
    """(source, number, pos, and the fields of the items): a source's pages read in order, as far as its first page without items or the
    first that isn't there, ``most`` at the furthest, and of items with one ``key`` the first. ``items`` is an array of structs, null for a page that failed.

    Pages are read all at once; where a source ends comes from one count a page, so that no task goes through a source page by page."""
    rows = pages.select(F.col(source).alias("_source"), F.col(number).cast("long").alias("_number"), F.col(items).alias("_items")).where(F.col("_number").between(1, most))
    full = rows.groupBy("_source", "_number").agg(F.max(F.coalesce(F.size("_items"), F.lit(0))).alias("_n")).where("_n > 0")
    # Full pages 1, 2, 3 ... have as many full pages up to them as their number says; behind a gap there are fewer.
    seen = full.groupBy("_source").agg(F.array_sort(F.collect_set("_number")).alias("_seen"))
    ends = seen.select("_source", F.aggregate("_seen", F.lit(0).cast("long"), lambda end, x: F.when(x == end + 1, x).otherwise(end)).alias("_end"))
    ends = ends.withColumnRenamed("_source", "_of")
    read = rows.join(ends, F.col("_source").eqNullSafe(F.col("_of"))).where("_number <= _end")
    each = read.select("_source", "_number", F.posexplode("_items").alias("_pos", "_item"))
    first = each.groupBy("_source", F.col(f"_item.{key}").alias("_key")).agg(F.min(F.struct("_number", "_pos", "_item")).alias("_first"))
    return first.select(F.col("_source").alias(source), F.col("_first._number").cast("int").alias(number), F.col("_first._pos").alias("pos"), "_first._item.*")


def head(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, lang, title) from the head of a page; null where missing."""
    lang = F.nullif(F.regexp_extract(html_col, r'(?i)<html[^>]*\slang="([^"]*)"', 1), F.lit(""))
    title = F.nullif(F.trim(F.regexp_extract(html_col, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return pages.select(id_col, lang.alias("lang"), title.alias("title"))


def pinned(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the ids a run is pinned to; refuses an empty list and ids that are not there."""
    wanted = ids.select(key).distinct()
    asked, found = wanted.count(), df.select(key).distinct().join(wanted, key, "left_semi").count()
    if not asked or found != asked:
        raise ValueError(f"{asked} ids asked for, {found} found")
    return df.join(wanted, key, "left_semi")


def run_count(spark: SparkSession, path: str) -> int:
    """The run counter of a one-row state table; 0 before the first run."""
    try:
        row = spark.read.schema("run int").json(path).agg(F.max("run")).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return 0
    return row[0] or 0


def save_run_count(spark: SparkSession, path: str, run: int) -> None:
    spark.createDataFrame([(run,)], "run int").coalesce(1).write.mode("append").json(path)


def dimension(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(list(rows), schema)
