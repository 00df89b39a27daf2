"""Titles, pages and prose: signatures, similarity, word lists, hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import money, numeric, text
from factloom.operators import similarity
from factloom.plans.base import checkpoint_folder, query, table
from factloom.sources import landed

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_SIGNATURE = f"list_distinct(list_filter(string_split(regexp_replace(lower({{0}}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= 4 AND w NOT IN ({_STOP})))"

#: Words of the corpus, with points; and kinds with their words.
LEXICON = {"pathetic": 4, "worthless": 3, "password": -2, "license": -2, "with": 1}
KINDS = {"rights": ("license", "licensed", "reserved"), "tone": ("pathetic", "worthless"), "common": ("with", "that")}


@query(f"SELECT doc_id, CAST(len(s) AS INT) AS n_tokens, md5(array_to_string(list_sort(s), ' ')) AS digest FROM (SELECT doc_id, {_SIGNATURE.format('text')} AS s FROM documents)")
def event_signature(spark: SparkSession, d: str) -> DataFrame:
    """Size and digest of every document's token set."""
    rows = table(spark, d, "documents").select("doc_id", text.event_signature(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("n_tokens"), F.md5(F.array_join(F.array_sort("s"), " ").cast("binary")).alias("digest"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    """(key, tokens): distinct token sets of part titles, each named by its least part."""
    title = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    rows = table(spark, d, "part").select("p_partkey", F.array_sort(text.event_signature(title)).alias("tokens"))
    return rows.groupBy("tokens").agg(F.min("p_partkey").alias("key")).select("key", "tokens")


_TITLES = f"t AS (SELECT min(p_partkey) AS key, tokens FROM (SELECT p_partkey, list_sort({_SIGNATURE.format('concat_ws(chr(32), p_name, p_brand, p_type)')}) AS tokens FROM part) GROUP BY tokens)"
_JACCARD = "len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens)))"


@query(f"WITH {_TITLES} SELECT a.key AS a, b.key AS b, {_JACCARD} AS score FROM t a JOIN t b ON a.key < b.key WHERE len(a.tokens) > 0 AND len(b.tokens) > 0 AND {_JACCARD} >= 0.5")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different titles with half their tokens in common."""
    return similarity.similar_pairs(titles(spark, d), 0.5)


@query(f"""WITH {_TITLES}, x AS (SELECT a.key AS left_key, b.key AS right_key, {_JACCARD} AS score FROM t a JOIN t b ON a.key % 2 = 0 AND b.key % 2 = 1 WHERE {_JACCARD} >= 0.25),
  r AS (SELECT *, row_number() OVER (PARTITION BY left_key ORDER BY score DESC, right_key) AS place FROM x) SELECT left_key, right_key, score FROM r WHERE place = 1""")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    """The nearest odd title of every even one."""
    rows = titles(spark, d)
    return similarity.best_match(rows.where("key % 2 = 0"), rows.where("key % 2 = 1"), 0.25)


@query()
def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Titles that stay when each, by key, shuts out later ones like it. Sequential by nature; tests hold a plain loop."""
    checkpoint_folder(spark)
    rows = titles(spark, d).checkpoint()
    return similarity.greedy_select(rows.select("key", F.col("key").alias("rank")), similarity.similar_pairs(rows, 0.5))


@query(f"""WITH RECURSIVE {_TITLES}, e AS (SELECT a.key AS a, b.key AS b FROM t a JOIN t b ON a.key <> b.key WHERE {_JACCARD} >= 0.6),
  c(key, cluster) AS (SELECT key, key FROM t UNION SELECT e.b, c.cluster FROM c JOIN e ON e.a = c.key)
  SELECT key, min(cluster) AS cluster FROM c GROUP BY key""")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    checkpoint_folder(spark)
    rows = titles(spark, d).checkpoint()
    return similarity.connected(rows.select("key"), similarity.similar_pairs(rows, 0.6))


def _has(column: str, word: str) -> str:
    return f"CAST(regexp_matches(lower({column}), '(^|[^a-z0-9]){word}($|[^a-z0-9])') AS INT)"


@query("SELECT doc_id, CAST(" + " + ".join(f"{p} * {_has('text', w)}" for w, p in LEXICON.items()) + " AS INT) AS points FROM documents")
def lexicon_score(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.select("doc_id", text.lexicon_points(F.lit(None).cast("string"), F.col("text"), LEXICON).cast("int").alias("points"))


_HITS = {k: " + ".join(_has("text", w) for w in words) for k, words in KINDS.items()}


@query(
    "WITH h AS (SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in _HITS.items()) + " FROM documents), m AS (SELECT *, greatest(" + ", ".join(_HITS) + ") AS most FROM h) "
    "SELECT doc_id, CASE WHEN most = 0 THEN NULL " + " ".join(f"WHEN {k} = most THEN '{k}'" for k in _HITS) + " END AS kind FROM m"
)
def kind_argmax(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.kind(F.col("text"), KINDS).alias("kind"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.url_host(F.col("url")).alias("host"))


@query(r"""WITH t AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f]+', ' ', 'g'), ' ') AS t FROM pages)
  SELECT page_id, CASE WHEN length(t) >= 100 THEN substr(t, 1, 800) END AS snippet FROM t""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.html_text(F.col("html")).alias("snippet"))


@query(r"""SELECT page_id, nullif(regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1), '') AS lang, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages""")
def page_heads(spark: SparkSession, d: str) -> DataFrame:
    return landed.head(table(spark, d, "pages"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?s)<a href="([^"]*)">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '(?s)<a href="([^"]*)">([^<]*)</a>', 2) AS t FROM pages),
  x AS (SELECT page_id, unnest(range(len(h))) AS pos, h, t FROM l), y AS (SELECT page_id, pos, h[pos + 1] AS href, t[pos + 1] AS label FROM x)
  SELECT page_id, CAST(min(pos) AS INT) AS pos, href, arg_min(label, pos) AS label FROM y GROUP BY page_id, href""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of every page, each target once."""
    return landed.links(table(spark, d, "pages"))


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)")
def facets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN round(o_totalprice / 1000, 0) * 1000000 ELSE round(o_totalprice, 0) END AS amount,
  CASE WHEN o_totalprice >= 100000 THEN CASE WHEN round(o_totalprice / 1000, 0) * 1000000 >= 100e6 THEN 3 ELSE 2 END
       WHEN round(o_totalprice, 0) >= 1e6 THEN 1 ELSE -3 END AS points FROM orders""")
def money_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written into headlines and read out again, with what they count for."""
    price = F.col("o_totalprice")
    large = F.concat(F.lit("Gift of $"), F.round(price / 1000, 0).cast("long").cast("string"), F.lit(" million, of which $5 were fees"))
    small = F.concat(F.lit("A fee of $"), F.round(price, 0).cast("long").cast("string"), F.lit(" was paid"))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(price >= 100000, large).otherwise(small).alias("headline"))
    return rows.select("o_orderkey", money.largest_amount(F.col("headline")).alias("amount"), money.money_points(F.col("headline"), F.lit(True)).alias("points"))


@query("""SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal / 5000 * 100 END AS percent, s_acctbal >= 10 * 500 AS dominates,
  s_acctbal / greatest(1, 2026 - (2000 + s_suppkey % 30)) AS yearly FROM supplier""")
def giving_figures(spark: SparkSession, d: str) -> DataFrame:
    """Ratio, dominance and yearly figures; what cannot be stated is null."""
    balance = F.col("s_acctbal")
    return table(spark, d, "supplier").select(
        "s_suppkey",
        numeric.giving_ratio(F.lit(5000.0), balance).alias("percent"),
        numeric.dominates(balance, F.lit(500.0)).alias("dominates"),
        numeric.annualised(balance, (2000 + F.col("s_suppkey") % 30), F.lit(None).cast("double"), 2026).alias("yearly"),
    )
