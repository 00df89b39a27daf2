"""Cards of a feed, scored: built from parts, so that every entry of the word lists occurs in some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import feed_scores, fixed
from factloom.plans.base import query, table

_TOPICS = [t for _, terms in fixed.SIGNALS.values() for t in terms]
_HEADS = [*_TOPICS, *fixed.NOISE, *fixed.TENSION, *fixed.HEDGES, "$WXYZ", "calm"]
_MARKS = ["", "", "reportedly", "rumoured", "rumors", "a report says", "reports say", "according to reports", "reported", "reporter"]
_SITES = [*fixed.AGGREGATORS, *fixed.LOW_CREDIBILITY, "example.org", "nodigg.com", "iheart.com"]
_NAMES = [*fixed.NO_SOURCE, *fixed.AGGREGATORS[:3], "Www.Zerohedge.com", "The Daily Example", "", None]


def _pick(values: list[str | None], at: str, spark: bool) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    place = f"CAST(({at}) % {len(values)} AS INT) + 1"
    return f"element_at(array({listed}), {place})" if spark else f"([{listed}])[{place}]"


def _cards_sql(spark: bool) -> str:
    """The cards, in the words of either engine; only lists and days are said differently."""
    day = "make_interval(0, 0, 0, CAST(p_partkey % 41 AS INT))" if spark else "to_days(CAST(p_partkey % 41 AS INT))"
    pick = lambda values, at: _pick(values, at, spark)
    report = "CASE WHEN p_partkey % 37 = 0 THEN 'Report: ' ELSE '' END"
    money = "CASE WHEN p_partkey % 3 = 0 THEN concat(' $', CAST(p_partkey % 997 + 1 AS VARCHAR(9)), ' ', " + pick(["", "thousand", "million", "billion", "K", "bn"], "p_partkey") + ") ELSE '' END"
    return (
        f"SELECT p_partkey AS card, concat({report}, 'The ', {pick(_HEADS, 'p_partkey')}, ', ', {pick(_MARKS, 'p_partkey')}, ' ', {pick(_HEADS, 'p_partkey * 7 + 3')}, {money}, '.') AS headline, "
        f"CASE WHEN p_partkey % 5 > 0 THEN concat(p_name, ' and ', {pick(_HEADS, 'p_partkey * 11 + 5')}, '-', {pick(_HEADS, 'p_partkey * 13 + 1')}) END AS summary, "
        f"{pick(_NAMES, 'p_partkey')} AS source, CASE WHEN p_partkey % 29 > 0 THEN concat('https://www.', {pick(_SITES, 'p_partkey')}, '/p/', CAST(p_partkey AS VARCHAR(20))) END AS url, "
        f"CASE WHEN p_partkey % 7 > 0 THEN TIMESTAMP '2024-03-01 00:00:00' - {day} END AS created, TIMESTAMP '2024-02-20 00:00:00' AS published FROM part"
    )


_CARDS = f"cards AS ({_cards_sql(False)})"


def cards(spark: SparkSession, d: str) -> DataFrame:
    """(card, headline, summary, source, url, created, published), one card a part. Parts are few bytes and much work each: their file
    would be one task, so they are dealt out first."""
    part = table(spark, d, "part").select("p_partkey", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return spark.sql(_cards_sql(True).replace("FROM part", "FROM {part}"), part=part)


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def _weighed(title: str, body: str, patterns: list[str], high: int, low: int) -> str:
    return " + ".join(f"CASE WHEN {_has(title, p)} THEN {high} WHEN {_has(body, p)} THEN {low} ELSE 0 END" for p in patterns)


_H, _S = "coalesce(headline, '')", "coalesce(summary, '')"
_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9$]+', ' ', 'g'))"
_NOISE = [*[feed_scores.beginning(feed_scores.plain_term(t)) for t in fixed.NOISE], feed_scores.TICKER]
_ACCOUNT = (
    "(" + " + ".join(_weighed(_H, _S, [feed_scores.beginning(t) for t in terms], 2 * w, w) for w, terms in fixed.SIGNALS.values())
    + ") - (" + _weighed(_PLAIN.format(_H), _PLAIN.format(_S), _NOISE, 4, 2) + ")"
)
_TENSE = [feed_scores.beginning(t) for t in fixed.TENSION]
_PULL = (
    f"3 * least({' + '.join(f'CAST({_has(_H, p)} AS INT)' for p in _TENSE)}, 3) + least("
    + " + ".join(f"CAST(NOT {_has(_H, p)} AND {_has(_S, p)} AS INT)" for p in _TENSE) + ", 3)"
)
_HEDGED = f"4 * least({' + '.join(f'CAST({_has(_H, feed_scores.beginning(t))} AS INT)' for t in fixed.HEDGES)}, 2)"
_HOST = "coalesce(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', ''), '')"


def _below(column: str, domains: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{column} = '{x}' OR {column} LIKE '%.{x}'" for x in domains) + ")"


_STORED = "lower(trim(coalesce(source, '')))"
_QUALITY = (
    f"CASE WHEN {_below(_STORED, fixed.AGGREGATORS)} OR {_below(_HOST, fixed.AGGREGATORS)} THEN -4 ELSE 0 END"
    f" + CASE WHEN {_below(_STORED, fixed.LOW_CREDIBILITY)} OR {_below(_HOST, fixed.LOW_CREDIBILITY)} THEN -10 ELSE 0 END"
)


@query(f"WITH {_CARDS} SELECT card, CAST({_ACCOUNT} AS INT) AS points FROM cards")
def accountability(spark: SparkSession, d: str) -> DataFrame:
    """How much every card is on topic."""
    return cards(spark, d).select("card", feed_scores.accountability(F.col("headline"), F.col("summary")).cast("int").alias("points"))


def _kind_sql(column: str) -> str:
    sums = {k: "(" + " + ".join(f"{w} * CAST({_has(column, feed_scores.beginning(t))} AS INT)" for t in terms) + ")" for k, (w, terms) in fixed.SIGNALS.items()}
    most = f"greatest({', '.join(sums.values())})"
    return f"CASE WHEN {most} = 0 THEN NULL " + " ".join(f"WHEN {s} = {most} THEN '{k}'" for k, s in sums.items()) + " END"


_KINDS = f"kinds AS (SELECT card, coalesce({_kind_sql(_H)}, {_kind_sql(_S)}) AS kind FROM cards)"


@query(f"WITH {_CARDS}, {_KINDS} SELECT card, kind FROM kinds")
def candidate_kind(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("card", feed_scores.candidate_kind(F.col("headline"), F.col("summary")).alias("kind"))


@query(f"""WITH {_CARDS}, {_KINDS}, names AS (SELECT unnest(['giving', 'political', 'wealth', 'power', 'unclassified']) AS kind)
  SELECT names.kind AS kind, count(kinds.card) AS n FROM names LEFT JOIN kinds ON names.kind = coalesce(kinds.kind, 'unclassified') GROUP BY names.kind""")
def kind_mix(spark: SparkSession, d: str) -> DataFrame:
    """Cards of each kind; the parts sum to all cards."""
    return feed_scores.kind_mix(candidate_kind(spark, d))


@query(f"""WITH {_CARDS}, sums AS (SELECT card, regexp_extract_all(headline, '(?i){fixed.HEADLINE_SUM}', 1) AS n, regexp_extract_all(headline, '(?i){fixed.HEADLINE_SUM}', 2) AS u FROM cards),
  each AS (SELECT card, unnest(n) AS n, lower(unnest(u)) AS u FROM sums),
  most AS (SELECT card, max(CAST(replace(n, ',', '') AS DOUBLE) * CASE WHEN u IN ('trillion', 't') THEN 1e12 WHEN u IN ('billion', 'b') THEN 1e9 WHEN u IN ('million', 'm') THEN 1e6 WHEN u IN ('thousand', 'k') THEN 1e3 ELSE 1 END) AS most FROM each GROUP BY card),
  parts AS (SELECT card, floor(({_ACCOUNT}) * 0.5 + 0.5) AS topic, {_PULL} AS pull, {_HEDGED} AS hedge, {_QUALITY} AS quality, coalesce(most, 0) AS most, {_has(_H, '(?i)' + fixed.POLITICAL_MONEY)} AS political,
            epoch(TIMESTAMP '2024-03-01 12:00:00' - coalesce(created, published)) / 86400.0 AS age FROM cards LEFT JOIN most USING (card)),
  weighed AS (SELECT *, CASE WHEN most = 0 THEN 0 WHEN most < 1e6 THEN -3 WHEN NOT (pull > 0 OR political) THEN 0 WHEN most >= 100e6 THEN 3 WHEN most >= 10e6 THEN 2 ELSE 1 END AS money,
              CASE WHEN age < 2 THEN 4 WHEN age < 4 THEN 3 WHEN age < 8 THEN 2 WHEN age < 15 THEN 1 WHEN age < 30 THEN 0 ELSE -5 END AS fresh FROM parts)
  SELECT card, CAST(pull AS INT) AS tension, CAST(hedge AS INT) AS hedge, CAST(money AS INT) AS money, CAST(quality AS INT) AS quality, CAST(topic + pull - hedge + money + quality + fresh AS INT) AS punch FROM weighed""")
def punch_score(spark: SparkSession, d: str) -> DataFrame:
    """Every card's punch and what it is made of."""
    c = {n: F.col(n) for n in ("headline", "summary", "source", "url", "created", "published")}
    rows = cards(spark, d).withColumn("tension", feed_scores.tension(c["headline"], c["summary"]))
    as_of = F.lit("2024-03-01 12:00:00").cast("timestamp")
    return rows.select(
        "card",
        F.col("tension").cast("int").alias("tension"),
        feed_scores.hedge(c["headline"]).cast("int").alias("hedge"),
        feed_scores.headline_money(c["headline"], F.col("tension")).cast("int").alias("money"),
        feed_scores.source_quality(c["source"], c["url"]).cast("int").alias("quality"),
        feed_scores.punch(**c, as_of=as_of).alias("punch"),
    )


@query(f"""WITH {_CARDS} SELECT card, CASE WHEN trim(source) <> '' AND lower(trim(source)) NOT IN ({", ".join(f"'{x}'" for x in fixed.NO_SOURCE)}) THEN trim(source)
    WHEN {_HOST} <> '' THEN {_HOST} ELSE 'Source not recorded' END AS label, CAST({_below(_HOST, fixed.LOW_CREDIBILITY)} AS INT) AS tier FROM cards""")
def source_label(spark: SparkSession, d: str) -> DataFrame:
    """What every card's source is called, and the standing of its host."""
    tier = F.coalesce(feed_scores.credibility_tier(feed_scores.url_host(F.col("url"))), F.lit(0))
    return cards(spark, d).select("card", feed_scores.source_label(F.col("source"), F.col("url")).alias("label"), tier.alias("tier"))


@query(f"WITH {_CARDS} SELECT card, lower(coalesce({', '.join(f'''nullif(regexp_extract(headline, '(?i)({p})', 1), '')''' for p in fixed.REPORTED)})) AS marker FROM cards")
def reported_marker(spark: SparkSession, d: str) -> DataFrame:
    """The words by which headlines say that they are second-hand."""
    return cards(spark, d).select("card", feed_scores.reported_marker(F.col("headline")).alias("marker"))
