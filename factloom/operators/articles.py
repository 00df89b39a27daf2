"""Which articles a profile shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.feed_scores import accountability
from factloom.functions.predicates import is_named
from factloom.functions.text import event_signature
from factloom.operators.similarity import greedy_select, jaccard_join

#: Least score, and Jaccard from which two titles tell of one event.
FLOOR, SAME = 3, 0.5


def profile_articles(articles: DataFrame, people: DataFrame, floor: int = FLOOR, most: int = 10) -> DataFrame:
    """(person, article, score, place): of articles (article, person, title, body, published) those that name the person (people:
    person, first, last) and score ``floor`` or more; best first, newer of equals; none that tells of the same event as a better
    one; ``most`` of each person. Needs a checkpoint folder, as rounds decide what shuts out what."""
    score = accountability(F.col("title"), F.col("body"))
    found = articles.join(people, "person").where(is_named(F.col("first"), F.col("last"), F.col("title"), F.col("body")))
    found = found.select("person", "article", "published", score.cast("int").alias("score"), F.array_sort(event_signature(F.col("title"))).alias("tokens")).where(F.col("score") >= floor)
    order = [F.desc("score"), F.desc_nulls_last("published"), F.asc("article")]
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("person").orderBy(*order))).checkpoint()
    keyed = found.withColumn("key", F.struct("person", "article"))
    # With the person in every token only titles of one person meet.
    own = keyed.select("key", F.transform("tokens", lambda t: F.concat_ws("|", F.col("person").cast("string"), t)).alias("tokens"))
    pairs = jaccard_join(own, own, SAME).where("left_key < right_key")
    kept = greedy_select(keyed.select("key", "rank"), pairs.select(F.col("left_key").alias("a"), F.col("right_key").alias("b")))
    left = keyed.join(kept.select("key"), "key", "left_semi")
    place = F.row_number().over(Window.partitionBy("person").orderBy("rank"))
    return left.withColumn("place", place).where(F.col("place") <= most).select("person", "article", "score", "place")
