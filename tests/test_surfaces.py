"""Cards as readers see them, against literals and a plain loop."""

from pyspark.sql import functions as F

from factloom.operators import cards
from factloom.plans import surfaces
from factloom.plans.base import checkpoint_folder

SF = "/root/testdata/sf0.001"


def _tokens(headline):
    import re

    from factloom.functions import fixed

    return {w for w in re.sub("[^a-z0-9]+", " ", headline.lower()).split() if len(w) >= 4 and w not in fixed.EVENT_STOP_WORDS}


def plain_slice(rows, count):
    promoted, kept = [], []
    for r in sorted(rows, key=lambda r: (-r["points"], -(r["stamp"].timestamp() if r["stamp"] else 0), r["id"])):
        own = _tokens(r["headline"])
        if len(promoted) < count and not any(own and s and len(own & s) / len(own | s) >= cards.ONE_EVENT for s in kept):
            promoted.append(r["id"])
            kept.append(own)
    return promoted


def test_top_slice_is_the_plain_loop(spark):
    checkpoint_folder(spark)
    rows = surfaces.headlines(spark, SF).withColumnRenamed("punch", "points")
    copies = rows.unionByName(rows.where("id % 4 = 0").withColumn("id", F.col("id") + 1000).withColumn("points", F.col("points") + 1))
    for looked_at in (400, 8):  # few at first, and more where they hold too few events
        got = cards.top_slice(copies, F.col("points"), 20, looked_at)
        assert [r["id"] for r in got.orderBy("place").collect()] == plain_slice([r.asDict() for r in copies.collect()], 20)
    assert cards.top_slice(copies.limit(0), F.col("points"), 5).count() == 0 and cards.top_slice(copies.where("id < 3"), F.col("points"), 50).count() <= 3


def test_cards_say_what_the_record_bears(spark):
    people = spark.createDataFrame([(1, True, 61.0, 2500.0, 1980, 1950), (2, True, 61.0, 2500.0, 1980, 1970), (3, False, 5.0, 0.0, None, None), (4, None, None, None, 1980, 1960)], "person int, graded boolean, score double, total double, first_year int, born int")
    told = cards.records(people, 1998)
    assert sorted((r.person, r.score, r.political, r.withheld) for r in told.collect()) == [(1, 61.0, 2500.0, []), (2, 61.0, None, ["political"]), (3, None, None, ["score"]), (4, None, None, [])]
    said = "Gave $1,000 in political donations."
    rows = [(1, 1, 1, said, "$1,000 in political donations"), (2, 2, 1, said, "$1,000 in political donations"), (3, 3, 1, "A giving score of 5.", None), (4, 9, 1, said, "$1,000 in political donations"), (5, 1, 2, "A PBS score of 12 each.", None), (6, 1, 1, None, None)]
    got = {r.card: (r.summary, r.chip, r.score) for r in cards.surfaced(spark.createDataFrame(rows, "card int, person int, tagged int, summary string, chip string"), told).collect()}
    assert got == {
        1: ("Gave $3,000 in political donations.", "$3K in political donations", 61.0), 2: ("", None, 61.0), 3: ("", None, None), 4: ("", None, None),
        5: ("", None, 61.0), 6: (None, None, 61.0),
    }
    both = cards.beside(spark.createDataFrame([(1, 2), (1, 3), (1, 9)], "left int, right int"), told).collect()
    assert sorted((r.right, r.larger_score, r.larger_political) for r in both) == [(2, "even", None), (3, None, None)]
