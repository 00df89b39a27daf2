"""Feed scores on cards of invented people, and goals."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import feed_scores as f
from factloom.functions import feed_scores, fixed
from factloom.operators import goals, resolve


def L(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("title", "body", "points"),
    [
        ("Vessel pledges a grant", None, 12), ("Vessel sails", "a foundation and a charity", 6), ("Migrants sail", "", 0), ("Vessel's $ORLN portfolio", "nyse", -10),
        ("A charitable gift", None, 12), ("Coach Quill", "forward P / E of 9", -6), (None, None, 0),
    ],
)
def test_accountability(one, title, body, points):
    assert one(f.accountability(L(title), L(body))) == points


@pytest.mark.parametrize(
    ("title", "body", "kind"),
    [("Super PAC names its donor", "a charitable foundation grant", "political"), ("Quill sails", "his net worth", "wealth"), ("Quill sails", None, None), ("A grant from a fortune", None, "giving"), ("Lobby of an empire", "", "political")],
)
def test_kinds(one, title, body, kind):
    assert one(f.candidate_kind(L(title), L(body))) == kind


def test_tension_and_hedges(one):
    assert one(f.tension(L("Quill sued over fraud probe and scandal"), L("lawsuit, layoffs"))) == 9 + 2
    assert one(f.tension(L(None), None)) == 0 and one(f.hedge(L("Quill may mull, could weigh"))) == 8 and one(f.hedge(L("mayor speaks"))) == 0


@pytest.mark.parametrize(
    ("headline", "tension", "points"),
    [("Quill gives $90 million", 0, 0), ("Quill gives $90 million", 3, 2), ("A $160,000 gift", 0, -3), ("Megadonor spends $2B", 0, 3), ("No sum", 3, 0), ("$5 bn suit", 3, -3), ("$1,500,000 and $2K", 3, 1)],
)
def test_money_beside_tension(one, headline, tension, points):
    assert one(f.headline_money(L(headline), F.lit(tension))) == points


def test_sources(one):
    assert one(f.source_quality(L("x"), L("https://www.digg.com/a"))) == -4 and one(f.source_quality(L("Zerohedge.com "), L(None))) == -10
    assert one(f.source_quality(L("iheart.com"), L("https://nodigg.com"))) == 0
    assert [one(f.source_label(L(n), L(u))) for n, u in ((" Unknown ", "https://www.example.org/x"), ("The Example", None), (None, "no url"), ("-", None))] == ["example.org", "The Example", "Source not recorded", "Source not recorded"]


def test_reported(one):
    said = {"Quill reportedly sails": "reportedly", "Report: Quill sails": "report", "Quill's reported stake": "reported", "A report by Quill": None, "Quill gave, the Example reports": None, "Reports say so": "reports say", None: None}
    assert {k: one(f.reported_marker(L(k))) for k in said} == said


def test_parts_of_a_mix_sum(spark):
    rows = spark.createDataFrame([("giving",), (None,), ("giving",)], "kind string")
    assert {r.kind: r.n for r in f.kind_mix(rows).collect()} == {"giving": 2, "unclassified": 1, "political": 0, "wealth": 0, "power": 0}
    assert sum(r.n for r in f.kind_mix(rows.limit(0)).collect()) == 0


def test_people_elsewhere_meet_goals_by_field_and_means(spark):
    asked = spark.createDataFrame([(1, ["Here"], ["ships"]), (2, [], [])], "goal long, places array<string>, fields array<string>")
    people = [(1, "Here", ["x"], 1.0, 5.0), (2, "There", ["ships", "ships"], None, None), (3, "There", None, 50.0, 1.0), (4, "There", ["x"], 2.0, 9.0), (5, None, ["ships"], 60.0, None)]
    rows = spark.createDataFrame(people, "person long, place string, fields array<string>, billions double, score double")
    got = sorted((r.goal, r.place, r.person, r.points) for r in goals.matches(asked, rows).collect())
    assert got == [(1, 1, 5, 2), (1, 2, 1, 2), (1, 3, 3, 1), (1, 4, 2, 1), (2, 1, 5, 1), (2, 2, 3, 1)]
    assert [r.person for r in goals.matches(asked, rows, most=1).orderBy("goal").collect()] == [5, 5]


def test_nicknames_and_listed_pairs(spark):
    rows = [(1, "Bill Vessel", 1950), (2, "William Vessel", 1950), (3, "Ted Vessel", 1960), (4, "Edward Vessel", 1961), (5, "Ann Quill", 1970), (6, "Annabel Quill", 1970), (7, "Ada Quill", 1970), (8, "Adam Quill", 1970)]
    people = spark.createDataFrame(rows, "id long, name string, born int")
    got = {(r.a, r.b): r.verdict for r in resolve.candidate_pairs(people, together=[("ted vessel", "Edward Vessel")], never=[("Ada Quill", "Adam Quill")]).collect()}
    assert got[1, 2] == "merge" and got[3, 4] == "merge" and got[5, 6] == "merge" and (7, 8) not in got and (1, 5) not in got


def test_profile_articles_are_those_of_a_plain_loop(spark):
    from factloom.operators import articles
    from factloom.plans.base import checkpoint_folder

    checkpoint_folder(spark)
    heads = ["Vessel pledges grant to harbor school", "Vessel pledges grant to harbor museum", "Vessel sails", "Vessel foundation endows clinic", "Quill gives away fortune", "Vessel lobby and empire of ships", "Ann Vessel gift of ships to a harbor school"]
    rows = [(i, p, h, "Ann Vessel says so" if i % 5 else "Bo says so", f"2024-01-{1 + i % 28:02d}") for i, (p, h) in enumerate((p, h) for p in (1, 2) for h in heads * 3)]
    given = spark.createDataFrame(rows, "article long, person long, title string, body string, published string")
    people = spark.createDataFrame([(1, "Ann", "Vessel"), (2, "Bo", "Vessel")], "person long, first string, last string")
    scored = given.withColumn("score", f.accountability(F.col("title"), F.col("body"))).collect()
    want, stop = [], set(__import__("factloom.functions.fixed", fromlist=["x"]).EVENT_STOP_WORDS)
    for person, first in ((1, "ann"), (2, "bo")):
        kept = []
        for r in sorted((r for r in scored if r.person == person and r.score >= 3), key=lambda r: (-r.score, [-ord(c) for c in r.published], r.article)):
            words = set(r.title.lower().split())
            if "vessel" in words and first in f"{r.title} {r.body}".lower().split():
                own = {w for w in words if len(w) >= 4 and w not in stop}
                if not any(len(own & k) / len(own | k) >= 0.5 for _, k in kept):
                    kept.append((r.article, own))
        want += [(person, a, i + 1) for i, (a, _) in enumerate(kept[:3])]
    got = sorted((r.person, r.article, r.place) for r in articles.profile_articles(given, people, most=3).collect())
    assert got == sorted(want) and len(got) > 4


def test_entries_are_found_as_their_expressions_find_them(spark):
    """Marked texts against one expression an entry."""
    terms = sorted({*fixed.TENSION, *fixed.HEDGES, *[t for _, listed in fixed.SIGNALS.values() for t in listed], *map(feed_scores.plain_term, fixed.NOISE)})
    odd = ["", "sues", "xsue", "_sue", "\u00e9sue", "\u0001sue", "a\u0001sue", "net \u0001worth", "NET WORTH falls", "net  worth", "\u212aelvin may ", "may", "may be", "tax-avoid tax avoid", "\u0130sues \u017fues", "donor-advised\nlobby"]
    texts = odd + [f"x {t}y, {t.upper()}" for t in terms] + [f"x{t}" for t in terms]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = sum((F.col("t").rlike(feed_scores.beginning(t)).cast("int") for t in terms[1:]), F.col("t").rlike(feed_scores.beginning(terms[0])).cast("int"))
    told = rows.select("t", feed_scores._hits(feed_scores._marked(F.col("t")), terms).alias("got"), want.alias("want"))
    assert [r for r in told.collect() if r.got != r.want] == []


def test_scores_use_few_expressions_and_many_tasks(spark):
    from factloom.plans import registry

    for name in ("accountability", "punch_score"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert plan.rdd.getNumPartitions() > 1
        assert plan._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") < 40


def test_goals_of_one_kind_are_judged_once(spark):
    asked = spark.range(300).select(F.col("id").alias("goal"), F.when(F.col("id") % 2 == 0, F.array(L("Here"), L("There"))).otherwise(F.array(L("There"), L("Here"), L("Here"))).alias("places"), F.array(L("ships")).alias("fields"))
    rows = spark.range(40).selectExpr("id AS person", "'Here' AS place", "array('ships', 'x') AS fields", "id / 1D AS billions", "CAST(NULL AS DOUBLE) AS score")
    found = goals.matches(asked, rows, most=3, means=100.0)
    assert "windowspecdefinition(kind" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.goal, r.place, r.person, r.points) for r in found.collect()) == [(g, i + 1, 39 - i, 3) for g in range(300) for i in range(3)]
