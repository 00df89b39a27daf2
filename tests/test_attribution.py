"""Attribution and sections on literals; all names are invented."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import attribution as a
from factloom.functions import sections as s


def texts(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def texts_map(**kv):
    return F.create_map(*[F.lit(x).cast("string") for p in kv.items() for x in p]) if kv else F.lit(None).cast("map<string,string>")


FILLER, NONE = ("inc", "the", "group", "holdings"), ("self employed", "at rest")


def employer_verdict(spark, employer, known):
    rows = lambda values, kind: spark.createDataFrame(values, kind)
    people = rows([(1, "Orlan Vessel Jr.")], "person long, name string")
    none = rows([], "person long, value string")
    told = a.affiliations(people, rows([(1, k) for k in known], "person long, value string"), none, none, none, FILLER)
    return a.employer_verdicts(rows([(7, 1, employer)], "record long, person long, employer string"), people, told, FILLER, NONE).first()["verdict"]


@pytest.mark.parametrize(
    ("employer", "known", "verdict"),
    [
        ("Tidewater Shipping Inc.", ["Tidewater Holdings (TDW)"], "affiliated"), ("SELF-EMPLOYED", ["Tidewater"], "generic"), ("The Group Inc", ["Tidewater"], "generic"),
        ("Vessel Consulting", ["Tidewater"], "surname"), ("Orlan Consulting", ["Vessel Orlan"], "no-list"), ("Harbor Bakery", ["Tidewater"], "unaffiliated"), (None, ["Tidewater"], "generic"), ("Harbor Bakery", [], "no-list"),
    ],
)
def test_employers(spark, employer, known, verdict):
    assert employer_verdict(spark, employer, known) == verdict


def test_affiliations(spark):
    rows = lambda *values: spark.createDataFrame(list(values), "person long, value string")
    people = spark.createDataFrame([(1, "Orlan Vessel"), (2, "Mara Quill")], "person long, name string")
    got = a.affiliations(people, rows((1, "Quill Mills"), (1, "Q77"), (2, "Quill Mills")), rows((1, "Tidewater")), rows(), rows((1, "co-founder of Harbor Bakery"), (2, "teacher")), FILLER)
    assert sorted(map(tuple, got.collect())) == [(1, "bakery"), (1, "harbor"), (1, "mills"), (1, "quill"), (1, "tidewater"), (2, "mills")]


CHARITY, INSTITUTIONS, CONNECTING = "foundation|fund|trust|charitable", ("university", "public library"), ("family", "charitable", "jr", "sr")


@pytest.mark.parametrize(
    ("org", "person", "own"),
    [
        ("The Vessel Family Foundation", "Orlan Vessel", True), ("Orlan Q Vessel Jr Charitable Trust", "Orlan Vessel Jr.", True), ("Tom And Orlan Vessel Foundation", "Orlan Vessel", True), ("Anne Vessel Foundation", "Orlan Vessel", False),
        ("Orlan Quill Foundation", "Mara Orlan", False), ("Vessel University Fund", "Orlan Vessel", False), ("Vessel Shipping", "Orlan Vessel", False), ("Family Foundation", "Orlan Vessel & family", False), ("Foundation", "Orlan Vessel", False), ("", "", False),
        ("Vessel Public Library Fund", "Orlan Vessel", False),
    ],
)
def test_own_foundations(one, org, person, own):
    assert one(a.own_foundation(F.lit(org), F.lit(person), CHARITY, INSTITUTIONS, CONNECTING)) is own


def test_legacies_and_reviews(one):
    assert one(a.own_foundation(F.lit("Vessel Foundation"), F.lit("Orlan Vessel"), CHARITY, INSTITUTIONS, CONNECTING, legacy=["vessel foundation"])) is False
    c = F.array(F.struct(F.lit(12345678).alias("ein")), F.struct(F.lit(987654321).alias("ein")))
    assert [r["ein"] for r in one(a.reviewed(c, texts("012345678")))] == [12345678] and len(one(a.reviewed(c, F.lit(None).cast("array<string>")))) == 2


def test_relatives(one):
    own = texts("mara", "elise", "vessel")
    title = lambda t: one(a.names_a_relative(F.lit(t), F.lit("vessel"), own))
    assert title("Olaf Vessel fined") and not title("Mara Vessel gives") and not title("Elise Vessel gives") and not title("nonprofit names Vessel its donor")


def test_filers(one):
    filers = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("name")) for i, n in (("1", "VESSEL ORLAN TRUST"), ("2", "VESSEL ORLAN Q (CIK 2)"), ("3", "VESSEL ORLAN"))])
    assert one(a.personal_id(filers, F.lit("Orlan Vessel"), ("trust", "fund"))) == "2"
    assert one(a.ticker(F.lit("TIDEWATER INC  (TDW-A)  (CIK 000)"))) == "TDW-A" and one(a.ticker(F.lit("TIDEWATER"))) is None and one(a.bare_filer(F.lit("TIDEWATER (CIK 0012)"))) == "TIDEWATER"


def test_labels_and_addresses(one):
    mapped = a.label(F.col("x"), {"tech": "Technology"}, {"ship": "Shipping"}, "Other")
    assert [one(mapped, x=x) for x in ("Tech", "Ships & docks", "Art", F.lit(None).cast("string"))] == ["Technology", "Shipping", "Other", "Other"]
    assert one(a.entity_id(F.lit("http://example.org/entity/Q5"))) == "Q5" and one(a.thumbnail(F.lit("http://x/a b.jpg"), "http://y/", 50)) == "http://y/a_b.jpg?width=50"
    assert one(a.suspect_drop(F.lit("claims $2 million"), F.lit("gave $2.01M"))) and not one(a.suspect_drop(F.lit("claims $3 million"), F.lit("gave $2.01M")))


def test_blocked_sections(one):
    new, old, blocked = texts_map(bio="new bio", news="bad news", money="bad money"), texts_map(news="old news", money=" "), texts("news", "money")
    assert one(s.blocked_sections(new, old, blocked)) == {"bio": "new bio", "news": "old news"}
    kept = s.outcome(new, old, blocked)
    assert one(kept) == {"news": "previous", "money": "withheld"}
    assert one(s.preserved_dates(kept, texts_map(bio="2020"), F.lit("2021"))) == {"news": "2021"} and one(s.preserved_dates(kept, texts_map(news="2019"), F.lit("2021"))) == {"news": "2019"}


def test_approved_sections(one):
    marker = lambda by, date, ruling: F.struct(F.lit(by).alias("by"), F.lit(date).alias("date"), F.lit(ruling).alias("ruling"))
    markers = F.create_map(F.lit("bio"), marker("m", "2024-01-02", "r"), F.lit("news"), marker("m", "soon", "r"), F.lit("other"), marker("m", "2024-01-02", "r"), F.lit("money"), marker("m", "2024-01-02", "r"))
    got = s.approved_sections(texts_map(bio="new", news="new", other="new", approvedSections="x"), texts_map(bio="old", news="old", other="old"), markers, texts("bio", "news", "money"))
    assert one(got) == {"bio": "old", "news": "new"}
    assert [one(s.approval_defect(marker(*m))) for m in (("m", "2024-01-02", "r"), ("", "2024-01-02", "r"), ("m", "x", "r"), ("m", "2024-01-02", ""))] == [None, "no by", "no date", "no ruling"]
