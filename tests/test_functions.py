"""Column functions on literals, boundaries included. All names and figures are invented."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.functions import dates, money, numeric, text

C = F.col


def now():
    return F.lit("2024-06-30 00:00:00").cast("timestamp")


@pytest.mark.parametrize(("score", "letter"), [(100, "A"), (60, "A"), (59.99, "B"), (45, "B"), (44.99, "C"), (30, "C"), (29.99, "D"), (15, "D"), (14.99, "F"), (0, "F"), (-5, "F")])
def test_grade(one, score, letter):
    assert one(numeric.grade(C("x")), x=float(score)) == letter


def test_grade_of_nothing(one):
    assert one(numeric.grade(F.lit(None).cast("double"))) is None


def test_rounding(one):
    assert [one(numeric.round_half_up(C("x")), x=x) for x in (1.005, 0.125, 2.675, -0.125)] == [1.0, 0.13, 2.68, -0.12]


def _score(one, worth, giving, pledged=False, sources=0):
    made = numeric.benefit_score(C("w"), C("g"), F.lit(0.0), C("p"), C("s"))
    return one(made, w=F.lit(worth).cast("double"), g=F.lit(giving).cast("double"), p=pledged, s=sources)


def test_score_of_zero_and_unknown_worth(one):
    for worth in (0.0, None):
        made = _score(one, worth, 1e6)
        assert made["generosity"] == 0 and made["score"] >= 0


def test_score_pledge_and_source_cap(one):
    assert 0 < _score(one, 1e9, 0.0, pledged=True)["score"] < 10
    assert _score(one, 1e9, 0.0, sources=8)["transparency"] == _score(one, 1e9, 0.0, sources=20)["transparency"] == 1


def test_score_grows_with_giving(one):
    scores = [_score(one, 1e9, g)["score"] for g in (0.0, 1e5, 1e6, 1e7, 1e8, 1e9)]
    assert scores == sorted(scores)


def test_ratios_are_absent_never_zero(one):
    ratio = numeric.giving_ratio(C("w"), C("g"))
    assert one(ratio, w=100.0, g=5.0) == 5
    assert one(ratio, w=100.0, g=0.0) is None and one(ratio, w=F.lit(None).cast("double"), g=1.0) is None


def test_zero_kinds(one):
    kind = numeric.zero_kind(C("s"), C("e"))
    assert [one(kind, s=s, e=e) for s, e in ((0.0, False), (0.0, True), (1.0, False))] == ["unevidenced", "evidenced-zero", None]


def test_dominance(one):
    d = numeric.dominates(C("a"), C("b"))
    assert [one(d, a=a, b=b) for a, b in ((10.0, 1.0), (9.9, 1.0), (10.0, 0.0))] == [True, False, False]


def test_annualised(one):
    a = numeric.annualised(C("t"), C("s"), F.lit(None).cast("double"), 2026)
    assert [one(a, t=100.0, s=s) for s in (2016, 2025, 2026, 2030)] == [10, 100, 100, 100]


def test_digits(one):
    assert [one(numeric.significant_digits(C("x")), x=x) for x in (120000, 12300, 7)] == [2, 3, 1]
    edit = numeric.one_digit_edit(C("a"), C("b"))
    cases = [("1234", "1244", True), ("1234", "1324", True), ("1234", "1234", False), ("1234", "12345", False), ("1234", "2143", False), ("", "", False)]
    assert [one(edit, a=a, b=b) for a, b, _ in cases] == [x for _, _, x in cases]


def test_sums(one):
    s = numeric.two_and_three_sums(F.array(*[F.lit(x) for x in (1.0, 2.0, 4.0)]))
    assert one(s) == [3.0, 5.0, 6.0, 7.0]
    assert one(numeric.two_and_three_sums(F.array_repeat(F.lit(1.0), 5), most=4)) is None
    assert one(numeric.two_and_three_sums(F.array().cast("array<double>"))) == []


def test_curation_score(one):
    assert [one(numeric.curation_score(C("x")), x=F.lit(x).cast("double")) for x in (0.0, None, 140.0, -3.0, 70.0)] == [50, 50, 100, 0, 70]


@pytest.mark.parametrize(("days", "points"), [(1, 4), (2, 3), (4, 2), (8, 1), (15, 0), (30, -5), (400, -5)])
def test_recency(one, days, points):
    assert one(dates.recency(now() - F.make_dt_interval(F.lit(days)), now())) == points


def test_recency_without_date(one):
    assert one(dates.recency(F.lit(None).cast("timestamp"), now())) == 0


@pytest.mark.parametrize(("days", "kind"), [(364, "current"), (365, "current"), (366, "stale")])
def test_age(one, days, kind):
    assert one(dates.age_class(now() - F.make_dt_interval(F.lit(days)), now(), F.lit(True))) == kind
    assert one(dates.age_class(now() - F.make_dt_interval(F.lit(days)), now(), F.lit(False))) == "undated"


def test_clock_trust(one):
    stamp = dates.trusted_stamp(C("c"), now())
    for minutes, trusted in ((5, True), (6, False), (-5, True), (-6, False)):
        client = now() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
        assert (one(stamp, c=client) == dt.datetime(2024, 6, 30)) is not trusted


def test_years(one):
    birth = dates.birth_year(C("t"), 2026)
    assert [one(birth, t=t) for t in ("3/4/51", "03/04/1960", "1/2/15", "soon", "1/2/123")] == [1951, 1960, 1915, None, None]
    year = dates.precise_year(C("t"), C("p"))
    assert one(year, t="+1950-01-01T00:00:00Z", p=9) == 1950 and one(year, t="+1950-00-00", p=7) is None
    assert one(dates.impossible_record(F.lit(1980), F.lit(1970), 2026)) and not one(dates.impossible_record(F.lit(1990), F.lit(1970), 2026))


def test_windows(one):
    w = dates.window_of(F.array(F.lit("2024-02-01"), F.lit("soon"), F.lit("2023-01-01")))
    assert tuple(one(w)) == ("2023-01-01", "2024-02-01")
    assert one(dates.window_of(F.array(F.lit("soon")))) is None
    assert [one(dates.compact_date(C("t")), t=t) for t in ("20240102T03", "2024")] == ["2024-01-02", ""]


@pytest.mark.parametrize(("said", "dollars"), [("~$1.2B", 1.2e9), ("$790 billion", 7.9e11), ("$1.14T", 1.14e12), ("$3,500", 3500), ("12M", 12e6), ("rich", None), ("", None)])
def test_parse_usd(one, said, dollars):
    assert one(money.parse_usd(C("t")), t=said) == pytest.approx(dollars) if dollars is not None else one(money.parse_usd(C("t")), t=said) is None


def test_billions_know_no_trillions(one):
    assert [one(money.parse_billions(C("t")), t=t) for t in ("~$1.2B", "$500M", "$1.14T")] == [1.2, 0.5, None]


def test_amounts(one):
    assert one(money.amounts(C("t")), t="Gave $2.5 million and $300k, of $1,200 and $4 bn") == [2.5e6, 3e5, 1200, 4e9]
    assert one(money.largest_amount(C("t")), t="none") is None
    assert [one(money.money_points(C("t"), F.lit(True)), t=t) for t in ("$100M", "$10M", "$1M", "$5", "no")] == [3, 2, 1, -3, 0]
    assert one(money.money_points(C("t"), F.lit(False)), t="$100M") == 0


def test_currency(one):
    assert [one(money.currency(C("x")), x=x) for x in (0.0, 999.0, 1e3, 1e6, 1.5e9)] == ["$0", "$999", "$1K", "$1.0M", "$1.5B"]


def test_signature_and_jaccard(one):
    assert one(text.event_signature(C("t")), t="Vast GIFT, vast gift from Orlan Fund!") == ["vast", "gift", "orlan", "fund"]
    j = text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))
    assert one(j) == pytest.approx(1 / 3)
    assert one(text.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0


def test_lexicon_counts_the_title_twice(one):
    lexicon = {"lawsuit": 3, "gala": -2}
    points = text.lexicon_points(C("t"), C("b"), lexicon)
    assert one(points, t="A lawsuit", b="lawsuit at a gala") == 4
    assert one(points, t="Lawsuits", b=F.lit(None).cast("string")) == 0


def test_kind_ties_go_to_the_first(one):
    kinds = {"law": ("court",), "gift": ("fund",)}
    assert [one(text.kind(C("t"), kinds), t=t) for t in ("Fund in court", "A fund", "Nothing")] == ["law", "gift", None]


def test_hosts(one):
    assert [one(text.url_host(C("u")), u=u) for u in ("https://WWW.News.Example.org/a", "nonsense", "")] == ["news.example.org", None, None]
    assert one(text.of_domain(C("h"), ["example.org"]), h="a.example.org") and not one(text.of_domain(C("h"), ["example.org"]), h="badexample.org")


def test_html(one):
    page = "<html><style>p{}</style><script>x('</p>')</script><p>" + "word &amp; " * 40 + "</p></html>"
    assert one(text.html_text(C("h")), h=page).startswith("word & word")
    assert one(text.html_text(C("h")), h="<p>short</p>") is None


def test_names(one):
    assert one(text.normal_name(C("n")), n="Orlan Q. Vessel, Jr.") == "orlan vessel"
    assert [one(text.generation(C("n")), n=n) for n in ("Orlan Vessel Jr.", "Orlan Vessel III", "Orlan Vessel")] == ["jr", "iii", None]
    assert one(text.name_in_text(F.lit("Mara Quill"), C("t")), t="Yesterday, MARA QUILL gave.") and not one(text.name_in_text(F.lit("Mara Quill"), C("t")), t="Mara Quillon gave")
    assert one(text.snake_case(C("n")), n="problemStatement") == "problem_statement"


def test_sentences(one):
    said = "Dr. Vessel gave 2.5 million. He left! Why? No. 4 knows"
    assert one(text.sentences(C("t")), t=said) == ["Dr. Vessel gave 2.5 million.", "He left!", "Why?", "No. 4 knows"]
    assert one(text.first_sentences(C("t"), 2), t=said) == "Dr. Vessel gave 2.5 million. He left!"
    assert one(text.without_sentences(C("t"), "left"), t=said) == "Dr. Vessel gave 2.5 million. Why? No. 4 knows"


def test_texts_that_speak_of_themselves(one):
    patterns = {"its table": r"(?i)\bthis table\b", "its rows": r"(?i)\b[0-9]+ rows\b"}
    found = one(text.speaks_of_itself(C("t"), patterns), t="Little is in this table of 12 rows. He gave $5 million. There were 9 rows left.")
    assert [(x["sentence"][:6], x["labels"]) for x in found] == [("Little", ["its table", "its rows"]), ("There ", ["its rows"])]


def test_exact_dollars(one):
    assert [one(money.exact_usd(C("x")), x=x) for x in (93720.25, 10.0, 711.5900000000003, -5.5)] == ["$93,720.25", "$10", "$711.59", "-$5.50"]


def test_prose_under_a_heading():
    from factloom.functions.prose import under_heading

    page = '<div><h2>Political&nbsp;activity</h2><p class="a summary-text">Gave &amp; gave</p></div>'
    assert under_heading(page, "political activity", "summary-text") and not under_heading(page.replace("Gave &amp; gave", " <b></b> "), "political activity", "summary-text")
    assert not under_heading(page.replace("<p", "<h3>x</h3><p"), "political activity", "summary-text") and not under_heading(None, "x", "y")
    assert under_heading("<H3><i>A</i><!-- x --> b</H3><p class=k>c&#100;<p class='k'></p>", "a B", "k") and not under_heading("<h2>A</h2></div><p class=k>c</p>", "a", "k")


@pytest.mark.parametrize(
    ("said", "now"),
    [
        ("Her PBS score of 91.60 is high", "Her giving score of 47 is high"), ("a Public  Benefit score: 12", "a giving score: 47"), ("with 91.6 PBS score.", "with 47 giving score."),
        ("giving grade A (92 of 100)", "giving grade B (47 of 100)"), ("her giving grade is A+ (92)", "her giving grade is B (47)"), ("Giving score was 9.", "Giving score was 47."), ("88 giving score", "47 giving score"),
        ("$91.60 PBS score", "$91.60 PBS score"), ("PBS score of 91.60%", "PBS score of 91.60%"), ("PBS aired it", "PBS aired it"), ("giving score of 1234", "giving score of 1234"),
    ],
)
def test_scores_are_restated(said, now):
    from factloom.functions.prose import restated

    assert restated(said, 46.6) == now and restated(now, 46.6) == now


def test_inside_names_are_withheld(one):
    from factloom.functions.prose import names_score_inside, withhold_any_score

    def named(text):
        return one(names_score_inside(F.lit(text).cast("string")))

    assert named("a PBS  score") and named("public benefit score") and not named("PBS scored it") and not named(None)
    assert one(withhold_any_score(F.lit("an F giving grade"))) == "" and one(withhold_any_score(F.lit("PBS aired it"))) == "PBS aired it"
