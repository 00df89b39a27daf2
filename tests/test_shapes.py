"""Gates, notes, formats and shapes on literals."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import money, notes, predicates
from factloom.operators import shaping


def texts(*xs):
    return F.array(*[F.lit(x).cast("string") for x in xs]) if xs else F.array().cast("array<string>")


def test_page_arguments():
    asked = [(None, None), ("3", "50"), (0, 0), (-2, 99999), ("x", "y"), (2.5, None)]
    assert [predicates.page_arguments(*a) for a in asked] == [(1, 20), (3, 50), (1, 1), (1, 2000), (1, 20), (1, 20)]


def test_gates_and_lists(spark):
    rows = spark.createDataFrame([(1, "approved", None), (2, None, True), (None, "approved", True)], "id long, status string, hidden boolean")
    assert [r.id for r in predicates.visible(rows, hidden="hidden").collect()] == [1] and predicates.visible(rows).count() == 2
    assert predicates.not_among(rows, "id", []).count() == 3 and [r.id for r in predicates.not_among(rows, "id", [1]).collect()] == [2, None]
    assert predicates.without(rows, ["hidden", "no"], {"id": "key"}).columns == ["key", "status"]


@pytest.mark.parametrize(
    ("window", "days", "fix"),
    [
        ("2024-01-05 to 2024-01-02", ["2024-01-02", "2024-01-05"], ("BACKWARD", "2024-01-02 to 2024-01-05")), ("2024-01-02 to 2024-01-02", ["2024-01-02", "2024-01-03", None], ("DEGENERATE", "2024-01-02 to 2024-01-03")),
        ("2024-01-03 to 2024-01-09", ["2024-01-02", "2024-01-05"], ("UNDERSTATED", "2024-01-02 to 2024-01-05")), ("2024-01-01 to 2024-01-09", ["2024-01-02", "2024-01-05"], None), ("soon", ["2024-01-02", "2024-01-05"], None),
        ("2024-01-05 to 2024-01-02", ["2024-01-02", "x"], None), (None, [], None),
    ],
)
def test_windows(one, window, days, fix):
    got = one(notes.window_fix(F.lit(window).cast("string"), texts(*days)))
    assert (got and (got["kind"], got["after"])) == fix


def test_notes_of_what_is_unknown(one):
    t = lambda x: F.lit(x).cast("timestamp")
    now, yes = t("2024-06-01"), F.lit(True)
    note = lambda retrieved, written, known=True: one(notes.summary_note(t(retrieved), t(written), now, yes, F.lit(known)))
    assert note("2024-05-01", "2024-05-02") is None and note("2024-05-01", "2024-04-30") == note(None, "2024-05-02") == note("2024-05-01", None) == notes.SUMMARY_NOTE and note(None, None, False) is None
    assert not one(notes.outdated(t(None), t("2024-01-01"))) and one(notes.outdated(t("2023-01-01"), t("2024-01-01")))
    assert one(notes.headline_caveat(F.lit(4.0), F.lit(None).cast("double"), F.lit(False))) and not one(notes.headline_caveat(F.lit(None).cast("double"), F.lit(0.0), F.lit(False)))
    assert [one(notes.is_capped(F.lit(n).cast("int"), F.lit(r).cast("int"))) for n, r in ((100, None), (99, None), (100, 100), (3, 4), (None, 9), (None, None))] == [True, False, False, True, False, False]


def test_money_in_words(one):
    assert [one(money.card_money(F.lit(x))) for x in (1.25e9, 2.5e8, 57e3, 711.59, 12.0, 0.0)] == ["$1.3B", "$250M", "$57K", "$711.59", "$12", ""]
    assert [one(money.compact_usd(F.lit(x))) for x in (3.7e9, 636e6, 5000.0, 999.0, 2e12)] == ["$3.7B", "$636M", "$5K", "$999", "$2T"]
    assert one(money.prose_amounts(F.lit("$1 234 and 93 gifts, $ 5 then 12.50 in 2025; 1,000,000"))) == [1234.0, 5.0, 12.5, 1000000.0]
    assert one(money.assets_chip(F.lit(9e5))) is None


def test_exact_halves_of_money_go_up(one):
    """As ``toFixed`` rounds them; 2,500 and 4,500 are where half to even differs."""
    assert [one(money.card_money(F.lit(x))) for x in (2500.0, 3500.0, 4500.0, 2499.99, 2.5e6)] == ["$3K", "$4K", "$5K", "$2K", "$3M"]


def test_json_of_any_shape(one):
    assert [one(notes.json_scalar(F.lit(x).cast("string"))) for x in ('"a"', "1.5", "true", "null", "[1]", '{"a": 1}', "x", None)] == ["a", "1.5", "true", None, None, None, None, None]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "a long, b string")
    assert shaping.oldest_left(none, none, "a", "b").first()["left"] == 0
    assert shaping.nested_json(none.select("a"), none, "a", ["b"]).count() == 0 and predicates.living(none, "b")[1].first().kept == 0
