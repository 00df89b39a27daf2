"""Operators on small tables, against plain loops and by their laws. All names are invented."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import lists, prose
from factloom.operators import audit, feed, latest, ranking, resolve, similarity, tables, totals
from factloom.plans.base import checkpoint_folder
from factloom.sources import landed
from factloom.streaming import events

SLOW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- newest rows and changes ---------------------------------------------------------------------------------------

VOTE = "user string, target string, direction int, at int"


@SLOW
@given(st.permutations([("u", "x", 1, 1), ("u", "x", -1, 3), ("u", "x", 1, 2), ("u", "y", 1, 1), ("v", "x", -1, 5)]))
def test_latest_does_not_depend_on_order(spark, votes):
    df = spark.createDataFrame(votes, VOTE)
    assert rows(latest.latest_by(df, ["user", "target"], ["at"], ["direction"])) == [("u", "x", -1), ("u", "y", 1), ("v", "x", -1)]
    assert rows(latest.dedup_latest(df, ["user", "target"], [F.desc("at")]), "user", "target", "direction") == [("u", "x", -1), ("u", "y", 1), ("v", "x", -1)]


def test_exempt_rows_stay(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("b", 1, False), ("b", 2, None)], "k string, at int, keep boolean")
    assert rows(latest.dedup_latest(df, ["k"], [F.desc("at")], F.col("keep")), "k", "at") == [("a", 1), ("a", 2), ("b", 2)]


def test_agreed_and_pivot(spark):
    df = spark.createDataFrame([(1, "a", 5, 1), (1, "a", 6, 2), (2, "a", 7, 1), (2, "b", 8, 1)], "p int, k string, v int, at int")
    assert rows(df.groupBy("p").agg(latest.agreed(F.col("k")))) == [(1, "a"), (2, None)]
    assert rows(latest.pick_by_kind(df, ["p"], "k", "v", ["at"], ["a", "b"])) == [(1, 6, None), (2, 7, 8)]


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([("u", "x", 1, 5), ("v", "x", 1, 1)], VOTE)
    new = spark.createDataFrame([("u", "x", -1, 5), ("v", "x", -1, 0), ("w", "x", 1, 1)], VOTE)
    once = tables.upsert_newest(old, new, ["user", "target"], "at")
    want = [("u", "x", -1, 5), ("v", "x", 1, 1), ("w", "x", 1, 1)]
    assert rows(once) == want == rows(tables.upsert_newest(once, new, ["user", "target"], "at"))
    assert rows(tables.superseded(old, new, ["user", "target"], "at")) == [("v", "x", -1, 0)]
    assert rows(tables.upsert(old, new, ["user", "target"])) == rows(new)
    assert rows(tables.insert_absent(old, new, ["user"])) == [("u", "x", 1, 5), ("v", "x", 1, 1), ("w", "x", 1, 1)]
    assert rows(tables.append(old, new)) == sorted(rows(old) + rows(new), key=repr)
    assert rows(tables.replace_keys(old, new.where("user = 'u'"), ["user"], attempted=old)) == [("u", "x", -1, 5)]
    assert rows(tables.cascade(new, old, {"user": "user"})) == [("u", "x", -1, 5), ("v", "x", -1, 0)]
    assert rows(tables.delete_keys(new, old, ["user"])) == [("w", "x", 1, 1)]


def test_guarded_delete_is_null_safe(spark):
    df = spark.createDataFrame([(1, None), (2, "manual"), (3, "auto"), (None, "auto")], "n int, method string")
    left = tables.delete_where(df, F.col("n") < 5, F.col("method").eqNullSafe(F.lit("manual")))
    assert rows(left) == [(2, "manual"), (None, "auto")]


def test_fill_update_patch_and_recount(spark):
    old = spark.createDataFrame([(1, None, []), (2, "NV", ["Mining"])], "id int, state string, industry array<string>")
    new = spark.createDataFrame([(1, "OR", ["Ships"]), (2, "TX", ["Oil"])], "id int, state string, industry array<string>")
    assert rows(tables.fill_missing(old, new, ["id"], ["state", "industry"])) == [(1, "OR", ["Ships"]), (2, "NV", ["Mining"])]
    assert rows(tables.update_changed(old.select("id", "state"), new.where("id = 2").select("id", "state"), ["id"], "state")) == [(1, None, False), (2, "TX", True)]
    patches = spark.createDataFrame([(1, "UT", 6, 1, "pending"), (2, "UT", 5, 1, "pending"), (2, "AK", 9, 0, "rejected")], "id int, state string, upvotes int, downvotes int, status string")
    assert rows(tables.patch(old.select("id", "state"), patches, "id", ["state"])) == [(1, "UT"), (2, "NV")]
    edges = spark.createDataFrame([(1, 1), (1, 1), (1, -1)], "id int, direction int")
    assert rows(tables.recount(old.select("id"), edges, "id", "id")) == [(1, 2, 1), (2, 0, 0)]


def test_badges_and_guarded_overwrite(one):
    badges = F.create_map(F.lit("pledge"), F.lit(False), F.lit("claimed"), F.lit(True))
    assert one(tables.set_badge(badges, "pledge", F.lit(True))) == {"pledge": True, "claimed": True}
    assert one(tables.set_badge(F.lit(None).cast("map<string,boolean>"), "pledge", F.lit(True))) == {"pledge": True}
    over = tables.overwrite_guarded(F.col("o"), F.col("s"), F.col("n"), "wiki", 2.5e12)
    cases = [(1.0, "hand", 2.0, 1.0), (1.0, "wiki", 2.0, 2.0), (1.0, "wiki", float("nan"), 1.0), (1.0, "wiki", 3e12, 1.0), (None, None, 2.0, 2.0)]
    assert [one(over, o=F.lit(o).cast("double"), s=F.lit(s).cast("string"), n=n) for o, s, n, _ in cases] == [c[3] for c in cases]


# --- order ---------------------------------------------------------------------------------------------------------


def test_pages_and_graded_first(spark):
    df = spark.createDataFrame([("a", True, 5.0), ("b", False, 99.0), ("c", True, 7.0), ("d", True, None)], "name string, graded boolean, score double")
    for down, want in ((True, "cadb"), (False, "acdb")):
        order = ranking.graded_first(df, F.col("graded"), F.col("score"), "name", down)
        assert "".join(r["name"] for r in df.orderBy(*order).collect()) == want
        assert [r["name"] for r in ranking.page(df, order, 2, 2).collect()] == list(want[2:])
    with pytest.raises(ValueError):
        ranking.page(df, [F.col("name")], 0, 5)


def test_promoted_rows_come_first_and_the_rest_keep_their_order(spark):
    df = spark.createDataFrame([(i, i * 7 % 10) for i in range(10)], "at int, points int")
    pos = {r["at"]: r["pos"] for r in ranking.promoted_first(df, [F.desc("at")], F.col("points"), 8, 2).collect()}
    newest = list(range(9, 1, -1))
    lead = sorted(newest, key=lambda i: -(i * 7 % 10))[:2]
    assert [k for k, _ in sorted(pos.items(), key=lambda x: x[1])] == lead + [i for i in newest if i not in lead]


def test_diversify_keeps_unclassified_slots(spark):
    kinds = ["a", "a", None, "a", "b", "a", None, "b"]
    df = spark.createDataFrame([(i + 1, k) for i, k in enumerate(kinds)], "pos int, kind string")
    new = dict(sorted((r["new_pos"], r["pos"]) for r in ranking.diversify(df, "pos", "kind", 2).collect()))
    assert new == {1: 1, 2: 2, 3: 3, 4: 5, 5: 8, 6: 4, 7: 7, 8: 6}


def test_daily_order(spark, one):
    checkpoint_folder(spark)
    assert one(ranking.seed(F.lit("2026-09-12"))) == 181415291

    def plain(ids, state):
        out = sorted(ids)
        for last in range(len(out) - 1, 0, -1):
            state = (state * ranking.LCG_FACTOR + ranking.LCG_STEP) & ranking.LCG_MASK
            other = min(last, int(state / ranking.LCG_MASK * (last + 1)))
            out[last], out[other] = out[other], out[last]
        return out[:10]

    for n, day in ((300, "2026-09-12"), (300, "2026-09-21"), (7, "2026-01-01"), (1, "x"), (0, "x")):
        ids = [f"p{i:04d}" for i in range(n)]
        got = ranking.daily_pick(spark.createDataFrame([(i,) for i in ids], "id string"), "id", day).collect()
        assert [r.id for r in sorted(got, key=lambda r: r.place)] == plain(ids, one(ranking.seed(F.lit(day)))) and sorted(r.place for r in got) == list(range(1, min(n, 10) + 1))


def test_rounds_under_a_budget(spark):
    checkpoint_folder(spark)
    rows = [(i, i % 13, None if i % 9 == 0 else float(i % 7)) for i in range(500)]
    got = {r.k: (r.spent, r.runs) for r in ranking.under_budget(spark.createDataFrame(rows, "k int, at int, cost double"), [F.asc("at"), F.asc("k")], F.col("cost"), 700.0).collect()}
    spent, want = 0.0, {}
    for k, _, cost in sorted(rows, key=lambda r: (r[1], r[0])):
        want[k] = (spent, spent <= 700.0)
        spent += cost or 0.0
    assert got == want and 0 < sum(runs for _, runs in got.values()) < 500


def test_pages_end_where_they_end(spark):
    pages = [("a", 1, ["x", "y"]), ("a", 2, ["y", "z"]), ("a", 3, []), ("a", 4, ["w"]), ("b", 2, ["x"]), ("c", 1, None), ("d", 1, ["x", "x"]), ("d", 3, ["v"]), (None, 1, ["n"]), ("e", 0, ["u"])]
    df = spark.createDataFrame([(s, n, i and [(k, f"{n}{k}") for k in i]) for s, n, i in pages], "source string, page int, items array<struct<key:string,label:string>>")
    got = sorted(((r.source or "", r.page, r.pos, r.key, r.label) for r in landed.paged(df, "source", "page", "items", "key").collect()))
    assert got == [("", 1, 0, "n", "1n"), ("a", 1, 0, "x", "1x"), ("a", 1, 1, "y", "1y"), ("a", 2, 1, "z", "2z"), ("d", 1, 0, "x", "1x")]
    assert [r.page for r in landed.paged(df, "source", "page", "items", "key", most=1).where("source = 'a'").collect()] == [1, 1]


def test_audits_say_what_differs(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3), (4, "d", 4), (5, "e", 5), (5, "e", 5)], "k int, x string, y int")
    served = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "z", None), (6, "f", 6), (5, "e", 5)], "k int, x string, y int")
    got = sorted((r.k, r.verdict, r.fields) for r in audit.compared(stored, served, "k", ["x", "y"]).collect())
    assert got == [(1, "agrees", []), (2, "differs", ["y"]), (3, "differs", ["x", "y"]), (4, "not served", []), (5, "ambiguous", []), (6, "not stored", [])]
    assert audit.compared(stored.limit(0), served.limit(0), "k", ["x"]).count() == 0


def test_totals_in_one_pass(spark):
    rows = [("p", 1.0, "DEM", "4", "2020-01-02"), ("p", 2.5, None, "4", "2019-05-01"), ("p", None, "DEM", None, None), ("q", None, "REP", None, None), (None, 4.0, "REP", "3", "2021-01-01")]
    got = {r.person: (r.total, r.n, r.parties, r.forms, r.span) for r in totals.summary(spark.createDataFrame(rows, "person string, amount double, party string, form string, day string"), "person", "amount", "party", "form", "day").collect()}
    assert got == {"p": (3.5, 3, {"DEM": 1.0, "Unknown": 2.5}, {"4": 2}, "2019-05-01 to 2020-01-02"), "q": (0.0, 1, {"REP": 0.0}, {}, ""), None: (4.0, 1, {"REP": 4.0}, {"3": 1}, "2021-01-01 to 2021-01-01")}


def test_splices_close_up(spark):
    checkpoint_folder(spark)
    listed = spark.createDataFrame([(i, 10 - i) for i in range(8)], "key int, rank int")
    near = spark.createDataFrame([(1, 0.3), (2, 0.3), (3, 0.5), (4, 0.3), (5, 0.3), (6, 0.1)], "key int, score double")
    verdicts = spark.createDataFrame([(1, "duplicate", False), (2, "duplicate", True), (4, "new", False), (6, "duplicate", False), (7, "duplicate", False)], "key int, verdict string, failed_open boolean")
    got = sorted((r.place, r.key, r.asked) for r in feed.spliced(listed, near, verdicts, [F.desc("rank")]).collect())
    assert got == [(1, 0, None), (2, 2, "failed open"), (3, 4, "cleared"), (4, 5, "failed open"), (5, 6, None), (6, 7, None)]


def test_pool_and_tiers(spark):
    few, all_ = spark.range(3), spark.range(50)
    assert ranking.pool(few, all_).count() == 50 and ranking.pool(all_.where("id < 20"), all_).count() == 20
    due = {run: ranking.tiers(spark.range(500), "id", [F.col("id")], run).count() for run in (1, 3, 10, 30)}
    assert due == {1: 100, 3: 400, 10: 200, 30: 500}


# --- similarity ----------------------------------------------------------------------------------------------------

SETS = st.lists(st.frozensets(st.sampled_from("abcdefg"), min_size=1, max_size=5), min_size=2, max_size=12, unique=True)


def near(a, b, t):
    return len(a & b) / len(a | b) >= t


@SLOW
@given(SETS, st.sampled_from([0.25, 0.4, 0.5, 1.0]))
def test_joins_and_greedy_are_the_plain_loops(spark, sets, t):
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "key int, tokens array<string>")
    pairs = {(i, j) for j in range(len(sets)) for i in range(j) if near(sets[i], sets[j], t)}
    found = similarity.similar_pairs(df, t)
    assert {(r["a"], r["b"]) for r in found.collect()} == pairs
    kept = []
    for j, s in enumerate(sets):
        if not any(near(sets[i], s, t) for i in kept):
            kept.append(j)
    assert sorted(r["key"] for r in similarity.greedy_select(df.select("key", F.col("key").alias("rank")), found).collect()) == kept
    label = list(range(len(sets)))
    for _ in sets:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    assert {r["key"]: r["cluster"] for r in similarity.connected(df.select("key"), found).collect()} == dict(enumerate(label))
    odd, even = df.where("key % 2 = 1"), df.where("key % 2 = 0")
    want = {}
    for i in range(0, len(sets), 2):
        scored = [(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), -j) for j in range(1, len(sets), 2) if near(sets[i], sets[j], t)]
        if scored:
            want[i] = -max(scored)[1]
    assert {r["left_key"]: r["right_key"] for r in similarity.best_match(even, odd, t).collect()} == want


def test_feed_selection_and_clusters_are_the_plain_loops(spark):
    from factloom.plans import feeds
    from factloom.plans.texts import titles

    d = "/root/testdata/sf0.001"
    cards = feeds._stories(spark, d).withColumn("tokens", feed.event_signature(F.col("title"))).collect()
    published = [set(r.tokens) for r in cards if r.published]
    want, runs = set(), {}
    for r in sorted((r for r in cards if not r.published), key=lambda r: r["rank"]):
        counts, kept = runs.setdefault(r.run, ({}, []))
        s = set(r.tokens)
        if len(kept) < 20 and counts.get(r.person, 0) < 2 and not any(near(s, k, 0.5) for k in kept) and not any(near(s, p, 0.4) for p in published):
            counts[r.person] = counts.get(r.person, 0) + 1
            kept.append(s)
            want.add((r.run, r.key))
    assert {(r.run, r.key) for r in feeds.candidate_selection(spark, d).collect()} == want and len(want) > 20
    cards = feeds._cards(spark, d).withColumn("tokens", feed.event_signature(F.col("title"))).collect()
    founders, by_url, clusters = {}, {}, {}
    for r in sorted(cards, key=lambda r: r["rank"]):
        mine, urls = founders.setdefault(r.run, []), by_url.setdefault(r.run, {})
        url = f"u{r.key % 90}" if r.key % 3 == 0 else None
        at = urls.get(url) if url else None
        at = at if at is not None else next((k for k, s in mine if near(s, set(r.tokens), 0.4)), None)
        if at is None:
            at = r.key
            mine.append((r.key, set(r.tokens)))
        if url:
            urls[url] = at
        clusters[r.key] = at
    assert {r.key: r.cluster for r in feeds.story_clusters(spark, d).collect()} == clusters
    assert titles(spark, d).count() > 10


def test_guards_and_judges(spark):
    items = spark.createDataFrame([(1, 5), (2, -1), (3, 5), (4, 5)], "key int, points int")
    verdicts = spark.createDataFrame([(3, "reject", False), (4, "reject", True)], "key int, verdict string, failed_open boolean")
    assert rows(feed.guarded(items, {"points": F.col("points") < 0}, verdicts), "key", "dropped_by") == [(1, None), (2, "points"), (3, "judge"), (4, None)]
    assert rows(feed.guarded(items, {"points": F.col("points") < 0}, verdicts, enforced=False), "key", "dropped_by") == [(1, None), (2, "points"), (3, None), (4, None)]


# --- people --------------------------------------------------------------------------------------------------------


def test_lookups(spark):
    people = spark.createDataFrame([(1, "Orlan Vessel", ["O. Vessel"]), (2, "Mara Quill", None), (3, "Oren Vessel", None)], "id int, name string, aliases array<string>")
    wanted = spark.createDataFrame([(10, "ORLAN Q. VESSEL Jr."), (11, "Olaf Vessel"), (12, "Nobody Known")], "id int, name string")
    assert rows(resolve.exact_then_initial(wanted, people)) == [(10, 1, "exact"), (11, 1, "initial")]
    assert rows(resolve.first_row_match(wanted, people)) == [(10, 1)]
    p = spark.createDataFrame([(1, "Alex Vessel", 1950), (2, "Alexander Vessel", 1950), (3, "Alex Vessel Jr.", 1980), (4, "Alex Vessel", 1954)], "id int, name string, born int")
    assert rows(resolve.candidate_pairs(p)) == [(1, 2, "merge"), (1, 3, "review"), (1, 4, "merge"), (2, 3, "review"), (2, 4, "review"), (3, 4, "review")]


def test_audits(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 7), ("g", 3, 1), ("h", 1, 1)], "g string, pos int, score int")
    got = audit.buckets(df, {"high": F.col("score") >= 5, "first": F.col("pos") == 1}).first()
    assert (got["total"], got["high"], got["first"], got["unclassified"], got["adds_up"]) == (4, 2, 1, 1, True)
    assert rows(audit.descending_breaks(df, "g", "pos", "score")) == [("g", 2, 7)]
    assert rows(audit.first_misplaced(df, "g", "pos", F.col("score") > 5)) == [("g", 1, 2)]


# --- arrays, maps, prose -------------------------------------------------------------------------------------------


def test_vehicles_count_once(one):
    names = [("Quill Foundation", 10.0), ("Quill Foundation, Trust", 9.0), ("Quill Foundation Health Plan Trust", 4.0), ("Quill", 1.0), (None, 2.0)]
    array = F.array(*[F.struct(F.lit(n).cast("string").alias("name"), F.lit(a).alias("assets")) for n, a in names])
    assert one(lists.vehicles(array)) == [False, True, False, False, False]
    assert one(lists.collapsed_total(array, "assets", F.lit(26.0))) == 17
    assert one(lists.collapsed_total(F.slice(array, 1, 0), "assets", F.lit(26.0))) == 26


def test_parties_fold(one):
    m = F.create_map(*[F.lit(x) for kv in (("DEM", 1000.0), ("Dem", 250.0), ("NNE", 5000.0), ("rep", 300.0)) for x in kv])
    assert [tuple(b) for b in one(lists.party_buckets(m))] == [(5000.0, "NNE"), (1250.0, "DEM"), (300.0, "REP")]
    assert one(lists.top_party(m)) == "DEM" and one(lists.adds_up(m, F.lit(6550.0))) and not one(lists.adds_up(m, F.lit(6551.0)))
    assert one(lists.whole_number(F.lit('{"n": 3}'), "$.n")) == 3 and one(lists.whole_number(F.lit('{"n": 3.5}'), "$.n")) is None and one(lists.whole_number(F.lit("junk"), "$.n")) is None


def test_send_tiers(one):
    cases = [("none", 3, 0), ("blind", 3, 1), ("none", 0, 2), ("blind", -1, 3), ("person", 9, 4)]
    assert [one(lists.send_tier(F.lit(k), F.lit(p))) for k, p, _ in cases] == [t for *_, t in cases]
    assert one(lists.receipts(("worth", F.lit("$5")), ("gifts", F.lit(None).cast("string")), ("rank", F.lit("2")))) == "worth: $5\nrank: 2"


def test_figure_block(spark):
    stored = [344769.0, 123456.0, -23456.0, 50.0]
    said = [
        ("Gave $344,769.", []), ("Gave $344,796.", [344796]), ("Gave $345,000 or $468,225.", []), ("Gave $689,538 in two.", []), ("Gave $468,252.", [468252]), ("Gave $3.4 million and $12.", []), (None, []), ("", []),
    ]
    df = spark.createDataFrame([(i, t, stored) for i, (t, _) in enumerate(said)], "i int, t string, s array<double>")
    got = [(r["v"]["figures"], r["v"]["refused"]) for r in df.orderBy("i").select(prose.figure_block("t", "s").alias("v")).collect()]
    assert got == [(f, False) for _, f in said]
    assert prose.disagreements("Gave $344,796.", [float(x) for x in range(1000, 1200)]) == ([], True)


def test_prose_repairs(spark):
    df = spark.createDataFrame([("A giving score of 91.6 is high", 47.4, 1), ("A giving score of 91.6", 47.4, 2), ("91 giving score", None, 1), (None, 1.0, 1)], "t string, s double, n int")
    assert [r[0] for r in df.select(prose.repair_score("t", "s", "n")).collect()] == ["A giving score of 47 is high", "A giving score of 91.6", "91 giving score", None]
    df = spark.createDataFrame([("Holds $152.5B and $3M", 152.5e9, 80.04e9), ("Holds $152.5B", 10.0, 80e9), ("Holds $2 million", 2e6, 1000.0)], "t string, a double, b double")
    assert [r[0] for r in df.select(prose.repair_holdings("t", "a", "b")).collect()] == ["Holds $80.0B and $3M", "Holds $152.5B", "Holds $2 million"]
    df = spark.createDataFrame([('{"a": [1, {"b": 2.5}], "c": true}',), ("junk",), (None,)], "t string")
    assert [r[0] for r in df.select(prose.json_numbers("t")).collect()] == [[1.0, 2.5], [], []]


# --- sources and streams -------------------------------------------------------------------------------------------


def test_landed_sources(spark, tmp_path, one):
    (tmp_path / "q.json").write_text('{"results": {"bindings": [{"item": {"value": "Q1"}, "name": {"value": "Orlan"}},\n {"item": {"value": "Q1"}, "name": {"value": "Olaf"}}, {"item": {"value": "Q2"}}]}}')
    assert rows(landed.sparql_bindings(spark, str(tmp_path / "q.json"), ["item", "name"], "item")) == [("Q1", "Orlan"), ("Q2", None)]
    (tmp_path / "r.json").write_text('{"results": [{"name": "Quill Fund", "amount": 5.5}], "other": 1}')
    assert rows(landed.rest_results(spark, str(tmp_path / "r.json"), "results", "struct<name: string, amount: double>")) == [("Quill Fund", 5.5)]
    kind = landed.classify_response(F.col("s"), F.col("b"), "items")
    cases = [
        (200, '{"total_results": 1, "items": [1]}', "answer"), (200, '{"total_results": 0, "items": []}', "empty"), (404, '{"total_results": 0, "items": []}', "empty"), (404, "", "failed"), (200, "oops", "failed"),
        (200, '{"items": 5}', "failed"), (200, '{"items": []}', "failed"), (200, '{"total_results": 3, "items": []}', "failed"), (500, '{"total_results": 1, "items": [1]}', "failed"),
    ]
    assert [one(kind, s=s, b=b) for s, b, _ in cases] == [k for *_, k in cases]
    state = str(tmp_path / "runs")
    assert landed.run_count(spark, state) == 0
    landed.save_run_count(spark, state, 4)
    assert landed.run_count(spark, state) == 4
    people = spark.createDataFrame([(1,), (2,)], "id int")
    assert landed.pinned(people, spark.createDataFrame([(2,)], "id int"), "id").count() == 1
    for bad in ([], [(3,)]):
        with pytest.raises(ValueError):
            landed.pinned(people, spark.createDataFrame(bad, "id int"), "id")
    forms = spark.createDataFrame([(["4", "10-K", "4"], ["a", "b", "c"])], "form array<string>, doc array<string>")
    n, first = landed.filings("form", ["doc"], ["4"], keep=1)
    assert [(r[0], [tuple(x) for x in r[1]]) for r in forms.select(n, first).collect()] == [(2, [("4", "a")])]


def _stream(spark, tmp_path, batches, schema):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:02}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_late_votes_are_superseded(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    votes = _stream(spark, tmp_path, [[("u", "x", 1, t(5))], [("u", "x", -1, t(3)), ("v", "x", 1, t(1))], [("u", "x", -1, t(5))]], "user string, target string, direction int, at timestamp")
    out = events.drain(events.last_writer_wins(votes, "user", "target", "direction", "at"), str(tmp_path))
    got = {(r.user, r["at"].minute, r.direction): r.outcome for r in out.collect()}
    outcomes = sorted(got.values())
    assert len(got) == 4 and got[("v", 1, 1)] == "accepted" and outcomes.count("accepted") >= 3


def test_limits_duplicates_and_recomputation(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    schema = "user string, url string, at timestamp"
    stream = _stream(spark, tmp_path, [[("u", "a", t(1)), ("u", "b", t(2)), ("v", "a", t(3))], [("u", "a", t(4))]], schema)
    over = events.settled(events.drain(events.over_limit(stream, "user", "at", 2), str(tmp_path), "update"), ["user", "minute"], ["n"])
    assert [(r.user, r.n) for r in over.collect()] == [("u", 3)]
    assert sorted(r.url for r in events.drain(events.first_seen(stream, "url", "at"), str(tmp_path)).collect()) == ["a", "b"]
    refused = spark.createDataFrame([("a", dt.datetime(2023, 12, 30))], "url string, refused_at timestamp")
    assert [r.url for r in events.drain(events.cooled(stream, refused, "url", "at"), str(tmp_path)).collect()] == ["b"]
    saved = {}
    writer = events.recompute(stream, "user", lambda ids: ids.withColumn("n", F.lit(1)), lambda df, n: saved.update({n: {r.user for r in df.collect()}}))
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert set().union(*saved.values()) == {"u", "v"}


def test_sums_that_end_in_half_a_dollar_do_not_depend_on_order(spark, tmp_path):
    """Added up as doubles in the first order, these prices make 2023.4999999999998."""
    from factloom.plans import registry

    prices = [723.24, 335.61, 43.54, 883.26, 37.85]
    rows = [(s, 1, p, "N", "F", dt.date(1995, 1, 4)) for s, order in ((1, prices), (2, prices[::-1])) for p in order]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate date").coalesce(1).write.parquet(path)
    got = registry.QUERIES["contribution_totals"](spark, str(tmp_path)).orderBy("l_suppkey").collect()
    assert [(r.total, r.parties) for r in got] == [(2023.5, "N=2024")] * 2


def test_best_matches_are_found_without_pairs(spark, monkeypatch):
    """Sets of few and many tokens, copies, one token that all have: against all pairs."""
    rng = random.Random(5)
    sets = [frozenset([*rng.sample(range(30), rng.randint(0, 9)), "all"]) for _ in range(120)] + [frozenset(), frozenset({"all"}), frozenset(range(13)), frozenset(range(14))]
    sets += sets[:9] + sets[-3:]
    df = spark.createDataFrame([(k, [str(w) for w in s]) for k, s in enumerate(sets)], "key long, tokens array<string>")
    left, right = df.where("key % 2 = 0"), df.where("key % 2 = 1")
    own = [frozenset(map(str, s)) for s in sets]
    for t, listed in ((0.2, 12), (0.5, 12), (1.0, 12), (0.2, 5)):
        monkeypatch.setattr(similarity, "LISTED", listed)
        want = {}
        for i in range(0, len(own), 2):
            scored = [(len(own[i] & own[j]) / len(own[i] | own[j]), -j) for j in range(1, len(own), 2) if own[i] and own[j]]
            if max(scored, default=(0,))[0] >= t:
                want[i] = (-max(scored)[1], max(scored)[0])
        assert {r.left_key: (r.right_key, r.score) for r in similarity.best_match(left, right, t).collect()} == want
    monkeypatch.setattr(similarity, "jaccard_join", None)  # sets of few tokens never meet in pairs
    monkeypatch.setattr(similarity, "LISTED", 12)
    few = df.where("size(tokens) <= 12")
    assert similarity.best_match(few.where("key % 2 = 0"), few.where("key % 2 = 1"), 0.2).count() > 50
