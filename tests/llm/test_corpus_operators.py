"""Operators that compare documents with each other or learn from them, against brute force and held-out rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import common, language, mixing, quality, queries, simhash, suffix_dedup
from factloom.llm.common import held_out
from tests.llm.test_near_copies import plain_components

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " ", "\n\n\n", "é", "x" * 20_000, "word " * 4_000, "a b", "A B", "a b c", "ÀÉ İ ß \U0001f600 text"]


def with_odd(spark, docs):
    """Documents with odd texts, repeated rows, a null id, and further columns whose names operators use inside."""
    rows = [(10**6 + i, t, None, None, 0) for i, t in enumerate(ODD_TEXTS)]
    rows += rows[:3] + [(None, "no id at all " * 9, "en", "src0", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd)
    return docs.withColumn("id", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("label", F.lit(None).cast("int")).withColumn("__lang", F.lit("y"))


@pytest.fixture(scope="module")
def docs(spark):
    return with_odd(spark, spark.read.parquet(f"{SF}/documents.parquet")).cache()


def plain_fingerprint(text, seed=42):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def clusters(values, near):
    """Least index reachable from each index."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_are_the_plain_ones(spark, docs):
    some = docs.where("doc_id < 40 OR doc_id >= 1000000")
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in simhash.fingerprints(some).collect():
        assert r.fp % 2**64 == plain_fingerprint(texts[r.id])


@pytest.mark.parametrize("paired", [simhash.PAIRED, 2])
def test_components_are_the_plain_ones(spark, docs, paired):
    rows = simhash.near_duplicates(docs, paired=paired).collect()
    assert len(rows) == docs.count()
    known = sorted({(r.doc_id, r.fingerprint) for r in rows if r.doc_id is not None})
    root = clusters([int(f, 16) for _, f in known], lambda a, b: (a ^ b).bit_count() <= 2)
    want = {key: known[r][0] for key, r in zip([k for k, _ in known], root, strict=True)}
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want


@pytest.mark.parametrize("paired", [48, 3])
def test_links_of_crowded_blocks(spark, paired):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**62, 6)]
    fps = set(base)
    for b in base:
        x = b
        for _ in range(40):
            x ^= 1 << int(rng.integers(0, 63))
            fps.add(x if rng.random() < 0.7 else (x := b))
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.links(nodes, paired=paired)
    assert all((r.a ^ r.b).bit_count() <= 2 for r in edges.collect())
    labels = {r.node: r.label for r in common.components(edges).collect()}
    root = clusters(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [labels.get(f, f) for f in fps] == [fps[r] for r in root]


def test_no_documents_no_groups(docs):
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


# --- repeated passages ---------------------------------------------------------------------------------------------


def plain_removal(rows):
    first = {}
    for i, t in rows:
        if i is not None:
            for k in range(len(t) - 49):
                first[t[k : k + 50]] = min(first.get(t[k : k + 50], 1 << 62), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        if i is not None:
            for k in range(len(t) - 49):
                if first[t[k : k + 50]] < i:
                    gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("sizes", [{}, {"crowded": ((1, 44), (3, 50))}, {"crowded": ((2, 48), (1 << 30, 50)), "group_bytes": 9_000, "text_bytes": 4_000, "shard_bytes": 700, "bucket_marks": 90}, {"group_bytes": 20_000, "text_bytes": 30_000, "shard_bytes": 9_000, "bucket_marks": 500}])
def test_removal_is_the_plain_one(spark, docs, sizes):
    extra = ["a" * 49, "a" * 50, "a" * 51, "a" * 200, "ab" * 300, "b" * 30 + "ab" * 100, "é" * 60, "zz" + "q" * 60, "\x00" * 70, "\x00" * 60 + "y"]
    more = spark.createDataFrame([(2 * 10**6 + i, t) for i, t in enumerate(extra)] + [(5, "q" * 80), (5, "q" * 80), (None, "a" * 200)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(more)
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    got = sorted((tuple(r) for r in suffix_dedup.report(suffix_dedup.repeated_spans(rows, **sizes)).collect()), key=order)
    assert got == sorted(plain_removal([(r.doc_id, (r.text or "").encode()) for r in rows.collect()]), key=order)
    assert suffix_dedup.repeated_spans(rows.limit(0)).count() == 0


def test_a_piece_in_thousands_of_contexts(spark):
    """Its stretches all have one mark; they are cut and dealt to many shards, and the result stays the plain one."""
    rng = np.random.default_rng(8)
    piece = b"<<one common piece>>"
    noise = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    rows = [(i, noise(60) + piece + (b"and more of the same in some of them" if i % 3 == 0 else b"") + noise(60)) for i in range(3000)]
    rows += [(4000 + i, rows[i][1][20:110]) for i in range(0, 3000, 50)]
    frame = spark.createDataFrame([(i, t.decode()) for i, t in rows], "doc_id long, text string")
    sizes = {"group_bytes": 60_000, "text_bytes": 20_000, "crowded": ((100, 44), (4000, 50))}
    got = sorted(tuple(r) for r in suffix_dedup.report(suffix_dedup.repeated_spans(frame, **sizes)).collect())
    assert got == sorted(plain_removal(rows))

    import pandas as pd

    told = {}
    for crowded in (((1 << 40, 50),), sizes["crowded"]):
        parts = []
        for gid in range(5):
            mine = rows[gid::5]
            group = suffix_dedup._Group(pd.DataFrame({"id": [i for i, _ in mine], "text": [t for _, t in mine], "gid": gid}))
            parts.append(suffix_dedup._ask_buckets(1)(pd.DataFrame({"id": [i for i, _ in mine], "text": [t for _, t in mine], "gid": gid})))
        answers = suffix_dedup._answer_marks(crowded)(pd.concat(parts))
        asked = group.ask(answers[answers["gid"] == 4], crowded)
        shard = suffix_dedup._bucket(asked.unit_mark, 30)
        told[len(crowded)] = np.bincount(shard, weights=[len(u) for u in asked.units], minlength=30).max() / sum(map(len, asked.units))
    assert told[1] > 0.5 and told[2] < 0.25


def test_ids_that_are_no_numbers(spark):
    rows = [("b", "x" * 30 + "the same fifty bytes and more of them, to be sure of it"), ("a", "the same fifty bytes and more of them, to be sure of it" + "y" * 9), (None, "z" * 80), ("c", None), ("aa", "z" * 80)]
    got = {r.doc_id: r for r in suffix_dedup.report(suffix_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id string, text string"))).collect()}
    # A null id is smaller than none, and none is smaller than it: its text takes nothing from others.
    assert {k: r.n_removed for k, r in got.items()} == {"a": 0, "b": 55, None: 0, "c": 0, "aa": 0}


def test_an_id_that_a_third_of_all_rows_have(spark):
    rng = np.random.default_rng(8)
    shared = [bytes(rng.integers(97, 123, 90).astype(np.uint8)).decode() for _ in range(6)]
    rows = [(7 if i % 3 == 0 else i, shared[i % 6] + str(i) * 30 + shared[(i * 5 + 1) % 6]) for i in range(90)] + [(7, None), (7, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix_dedup.report(suffix_dedup.repeated_spans(df, group_bytes=1500, text_bytes=3000, shard_bytes=2000, bucket_marks=64)).collect())
    least = {}
    for i, t in rows:
        for k in range(len(t or "") - 49):
            least[t[k : k + 50]] = min(i, least.get(t[k : k + 50], i))
    want = []
    for i, t in rows:
        gone = {p for k in range(len(t or "") - 49) if least[t[k : k + 50]] < i for p in range(k, k + 50)}
        kept = "".join(c for p, c in enumerate(t or "") if p not in gone)
        want.append((i, len(t or ""), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(4)
    for size, letters in ((400, 2), (3000, 3), (50, 1), (1, 1), (9, 2)):
        data = rng.integers(0, letters, size).astype(np.uint8)
        order, eight = suffix_dedup.suffix_array(data)
        raw = data.tobytes()
        assert order.tolist() == sorted(range(size), key=lambda i: raw[i:])
        # All suffixes but the last ten, in two stretches, against common prefixes counted byte by byte.
        n = max(1, size - 10)
        starts, counts = (np.array([0, n // 2]), np.array([n // 2, n - n // 2])) if n > 1 else (np.array([0]), np.array([1]))
        picked = order[order < n]
        for width in (50, 7):
            want = [0]
            for a, b in zip(picked[:-1].tolist(), picked[1:].tolist()):
                k = 0
                while k < width and max(a, b) + k < size and raw[a + k] == raw[b + k]:
                    k += 1
                want.append(k)
            got = suffix_dedup.common_prefixes(picked, np.append(eight, np.zeros(0, np.uint64)), starts, counts, width)
            assert np.array_equal(np.minimum(got, size - np.maximum(picked, np.roll(picked, 1)))[1:], want[1:]) and got[0] == 0


def test_merging_parts_changes_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(97, 100, 500).astype(np.uint8).tobytes()
    for _ in range(10):
        texts = list({base[a : a + int(n)] for a, n in zip(rng.integers(0, 400, 15), rng.integers(50, 100, 15), strict=True)})
        texts = [t for t in texts if len(t) >= 50]
        ids = rng.integers(0, 50, len(texts))
        least = defaultdict(lambda: 99)
        for t, i in zip(texts, ids, strict=True):
            for k in range(len(t) - 49):
                least[t[k : k + 50]] = min(least[t[k : k + 50]], int(i))
        want = [least[t[k : k + 50]] for t in texts for k in range(len(t) - 49)]
        for size in (1 << 20, 200):
            assert suffix_dedup.merged_ids(texts, ids, size)[0].tolist() == want


def test_stretches_cover_every_string_once():
    rng = np.random.default_rng(6)
    texts = [b"", b"x" * 49, b"y" * 50, bytes(rng.integers(97, 123, 5000, dtype=np.uint8)), b"ab" * 400_000, bytes(rng.integers(97, 123, 700_000, dtype=np.uint8))]
    doc, start, count, mark, _ = suffix_dedup.stretches(texts)
    for d, t in enumerate(texts):
        seen = np.concatenate([np.arange(s, s + c) for s, c in zip(start[doc == d], count[doc == d], strict=True)] or [np.empty(0, int)])
        assert sorted(seen.tolist()) == list(range(max(0, len(t) - 49)))
    again = suffix_dedup.stretches([b"some words before it " + texts[3]])
    assert set(mark[doc == 3].tolist()) <= set(again[3].tolist())


# --- mixing --------------------------------------------------------------------------------------------------------


def test_mix(spark, docs):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[(r.doc_id, r.source)].append(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")))
    by_source = defaultdict(list)
    for r in rows:
        assert r["size"] in texts[(r.doc_id, r.source)] and r.taken in (0, r["size"], 2 * r["size"])
        by_source[r.source].append(r)
    total = sum(r["size"] for r in rows)
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by_source[s]) for s in order]
    goal = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * total, 2)
    assert sum(goal) == pytest.approx(1.5 * total)
    for s, size, g in zip(order, sizes, goal, strict=True):
        assert all(r.source_size == size and r.target == pytest.approx(g) for r in by_source[s])
        longest = max(r["size"] for r in by_source[s])
        # The odd texts, without a source, are a very long one and some of a word or two.
        assert abs(sum(r.taken for r in by_source[s]) - g) <= (longest / 2 if s is None else max(1, 0.01 * g))
    assert mixing.mix(docs.limit(0)).count() == 0


def plain_targets(sizes, weights, total, most):
    """Shares by weight, cut at ``most`` times the size, the excess shared again until none is above."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left, weight = total - sum(out[i] for i in range(len(sizes)) if i not in free), sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        for i in over or free:
            out[i] = most * sizes[i] if over else left * weights[i] / weight
        free = free - over if over else set()
    return out


def test_targets_share_what_is_cut_off(spark):
    rng = np.random.default_rng(3)
    assert plain_targets([100, 10, 1, 50], [5, 2, 1, 5], 1.5 * 161, 2) == pytest.approx([119.5, 20, 2, 100])
    for sizes in ([100, 10, 1, 50], [10, 10], [0, 10], [], [7], (rng.pareto(0.5, 3000) * 10).astype(int).tolist()):
        names = [f"s{i:05d}" for i in range(len(sizes))]
        names[-1:] = [None] if len(sizes) > 1 else names[-1:]
        rows = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long").repartition(3)
        got = {r.source: (r.source_size, r.target) for r in mixing.targets(rows, (5, 2, 1), 1.5, 2).collect()}
        want = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2)
        assert len(got) == len(sizes)
        for name, size, goal in zip(names, sizes, want, strict=True):
            assert got[name] == (size, pytest.approx(goal))
    rows = spark.createDataFrame([("a", 10), ("b", 10)], "source string, source_size long")
    assert {r.target for r in mixing.targets(rows, (5, 2), 50, 2).collect()} == {20}


def test_fit_is_the_best_sum():
    rng = np.random.default_rng(7)
    for _ in range(120):
        lengths, counts = rng.choice(np.arange(0, 300), 12, replace=False), rng.integers(1, 5, 12)
        budget = int(rng.integers(0, (lengths * counts).sum() + 5))
        take = mixing.fit(lengths, counts, budget)
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            reach = {r + k * n for r in reach for k in range(c + 1) if r + k * n <= budget}
        assert (take <= counts).all() and abs((take * lengths).sum() - budget) <= budget - max(reach)
    lengths, counts = np.arange(1, 20_001), rng.integers(1, 50, 20_000)
    budget = int((lengths * counts).sum() * 0.37)
    assert (mixing.fit(lengths, counts, budget) * lengths).sum() == budget


def test_large_groups_are_ranked_in_parts(spark):
    docs = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 > 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix(docs)
    for r in rows.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 3


# --- learned operators ---------------------------------------------------------------------------------------------


def test_language(spark, docs):
    model = language.fit(docs)
    rows = language.identify(docs.withColumn("held_out", held_out(F.col("doc_id"))), model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id - 10**6: r.lang_pred for r in rows if r.doc_id is not None and r.doc_id >= 10**6}
    assert all(odd[i] == "und" for i in range(4)) and all(odd[i] != "und" for i in range(4, len(ODD_TEXTS)))
    kept = [r for r in rows if r.held_out and r.lang is not None]
    assert len(kept) > 30 and np.mean([r.lang == r.lang_pred for r in kept]) > 0.95


def test_language_without_rows(spark, docs):
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    single = language.fit(docs.where("lang = 'en' OR lang IS NULL"))
    assert {r.lang_pred for r in language.identify(docs.limit(20), single).collect()} == {"en"}
    assert language.identify(docs.limit(0), nothing).count() == 0


def test_temperature_repairs_confidence():
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(size=(400, 3)) + 1.5 * np.eye(3)[y]
    assert language._temperature(logits * 8, y) == pytest.approx(8 * language._temperature(logits, y), rel=0.1)


def test_long_texts_come_in_pieces(monkeypatch):
    rng = np.random.default_rng(10)
    model = language.Model(["a", "b"], rng.normal(size=(language.DIMS, 2)), np.zeros(2))
    texts = ["word " * 4000, "other text " * 9, "", None, "words more " * 3000, "7" * 70 + "ab" + " -" * 400 + "Σ", "x" * 128, " " * 200]
    names, whole = model.predict(texts)
    for block in (1000, 64, 7):
        monkeypatch.setattr(language, "_BLOCK", block)
        again, pieces = model.predict(texts)
        assert names == again and np.allclose(whole, pieces, atol=1e-6) and names[2:4] == ["und", "und"] and names[-1] == "und"


def grams_of(texts):
    """Sorted n-gram buckets of each text."""
    out = defaultdict(list)
    for numbers, grams, ends in language._blocks(texts):
        for i, a, b in zip(numbers, ends[:-1], ends[1:], strict=True):
            out[i] += grams[a:b].tolist()
    return [sorted(out[i]) for i in range(len(texts))]


def test_grams_stay_in_their_text(monkeypatch):
    texts = ["ab cd", "ef1g", "", "7", "long one, with 1 or 2 cuts in a row"]
    whole = grams_of(texts)
    assert whole == [grams_of([t])[0] for t in texts]
    for block in (1, 2, 3, 8):
        monkeypatch.setattr(language, "_BLOCK", block)
        assert grams_of(texts) == whole


def test_sample_is_of_distinct_rows(spark):
    """A text that a third of all rows repeat is one row of the sample; more languages than are learned are no error."""
    rows = [(None, "immer wieder der gleiche Satz", "de")] * 60 + [(i, f"word number {i} of these", "en") for i in range(60)] + [(i, f"rare {i}", f"l{i}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, sample=20, most_languages=3)
    assert len(model.languages) == 3 and {"de", "en"} < set(model.languages)
    said = {r.lang: r.lang_pred for r in language.identify(docs.where("lang IN ('de', 'en')"), model).collect()}
    assert said == {"de": "de", "en": "en"}


def test_quality(spark, docs):
    large = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(large, labels, sample=1500)
    known = large.join(F.broadcast(labels), "doc_id").where(held_out(F.col("doc_id")))
    rows = quality.assess(known, model).select("score", "predicted", "quality").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98 and np.mean([r.predicted == r.quality for r in rows]) > 0.97
    odd = quality.assess(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in odd)
    lines = quality.label_lines(docs.where("doc_id < 30"), model).groupBy("doc_id").count().collect()
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 30").collect()}
    assert {r.doc_id: r["count"] for r in lines} == {i: t.count("\n") + 1 for i, t in texts.items()}


def test_quality_without_labels(spark, docs):
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.assess(docs, none).collect()} == {0.5}
    assert quality.assess(docs.limit(0), none).count() == 0


# --- queries and pipeline ------------------------------------------------------------------------------------------


def test_url_query_agrees_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(queries.ORACLE_SQL["op1_url_filter"]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in queries.op1_url_filter(spark, SF).collect())


def test_url_query_has_the_words_of_its_contract(spark, tmp_path):
    """block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/; without a rule: allow."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://example.com/en/8": ("com/en/", "block"),
        "http://b.net/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://x.example.net/de/80": ("example.net/de/8", "block"),
        "http://c.org/es/1": ("org/es/", "block"), "http://c.org/en/1": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op1_url_filter(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p

    kept = {}
    now = docs
    for name, stage in p.STAGES:
        out = stage(spark, now, SF).cache()
        if name != p.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept[name] = out
        assert stage(spark, now.limit(0), SF).count() == 0
        now = out
    rows = {n: d.collect() for n, d in kept.items()}
    assert not {None, "", " "} & {r.text for r in rows["language ID"]} and {r.doc_id for r in docs.where("lang = 'en' AND length(text) > 200 AND doc_id < 50").collect()} <= {r.doc_id for r in rows["language ID"]}
    given = sorted(rows["language ID"], key=lambda r: (r.doc_id is None, r.doc_id or 0))
    label = plain_components([r.text for r in given])
    assert len(rows["near duplicates"]) == len(set(label))
    assert {r.doc_id for r in rows["near duplicates"]} == {given[min(i for i, x in enumerate(label) if x == c)].doc_id for c in set(label)}
    clean = [r.text for r in rows["personal data"]]
    assert not any(re.search(r"[a-z]@mail[0-9]\.example\.com", t) for t in clean) and any("<EMAIL>" in t for t in clean)
    assert all(r.n_chars == len(r.text) for r in rows["personal data"])
    mixed = rows["source mix"]
    assert sum(r.taken for r in mixed) == pytest.approx(1.5 * sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in clean), rel=0.02)
