"""Every stage of the pipeline on its own input, against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from factloom.llm import decontaminate, language
from tests.llm.test_near_copies import plain_components
from tests.llm.test_text_operators import base_spans, plain_distance, plain_identifiers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with repeated rows, nulls in every column, ids that repeat, and columns whose names the stages use inside."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, "no id at all " * 9, "en", "src0", 1), (None, "no id at all " * 9, "en", "src0", 1), (None, "no id here either, but other words " * 4, None, None, None), (3, None, None, None, None), (3, "", "en", "src1", 0), (10**6, "- 7 -", "en", "src1", 5)]
    rows = given.union(given.limit(3)).union(spark.createDataFrame(odd, given.schema))
    return rows.withColumns({c: F.lit(c) for c in ("row", "gone", "same", "mixed", "told", "size", "pii_key", "__text", "held_out", "a b")}).cache()


def test_language_stage_keeps_what_the_model_is_sure_of(spark, docs):
    kept = p.identify_language(spark, docs, SF)
    assert kept.columns == docs.columns
    model = language.fit(docs)
    want = [r for r in docs.collect() for name, score in [tuple(x[0] for x in model.predict([r.text]))] if name != "und" and score >= p.LEAST_SCORE]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, want))


def test_near_duplicate_stage_keeps_one_row_a_group(spark, docs):
    kept = p.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = docs.collect()
    label = plain_components([r.text for r in rows])
    left = kept.collect()
    assert len(left) == len(set(label))
    groups = {c: [r for r, x in zip(rows, label, strict=True) if x == c] for c in set(label)}
    for g in groups.values():
        ids = [r.doc_id for r in g if r.doc_id is not None]
        assert sum(r in g for r in left) == 1 and next(r for r in left if r in g).doc_id == (min(ids) if ids else None)


def test_decontamination_stage_drops_passages(spark, docs):
    kept = p.decontaminate_benchmark(spark, docs, SF)
    assert kept.columns == docs.columns
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def leaks(text):
        words = decontaminate.words_of(text)
        # A passage of distance k or less has a piece of the item as it is; only then the plain distance is worth its time.
        line = f" {' '.join(words)} "
        for item in items:
            k = int(decontaminate.RATE * len(item))
            if item and any(f" {' '.join(item[a:b])} " in line for a, b in decontaminate.split(len(item), k)) and plain_distance(item, words) <= k:
                return True
        return False

    want = [r for r in docs.collect() if not leaks(r.text)]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, want)) and len(want) < docs.count()


def test_personal_data_stage_masks_all_spans(spark, docs):
    red = p.redact_personal_data(spark, docs, SF)
    assert red.columns == docs.columns
    rows = docs.collect()
    extra = plain_identifiers([r.text for r in rows])

    def masked(text, ids):
        spans = sorted([(a, n, b, kind) for a, n, b, kind in base_spans(text)] + [(a, 4, b, "id") for a, b in ids])
        out, at = "", 0
        for a, _, b, kind in spans:
            if a >= at:
                out += text[at:a] + f"<{kind.upper()}>"
            at = max(at, b)
        return out + text[at:]

    want = [(r.doc_id, None if r.text is None else masked(r.text, ids)) for r, ids in zip(rows, extra, strict=True)]
    got = [(r.doc_id, r.text) for r in red.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in red.collect())


def test_mix_stage_returns_whole_documents(spark, docs):
    mixed = p.mix_sources(spark, docs, SF)
    rows = mixed.collect()
    assert set(docs.columns) <= set(mixed.columns) and {"copies", "taken", "target", "source_size"} <= set(mixed.columns)
    times = {}
    for r in docs.collect():
        key = repr((r.doc_id, r.text, r.lang, r.source, r.n_chars))
        times[key] = times.get(key, 0) + 1
    seen = [repr((r.doc_id, r.text, r.lang, r.source, r.n_chars)) for r in rows]
    assert len(seen) == len(set(seen)) and set(seen) <= set(times)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(r["size"] == count(r.text) and r.taken == r["size"] * r.copies and 0 < r.copies <= 2 * times[k] for r, k in zip(rows, seen, strict=True))
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(count(r.text) for r in docs.collect()), rel=0.02)


def test_run_ends_with_clean_texts(spark):
    rows = p.run(spark, SF).collect()
    assert rows and all(r.text and not re.search(r"[a-z]@mail[0-9]\.example\.com", r.text) for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
