"""Alignment of tokenizers, whitening and exact copies, against plain versions over whole tables and odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import crosstok, exact_dedup, queries, whitening
from tests.llm.test_corpus_operators import with_odd

SF = "/root/testdata/sf0.001"
A, B = f"{queries.TOKENIZERS}/byte_bpe_50k.json", f"{queries.TOKENIZERS}/piece_bpe_32k.model"
TEXTS = ["  two  spaces ", "a\nb", "a \n b\n", "\n", "x ▁y the of", "<|endoftext|> <s> \U0001f600", "nul\x00 here a b", "tab\there we\r\ngo on", "it's we'll 's", "é café a b 　c", "1,000.50 $5 !!! ...", "中文 字 符", "a" * 5000 + " b"]


@pytest.fixture(scope="module")
def docs(spark):
    docs = with_odd(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    more = spark.createDataFrame([(2 * 10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    return docs.unionByName(more, allowMissingColumns=True).cache()


def plain_alignment(rows, own):
    """Each text encoded whole, all ends compared."""
    told, pairs = [], Counter()
    for text in rows:
        a, b = (own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)) if text else ([], [])
        of_a, of_b = [own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b]
        if not text or not b"".join(of_a) == (" " + text).encode() == b"".join(of_b):
            told.append(None)
            continue
        end_a, end_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        links = [(x, y) for x, i in zip(a, end_a, strict=True) for y in [dict(zip(end_b, b, strict=True)).get(i)] if y is not None] if len(a) < 400 else None
        if links is None:
            at = dict(zip(end_b, b, strict=True))
            links = [(x, at[i]) for x, i in zip(a, end_a, strict=True) if i in at]
        pairs.update(links)
        cuts, groups, i, j = sorted(set(end_a) & set(end_b)), [], 0, 0
        for c in cuts:
            left = [x for x, e in zip(a[i:], end_a[i:], strict=True) if e <= c]
            right = [x for x, e in zip(b[j:], end_b[j:], strict=True) if e <= c]
            i, j = i + len(left), j + len(right)
            groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
        told.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if t is None else (t[0], t[1], t[2], len(t[3]), sum(pairs[p] == best[p[1]] for p in t[3]), sum(pairs[p] for p in t[3]), t[4]) for t in told], pairs


@pytest.mark.parametrize("frequent", [crosstok.FREQUENT, 40])
def test_alignment_is_that_of_whole_texts(spark, docs, frequent):
    own = crosstok.Tokenizers(open(A).read(), open(B, "rb").read())
    assert own.separable()
    some = docs.where("length(text) < 3000 OR text IS NULL")
    rows = [(r["doc_id"], r["text"]) for r in some.select("doc_id", "text").collect()]
    want, pairs = plain_alignment([t for _, t in rows], own)
    aligned, counted = crosstok.align(some, A, B, frequent=frequent)
    got = Counter(tuple(r) for r in aligned.collect())
    assert got == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert {(r["a"], r["b"]): r["links"] for r in counted.collect()} == pairs


def test_alignment_by_whole_texts_is_the_same(spark, docs, monkeypatch):
    some = docs.where("doc_id % 40 = 1 OR doc_id >= 2000000").where("length(text) < 2000")
    cut = sorted(tuple(r) for r in crosstok.align(some, A, B)[0].collect())
    monkeypatch.setattr(crosstok.Tokenizers, "separable", lambda self: False)
    assert sorted(tuple(r) for r in crosstok.align(some, A, B)[0].collect()) == cut and len(cut) > 10


def test_pieces_are_the_text():
    for text in [*TEXTS, "a b", " ", "a  b c", "x\x00 y z", "end "]:
        pieces = crosstok.pieces_of(text)
        assert "".join(pieces) == " " + text and pieces == crosstok.CUT.split(" " + text)


def test_alignment_of_nothing(spark, docs):
    assert crosstok.align(docs.limit(0), A, B)[0].count() == 0
    got = crosstok.align(docs.where("text IS NULL OR text = '' OR text LIKE '%▁%'"), A, B)[0].collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "")} and len(got) > 4


def test_alignment_query(spark):
    got = queries.op11_alignment(spark, SF)
    assert got.columns == ["doc_id", *crosstok.NUMBERS, "groups_sha256"] and got.count() == 200
    assert got.where("n_a = 0 AND groups_sha256 <> '' OR n_a > 0 AND length(groups_sha256) <> 64 OR n_best > n_links").isEmpty()


# --- whitening -----------------------------------------------------------------------------------------------------


def test_whitening_is_that_of_numpy(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    d = len(vectors.first()["embedding"])
    odd = [(9001, None, 1), (9002, [float("nan")] * d, 1), (9003, [], 1), (9004, [1.0] * 5, 2), (9005, [0.5] * (d - 1) + [None], 2), (9006, [0.1] * (d - 1) + [float("-inf")], 2), (None, [0.25] * d, 2)]
    vectors = vectors.unionByName(spark.createDataFrame(odd, vectors.schema)).union(vectors.limit(7)).withColumn("x", F.lit(1)).withColumn("n", F.lit("y"))
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect() if r["embedding"] and len(r["embedding"]) == d and None not in r["embedding"] and np.isfinite(r["embedding"]).all()]
    m = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in rows])
    u = np.unique(m, axis=0)
    n, s = len(u), u.sum(0)
    centred = (n * u - s) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts, trace = values[::-1][:16], parts[:, ::-1][:, :16], values.sum()
    white = ((n * m - s) / n) @ parts / np.sqrt(values)
    got = whitening.by_component(whitening.whiten(vectors))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "identity_error": "double", "whitened": "double", "explained": "double"}
    table = got.toPandas()
    assert len(table) == 16 * len(rows) and set(table["n"]) == {n} and table["identity_error"].nunique() == 1 and table["identity_error"][0] < 1e-10
    deviation = {i: int(x) for (i, _), x in zip(rows, ((n * m - s) ** 2).sum(1), strict=True)}
    for (i, _), w in zip(rows, white, strict=True):
        mine = table[table["vec_id"].isna()] if i is None else table[table["vec_id"] == i]
        first = mine.drop_duplicates("component").sort_values("component")
        assert set(mine["deviation"]) == {deviation[i]} and np.allclose(np.abs(first["whitened"]), np.abs(w), atol=1e-8) and np.allclose(first["explained"], values / trace, rtol=1e-9)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"

    def of(rows):
        return whitening.by_component(whitening.whiten(spark.createDataFrame(rows, schema))).collect()

    assert of([]) == [] and of([(1, None)]) == [] and of([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    line = of([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [3.0, 1.0])])  # one direction only varies
    assert [r["component"] for r in line] == [1, 1, 1] and abs(line[0]["explained"] - 1) < 1e-12 and np.isclose(sum(r["whitened"] ** 2 for r in line), 3)
    huge = of([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])])
    assert len(huge) == 6 and all(np.isfinite(r["whitened"]) for r in huge)


# --- exact copies --------------------------------------------------------------------------------------------------


def plain_copies(rows):
    """rows of (id, text): id, id that stays, size of the group, digest; and how many stay."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    keep = {k: min(v, key=lambda x: x[:3])[3] for k, v in groups.items()}
    out = Counter()
    for i, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out[i, keep[bare], len(groups[bare]), hashlib.sha256(bare.encode()).hexdigest()] += 1
    return out, len(groups)


@pytest.mark.parametrize("how", [{}, {"bits": 4, "bucket": 1000, "combined": 20_000}, {"bits": 0}])
@pytest.mark.parametrize("colliding", [False, True])
def test_copies_are_the_plain_ones(spark, docs, monkeypatch, how, colliding):
    if colliding:  # seven keys for all texts: every chain has many links
        monkeypatch.setattr(exact_dedup, "key_of", lambda c: (F.pmod(F.length(c), F.lit(7)) - 3).cast("long") * (1 << 60))
    spaced = docs.where("doc_id % 9 = 2").select(F.col("doc_id") + 5_000_000, F.concat(F.lit("\n\t "), F.replace("text", F.lit(" "), F.lit("\x0b  "))))
    all_docs = docs.select("doc_id", "text").union(spaced.toDF("doc_id", "text"))
    want, groups = plain_copies([tuple(r) for r in all_docs.collect()])
    got = exact_dedup.copies(all_docs.withColumn("key", F.lit(0)).withColumn("ties", F.lit(1)), **how).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == groups and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_copies_by_other_ids_and_of_nothing(spark, docs):
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("name"), F.col("text").alias("body"))
    got = exact_dedup.copies(named, "name", "body").collect()
    assert len(got) == docs.count() and {tuple(r)[4] for r in got} == {tuple(r)[4] for r in exact_dedup.copies(docs).collect()}
    assert exact_dedup.copies(docs.limit(0)).count() == 0


def test_a_hot_text_is_one_entry_a_task(spark):
    hot = spark.range(0, 9000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("same "), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int")))).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.copies(hot)
    assert got.where("kept").count() == 3001 and got.where("group_size = 6000").select("keep_id").distinct().collect() == [(4,)]


def test_directory_doubles_where_it_is_full():
    cells = np.array([1, 1, 1, 1, 90, 1, 1, 1])
    found = exact_dedup.directory(cells, 10)
    assert found.depth == 3 and found.depths.tolist() == [1, 3, 3, 2] and found.buckets.tolist() == [0, 0, 0, 0, 1, 2, 3, 3] and found.sizes.tolist() == [4, 90, 1, 2]
    assert exact_dedup.directory(cells, 1000).depth == 0 and exact_dedup.directory(np.zeros(16), 0).buckets.tolist() == [0]
    owners = found.owners(3)
    assert (np.diff(owners) >= 0).all() and owners.max() < 3
    for capacity in (1, 5, 50):  # every slot of a bucket, and no other, is its key range
        d = exact_dedup.directory(np.arange(64), capacity)
        assert (np.bincount(d.buckets) == 1 << (d.depth - d.depths)).all() and (np.diff(d.buckets) >= 0).all() and d.sizes.sum() == np.arange(64).sum()
