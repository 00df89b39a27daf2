"""Line features, chains and scores against plain loops."""

import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import quality, queries
from factloom.llm.common import held_out, table

SF = "/root/testdata/sf0.001"


def plain_features(text):
    """The fourteen features of every line, byte by byte."""
    lines = text.encode().split(b"\n")
    known, out = Counter(lines), []
    for line in lines:
        upper = sum(65 <= b <= 90 for b in line)
        digit = sum(48 <= b <= 57 for b in line)
        space = sum(b in (9, 11, 12, 13, 32) for b in line)
        stop = sum(chr(b) in ".,;:?'" for b in line)
        letters = upper + sum(97 <= b <= 122 or b >= 0xC0 for b in line)
        symbol = len(line) - letters - digit - space - stop - sum(0x80 <= b < 0xC0 for b in line)
        words = [w for w in line.replace(b"\t", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
        alike = lambda a, b: len(a) == len(b) and sum(a) == sum(b) and a[0] == b[0]
        again = sum(alike(a, b) for a, b in zip(words, words[1:]))
        full, n = max(len(line), 1), max(len(words), 1)
        out.append([
            math.log1p(len(line)) / 8, upper / max(letters, 1), digit / full, 10 * stop / full, 5 * symbol / full,
            min((len(line) - space) / n / 10, 3), 5 * space / full, again / n, bool(line) and known[line] > 1,
            line[-1:] in (b".", b"?"), line[:1].isupper() or line[:1] >= b"\xc0", min(symbol / n, 3), min(len(words) / (stop + 1) / 20, 3), not line,
        ])
    return np.array(out, float), np.array([len(x) for x in lines])


def plain_score(model, text):
    """Share of good text by forward-backward in plain loops, through the curve."""
    x, size = plain_features(text)
    n, zero = len(x), np.zeros(quality.OWN)
    node = []
    for i in range(n):
        z = np.concatenate([x[i], x[i - 1] if i else zero, x[i + 1] if i < n - 1 else zero, [i == 0, i == n - 1]])
        node.append(float((z - model.mean) / model.spread @ model.weights + model.bias))
    move = np.exp(model.step)
    local = [np.array([1.0, math.exp(max(-27, min(27, s)))]) for s in node]
    ahead = [local[0] / local[0].sum()]
    for s in local[1:]:
        a = (ahead[-1] @ move) * s
        ahead.append(a / a.sum())
    back = [np.ones(2)]
    for s in reversed(local[1:]):
        b = move @ (s * back[0])
        back.insert(0, b / b.sum())
    good = [a[1] * b[1] / (a @ b) for a, b in zip(ahead, back, strict=True)]
    weight = np.maximum(size, 1)
    p = min(max(float(np.dot(good, weight) / weight.sum()), 1e-3), 1 - 1e-3)
    return 1 / (1 + math.exp(-(model.slope * math.log(p / (1 - p)) + model.shift)))


ODD = ["One line.\nTwo TWO two two!!\n\nOne line.", "", "x" * 500, "\n\n", "é ü 12 | 34\n" * 60, "\r\t \x0b\n a  b", "a\n" * 300 + "b", "same same\nsame same\nÉtat"]


def test_line_features_are_the_plain_ones():
    x, size, lines = quality._together([t.encode() for t in ODD])
    for t, a, b in zip(ODD, lines[:-1], lines[1:], strict=True):
        want, sizes = plain_features(t)
        assert np.allclose(x[a:b], want) and size[a:b].tolist() == sizes.tolist()
        alone = quality.line_features(t.encode())
        assert np.allclose(alone[0], want) and alone[1].tolist() == sizes.tolist()


@pytest.mark.parametrize("span", [64, 2, 1])
def test_marginals_are_the_plain_ones(span, monkeypatch):
    monkeypatch.setattr(quality, "SPAN", span)
    rng = np.random.default_rng(9)
    node, step, lines = rng.normal(size=17), rng.normal(size=(2, 2)), np.array([0, 4, 5, 9, 17])
    good, pairs = quality.Chains(lines).marginals(node, step, pairs=True)
    together = np.zeros((2, 2))
    for a, b in zip(lines[:-1], lines[1:], strict=True):
        total, mass, move = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for ys in product((0, 1), repeat=b - a):
            w = np.exp(sum(node[a + i] * y for i, y in enumerate(ys)) + sum(step[ys[i], ys[i + 1]] for i in range(b - a - 1)))
            total, mass = total + w, mass + w * np.array(ys)
            for i in range(b - a - 1):
                move[ys[i], ys[i + 1]] += w
        assert np.allclose(mass / total, good[a:b], atol=1e-5)
        together += move / total
    assert np.allclose(together, pairs, atol=1e-4)


def test_query_scores_every_document_as_plain_loops_do(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r for r in queries.op4_quality(spark, SF).collect()}
    given = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held")).collect()
    assert len(rows) == len(given)
    for r in given:
        want = plain_score(model, r.text or "")
        assert rows[r.doc_id].score == pytest.approx(want, abs=2e-4) and rows[r.doc_id].held_out == r.held
        assert rows[r.doc_id].predicted == int(rows[r.doc_id].score >= 0.7)


def test_long_texts_are_scored_like_short_ones(spark, monkeypatch):
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    texts = [t for t in ODD if max(map(len, t.split("\n"))) < 60]
    whole = model.score(texts)
    monkeypatch.setattr(quality, "_BLOCK", 64)
    assert np.allclose(model.score(texts), whole, atol=1e-4)
    assert 0 <= model.score(["z" * 10_000])[0] <= 1


def test_fit_is_bounded_in_rows_and_lines(spark, monkeypatch):
    rows = [(1, "hot line\n" * 5)] * 50 + [(i, f"line {i}\nand one\n{'!' * (i % 7)}") for i in range(2, 40)] + [(2, "x\n" * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, y: seen.append((len(texts), sum(len(x) for x, _ in texts))))
    quality.fit(docs, labels, sample=20, most_lines=60)
    assert seen[0][0] <= 20 and 0 < seen[0][1] <= 60


def test_millions_of_short_lines():
    import resource
    import time

    model = quality.Model(np.zeros(44), np.ones(44), np.linspace(-1, 1, 44), 0.1, np.array([[0.5, -0.5], [-0.5, 0.5]]), 1.0, 0.0)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert 0 <= model.score(["\n" * 20_000_000])[0] <= 1
    grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
    assert grown < 700_000 and time.time() - began < 60
