"""Quality by a linear-chain conditional random field over lines.

Every line of a text gets features of its own characters and words and those of the lines before and after it. A chain
over the lines with two states, bad and good, is fitted to documents labelled as a whole (each line carries its
document's label). Forward-backward marginals, weighted by line length, give a document's share of good text, which a
logistic curve fitted on the sample turns into a score.

The fit uses SAMPLE distinct labelled rows and LINES lines at most, in the order of a hash of id and text; every document is
scored whole. Lines are measured in blocks and folded at once into one number each, and chains run in segments side by side, so a
long text takes some 20 bytes a line beside itself and a number of steps that grows with the root of its lines.

Edge cases: a null text is an empty one, which has one empty line and gets a score like any other; a line of more than
256 KB counts as several in a text of more than that; rows whose label is null are never learned from; ids labelled more
than once count with their lowest label; without labelled rows, or with one label only, all scores are the share of good
labels (0.5 without any). Repeated rows stay and get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import by_text, held_out

#: Labelled rows that the chain is fitted on at most, and lines of all of them together.
SAMPLE, LINES = 6_000, 500_000
#: Lines of one segment at least.
SPAN = 64
STEPS, RATE, DECAY = 250, 0.08, 1e-3
#: Score from which a document counts as good.
GOOD = 0.7
#: Features of a line, and which of them says that it is repeated in its text.
OWN, REPEATED = 14, 8
_BLOCK = 1 << 18

_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL, _INNER, _LEAD, _END = range(9)


def _classes() -> np.ndarray:
    of = np.full(256, _SYMBOL, np.int64)
    of[ord("a") : ord("z") + 1] = _LOWER
    of[ord("A") : ord("Z") + 1] = _UPPER
    of[ord("0") : ord("9") + 1] = _DIGIT
    of[[9, 11, 12, 13, 32]] = _SPACE
    of[[ord(c) for c in ".,;:?'"]] = _STOP
    of[0x80:0xC0], of[0xC0:] = _INNER, _LEAD
    of[10] = _END
    return of


_CLASS = _classes()


def _measure(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, marks) of the lines of ``data``, which end at ``ends``; equal lines have equal marks."""
    starts = np.concatenate(([0], ends[:-1] + 1))
    n, size = len(ends), ends - starts
    kind = _CLASS[data]
    count = np.bincount(np.repeat(np.arange(n) * 9, size + 1) + kind, minlength=9 * n).reshape(n, 9)
    letters = count[:, _LOWER] + count[:, _UPPER] + count[:, _LEAD]

    gap = (kind == _SPACE) | (kind == _END)
    first = ~gap
    first[1:] &= gap[:-1]
    words = np.flatnonzero(first)
    of_line = np.searchsorted(ends, words)
    n_words = np.bincount(of_line, minlength=n)
    again = np.zeros(n)
    if len(words) > 1:
        total = np.add.reduceat(np.where(gap, 0, data), words, dtype=np.int64)
        letters_in = np.add.reduceat(~gap, words, dtype=np.int64)
        same = (total[1:] == total[:-1]) & (letters_in[1:] == letters_in[:-1]) & (data[words[1:]] == data[words[:-1]]) & (of_line[1:] == of_line[:-1])
        again = np.bincount(of_line[1:][same], minlength=n)

    plain = np.add.reduceat(data, starts, dtype=np.int64)
    weighed = np.add.reduceat(data * np.arange(len(data), dtype=np.int64), starts) - starts * plain
    mark = size * np.int64(8191) + plain * np.int64(131) + weighed * np.int64(524_287)

    full = np.maximum(size, 1)
    last = data[np.maximum(ends - 1, starts)]
    x = np.stack([
        np.log1p(size) / 8,
        count[:, _UPPER] / np.maximum(letters, 1),
        count[:, _DIGIT] / full,
        10 * count[:, _STOP] / full,
        5 * count[:, _SYMBOL] / full,
        np.minimum((size - count[:, _SPACE]) / np.maximum(n_words, 1) / 10, 3),
        5 * count[:, _SPACE] / full,
        again / np.maximum(n_words, 1),
        np.zeros(n),  # whether the line is repeated, which only its whole text can tell
        np.isin(last, [ord(c) for c in ".?"]) & (size > 0),
        np.isin(kind[starts], [_UPPER, _LEAD]),
        np.minimum(count[:, _SYMBOL] / np.maximum(n_words, 1), 3),
        np.minimum(n_words / (count[:, _STOP] + 1) / 20, 3),
        size == 0,
    ], axis=1).astype(np.float64)
    return x, size, mark


def _pieces(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of whole lines of a text, and where their lines end; a line longer than a block is cut."""
    at = 0
    while at + _BLOCK < len(data):
        part = data[at : at + _BLOCK]
        ends = np.flatnonzero(part == 10)
        if len(ends):
            part = part[: ends[-1] + 1]
            at += len(part)
        else:
            part, ends = np.append(part, np.uint8(10)), np.array([_BLOCK])
            at += _BLOCK
        yield part, ends
    part = np.append(data[at:], np.uint8(10))
    yield part, np.flatnonzero(part == 10)


def _repeated(mark: np.ndarray) -> np.ndarray:
    """Which marks occur more than once."""
    ranked = np.sort(mark)
    many = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(many):
        return np.zeros(len(mark), bool)
    return many[np.minimum(np.searchsorted(many, mark), len(many) - 1)] == mark


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(features of every line, its length in bytes) of one text."""
    parts = [_measure(*piece) for piece in _pieces(np.frombuffer(text, np.uint8))]
    x, size, mark = (np.concatenate(p) for p in zip(*parts, strict=True))
    full = np.flatnonzero(size)
    x[full, REPEATED] = _repeated(mark[full])
    return x, size


def _together(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, where each text's lines begin, with one entry more) of short texts, measured together."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lines = np.array([0, *(t.count(b"\n") + 1 for t in texts)]).cumsum()
    x, size, mark = _measure(data, np.flatnonzero(data == 10))
    doc = np.repeat(np.arange(len(texts)), np.diff(lines))
    order = np.lexsort((mark, doc))
    same = (mark[order][1:] == mark[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again = np.zeros(len(mark), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    x[:, REPEATED] = again & (size > 0)
    return x, size, lines


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at a text's ends), and whether there is one."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    top, end = np.zeros(len(x)), np.zeros(len(x))
    top[lines[:-1]], end[lines[1:] - 1] = 1, 1
    before[top == 1], after[end == 1] = 0, 0
    return np.column_stack([x, before, after, top, end])


class Chains:
    """Texts of lines, cut into segments that advance side by side; what goes over a cut is carried by the product of a
    segment's transfer matrices, so the marginals are those of the whole texts."""

    def __init__(self, lines: np.ndarray):
        sizes = np.diff(lines)
        span = max(SPAN, isqrt(int(sizes.max(initial=1))))
        self.count = -(-sizes // span)
        self.head = self.count.cumsum() - self.count
        k = int(self.count.sum())
        place = np.arange(k) - np.repeat(self.head, self.count)
        start = np.repeat(lines[:-1], self.count) + place * span
        size = np.minimum(np.repeat(lines[1:], self.count) - start, span)
        # Longest first, so that those still running are always the first ones.
        self.order = np.argsort(-size, kind="stable")
        self.rank = np.empty(k, np.int64)
        self.rank[self.order] = np.arange(k)
        self.start, self.size, self.first = start[self.order], size[self.order], place[self.order] == 0
        self.live = np.searchsorted(-self.size, -np.arange(int(self.size[0]) + 1), side="left") if k else np.zeros(1, np.int64)

    @staticmethod
    def _local(node: np.ndarray) -> np.ndarray:
        good = 1 / (1 + np.exp(-np.clip(node.astype(np.float64), -27, 27)))
        return np.stack([1 - good, good], axis=-1)

    def _over_cuts(self, node: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(forward vector before each segment, backward vector at its last line)."""
        before, after = np.full((len(self.start), 2), 0.5), np.full((len(self.start), 2), 0.5)
        if self.count.max(initial=1) == 1:
            return before, after
        product = np.tile(np.eye(2), (len(self.start), 1, 1))
        for t in range(len(self.live) - 1):
            k = self.live[t]
            step = move * self._local(node[self.start[:k] + t])[:, None, :]
            if t == 0:
                step[self.first] = self._local(node[self.start[self.first]])[:, None, :]
            product[:k] = product[:k] @ step
            product[:k] /= product[:k].sum(axis=(1, 2), keepdims=True)
        for r in range(int(self.count.max()) - 1):
            doc = np.flatnonzero(self.count > r + 1)
            a, b = self.rank[self.head[doc] + r], self.rank[self.head[doc] + r + 1]
            v = np.einsum("ni,nij->nj", before[a], product[a])
            before[b] = v / v.sum(axis=1, keepdims=True)
            doc = np.flatnonzero(self.count > r + 1)
            a, b = self.rank[self.head[doc] + self.count[doc] - 1 - r], self.rank[self.head[doc] + self.count[doc] - 2 - r]
            v = np.einsum("nij,nj->ni", product[a], after[a])
            after[b] = v / v.sum(axis=1, keepdims=True)
        return before, after

    def marginals(self, node: np.ndarray, step: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Marginal probability of the good state of every line, and with ``pairs`` the sum of pair marginals.

        ``node`` is the score of good over bad per line, ``step`` the 2 x 2 scores of moving from one state to the next."""
        move = np.exp(step - step.max())
        before, back = self._over_cuts(node, move)
        good, seen = np.empty(len(node), np.float32), np.zeros((2, 2))
        a, last = before, np.empty_like(before)
        for t in range(len(self.live) - 1):
            k = self.live[t]
            i = self.start[:k] + t
            local = self._local(node[i])
            a = (a[:k] @ move) * local
            if t == 0:
                a[self.first] = local[self.first]
            a /= a.sum(axis=1, keepdims=True)
            good[i] = a[:, 1]
            last[:k] = a
        first = np.empty_like(before)
        for t in range(len(self.live) - 2, -1, -1):
            k, onward = self.live[t], self.live[t + 1]
            i = self.start[:k] + t
            ahead = np.stack([1 - good[i].astype(np.float64), good[i]], axis=-1)
            if onward:
                then = self._local(node[i[:onward] + 1]) * back[:onward]
                if pairs:
                    p = ahead[:onward, :, None] * move * then[:, None, :]
                    seen += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                v = then @ move.T
                back[:onward] = v / v.sum(axis=1, keepdims=True)
            both = ahead * back[:k]
            good[i] = both[:, 1] / both.sum(axis=1)
        if pairs and self.count.max(initial=1) > 1:
            first[:] = self._local(node[self.start]) * back
            b = np.flatnonzero(~self.first)
            a = self.rank[self.order[b] - 1]
            p = last[a][:, :, None] * move * first[b][:, None, :]
            seen += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        return good, seen


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    step: np.ndarray
    slope: float
    shift: float

    def _folded(self) -> tuple[np.ndarray, float, float, float]:
        """(weights of own features, those as the line before, and those as the line after, side by side; for a first line;
        for a last line; constant), all over features as they are."""
        w = self.weights / self.spread
        return w[: 3 * OWN].reshape(3, OWN).T, float(w[-2]), float(w[-1]), float(self.bias - w @ self.mean)

    def _nodes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of every line, its length, where each text's lines begin) of short texts."""
        x, size, lines = _together(texts)
        w, top, end, const = self._folded()
        own, before, after = (x @ w).T
        node = own + const
        inner = np.ones(len(node), bool)
        inner[lines[:-1]] = False
        i = np.flatnonzero(inner)
        node[i] += before[i - 1]
        node[i - 1] += after[i]
        node[lines[:-1]] += top
        node[lines[1:] - 1] += end
        return node, size, lines

    def _long_nodes(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for one long text, block by block."""
        w, top, end, const = self._folded()
        nodes, sizes, marks, full, n, carry = [], [], [], [], 0, 0.0
        for piece in _pieces(np.frombuffer(text, np.uint8)):
            x, size, mark = _measure(*piece)
            own, before, after = (x @ w).T
            node = own + const
            node[1:] += before[:-1]
            node[:-1] += after[1:]
            if nodes:
                node[0] += carry
                nodes[-1][-1] += after[0]
            carry = before[-1]
            nodes.append(node.astype(np.float32))
            sizes.append(size.astype(np.int32))
            at = np.flatnonzero(size)
            marks.append(mark[at])
            full.append(at + n)
            n += len(size)
        node, size = np.concatenate(nodes), np.concatenate(sizes)
        node[0] += top
        node[-1] += end
        again = np.zeros(n, bool)
        again[np.concatenate(full)] = _repeated(np.concatenate(marks))
        own, before, after = w[REPEATED]
        node += np.float32(own) * again
        node[1:] += np.float32(before) * again[:-1]
        node[:-1] += np.float32(after) * again[1:]
        return node, size, np.array([0, n])

    def lines(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability that each line is good, its length, where each text's lines begin)."""
        node, size, lines = self._long_nodes(texts[0]) if len(texts) == 1 and len(texts[0]) > _BLOCK else self._nodes(texts)
        return Chains(lines).marginals(node, self.step)[0], size, lines

    def share(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean probability of good over each text's lines."""
        good, size, lines = self.lines(texts)
        weight = np.maximum(size, 1)
        return np.add.reduceat(good * weight, lines[:-1], dtype=np.float64) / np.add.reduceat(weight, lines[:-1], dtype=np.float64)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        block: list[int] = []
        held: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if held:
                out[block] = self._curve(self.share(held))
            block.clear()
            held.clear()
            size = 0

        for i, t in enumerate(texts):
            data = (t or "").encode()
            if len(data) > _BLOCK:
                out[i] = self._curve(self.share([data]))[0]
                continue
            if size + len(data) > _BLOCK:
                flush()
            block.append(i)
            held.append(data)
            size += len(data) + 1
        flush()
        return out

    def _curve(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(share) + self.shift)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _adam(gradient, start: np.ndarray, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Fit to texts given as (own line features, line sizes) with one label each."""
    n_features = 3 * OWN + 2
    rate = float(labels.mean()) if len(labels) else 0.5
    if rate in (0.0, 1.0) or not len(labels):
        flat = np.zeros(n_features)
        return Model(flat, flat + 1, flat, 0.0, np.zeros((2, 2)), 0.0, float(_logit(np.array(rate))))
    lines = np.array([0, *(len(x) for x, _ in texts)]).cumsum()
    z = with_neighbours(np.concatenate([x for x, _ in texts]), lines)
    mean, spread = z.mean(axis=0), z.std(axis=0) + 1e-6
    z = (z - mean) / spread
    y = np.repeat(labels, np.diff(lines))
    inner = np.ones(len(y), bool)
    inner[lines[1:] - 1] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i], y[i + 1]), 1)
    chains = Chains(lines)

    def gradient(w: np.ndarray) -> np.ndarray:
        good, pairs = chains.marginals(z @ w[:n_features] + w[n_features], w[n_features + 1 :].reshape(2, 2), pairs=True)
        off = good - y
        g = np.concatenate([z.T @ off, [off.sum()], (pairs - seen).ravel()]) / len(y)
        return g + DECAY * w

    w = _adam(gradient, np.zeros(n_features + 5))
    model = Model(mean, spread, w[:n_features], float(w[n_features]), w[n_features + 1 :].reshape(2, 2), 1.0, 0.0)
    weight = np.maximum(np.concatenate([s for _, s in texts]), 1)
    good = chains.marginals(z @ model.weights + model.bias, model.step)[0]
    share = _logit(np.add.reduceat(good * weight, lines[:-1]) / np.add.reduceat(weight, lines[:-1]))

    def curve(w: np.ndarray) -> np.ndarray:
        off = 1 / (1 + np.exp(-(w[0] * share + w[1]))) - labels
        return np.array([off @ share, off.sum()]) / len(labels)

    slope, shift = _adam(curve, np.array([1.0, 0.0]), steps=600, rate=0.02)
    model.slope, model.shift = max(float(slope), 0.0), float(shift)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most_lines: int = LINES) -> Model:
    """Learn from labelled rows that are not held out: the first by hash, ``sample`` rows and ``most_lines`` lines at most."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("label_id")))
    known = known.groupBy("label_id").agg(F.min("label").cast("int").alias("label"))
    # ``sample`` ids of two small columns: safe to send to every executor. Of rows that agree in id and text one is learned from.
    picked = F.broadcast(known.orderBy(F.xxhash64("label_id", F.lit(23)), "label_id").limit(sample))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(picked, F.col("id") == F.col("label_id"))
    rows = rows.groupBy(F.xxhash64("id", "text", F.lit(23)).alias("place")).agg(F.min("text").alias("text"), F.min("label").alias("label"))
    lines = F.regexp_count("text", F.lit("\n")) + F.ceil(F.octet_length("text") / _BLOCK) + 1
    first = rows.select("place", lines.cast("long").alias("lines")).orderBy("place").limit(sample)
    first = first.withColumn("sum", F.sum("lines").over(Window.orderBy("place"))).where(F.col("sum") <= most_lines)
    rows = rows.join(F.broadcast(first.select("place")), "place", "left_semi")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [line_features(t.encode()) for t in batch["text"]]
            yield pd.DataFrame({
                "place": batch["place"], "label": batch["label"],
                "x": [x.astype(np.float32).tobytes() for x, _ in made], "size": [s.astype(np.int64).tobytes() for _, s in made],
            })

    got = rows.select("place", "label", "text").mapInPandas(features, "place long, label int, x binary, size binary").toPandas()
    got = got.sort_values(["place", "x"]).reset_index(drop=True)
    texts = [(np.frombuffer(x, np.float32).reshape(-1, OWN).astype(np.float64), np.frombuffer(s, np.int64)) for x, s in zip(got["x"], got["size"], strict=True)]
    return train(texts, got["label"].to_numpy(np.int64))


def assess(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    score = by_text(T.DoubleType(), lambda texts: shared.value.score(texts), F.col(text_col))
    return docs.withColumn("score", score).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def label_lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: id, line (from 0), good (probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def lines(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.lines([(t or "").encode()])[0].astype(float).tolist() for t in batch])

    return docs.select(F.col(id_col), F.posexplode(lines(F.col(text_col))).alias("line", "good"))
