"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character 1- to 3-grams of the lower-cased text, runs of anything but letters taken as one space, hashed to
DIMS buckets; term frequencies are relative, document frequencies are counted over every training document. The
regression is trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample per language, and
its probabilities are calibrated by one temperature, fitted on a further part of the sample. Whole texts are used, to
train and to predict.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. Rows with a null language, or held out, are
never learned from; nor, beyond LANGUAGES languages, are those of the rarest, whose texts get a learned one. With no
training rows every text is ``und``; with one language every text with letters is that. Repeated rows stay and get equal results. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import by_text, held_out, unused

DIMS = 1 << 15
UNKNOWN = "und"
#: The sample that the regression is fitted on: distinct rows per language at most, by hash of id and text (a tenth of them
#: sets the temperature), and languages at most, the most frequent ones. The driver holds 0.5 MB of state a language.
SAMPLE, LANGUAGES = 1_500, 1_000
EPOCHS, BATCH = 6, 16
#: Relative term frequencies are multiplied by this, so that features are of the order of one.
SCALE = 64.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.002
#: Characters that one block of texts holds.
_BLOCK = 1 << 16

_LETTER = np.zeros(0x110000, bool)


def _letters() -> np.ndarray:
    if not _LETTER[ord("a")]:
        for c in range(0x110000):
            if chr(c).isalpha():
                _LETTER[c] = True
    return _LETTER


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the texts, and one space for every run of anything else, as code points; and where each text's begin
    (one more entry than texts). A text starts with its first letter and ends with a space; texts without letters have none."""
    joined = np.frombuffer("".join([t + "\n" for t in texts]).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    letter = _letters()[joined]
    # Keep letters, and the first of every run of others; a text's first character that is no letter is dropped.
    fresh = np.empty(len(joined), bool)
    fresh[:1] = False
    fresh[1:] = letter[:-1]
    keep = letter | fresh
    return np.where(letter, joined, 32)[keep].astype(np.uint32), np.searchsorted(owner[keep], np.arange(len(texts) + 1))


def _long_codes(text: str) -> np.ndarray:
    """The same for one long text, piece by piece."""
    parts, before = [], False
    for start in range(0, len(text) + 1, _BLOCK):
        piece = np.frombuffer((text[start : start + _BLOCK] + ("\n" if start + _BLOCK > len(text) else "")).encode("utf-32-le"), np.uint32)
        letter = _letters()[piece]
        fresh = np.append(before, letter[:-1])[: len(letter)]
        parts.append(np.where(letter, piece, 32)[letter | fresh].astype(np.uint32))
        before = bool(letter[-1]) if len(letter) else before
    return np.concatenate(parts)


def _grams(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams that start at each code; one that would run into the next text counts as the 1-gram."""
    wide = codes.astype(np.uint64)
    grams = np.empty((len(codes), 3), np.int32)
    for n, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (3, 0x165667B19E3779F9)):
        h = np.full(len(codes), np.uint64(salt))
        for k in range(n):
            h[: len(codes) - k] = (h[: len(codes) - k] ^ wide[k:]) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
        grams[:, n - 1] = (h >> np.uint64(20)) % np.uint64(DIMS)
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(codes))
    for n in (2, 3):
        over = left < n
        grams[over, n - 1] = grams[over, 0]
    return grams.ravel()


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Buckets of the lower-cased texts' n-grams in blocks of bounded size: numbers of the texts, buckets, and where each
    one's begin. A text longer than a block comes in several, which hold each of its n-grams once."""
    numbers: list[int] = []
    block: list[str] = []
    size = 0

    def flush() -> tuple[list[int], np.ndarray, np.ndarray]:
        codes, ends = _codes(block)
        return numbers, _grams(codes, ends), ends * 3

    for i, t in enumerate(texts):
        low = (t or "").lower()
        if len(low) > _BLOCK:
            codes = _long_codes(low)
            for start in range(0, len(codes), _BLOCK):
                # Two codes more, so that n-grams over the cut are whole; those that start there belong to the next.
                part = codes[start : start + _BLOCK + 2]
                grams = _grams(part, np.array([0, len(part)]))[: 3 * _BLOCK] if start + _BLOCK < len(codes) else _grams(part, np.array([0, len(part)]))
                yield [i], grams, np.array([0, len(grams)])
            continue
        if block and size + len(low) > _BLOCK:
            yield flush()
            numbers, block, size = [], [], 0
        numbers.append(i)
        block.append(low)
        size += len(low) + 1
    if block:
        yield flush()


def _sums(table: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the table's rows over each text's n-grams."""
    out = np.zeros((len(ends) - 1, table.shape[1]))
    full = ends[1:] > ends[:-1]
    if full.any():
        out[full] = np.add.reduceat(table[grams], ends[:-1][full], axis=0, dtype=np.float64)
    return out


@dataclass
class Model:
    """Weights already multiplied by inverse document frequency, and by one over the temperature."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for numbers, grams, ends in _blocks(texts):
            np.add.at(total, numbers, _sums(self.table, grams, ends))
            np.add.at(count, numbers, np.diff(ends))
        p = _softmax(total / np.maximum(count, 1)[:, None] + self.bias)
        best = p.argmax(axis=1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, count > 0, strict=True)]
        return names, np.where(count > 0, p[np.arange(len(p)), best], 0.0).tolist()


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by follow-the-regularised-leader with elastic net, in batches; rows are (buckets, values)."""
    z, n = np.zeros((DIMS + 1, n_classes)), np.zeros((DIMS + 1, n_classes))
    rng = np.random.default_rng(3)
    one = np.array([DIMS]), np.array([1.0])

    def weights(at: np.ndarray) -> np.ndarray:
        zi, ni = z[at], n[at]
        l1 = np.where(at == DIMS, 0.0, L1)[:, None]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            picked = order[start : start + BATCH]
            at, slot = np.unique(np.concatenate([np.concatenate([rows[i][0], one[0]]) for i in picked]), return_inverse=True)
            value = np.concatenate([np.concatenate([rows[i][1], one[1]]) for i in picked])
            row = np.repeat(np.arange(len(picked)), [len(rows[i][0]) + 1 for i in picked])
            x = np.zeros((len(picked), len(at)))
            np.add.at(x, (row, slot), value)
            w = weights(at)
            p = _softmax(x @ w)
            p[np.arange(len(picked)), y[picked]] -= 1
            g = x.T @ p / len(picked)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = np.concatenate([weights(np.arange(a, min(a + 4096, DIMS + 1))) for a in range(0, DIMS + 1, 4096)])
    return w[:DIMS], w[DIMS]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by a search over a grid."""
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def document_frequencies(texts: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts, over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMS, np.int64), 0
        seen = np.zeros(DIMS, bool)
        for batch in batches:
            last = -1
            for numbers, grams, ends in _blocks(batch[text_col].tolist()):
                for i, a, b in zip(numbers, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if i != last:
                        at = np.flatnonzero(seen)
                        total[at] += 1
                        n += len(at) > 0
                        seen[at], last = False, i
                    seen[grams[a:b]] = True
            at = np.flatnonzero(seen)
            total[at] += 1
            n += len(at) > 0
            seen[at] = False
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], n)})

    counted = texts.select(text_col).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIMS), 0
    for r in counted:  # one row per bucket at most
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, n


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, most_languages: int = LANGUAGES) -> Model:
    """Learn from rows that have a language and are not held out: document frequencies from all of them, weights from at most
    ``sample`` distinct rows of each of the ``most_languages`` most frequent languages."""
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((DIMS, 0)), np.zeros(0))
    df, n = document_frequencies(train, "text")
    idf = np.where(df > 0, np.log((1 + n) / (1 + df)) + 1, 0.0)

    # A share of each language's texts by hash, a little more than ``sample`` of them; of repeated rows one. Then exactly the first ``sample``.
    spark = docs.sparkSession
    shares = spark.createDataFrame([(lang, min(1.0, (sample + 4 * sample**0.5) / c)) for lang, c in counts.items()], "lang string, share double")
    place = F.shiftrightunsigned(F.xxhash64("id", "text", F.lit(17)), 11) / F.lit(float(1 << 53))
    placed = train.join(F.broadcast(shares), "lang").withColumn("place", place).where("place < share")
    picked = placed.groupBy("lang", "place").agg(F.min("text").alias("text"))
    picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("rank") <= sample)

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, values = [], []
            for text in batch["text"]:
                c = sum((np.bincount(grams, minlength=DIMS) for _, grams, _ in _blocks([text])), np.zeros(DIMS, np.int64))
                b = np.flatnonzero(c)
                at.append(b.astype(np.int32).tobytes())
                values.append((c[b] * SCALE / max(1, c.sum())).astype(np.float32).tobytes())
            yield pd.DataFrame({"lang": batch["lang"], "place": batch["place"], "at": at, "values": values})

    # A row of the sample is at most DIMS buckets, whatever the length of its text.
    sampled = picked.select("lang", "text", "place").mapInPandas(rows_of, "lang string, place double, at binary, values binary").toPandas()
    sampled = sampled.sort_values(["place", "lang", "at"]).reset_index(drop=True)
    number = {lang: i for i, lang in enumerate(languages)}
    y = sampled["lang"].map(number).to_numpy(np.int64)
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32) * idf[np.frombuffer(a, np.int32)]) for a, v in zip(sampled["at"], sampled["values"], strict=True)]
    aside = np.arange(len(rows)) % 10 == 9
    fitted = np.flatnonzero(~aside)
    w, b = _ftrl([rows[i] for i in fitted], y[fitted], len(languages))
    rest = np.flatnonzero(aside)
    t = 1.0
    if len(rest) >= 20 and len(languages) > 1:
        t = _temperature(np.stack([rows[i][1] @ w[rows[i][0]] + b for i in rest]), y[rest])
    return Model(languages, (w * idf[:, None] * SCALE / t).astype(np.float32), b / t)


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability; columns of these two names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: list[str | None]) -> list[dict]:
        return [{"lang_pred": name, "score": score} for name, score in zip(*shared.value.predict(texts), strict=True)]

    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    kept = [f"`{c}`" for c in docs.columns if c not in (pred_col, score_col)]
    said = unused(docs, "said")
    told = docs.select(*kept, by_text(kind, predict, F.col(text_col)).alias(said))
    return told.select(*kept, F.col(f"{said}.lang_pred").alias(pred_col), F.col(f"{said}.score").alias(score_col))
