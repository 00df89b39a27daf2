"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as sequences of words: lower-cased runs of letters and digits, and single characters of scripts
written without spaces. An item of m words may differ from a passage by k = floor(rate * m) word edits. It is split into
k + 1 pieces; with at most k edits one piece is untouched, so every passage shows an exact piece hit. Hits are found by one
automaton over all pieces, and around each hit Myers' bit-parallel distance decides.

Items are a stated query set. One of AUTOMATON characters or fewer is brought to the executors in blocks, and every document is
read whole once per block, without a shuffle. A larger one stays in Spark: the hashes of its pieces meet those of the
documents' runs of words by an equi-join, after a bitmap of all pieces has put aside the runs that are none, and every distinct
text is verified together with the items that a piece of it named. Both ways find the same passages.

Edge cases: a null or empty text has no hits; an item of fewer than five words has no budget and is found as it is; one
without words never matches; items of equal text are all reported; repeated documents are reported as often as they occur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import by_text, cut, sized, unused

RATE = 0.2
#: Characters of items in one block, and of all items up to which blocks are used.
BLOCK_CHARS, AUTOMATON = 400_000, 8_000_000
#: Bits of the bitmap of pieces, as a power of two: 16 MB sent to every executor.
BITMAP = 27
#: Texts with a passage whose hashes are sent to every executor; more are joined by shuffle.
SENT = 2_000_000
#: Scripts written without spaces: kana, ideographs, Hangul, Thai.
_SOLID = "฀-๿぀-ヿ㐀-鿿가-힯"
_WORDS = re.compile(rf"[{_SOLID}]|[^\W_{_SOLID}]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least edit distance between ``pattern`` and any stretch of ``text``, and where the first such stretch ends."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    up, down, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(across | up)) & full, up & across
        score += bool(more & top) - bool(less & top)
        more, less = (more << 1) & full, (less << 1) & full
        up, down = (less | ~(vertical | more)) & full, more & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def split(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 stretches of nearly equal length that cover m words."""
    return [(i * m // (k + 1), (i + 1) * m // (k + 1)) for i in range(k + 1)]


class Matcher:
    """Items of one block, ready to be looked for."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items: list[tuple[object, list[str], int]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            words = words_of(text)
            if not words:
                continue
            k = int(rate * len(words))
            for a, b in split(len(words), k):
                pieces.setdefault(f" {' '.join(words[a:b])} ", []).append((len(self.items), a))
            self.items.append((key, words, k))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item, distance, budget, end of the passage in words) of every item in the text, its best passage."""
        words = words_of(text)
        if not words or not self.items:
            return []
        line = f" {' '.join(words)} "
        seen: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int]] = {}
        at_char = at_word = 0
        for end, (size, places) in self.automaton.iter(line):
            start = end - size + 1
            if start >= at_char:
                at_word += line.count(" ", at_char, start)
                at_char = start
                first = at_word
            else:
                first = at_word - line.count(" ", start, at_char)
            for item, offset in places:
                begin = first - offset
                if (item, begin) in seen:
                    continue
                seen.add((item, begin))
                _, pattern, k = self.items[item]
                low = max(0, begin - k)
                distance, stop = myers(pattern, words[low : begin + len(pattern) + k])
                if distance <= k:
                    best[item] = min(best.get(item, (distance, low + stop)), (distance, low + stop))
        return [(self.items[i][0], d, self.items[i][2], stop) for i, (d, stop) in sorted(best.items())]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[object, str]]]:
    block: list[tuple[object, str]] = []
    size = 0
    for row in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        if block and size + len(row[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = RATE,
    block_chars: int = BLOCK_CHARS,
    automaton: int = AUTOMATON,
) -> DataFrame:
    """One row per document and item found in it: id, item, distance and budget in word edits, end_word."""
    kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"`{id_col}` {kind[0]}, `{item_col}` {kind[1]}, distance long, budget long, end_word long"
    names = [id_col, item_col, "distance", "budget", "end_word"]
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if _chars(benchmark, item_text_col) > automaton:
        items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("item_text"))
        found = _joined(slim.select("text"), items, rate)
        keyed = slim.select("id", *_text_key())
        return keyed.join(found, ["k1", "k2"]).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance", "budget", "end_word")

    def search(items: list[tuple[object, str]]) -> DataFrame:
        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = Matcher(items, rate)
            for batch in batches:
                found = [(key, *hit) for key, text in zip(batch["id"], batch["text"], strict=True) for hit in matcher.find(text)]
                yield pd.DataFrame(found, columns=names)

        return slim.mapInPandas(rows, schema)

    out = None
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        out = search(block) if out is None else out.union(search(block))
    return search([]) if out is None else out


def _chars(benchmark: DataFrame, text_col: str) -> int:
    return benchmark.agg(F.sum(F.length(text_col))).first()[0] or 0


def _text_key() -> list[Column]:
    """128 bits of a text, by which repeated texts are one."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]


def _runs(words: list[str], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of words of the given sizes."""
    known = {w: xxhash.xxh64_intdigest(w.encode()) for w in set(words)}
    codes = np.array([known[w] for w in words], np.uint64)
    hashes, places = [], []
    for n in sizes:
        if n <= len(codes):
            h = np.full(len(codes) - n + 1, np.uint64(n))
            for k in range(n):
                h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
                h ^= h >> np.uint64(29)
            hashes.append(h)
            places.append(np.arange(len(h)))
    if not hashes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(hashes).view(np.int64), np.concatenate(places)


def _joined(texts: DataFrame, items: DataFrame, rate: float) -> DataFrame:
    """(k1, k2, item, distance, budget, end_word): passages of items in every distinct text, with the items left in Spark."""
    spark = texts.sparkSession
    kind = items.schema["item"].dataType.simpleString()

    def pieces_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["item_text"], strict=True):
                words = words_of(text)
                for a, b in split(len(words), int(rate * len(words))) if words else []:
                    rows.append((item, text, int(_runs(words[a:b], [b - a])[0][0]), b - a, a))
            yield pd.DataFrame(rows, columns=["item", "item_text", "hash", "n", "at"])

    pieces = cut(items.mapInPandas(pieces_of, f"item {kind}, item_text string, hash long, n int, at int"), "pieces")
    sizes = sorted(r["n"] for r in pieces.select("n").distinct().collect())  # 1 / rate at most
    place = F.shiftrightunsigned("hash", 64 - BITMAP)
    parts = pieces.select(F.shiftright(place, 15).cast("int").alias("part"), place.bitwiseAND(F.lit(32767)).alias("bit")).distinct()
    bits = np.zeros((1 << (BITMAP - 15), 4096), np.uint8)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        bits[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(bits.ravel())

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = sent.value
        for batch in batches:
            for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"], strict=True):
                h, at = _runs(words_of(text), sizes)
                spot = (h.view(np.uint64) >> np.uint64(64 - BITMAP)).astype(np.int64)
                good = (have[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
                yield pd.DataFrame({"k1": k1, "k2": k2, "hash": h[good], "first": at[good]})

    keyed = texts.where("text IS NOT NULL").select(*_text_key(), "text").groupBy("k1", "k2").agg(F.min("text").alias("text"))
    keyed = cut(keyed, "texts")
    met = keyed.mapInPandas(hits, "k1 long, k2 long, hash long, first long").join(pieces, "hash")
    asked = met.groupBy("k1", "k2", "item", "item_text").agg(F.collect_set(F.col("first") - F.col("at")).alias("begins"))

    def verified(key: tuple, text: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        words = words_of(text["text"].iloc[0]) if len(text) else []
        for item, said, begins in zip(found["item"], found["item_text"], found["begins"], strict=True):
            pattern = words_of(said)
            k = int(rate * len(pattern))
            best = None
            for begin in sorted(begins):
                low = max(0, int(begin) - k)
                distance, stop = myers(pattern, words[low : int(begin) + len(pattern) + k])
                if distance <= k:
                    best = min(best or (distance, low + stop), (distance, low + stop))
            if best:
                rows.append((*key, item, best[0], k, best[1]))
        return pd.DataFrame(rows, columns=["k1", "k2", "item", "distance", "budget", "end_word"])

    both = keyed.join(asked.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").groupBy("k1", "k2").cogroup(asked.groupBy("k1", "k2"))
    return both.applyInPandas(verified, f"k1 long, k2 long, item {kind}, distance long, budget long, end_word long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS, automaton: int = AUTOMATON) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no passage of any item."""
    if _chars(benchmark, "text") > automaton:
        texts = docs.select(F.col(f"`{text_col}`").alias("text"))
        found = _joined(texts, benchmark.select(F.lit(0).alias("item"), F.col("text").alias("item_text")), rate)
        leaky = sized(cut(found.select("k1", "k2").distinct(), "leaky"), SENT)
        k1, k2 = unused(docs, "k1"), unused(docs, "k2")
        leaky = leaky.withColumnsRenamed({"k1": k1, "k2": k2})
        same = (F.xxhash64(F.col(f"`{text_col}`")) == F.col(k1)) & (F.xxhash64(F.lit(1), F.col(f"`{text_col}`")) == F.col(k2))
        return docs.join(leaky, same, "left_anti")

    def clean(block: list[tuple[object, str]]) -> Column:
        made: list[Matcher] = []

        def of(texts: list[str | None]) -> list[bool]:
            if not made:
                made.append(Matcher(block, rate))
            return [not made[0].find(t) for t in texts]

        return by_text(T.BooleanType(), of, F.col(text_col))

    for block in blocks(benchmark, block_chars=block_chars):
        docs = docs.where(clean(block))
    return docs
