"""SimHash near-duplicates: pivot distance tables, exact verification, connected components.

Fingerprints are 64 bits over word shingles; two fingerprints link if they differ in at most RADIUS bits. Documents of one
fingerprint are one node. Every node has a table of Hamming distances to reference fingerprints. References come as a few
base ones and, of each, others that have all bits of one group turned: what a node's distance changes by between the two
says how far it is from the base within that group. Two nodes that link differ in two bits, hence in two groups, at most; in
every other group all their coordinates agree. So candidates are found by an equi-join on coordinates, and no link escapes:

1. groups are the four quarters: nodes meet that agree in the coordinates of two of them;
2. nodes of crowded cells are dealt anew by finer references, whose groups are the eight octets: they meet where they
   agree in six of them;
3. nodes of cells that are still crowded differ in 16 bits only; references with one bit turned deal them by all but two
   of these bits, so that four nodes meet at most.

Candidates whose tables differ by more than RADIUS in any coordinate are discarded, the others verified bit by bit. Plain
references without groups could not be joined on: within RADIUS of a distance lies a third of all fingerprints, and their
neighbouring values would have to be tried for each coordinate of a key.

Edge cases: a null or empty text, or one of white space, has fingerprint zero and links like any other; a text of fewer
words than a shingle is one shingle. Repeated rows keep their number. A null id is kept and never names a component
that has another id. An empty table gives no rows. Whole texts are read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import by_text, components, cut, scratch

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Nodes of one cell that are compared with each other; a cell with more is dealt by further references.
PAIRED = 48
#: Base references, from a fixed seed.
BASES = [int(p) for p in np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 6)]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: Bits of each group, as numbers.
QUARTERS = [_signed(0xFFFF << 16 * i) for i in range(4)]
OCTETS = [_signed(0xFF << 8 * i) for i in range(8)]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of a text: A-Z lower-cased, ASCII white space between words, repeats counted."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(joined, seed)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = ends - sizes
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)])
    return majority(np.frombuffer(hashes, np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, rows of eight bytes, as a signed number; 0 without any."""
    if len(hashes) > 512:
        counts = np.concatenate([np.bincount(hashes[:, i], minlength=256) @ _BITS for i in range(8)])
    else:
        counts = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): every row's fingerprint as a signed long."""

    fp = by_text(T.LongType(), lambda texts: [fingerprint(t, shingle) for t in texts], F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), fp.alias("fp"))


def _apart(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(b).cast("long") if isinstance(b, int) else b))


def _table(groups: list[int]) -> tuple[list[Column], list[list[Column]]]:
    """Distances of ``fp`` to the bases, and for each group to the bases with the group's bits turned."""
    return [_apart(F.col("fp"), p) for p in BASES], [[_apart(F.col("fp"), p ^ g) for p in BASES] for g in groups]


def _within(own: list[Column], turned: list[Column]) -> list[Column]:
    """Coordinates of one group: twice the distance to each base within it, less the group's size."""
    return [a - b for a, b in zip(own, turned, strict=True)]


def _cells(nodes: DataFrame, paired: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with the cells that they share with others, split into those of few nodes and of many."""
    sizes = nodes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(nodes.join(sizes, "cell"), "cells")
    return shared.where(F.col("n") <= paired), shared.where(F.col("n") > paired)


def _pairs(met: DataFrame) -> DataFrame:
    """Linked pairs (a, b), a < b, of nodes that meet in a cell: first the tables are compared, then the bits."""
    own, turned = _table(QUARTERS)
    table = {f"d{i}": d.cast("tinyint") for i, d in enumerate([*own, *(d for group in turned for d in group)])}
    rows = met.select("cell", "fp", *[d.alias(name) for name, d in table.items()])
    a, b = rows.alias("a"), rows.alias("b")
    close = reduce(lambda x, y: x & y, [F.abs(F.col(f"a.{d}") - F.col(f"b.{d}")) <= RADIUS for d in table])
    linked = close & (_apart(F.col("a.fp"), F.col("b.fp")) <= RADIUS)
    pairs = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & linked)
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def links(nodes: DataFrame, paired: int = PAIRED) -> DataFrame:
    """All pairs (a, b), a < b, of nodes (column ``fp``, distinct) within RADIUS bits of each other."""
    own, turned = _table(QUARTERS)
    placed = nodes.select("fp", *[F.xxhash64(*_within(own, t)).alias(f"g{i}") for i, t in enumerate(turned)])
    met = [F.xxhash64(F.lit(n), f"g{i}", f"g{j}") for n, (i, j) in enumerate(combinations(range(4), 2))]
    few, many = _cells(placed.select("fp", F.explode(F.array(*met)).alias("cell")), paired)

    own, turned = _table(OCTETS)
    placed = many.select("fp").distinct().select("fp", *[F.xxhash64(*_within(own, t)).alias(f"g{i}") for i, t in enumerate(turned)])
    met = [
        F.struct(F.xxhash64(F.lit(n), *[f"g{k}" for k in range(8) if k not in free]).alias("cell"), F.lit(8 * free[0]).alias("low"), F.lit(8 * free[1]).alias("high"))
        for n, free in enumerate(combinations(range(8), 2))
    ]
    finer = placed.select("fp", F.explode(F.array(*met)).alias("met")).select("fp", "met.*")
    few2, many2 = _cells(finer, paired)

    # Of the 64 references that turn one bit of a base each coordinate is one bit of this number.
    bits = F.col("fp").bitwiseXOR(F.lit(BASES[0]).cast("long"))
    left_out = F.array(*[F.lit((1 << i) | (1 << j)) for i, j in combinations(range(16), 2)])
    mask = F.expr("shiftleft(cast(two & 255 AS bigint), low) | shiftleft(cast(two >> 8 AS bigint), high)")
    last = many2.select("fp", "low", "high", F.explode(left_out).alias("two")).select("fp", mask.alias("mask"))
    last = last.select("fp", F.xxhash64("mask", bits.bitwiseAND(F.bitwise_not("mask"))).alias("cell")).distinct()
    return _pairs(few).union(_pairs(few2)).union(_pairs(last)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, paired: int = PAIRED) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id, the least id among all documents that a
    chain of links reaches, itself included."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    with scratch(docs.sparkSession):
        nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
        labels = components(links(nodes.select("fp"), paired))
        linked = labels.join(nodes, labels["node"] == nodes["fp"]).select("fp", "label", "least")
        least = linked.groupBy("label").agg(F.min("least").alias("component"))
        joined = linked.join(least, "label").select("fp", "component")
        alone = nodes.join(labels, nodes["fp"] == labels["node"], "left_anti").where("n > 1").select("fp", F.col("least").alias("component"))
        # Only fingerprints of several documents or with links need looking up; a hot one is split by adaptive skew handling.
        known = cut(joined.union(alone), "components", keep=True)
    return prints.join(known, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "id").alias("component_id")
    )
