"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are identical after all white space ([\\x20\\x09-\\x0D]) is deleted. A text's key is a 64-bit hash
of what is left. The directory starts with one bucket; a bucket that holds too many bytes is split in two by one more
bit of the key, and where its keys use all bits of the directory the directory doubles. It is built from counts of
2 ** ``BITS`` cells of keys at most, and lists buckets in the order of keys, so that every owner task is given a range of keys.

Entries reach their owner in the order of keys: equal texts of one input task as one entry, compared byte by byte
(within ``COMBINED`` bytes of texts; what comes later is one entry more). Only texts whose key occurs twice are sent; an entry without a
text is alone. The owner keeps a chain for the key at hand: an entry joins the link whose bytes are its own, or adds a
link. Chains are written to the shared folder: the index, one row a text. An owner holds the different texts of one key,
never its group, however many copies there are.

Documents get their group by (key, SHA-256 of the text), which names a link: two different texts in a chain that share
both would be an error that stops the job.

Edge cases: a null text counts as empty, and equals all texts of white space; long texts are moved whole. Of equal texts the row with the
most code points stays, then that of least id, a null id last; of rows that agree in id too one stays. Repeated rows
are copies. An empty table gives no rows. Columns of any name may be there; ids of any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.llm.common import cut, scratch, sized

SPACE = r"[\x20\x09-\x0D]+"
#: Bits of a key that the directory can use, bytes of a full bucket, and owner tasks.
BITS, BUCKET, OWNERS = 20, 16 << 20, 20_000
#: What an entry without a text counts for, in bytes.
ENTRY = 64
#: Bytes of texts that an input task compares with before it starts anew.
COMBINED = 32 << 20
#: Keys and groups that are sent to every executor; more are joined by shuffle.
SENT_KEYS, SENT_GROUPS = 1_000_000, 200_000


def normal(text: Column) -> Column:
    """The text without white space; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def key_of(text: Column) -> Column:
    """The key of a normal text."""
    return F.xxhash64(text)


@dataclass
class Directory:
    """2 ** depth slots in the order of keys; ``buckets`` gives each slot's bucket, ``depths`` each bucket's own depth, ``sizes``
    its bytes."""

    depth: int
    buckets: np.ndarray
    depths: np.ndarray
    sizes: np.ndarray

    def owners(self, most: int) -> np.ndarray:
        """The owner of each bucket: ranges of buckets of about equal size."""
        middle = np.cumsum(self.sizes) - self.sizes / 2
        owner = (middle * most / max(float(self.sizes.sum()), 1.0)).astype(np.int64)
        return np.unique(np.clip(owner, 0, most - 1), return_inverse=True)[1]


def directory(cells: np.ndarray, capacity: float) -> Directory:
    """The directory over ``cells``, the bytes of 2 ** bits equal ranges of keys. A range of one cell is split no further: its
    bucket chains."""
    bits = int(len(cells)).bit_length() - 1
    before = np.concatenate([[0], np.cumsum(cells)])
    depth, slots, open_ = 0, [(0, 0)], [(0, 0)]  # a bucket is (first bits of its keys, how many bits)
    full: set[tuple[int, int]] = set()
    while open_:
        prefix, own = bucket = open_.pop()
        first, last = prefix << (bits - own), (prefix + 1) << (bits - own)
        if before[last] - before[first] <= capacity or own == bits:
            full.add(bucket)
            continue
        depth = max(depth, own + 1)  # the directory doubles
        open_ += [(prefix << 1, own + 1), (prefix << 1 | 1, own + 1)]
    slots = sorted(full, key=lambda b: b[0] << (bits - b[1]))
    depths = np.array([own for _, own in slots])
    starts = np.array([prefix << (bits - own) for prefix, own in slots])
    sizes = before[starts + (1 << (bits - depths))] - before[starts]
    return Directory(depth, np.repeat(np.arange(len(slots)), 1 << (depth - depths)), depths, sizes)


def _better(a: tuple, b: tuple) -> bool:
    """Whether (code points, id) a stays before b."""
    return (-a[0], a[1] is None, 0 if a[1] is None else a[1]) < (-b[0], b[1] is None, 0 if b[1] is None else b[1])


def _merge(link: list, n: int, chars: int, who, ties: int) -> None:
    """Count an entry into ``link`` (n, chars, id, ties)."""
    if (chars, who) == (link[1], link[2]):
        link[3] += ties
    elif _better((chars, who), (link[1], link[2])):
        link[1:] = [chars, who, ties]
    link[0] += n


_ENTRY = "key long, sha string, text string, n long, chars long, id {id}, ties long"
_LINK = "bucket long, key long, link int, sha string, n long, chars long, id {id}, ties long"


def _combined(rows: DataFrame, kinds: str, most: int) -> DataFrame:
    """Entries of ``rows`` (key, sha, text, chars, id): equal texts of one task together."""
    shape = to_arrow_schema(rows.sparkSession.createDataFrame([], kinds).schema)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def out(entries: list) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(entries), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*entries[at : at + 256], strict=True), shape, strict=True)], schema=shape)

        for batch in batches:
            alone = []
            for at in range(0, batch.num_rows, 256):
                for key, sha, text, chars, who in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if text is None:
                        alone.append((key, sha, None, 1, chars, who, 1))
                        continue
                    link = held.get(text)  # texts are told apart by all their characters
                    if link is not None:
                        _merge(link[2], 1, chars, who, 1)
                        continue
                    held[text] = (key, sha, [1, chars, who, 1])
                    size += len(text)
                if size > most:
                    yield from out([(k, s, t, *x) for t, (k, s, x) in held.items()])
                    held, size = {}, 0
            yield from out(alone)
        yield from out([(k, s, t, *x) for t, (k, s, x) in held.items()])

    return rows.select("key", "sha", "text", "chars", "id").mapInArrow(combine, kinds)


def _chained(entries: DataFrame, kinds: str) -> DataFrame:
    """The links of ``entries`` (bucket and an entry's columns), which come in the order of keys."""
    shape = to_arrow_schema(entries.sparkSession.createDataFrame([], kinds).schema)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_key, links, done = None, [], []

        def close() -> None:
            if len({sha for _, sha, _ in links}) < len(links):
                raise ValueError(f"two texts of key {at_key[1]} share a SHA-256")
            done.extend((*at_key, i, sha, *link) for i, (_, sha, link) in enumerate(links))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), shape, strict=True)], schema=shape)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for bucket, key, sha, text, n, chars, who, ties in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if (bucket, key) != at_key:
                        if at_key is not None:
                            close()
                        at_key, links = (bucket, key), []
                    own = next((link for other, _, link in links if other == text), None)
                    if own is not None:
                        _merge(own, n, chars, who, ties)
                    else:
                        links.append((text, sha, [n, chars, who, ties]))
                if len(done) >= 4096:
                    yield out()
                    done = []
        if at_key is not None:
            close()
        if done:
            yield out()

    order = ["bucket", "key", "sha", "text", "n", "chars", "id", "ties"]
    return entries.select(order).mapInArrow(chain, kinds)


def index(texts: DataFrame, rows: DataFrame, bits: int = BITS, bucket: int = BUCKET, combined: int = COMBINED) -> DataFrame:
    """The index of ``texts`` (id, text) whose keys, digests and sizes are the stored table ``rows``: one row a text, with
    ``n`` rows that have it, ``id`` and ``chars`` of the one that stays and the number of rows that ``ties`` with it."""
    spark = texts.sparkSession
    # Keys are signed: their order is that of the first bits with the sign turned.
    first_bits = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long")
    keys = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes")), "keys")
    size = F.when(F.col("rows") > 1, F.col("bytes")).otherwise(0) + F.col("rows") * ENTRY
    counted = keys.groupBy(first_bits.alias("cell")).agg(F.sum(size).alias("bytes")).toPandas()
    cells = np.zeros(1 << bits, np.int64)
    cells[counted["cell"].to_numpy(np.int64)] = counted["bytes"].to_numpy(np.int64)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = directory(cells, min(bucket, cells.sum() / (4 * tasks)))
    owners = found.owners(min(OWNERS, max(tasks, int(cells.sum() // (4 * bucket)))))
    slots = pd.DataFrame({"slot": np.arange(len(found.buckets)), "bucket": found.buckets, "owner": owners[found.buckets]})
    slots = spark.createDataFrame(slots, "slot long, bucket long, owner int")

    repeated = keys.where("rows > 1").select("key", F.lit(True).alias("twice"))
    kind = texts.schema["id"].dataType.simpleString()
    text = normal(F.col("text"))
    sent = texts.select("id", text.alias("text"), F.length("text").alias("chars"))
    sent = sent.select("id", key_of(F.col("text")).alias("key"), F.sha2("text", 256).alias("sha"), "text", F.coalesce(F.col("chars"), F.lit(0)).cast("long").alias("chars"))
    sent = sent.join(sized(repeated, SENT_KEYS), "key", "left").withColumn("text", F.when(F.col("twice"), F.col("text")))
    entries = _combined(sent, _ENTRY.format(id=kind), combined)
    slot = F.shiftrightunsigned(first_bits, bits - found.depth) if found.depth else F.lit(0).cast("long")
    entries = entries.withColumn("slot", slot).join(F.broadcast(slots), "slot")
    dealt = entries.repartitionById(int(owners.max()) + 1, F.col("owner")).sortWithinPartitions("key")
    return _chained(dealt, _LINK.format(id=kind))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """One row per document: its id, ``keep_id`` (the id of the row that stays), ``group_size``, ``kept`` and ``text_sha256``."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    told = texts.select("id", normal(F.col("text")).alias("normal"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    told = told.select("id", key_of(F.col("normal")).alias("key"), F.sha2("normal", 256).alias("sha"), "chars", F.octet_length("normal").cast("long").alias("bytes"))
    rows = cut(told.withColumn("row", F.monotonically_increasing_id()), "rows-by-key", keep=True)
    with scratch(docs.sparkSession):
        links = cut(index(texts, rows, **how), "hash-index", keep=True)
    groups = links.where("n > 1").select("key", "sha", F.col("n").alias("group_size"), F.col("chars").alias("most"), F.col("id").alias("keep_id"), "ties")

    def stays() -> Column:
        return F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("most"))

    # Where rows agree in id and length, one of them stays: the first as stored.
    tied = groups.where("ties > 1")
    first = rows.join(sized(tied, SENT_GROUPS), ["key", "sha"]).where(stays()).groupBy("key", "sha").agg(F.min("row").alias("first"))
    out = rows.join(sized(groups, SENT_GROUPS), ["key", "sha"], "left").join(first, ["key", "sha"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (stays() & F.coalesce(F.col("row") == F.col("first"), F.lit(True)))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
