"""Alignment of two tokenizers: where the tokens of a byte-level BPE and of a sentence-piece BPE end together.

Both encode a space and the text. Byte offsets where tokens of both end cut them into groups; every pair of tokens that
end together is a link; a pair of ids counts for as many links as the corpus has of it.

The work is relational. Texts are cut into pieces at places where no token of either tokenizer can reach across and no
context is looked at: before a single space or line feed between two visible characters. So tokens of a piece are the
same in every text, and each distinct piece is encoded and aligned once, with the number of times that it occurs. Its
tokens are exploded with their places, running sums of lengths give their ends, an equi-join on (piece, end) gives cuts
and links, a running count of cuts numbers the groups. Tokenizers whose vocabulary doesn't allow such cuts get whole texts as pieces.

Documents are put together from pieces: the most frequent ones are sent to every task (``FREQUENT`` of bounded length);
the others come by a join, once for each text that has them. Nothing is left out.

Edge cases: null and empty texts, and texts that one of the tokenizers doesn't give back byte by byte (the visible space
mark of the second, for one), have no tokens: zeros and no groups. They count for no pair. Repeated rows count each.
An empty table gives no rows. Columns of any name may be there; only the id is returned.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.llm.common import cut, scratch, sized

#: Characters beside which nothing is cut: all that some engine takes for white space or for nothing, and the space mark.
_BLANK = [(0x00, 0x20), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x2581, 0x2581), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
BLANK = "".join(f"{chr(first)}-{chr(last)}".replace("\\", r"\\") for first, last in _BLANK)
CUT = re.compile(rf"(?<=[^{BLANK}])(?=[ \n][^{BLANK}])")
#: A mark of a cut that isn't one, as a blank stands on its other side or the text ends.
_NO_CUT = re.compile(rf"\x00(?:(?=[ \n](?:[{BLANK}]|\Z))|(?<=[{BLANK}]\x00))")
#: Pieces that every task knows, and the longest piece and spelling among them, in characters.
FREQUENT, LONGEST_PIECE, LONGEST_SPELLING = 1 << 18, 64, 512
#: Id pairs that are sent to every task (32 bytes each); more are joined by shuffle.
SENT = 1_000_000
#: Documents whose groups are Python strings at once, and distinct pieces that a task counts together.
ROWS, HELD = 128, 1 << 20

NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
#: What moves of a piece that not all tasks know, besides its text; the other numbers follow from the spelling.
OWN = ["groups", "n_a", "n_best", "count_sum"]
MARK = "\u2581"


def pieces_of(text: str) -> list[str]:
    """The pieces of a space and a text: together they are both."""
    whole = " " + text
    if "\x00" in whole:
        return CUT.split(whole)
    # The same by marking every space and line feed, and taking the marks off again where nothing is cut.
    return _NO_CUT.sub("", whole.replace(" ", "\x00 ").replace("\n", "\x00\n")).removeprefix("\x00").split("\x00")


class Tokenizers:
    """Both tokenizers and the bytes of each of their tokens, from the contents of their files."""

    def __init__(self, byte_level: str, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.spec = json.loads(byte_level)
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on.
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(x): x for x in kept} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in kept)}
        tokens = self.a.get_vocab(with_added_tokens=False)
        # Ids of added tokens stand for no bytes: a text that has one is not given back.
        self.a_bytes = [b""] * (self.a.get_vocab_size(with_added_tokens=True) + 1)
        for token, i in tokens.items():
            self.a_bytes[i] = bytes(byte.get(c, 0) for c in token)
        self.names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(self.names)]
        if not (all(self.a_bytes[i] for i in tokens.values()) and all(self.b_bytes)):
            raise ValueError("a token without bytes has no end of its own")

    def separable(self) -> bool:
        """Whether tokens of pieces cut at ``CUT`` are tokens of the whole text."""
        before = self.spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not self.spec.get("normalizer")
        return bool(plain and not any("\n" in x or MARK in x.lstrip(MARK) for x in self.names))

    def encode(self, pieces: list[str]) -> list[pa.Array]:
        """Ids and byte lengths by either tokenizer of each piece, as four arrays of lists; null where the bytes aren't given back."""
        ones = [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        # The second puts a space of its own first: it stands for the piece's, or, before a line feed, is taken off again.
        others = self.b.encode([x[1:] if x.startswith(" ") else x for x in pieces], num_threads=1)
        for at, piece in enumerate(pieces):
            if not piece.startswith(" "):
                if not others[at] or self.names[others[at][0]] != MARK:
                    raise ValueError(f"the piece tokenizer doesn't put a space before {piece[:20]!r}")
                others[at] = others[at][1:]
        whole = [piece.encode() for piece in pieces]
        sides = [(ids, of, *self._flat(ids, of)) for ids, of in ((ones, self.a_bytes), (others, self.b_bytes))]
        bad = np.zeros(len(pieces), bool)
        for ids, of, flat, offsets, lengths in sides:
            total = np.diff(np.concatenate([[0], np.cumsum(lengths)])[offsets])
            bad |= total != np.fromiter(map(len, whole), np.int64, len(whole))
            # With all lengths right, the bytes of all pieces together are right only if each one's are.
            if bad.any() or b"".join(map(of.__getitem__, flat.tolist())) != b"".join(whole):
                bad |= np.array([b"".join(map(of.__getitem__, x)) != w for x, w in zip(ids, whole, strict=True)])
        mask = pa.array(bad)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x), mask=mask) for _, _, flat, offsets, lengths in sides for x in (flat, lengths)]

    @staticmethod
    def _flat(ids: list[list[int]], of: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids in a row, where each piece's begin and end, and their lengths in bytes."""
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))]).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
        return flat, offsets, np.fromiter((len(of[i]) for i in flat.tolist()), np.int32, len(flat))


def load(path: str, spark: SparkSession) -> bytes:
    """A tokenizer's file, read by the driver; tasks get its contents."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def _counted(texts: DataFrame, cuts: bool) -> DataFrame:
    """(piece, n): how often each piece occurs in the column ``text``. Tasks send each piece they meet once, about."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            pieces, times = [*found], [*found.values()]
            for at in range(0, len(pieces), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(pieces[at : at + 8192], pa.string()), pa.array(times[at : at + 8192], pa.int64())], ["piece", "times"])

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for text in batch.column(0).slice(at, ROWS).to_pylist():
                    found.update(pieces_of(text) if cuts else [" " + text])
                if len(found) > HELD:
                    yield from out()
                    found = Counter()
        yield from out()

    return texts.select("text").mapInArrow(count, "piece string, times long").groupBy("piece").agg(F.sum("times").alias("n"))


def _having(texts: DataFrame, cuts: bool, pieces: Broadcast, among: bool) -> DataFrame:
    """(key, piece): the distinct pieces of each text (key, text) that are ``among`` the ones sent, or that aren't."""
    schema = f"key {texts.schema['key'].dataType.simpleString()}, piece string"

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.value[0]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [set(pieces_of(t) if cuts else [" " + t]) for t in part.column(1).to_pylist()]
                own = [{p for p in x if p in known} if among else x.difference(known) for x in found]
                rows = np.repeat(np.arange(len(own)), [len(x) for x in own])
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array([x for xs in own for x in xs], pa.string())], ["key", "piece"])

    return texts.select("key", "text").mapInArrow(pick, schema)


def _encoded(counted: DataFrame, byte_level: str, model: bytes) -> DataFrame:
    """(piece, n) with the ids and lengths of its tokens, null where it has none."""
    schema = "piece string, n long, a array<int>, al array<int>, b array<int>, bl array<int>"

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            own = own or Tokenizers(byte_level, model)
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *own.encode(part.column(0).to_pylist())], ["piece", "n", "a", "al", "b", "bl"])

    return counted.select("piece", "n").mapInArrow(tokens, schema)


def _ends(tokens: DataFrame, ids: str, lengths: str, *more: str) -> DataFrame:
    """One row a token: piece number, byte offset of its end, id, and ``more`` of its piece. Pieces are dealt out by their numbers before they
    are exploded, so that their tokens are summed up where they are."""
    rows = tokens.select("no", *more, F.posexplode(F.arrays_zip(F.col(ids).alias("id"), F.col(lengths).alias("length"))).alias("at", "token"))
    end = F.sum("token.length").over(Window.partitionBy("no").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("no", end.cast("int").alias("end"), F.col("token.id").alias(ids), *more)


def aligned(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``tokens`` (no, n, a, al, b, bl): the spelled alignment of each piece number, with its ``NUMBERS``; and the id pairs
    (a, b, links, best), where best tells that no other pair of that b has more links."""
    dealt = tokens.where("a is not null").select("no", "n", "a", "al", "b", "bl").repartition("no")
    ends = cut(_ends(dealt, "a", "al", "n").join(_ends(dealt, "b", "bl"), ["no", "end"], "full"), "token-ends", free=True)
    linked = ends.where("a is not null and b is not null")
    pairs = cut(linked.groupBy("a", "b").agg(F.sum("n").alias("links")).where("links > 0"), "id-pairs")
    most = pairs.groupBy("b").agg(F.max("links").alias("most"))
    pairs = cut(pairs.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best")), "ranked-pairs", keep=True)

    known = sized(pairs.select(F.col("a").alias("a_"), F.col("b").alias("b_"), "links", "best"), SENT)
    ends = ends.drop("n").join(known, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_")), "left").drop("a_", "b_")
    is_cut = F.col("a").isNotNull() & F.col("b").isNotNull()
    before = Window.partitionBy("no").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("is_cut", is_cut).withColumn("group", F.coalesce(F.count_if("is_cut").over(before), F.lit(0)))

    def spelled(side: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side))))
        return F.array_join(F.transform(own, lambda x: x[side].cast("string")), ",")

    groups = ends.groupBy("no", "group").agg(
        F.concat(spelled("a"), F.lit("|"), spelled("b")).alias("spelled"),
        F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if("is_cut").alias("n_links"),
        F.count_if("best").alias("n_best"), F.coalesce(F.sum("links"), F.lit(0)).alias("count_sum"),
    )
    whole = F.array_sort(F.collect_list(F.struct("group", "spelled")))
    sums = [F.sum(c).alias(c) for c in NUMBERS if c != "n_groups"]
    found = groups.groupBy("no").agg(F.count(F.lit(1)).alias("n_groups"), *sums, F.array_join(F.transform(whole, lambda x: x["spelled"]), ";").alias("groups"))
    return found.select("no", *NUMBERS, "groups"), pairs


def align(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Per document its id, the ``NUMBERS`` and ``groups``, spelled ``a1,a2|b1;a3|b2,b3``; and the table of id pairs."""
    spark = docs.sparkSession
    byte_level, model = load(byte_level_path, spark).decode(), load(piece_path, spark)
    cuts = Tokenizers(byte_level, model).separable()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Texts of one hash only get each other's pieces besides their own, which no text looks up that doesn't have them.
    key = F.xxhash64("text")
    full = texts.where("text <> ''").select(key.alias("key"), "text")

    with scratch(spark):
        tokens = cut(_encoded(_counted(full, cuts), byte_level, model).withColumn("no", F.monotonically_increasing_id()), "piece-tokens", free=True)
        odd = tokens.where("a is null").select("piece")
        # Here a hash decides which texts count, so it has 128 bits.
        tagged = full.withColumn("key", F.concat_ws(" ", F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))))
        if not odd.isEmpty():  # texts with such a piece have no tokens, so their other pieces count for nothing either
            some = odd.limit(frequent).toPandas()["piece"]
            if len(some) < frequent:
                met = _having(tagged, cuts, spark.sparkContext.broadcast((dict.fromkeys(some),)), True)
            else:
                met = _having(tagged, cuts, spark.sparkContext.broadcast(({},)), False).join(odd, "piece", "left_semi")
            gone = cut(met.select("key").distinct(), "texts-without-tokens")
            left = _counted(tagged.join(sized(gone, SENT), "key", "left_anti"), cuts).withColumnRenamed("n", "left")
            tokens = cut(tokens.drop("n").join(left, "piece", "left").withColumn("n", F.coalesce("left", F.lit(0))).drop("left"), "piece-tokens")
        found, pairs = aligned(tokens)
        told = cut(tokens.select("no", "piece", "n").join(found, "no", "left").drop("no"), "pieces", keep=True, free=True)

    # As many of the most frequent as there is room for: counts are counted, and no order is made over pieces.
    brief = (F.length("piece") <= LONGEST_PIECE) & (F.coalesce(F.length("groups"), F.lit(0)) <= LONGEST_SPELLING)
    counts = told.where(brief).groupBy("n").count().orderBy(F.desc("n")).limit(frequent).toPandas()
    fits = counts["n"][counts["count"].cumsum() <= frequent]
    sent = brief & (F.col("n") >= (int(fits.min()) if len(fits) else 1 << 62))
    common = told.where(sent)
    known = common.select("piece", *NUMBERS, "groups").toPandas()
    shared = spark.sparkContext.broadcast((dict(zip(known["piece"], range(len(known)), strict=True)), known[NUMBERS].fillna(0).to_numpy(np.int64), [*known["groups"]]))
    del known
    rest = told.where(~sent).drop("n")
    asked = _having(full, cuts, shared, False)
    # Equal texts ask for the same pieces: the set of what they get is the same as one text's.
    own = asked.join(rest, "piece").groupBy("key").agg(F.collect_set(F.struct("piece", *OWN)).alias("own"))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _packed(texts.select("id", F.when(F.col("text") != "", key).alias("key"), "text"), id_type).join(own, "key", "left").select("id", "packed", "own")
    return _put_together(rows, shared, cuts, id_type).withColumnRenamed("id", id_col), pairs


def _packed(texts: DataFrame, id_type: str) -> DataFrame:
    """(id, key, packed): texts compressed one by one, as they move on to where their pieces are; null for none."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                packed = [zlib.compress(x.encode(), 1) if x else None for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], ["id", "key", "packed"])

    return texts.mapInArrow(pack, f"id {id_type}, key long, packed binary")


def _put_together(rows: DataFrame, shared: Broadcast, cuts: bool, id_type: str) -> DataFrame:
    """Documents (id, packed, own) from the pieces that all know and those of their own."""
    schema = f"id {id_type}, {', '.join(f'{c} long' for c in NUMBERS)}, groups string"
    shape = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, numbers, spelled = shared.value
        # The last place stands for pieces that not all know.
        numbers, spelled = np.vstack([numbers, np.zeros((1, len(NUMBERS)), np.int64)]), [*spelled, None]

        def one(packed: bytes | None, held: dict[str, int], groups: list[str | None], counts: np.ndarray) -> tuple[list[int], str]:
            text = zlib.decompress(packed).decode() if packed else ""
            pieces = (pieces_of(text) if cuts else [" " + text]) if text else []
            place = np.fromiter(map(places.get, pieces, repeat(-1)), np.int64, len(pieces))
            words, total = [*map(spelled.__getitem__, place.tolist())], numbers[place].sum(0)
            own = [held[pieces[i]] for i in np.flatnonzero(place < 0).tolist()]
            for i, at in zip(np.flatnonzero(place < 0).tolist(), own, strict=True):
                words[i] = groups[at]
            if not words or None in words:
                return [0] * len(NUMBERS), ""
            if own:
                # Every group ends with one link; tokens are as many as commas and the two first ones of each group.
                n = np.array([groups[at].count(";") + 1 for at in own])
                tokens = np.array([groups[at].count(",") for at in own]) + 2 * n
                mine = counts[own]
                total = total + np.array([mine[:, 0].sum(), (tokens - mine[:, 0]).sum(), n.sum(), n.sum(), mine[:, 1].sum(), mine[:, 2].sum()])
            return total.tolist(), ";".join(words)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                lists = part.column(2)
                own = lists.flatten()  # what all documents of the part have of their own, in their order
                ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                names, groups = own.field("piece").to_pylist(), own.field("groups").to_pylist()
                counts = np.stack([pc.fill_null(own.field(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in OWN[1:]], 1)
                told, start = [], 0
                for packed, end in zip(part.column(1).to_pylist(), ends.tolist(), strict=True):
                    told.append(one(packed, dict(zip(names[start:end], range(start, end), strict=True)), groups, counts))
                    start = end
                columns = [pa.array(x, pa.int64()) for x in zip(*(n for n, _ in told), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array([g for _, g in told], pa.string())], schema=shape)

    return rows.mapInArrow(assemble, schema)
