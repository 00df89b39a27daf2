"""Removal of repeated passages with suffix arrays.

A byte is removed if a string of WIDTH bytes that covers it also starts in a document of smaller id. Strings are judged
on the input, and never cross documents.

Documents are dealt to groups by hash of the id. Every string of WIDTH bytes has a mark, the least hash among its
pieces of PIECE bytes; equal strings have equal marks, and neighbouring strings mostly share theirs, so a document falls into
stretches of one mark. The steps are one plan in which the dealt documents are shuffled once and read three times:

1. each group sends its distinct marks to buckets, with the number of distinct stretches that have them; buckets answer which
   marks occur in more than one document, and which are crowded;
2. each group sends the text of its stretches of shared marks, each distinct stretch once with the least id it occurs in,
   to the shard of its mark. Stretches of a crowded mark (a piece that stands in very many different contexts) are cut
   further by the marks of longer pieces, of the most crowded ones by whole strings, and each part goes to the shard of
   that mark, so that no shard gets all contexts. A shard builds a suffix array over its stretches by Larsson-Sadakane
   refinement, finds common prefixes by Kasai's method, and so the least id of every string; a shard of more than
   SHARD_BYTES is cut into parts with a suffix array each, whose sorted strings are merged two by two by binary search;
3. shards answer with these ids, and groups remove what has a smaller one than its own document.

Hot passages meet at most once per group and mark. Groups, buckets and shards are of bounded size, their number and that
of the tasks follow the input. Everything before suffix sorting only decides where strings meet; equality is decided on
the bytes. What still grows is the number of groups that tell one shard of the same passage, a row each: one in 4 MB of text.

Edge cases: a null text is an empty one; documents shorter than WIDTH lose nothing; rows that share an id never remove
each other's bytes; rows with a null id lose nothing and remove nothing; repeated rows stay. Ids may be of any type that
sorts; those that are no whole numbers are numbered in their order first. Columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut

WIDTH = 50
PIECE = 20
#: Distinct stretches, about, from which on a mark is crowded, and the pieces by which its stretches are marked anew.
CROWDED = ((512, 44), (1 << 18, WIDTH))
#: Tasks of one step at most; a task takes any number of groups, one after the other.
TASKS = 20_000
#: Bytes of text in a group of documents, of text for every shard, and of stretches in one suffix array; marks in a
#: bucket; all about.
GROUP_BYTES, TEXT_BYTES, SHARD_BYTES, BUCKET_MARKS = 4 << 20, 1 << 19, 3 << 20, 1 << 18
#: Strings in one stretch at most, and bytes whose marks are computed at once.
LONGEST, BLOCK = 256, 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_ODD), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


_known: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next block."""
    if not _known or len(_known[0]) < n:
        made = []
        for base in (_ODD, _BACK):
            out = np.full(max(n, 2 * BLOCK), base)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _known[:] = made
    return _known[0][:n], _known[1][:n]


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes before each place, each byte times the power of its own."""
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data))[0], out=total[1:])
    return total


def _hashes(total: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Hashes of the bytes from ``start`` to ``end``: a sum's terms start at the power of its place, and the inverse power
    there makes equal stretches equal."""
    with np.errstate(over="ignore"):
        h = (total[end] - total[start]) * _powers(len(total) - 1)[1][start]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(32)
    return h


def marks(total: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """For every start of a string of WIDTH bytes its mark, 48 bits."""
    n = len(total) - piece
    window, least = 1, _hashes(total, slice(0, n), slice(piece, None))
    span = WIDTH - piece + 1
    while window * 2 <= span:
        least = np.minimum(least[:-window], least[window:])
        window *= 2
    if window < span:
        least = np.minimum(least[: len(least) - (span - window)], least[span - window :])
    return least >> np.uint64(16)


def stretches(docs: list[bytes], piece: int = PIECE, hashed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start in it, number of strings, mark, hash if ``hashed`` else 0) of every stretch; each string is in exactly one."""
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        lengths = np.array([len(b) for _, _, b in held])
        ends = lengths.cumsum()
        total = _sums(data)
        mark = marks(total, piece)
        good = np.ones(len(mark), bool)
        for back in range(1, WIDTH):
            at = ends[:-1] - back
            good[at[(at >= 0) & (at < len(mark))]] = False
        at = np.flatnonzero(good)
        m = mark[at]
        new = np.ones(len(at), bool)
        new[1:] = (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        new |= (np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))) % LONGEST == 0
        head = np.flatnonzero(new)
        of = np.searchsorted(ends, at[head], side="right")
        number, offset = np.array([d for d, _, _ in held]), np.array([o for _, o, _ in held])
        count = np.diff(np.append(head, len(at)))
        told = _hashes(total, at[head], at[head] + count + WIDTH - 1) if hashed else np.zeros(len(head), np.uint64)
        found.append((number[of], offset[of] + at[head] - (ends - lengths)[of], count, m[head], told))

    for d, text in enumerate(docs):
        # A long document is taken in overlapping parts that share no string.
        for start in range(0, len(text) - WIDTH + 1, BLOCK):
            held.append((d, start, text[start : start + BLOCK + WIDTH - 1]))
            size += len(held[-1][2])
            if size >= BLOCK:
                flush()
                held.clear()
                size = 0
    if held:
        flush()
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _bucket(mark: np.ndarray, n: int) -> np.ndarray:
    return ((mark >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Sorted integers as differences, in as few bytes each as all fit in."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = next(w for w in range(1, 9) if w == 8 or not len(steps) or int(steps.max()) < 1 << (8 * w))
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, blob[0])
    out = np.zeros((len(steps), 8), np.uint8)
    out[:, : blob[0]] = steps
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64)


def _slices(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    for a, b in zip(at, np.append(at, len(keys))[1:], strict=True):
        yield int(keys[a]), slice(int(a), int(b))


# --- suffix arrays -------------------------------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``data`` in the order of their suffixes, and the eight bytes at each position as an integer. Only
    groups that are still tied are sorted again, by the rank of what follows, at twice the depth."""
    n = len(data)
    eight = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    for w in (1, 2, 4):
        eight = (eight[: len(eight) - w] << np.uint64(8 * w)) | eight[w:]
    eight = eight[:n]
    order = np.argsort(eight)
    ranked = eight[order]
    new = np.ones(n, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = 8
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        place = np.flatnonzero(tied)
        if not len(place):
            break
        at = order[place]
        after = at + depth
        # A suffix that ends here is less than one that goes on, and a shorter one less than a longer.
        key = rank[at] * (n + depth + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + depth + 1, n - at)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[place] = at
        fresh = np.ones(len(place), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[place] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, place, 0))
        depth *= 2
    return order, eight


def common_prefixes(order: np.ndarray, eight: np.ndarray, starts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Length, up to ``width``, of the prefix that each suffix in ``order`` shares with the one before it.

    ``order`` holds the suffixes that start in the first ``counts`` positions from ``starts``. Kasai's method: going one
    byte on in the text loses at most one byte of the prefix. All stretches go on together."""
    n = len(eight)
    place = np.full(n + 1, -1, np.int64)
    place[order] = np.arange(len(order))
    out = np.zeros(len(order), np.int64)
    by = np.argsort(-counts, kind="stable")
    starts, counts = starts[by], counts[by]
    have = np.zeros(len(starts), np.int64)
    for step in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -step, side="left"))
        p = starts[:live] + step
        r = place[p]
        q = order[np.maximum(r - 1, 0)]
        have = np.where(r > 0, have[:live], width)
        todo = np.flatnonzero(have < width)
        while len(todo):
            a, b = p[todo] + have[todo], q[todo] + have[todo]
            x = eight[np.minimum(a, n - 1)] ^ eight[np.minimum(b, n - 1)]
            same = sum((x < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8)) + (x == 0)
            have[todo] = np.minimum(have[todo] + same, width)
            todo = todo[(same == 8) & (have[todo] < width)]
        out[r] = np.where(r > 0, have, 0)
        # The bound holds on only if the neighbour's next suffix is in the order too.
        have = np.where((place[np.minimum(q + 1, n)] >= 0) & (r > 0), np.maximum(have - 1, 0), 0)
    return out


def least_ids(texts: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, counts, heads, least): for every string of WIDTH bytes in ``texts``, text after text, the number of its
    group of equal strings; how many strings each text has; and for every group, in suffix order, where its first
    string stands in the texts joined by a byte, and the least id of all texts that have it."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    starts = np.concatenate(([0], (sizes + 1).cumsum()[:-1]))
    counts = sizes - WIDTH + 1
    order, eight = suffix_array(data)
    owner = np.full(len(data), -1, np.int64)
    at = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)
    owner[at] = np.repeat(np.arange(len(texts)), counts)
    order = order[owner[order] >= 0]
    shared = common_prefixes(order, eight, starts, counts, WIDTH)
    heads = np.flatnonzero(shared < WIDTH)
    least = np.minimum.reduceat(ids[owner[order]], heads)
    group = np.empty(len(data), np.int32)
    group[order] = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(np.append(heads, len(order))))
    return group[at], counts, order[heads], least


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Union of two sorted tables of distinct strings with their least ids: the strings of one are looked up in the other."""
    (strings, ids), (others, low) = a, b
    at = np.searchsorted(others, strings)
    hit = others[np.minimum(at, len(others) - 1)] == strings
    low = low.copy()
    low[at[hit]] = np.minimum(low[at[hit]], ids[hit])
    return np.insert(others, at[~hit], strings[~hit]), np.insert(low, at[~hit], ids[~hit])


def merged_ids(texts: list[bytes], ids: np.ndarray, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(least id of every string, number of strings of each text), with one suffix array per ``shard_bytes`` of text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    part = (sizes.cumsum() - sizes) // shard_bytes
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    stops = np.append(cuts[1:], len(texts))
    parts = [least_ids(texts[a:b], ids[a:b]) for a, b in zip(cuts, stops, strict=True)]
    best = [least for _, _, _, least in parts]
    if len(parts) > 1:
        # Every part's distinct strings, which its suffix array has in order, are merged with its neighbour's, and so on.
        tables = []
        for (_, _, heads, least), a, b in zip(parts, cuts, stops, strict=True):
            data = np.frombuffer(b"\xff".join(texts[a:b]), np.uint8)
            tables.append((np.lib.stride_tricks.sliding_window_view(data, WIDTH)[heads].copy().view(f"S{WIDTH}").ravel(), least))
        rest = tables
        while len(rest) > 1:
            rest = [_merge(*rest[i : i + 2]) if i + 1 < len(rest) else rest[i] for i in range(0, len(rest), 2)]
        best = [rest[0][1][np.searchsorted(rest[0][0], strings)] for strings, _ in tables]
    return np.concatenate([b[p[0]] for b, p in zip(best, parts, strict=True)]), np.concatenate([p[1] for p in parts])


# --- what groups and shards tell each other ------------------------------------------------------------------------


class _Asked:
    """What a group asks shards for: its distinct stretches of shared marks, and the units they are sent as, a whole stretch
    or the parts that a stretch of a crowded mark is cut into. Equal units are one."""

    def __init__(self, group: _Group, status: np.ndarray, crowded: tuple[tuple[int, int], ...]):
        self.picked = np.flatnonzero(status[group.of])
        number: dict[bytes, int] = {}
        doc, start, end = group.doc[self.picked], group.start[self.picked], group.start[self.picked] + group.count[self.picked] + WIDTH - 1
        texts = group.texts
        self.which = np.fromiter((number.setdefault(texts[d][a:b], len(number)) for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)), np.int64, len(self.picked))
        self.texts = list(number)
        self.least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, group.ids[doc])
        mark, level = np.zeros(len(number), np.uint64), np.zeros(len(number), np.int64)
        mark[self.which], level[self.which] = group.mark[self.picked], status[group.of[self.picked]]

        # Parts: (text, first string, number of strings, mark).
        whole = np.flatnonzero(level == 1)
        size = np.fromiter(map(len, self.texts), np.int64, len(self.texts)) - WIDTH + 1
        parts = [(whole, np.zeros(len(whole), np.int64), size[whole], mark[whole])]
        for k, (_, piece) in enumerate(crowded):
            hot = np.flatnonzero(level == 2 + k)
            if len(hot):
                of, first, count, finer, _ = stretches([self.texts[i] for i in hot.tolist()], piece)
                parts.append((hot[of], first, count, finer))
        self.text, self.first, self.count, part_mark = (np.concatenate(x) for x in zip(*parts, strict=True))
        # A whole stretch is a unit as it is; parts of crowded ones can be equal.
        number = {}
        hot = slice(len(whole), None)
        cut_off = np.fromiter(
            (number.setdefault(self.texts[i][a : a + c + WIDTH - 1], len(number)) for i, a, c in zip(self.text[hot].tolist(), self.first[hot].tolist(), self.count[hot].tolist(), strict=True)),
            np.int64, len(self.text) - len(whole),
        )
        self.unit = np.concatenate([np.arange(len(whole)), len(whole) + cut_off])
        self.units = [self.texts[i] for i in whole.tolist()] + list(number)
        self.unit_least = np.full(len(self.units), np.iinfo(np.int64).max)
        np.minimum.at(self.unit_least, self.unit, self.least[self.text])
        self.unit_mark = np.zeros(len(self.units), np.uint64)
        self.unit_mark[self.unit] = part_mark

    def put_together(self, single: np.ndarray, several: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From ids of units (one for all strings, or where theirs begin in ``each``, else -1) the same of texts."""
        parts = np.bincount(self.text, minlength=len(self.texts))
        one, many = np.flatnonzero(parts[self.text] == 1), np.flatnonzero(parts[self.text] > 1)
        text_single, text_several = self.least.copy(), np.full(len(self.texts), -1, np.int64)
        text_single[self.text[one]], text_several[self.text[one]] = single[self.unit[one]], several[self.unit[one]]
        if not len(many):
            return text_single, text_several, each
        many = many[np.lexsort((self.first[many], self.text[many]))]
        n, unit = self.count[many], self.unit[many]
        ends = n.cumsum()
        step = np.arange(ends[-1]) - np.repeat(ends - n, n)
        spread = np.repeat(several[unit], n)
        told = np.append(each, 0)[np.where(spread >= 0, spread + step, -1)]
        values = np.where(spread >= 0, told, np.repeat(single[unit], n))
        heads = np.flatnonzero(np.diff(self.text[many], prepend=-1))
        text_several[self.text[many[heads]]] = len(each) + (ends - n)[heads]
        return text_single, text_several, np.concatenate([each, values])


class _Group:
    """The documents of one group and their stretches; the same for the same documents, whatever order they come in."""

    def __init__(self, docs: pd.DataFrame, hashed: bool = False):
        docs = docs[docs["id"].notna()].sort_values(["id", "text"])
        self.ids = docs["id"].to_numpy(np.int64)
        self.texts = docs["text"].tolist()
        self.doc, self.start, self.count, self.mark, self.hash = stretches(self.texts, hashed=hashed)
        self.distinct, self.of = np.unique(self.mark, return_inverse=True)

    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct mark: whether it occurs under more than one id in this group, in how many distinct stretches (65,535
        at most), and a byte of the hash of one of them."""
        low = np.full(len(self.distinct), np.iinfo(np.int64).max)
        high = np.full(len(self.distinct), np.iinfo(np.int64).min)
        ids = self.ids[self.doc]
        np.minimum.at(low, self.of, ids)
        np.maximum.at(high, self.of, ids)
        times = np.bincount(self.of, minlength=len(self.distinct))
        tag = np.zeros(len(self.distinct), np.uint8)
        tag[self.of] = (self.hash >> np.uint64(20)).astype(np.uint8)
        # Most marks have one stretch; only of the others the hashes are compared.
        many = np.flatnonzero(times[self.of] > 1)
        order = many[np.lexsort((self.hash[many], self.of[many]))]
        of, told = self.of[order], self.hash[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (told[1:] != told[:-1])
        kinds = np.bincount(of[new], minlength=len(self.distinct))
        first = order[np.flatnonzero(np.diff(of, prepend=-1))]
        tag[self.of[first]] = (self.hash[first] >> np.uint64(20)).astype(np.uint8)
        return low < high, np.minimum(np.maximum(kinds, 1), 65_535).astype(np.uint16), tag

    def ask(self, answers: pd.DataFrame, crowded: tuple[tuple[int, int], ...]) -> _Asked:
        status = np.zeros(len(self.distinct), np.uint8)
        if len(self.distinct) and len(answers):
            status = np.concatenate([np.frombuffer(zstandard.decompress(b), np.uint8) for b in answers.sort_values("bucket")["status"]])
        return _Asked(self, status, crowded)


def _zip(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    sizes = np.array([len(parts), *map(len, parts)], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(sizes.tobytes() + b"".join(parts))


def _unzip(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = np.frombuffer(data, np.int64, n, 8).cumsum() + 8 * (n + 1)
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


def _ask_buckets(n_buckets: int):
    def of(docs: pd.DataFrame) -> pd.DataFrame:
        group, gid = _Group(docs, hashed=True), docs["gid"].iloc[0]
        shared, times, tag = group.shared()
        rows = [(b, gid, _pack(group.distinct[s]), _zip(np.packbits(shared[s]), times[s], tag[s])) for b, s in _slices(_bucket(group.distinct, n_buckets))]
        return pd.DataFrame(rows, columns=["bucket", "gid", "marks", "told"])

    return of


def _answer_marks(crowded: tuple[tuple[int, int], ...]):
    def of(asked: pd.DataFrame) -> pd.DataFrame:
        """0 for a mark of one document, 1 for a shared one, 2 and more for levels of crowdedness."""
        values = [_unpack(b) for b in asked["marks"]]
        local, times, tags = [], [], []
        for blob, v in zip(asked["told"], values, strict=True):
            bits, n, tag = _unzip(blob)
            local.append(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(v)))
            times.append(np.frombuffer(n, np.uint16))
            tags.append(np.frombuffer(tag, np.uint8))
        distinct, mark, groups = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        shared = (groups > 1) | (np.bincount(mark, weights=np.concatenate(local), minlength=len(distinct)) > 0)
        # Distinct stretches, about: one in each group is the same as in others as far as the hashes' bytes agree.
        kinds = np.bincount(np.unique(mark * 256 + np.concatenate(tags)) // 256, minlength=len(distinct))
        ones = np.where(kinds < 256, -256 * np.log1p(-np.minimum(kinds, 255) / 256), groups)
        many = np.bincount(mark, weights=np.concatenate(times), minlength=len(distinct)) - groups + np.minimum(ones, groups)
        status = shared.astype(np.uint8)
        for least, _ in crowded:
            status += (shared & (many >= least)).astype(np.uint8)
        parts = np.split(status[mark], np.cumsum([len(v) for v in values])[:-1])
        return pd.DataFrame({"gid": asked["gid"], "bucket": asked["bucket"], "status": [zstandard.compress(p.tobytes(), 1) for p in parts]})

    return of


def _ask_shards(n_shards: int, crowded: tuple[tuple[int, int], ...]):
    def of(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs):
            gid = docs["gid"].iloc[0]
            asked = _Group(docs).ask(answers, crowded)
            shard = _bucket(asked.unit_mark, n_shards)
            order = np.argsort(shard, kind="stable")
            for b, s in _slices(shard[order]):
                at = order[s]
                mine = [asked.units[i] for i in at]
                rows.append((b, gid, _zip(np.array([len(t) for t in mine], np.int32), asked.unit_least[at], b"".join(mine))))
        return pd.DataFrame(rows, columns=["shard", "gid", "stretches"])

    return of


def _answer_stretches(shard_bytes: int):
    def of(asked: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        groups = []
        for blob in asked["stretches"]:
            sizes, ids, data = _unzip(blob)
            ends = np.frombuffer(sizes, np.int32).astype(np.int64).cumsum()
            which = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], np.int64)
            groups.append((which, np.frombuffer(ids, np.int64)))
        least = np.full(len(number), np.iinfo(np.int64).max)
        for which, ids in groups:
            np.minimum.at(least, which, ids)
        found, counts = merged_ids(list(number), least, shard_bytes)
        starts = counts.cumsum() - counts
        low, high = np.minimum.reduceat(found, starts), np.maximum.reduceat(found, starts)
        out = []
        for which, ids in groups:
            # Nothing is said of a stretch whose strings all occur first where the group has it itself.
            told = np.flatnonzero(low[which] < ids)
            even = low[which[told]] == high[which[told]]
            same, mixed = told[even], told[~even]
            each = np.concatenate([found[starts[w] : starts[w] + counts[w]] for w in which[mixed]]) if len(mixed) else np.empty(0, np.int64)
            out.append(_zip(same.astype(np.int32), low[which[same]], mixed.astype(np.int32), each))
        return pd.DataFrame({"gid": asked["gid"], "shard": asked["shard"], "kind": 1, "blob": out})

    return of


def _remove(n_shards: int, crowded: tuple[tuple[int, int], ...]):
    def of(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"id": [], "n_bytes": [], "removed": [], "kept_sha256": []})
        told = answers["kind"] == 1
        group = _Group(docs)
        asked = group.ask(answers[~told].rename(columns={"shard": "bucket", "blob": "status"}), crowded)
        shard = _bucket(asked.unit_mark, n_shards)
        order = np.argsort(shard, kind="stable")
        first = {b: s for b, s in _slices(shard[order])}
        size = np.fromiter(map(len, asked.units), np.int64, len(asked.units)) - WIDTH + 1
        single = asked.unit_least.copy()  # the least id of all strings of a unit, where they agree
        several = np.full(len(asked.units), -1, np.int64)  # else where its strings' ids begin in ``each``
        parts, filled = [], 0
        for b, blob in zip(answers["shard"][told], answers["blob"][told], strict=True):
            same, ids, mixed, each = _unzip(blob)
            mine = order[first[b]]
            single[mine[np.frombuffer(same, np.int32)]] = np.frombuffer(ids, np.int64)
            mixed = mine[np.frombuffer(mixed, np.int32)]
            several[mixed] = filled + size[mixed].cumsum() - size[mixed]
            parts.append(np.frombuffer(each, np.int64))
            filled += len(parts[-1])
        single, several, each = asked.put_together(single, several, np.concatenate(parts) if parts else np.empty(0, np.int64))
        picked, which = asked.picked, asked.which
        # Documents stand one after another with a gap of one, so that runs of two never touch.
        lengths = np.fromiter(map(len, group.texts), np.int64, len(group.texts))
        base = (lengths + 1).cumsum() - lengths - 1
        doc, count = group.doc[picked], group.count[picked]
        at, ids = base[doc] + group.start[picked], group.ids[doc]
        whole = np.flatnonzero((several[which] < 0) & (single[which] < ids))
        part = np.flatnonzero(several[which] >= 0)
        n = count[part]
        step = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        hit = each[np.repeat(several[which[part]], n) + step] < np.repeat(ids[part], n)
        single_begin = (np.repeat(at[part], n) + step)[hit]
        begin = np.concatenate([at[whole], single_begin])
        end = np.concatenate([at[whole] + count[whole] + WIDTH - 1, single_begin + WIDTH])
        by = np.argsort(begin, kind="stable")
        begin, reach = begin[by], np.maximum.accumulate(end[by])
        new = np.ones(len(begin), bool)
        new[1:] = begin[1:] > reach[:-1]
        head = np.flatnonzero(new)
        begin, end = begin[head], reach[np.append(head[1:], len(by))[: len(head)] - 1]
        edges = np.searchsorted(begin, np.append(base, np.iinfo(np.int64).max)).tolist()
        rows = []
        for d, (key, text) in enumerate(zip(group.ids.tolist(), group.texts, strict=True)):
            mine = slice(edges[d], edges[d + 1])
            rows.append((key, text, list(zip((begin[mine] - base[d]).tolist(), (end[mine] - base[d]).tolist(), strict=True))))
        rows += [(None, text, []) for text in docs.loc[docs["id"].isna(), "text"]]
        out = []
        for key, text, runs in rows:
            kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(text)], strict=True))
            out.append((key, len(text), [x for r in runs for x in r], hashlib.sha256(kept).hexdigest()))
        out = pd.DataFrame(out, columns=["id", "n_bytes", "removed", "kept_sha256"])
        return out.assign(id=out["id"].astype("Int64"))

    return of


def repeated_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_bytes: int = GROUP_BYTES,
    text_bytes: int = TEXT_BYTES,
    shard_bytes: int = SHARD_BYTES,
    bucket_marks: int = BUCKET_MARKS,
    crowded: tuple[tuple[int, int], ...] = CROWDED,
) -> DataFrame:
    """One row per document: id, n_bytes, removed (array of start and end of every maximal removed run, in bytes), and
    kept_sha256 of the rest."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_groups = max(1, -(-total // group_bytes))
    n_buckets = max(1, -(-total // (16 * bucket_marks)))
    n_shards = max(1, -(-total // text_bytes))

    whole = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    if whole:
        rows = rows.withColumn("id", F.col("id").cast("long"))
    else:
        # Numbers of sorted rows grow from partition to partition.
        order = docs.select(F.col(id_col).alias("name")).where("name IS NOT NULL").distinct().sort("name")
        order = cut(order.select("name", F.monotonically_increasing_id().alias("number")), "id-order")
        rows = rows.join(order, F.col("id") == F.col("name"), "left").select(F.col("number").alias("id"), "text")
    # Nothing needs the rows of one id together: an id that very many rows have is dealt out by its texts.
    gid = F.pmod(F.xxhash64("id", "text"), F.lit(n_groups))
    tasks = [min(TASKS, -(-n // few)) for n, few in ((n_groups, 2), (n_buckets, 2), (n_shards, 16))]
    # The same exchange serves all three uses below.
    dealt = rows.withColumn("gid", gid).repartition(tasks[0], "gid")

    asked = dealt.groupBy("gid").applyInPandas(_ask_buckets(n_buckets), "bucket long, gid long, marks binary, told binary")
    known = asked.repartition(tasks[1], "bucket").groupBy("bucket").applyInPandas(_answer_marks(crowded), "gid long, bucket long, status binary")
    known = known.repartition(tasks[0], "gid")
    sent = dealt.groupBy("gid").cogroup(known.groupBy("gid")).applyInPandas(_ask_shards(n_shards, crowded), "shard long, gid long, stretches binary")
    least = sent.repartition(tasks[2], "shard").groupBy("shard").applyInPandas(_answer_stretches(shard_bytes), "gid long, shard long, kind int, blob binary")
    both = least.unionByName(known.select("gid", F.col("bucket").alias("shard"), F.lit(0).alias("kind"), F.col("status").alias("blob"))).repartition(tasks[0], "gid")
    out = dealt.groupBy("gid").cogroup(both.groupBy("gid")).applyInPandas(_remove(n_shards, crowded), "id long, n_bytes long, removed array<long>, kept_sha256 string")
    if not whole:
        out = out.join(order, F.col("id") == F.col("number"), "left").select(F.col("name").alias("id"), "n_bytes", "removed", "kept_sha256")
    return out.withColumnRenamed("id", id_col)


def report(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per document, from ``repeated_spans``."""
    lengths = F.transform("removed", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return spans.select(
        id_col,
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.floor(F.size("removed") / 2).cast("long").alias("n_spans"),
        "kept_sha256",
    )
