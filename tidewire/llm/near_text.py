"""Near-duplicate texts: codes of parts in a Gray-order index, exact check, groups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.gray_index import GrayForest, gray_rank
from tidewire.llm.leaks import normalise
from tidewire.runtime import cut, shuffle_partitions

SIMILAR = 2 / 3  # part of the longer text that must stand in the other, by windows of eight letters
SHINGLE = 9  # bytes of a feature of the fingerprint: three Chinese characters, two English words
HEAD = 24  # bytes that name a part: eight letters in Chinese, four or five English words
AROUND, CLOSE, BRIEF_BYTES = 15, 6, 450  # a part starts where a head's hash is the smallest of so many bytes to either side; in texts up to BRIEF_BYTES of CLOSE
SIZE = 39  # bytes of a text that count as one part where near parts are held against its size
BEFORE, WIDTH = 12, 60  # a part's code covers so many bytes before its start, and so many in all: twenty Chinese letters
RADIUS = 4  # bits by which the codes of near parts differ: two letters changed in twenty
BITS = 50  # of 128 by which the fingerprints of near-duplicates differ at most
NEAR = 42  # bits up to which one near part is enough
EVIDENCE = 6  # beyond that, near parts must make up one in so many of the shorter text's
STANDING = 50  # holders of one code from which it is asked whether they are alike at all
UNLIKE = 48  # bits by which the holders' fingerprints differ in the mean if the part is a standing phrase (61 of 128 for any two texts, 34 for near-duplicates)
WINDOW = 8  # letters of the windows by which holders of a standing phrase meet, as in shared_share
LOT = 2_000_000  # letters of such texts that are held against as many at once, about
MORE = 4  # one in so many letters is asked for beyond those that may differ, so that a pair must share several windows
CHUNK = 2_000_000  # pairs of texts with a window that are made at once
STARS = 200  # records with one part from which groups are found by stars first
SHORT = 40  # letters up to which a text has all its windows as parts
GROUP_ROWS = 200_000  # parts with one head that one task compares, at most about; larger groups are spread by blocks of the code
SAMPLE = 30_000  # records by which large groups are foreseen
COPIES = 200_000  # keys of exact copies that are sent to every task, at most
MAP_BITS = 1 << 24
GAP = 64  # bytes between texts that are hashed together
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finalising hash of 64-bit words."""
    x = x ^ np.uint64(seed)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for odd in (_ODD, _ODD_INVERSE):
        p = np.full(size, odd)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Windows:
    """Hashes of the windows of many texts at once: k bytes of UTF-8 from each character on, so that a window holds about as much in any script."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        gap = b"\0" * GAP
        self.codes = np.frombuffer(gap + gap.join(raw) + gap, np.uint8)
        size = np.array([len(r) for r in raw], np.int64)
        self.begin = GAP + np.r_[0, (size + GAP).cumsum()[:-1]]
        self.end = self.begin + size
        n = len(self.codes)
        self.at = np.flatnonzero(((self.codes & 0xC0) != 0x80) & (self.codes != 0))
        self.owner = np.searchsorted(self.begin, self.at, side="right") - 1
        powers, inverse = _powers(1 << (n - 1).bit_length())
        self.inverse = inverse[self.at]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.codes + np.uint64(1)) * powers[:n], dtype=np.uint64, out=self.sums[1:])
        self.left = self.end[self.owner] - self.at  # bytes from here to the end of the text

    def hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that lie within one text, and the text of each. A shorter text is one window."""
        first = np.r_[True, self.owner[1:] != self.owner[:-1]] if len(self.owner) else np.zeros(0, bool)
        whole = np.flatnonzero((self.left >= k) | first)
        at, width = self.at[whole], np.minimum(self.left[whole], k)
        return mix((self.sums[at + width] - self.sums[at]) * self.inverse[whole]), self.owner[whole]

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The parts of each text: whose they are, the hash of their head and their code.

        A part starts at a head whose hash is the smallest around, so that texts which share a passage start parts at the same places of it, wherever it
        stands. Its code is the odd sketch of the letters around (three bytes each): a letter changed turns two bits, one put in or left out one.
        """
        n = len(self.codes)
        whole = np.flatnonzero(self.left >= HEAD)
        at, owner = self.at[whole], self.owner[whole]
        head = mix((self.sums[at + HEAD] - self.sums[at]) * self.inverse[whole], 0x2545F4914F6CDD1D)
        scale = np.full(n, _MOST)
        scale[at] = head

        def least(width: int) -> np.ndarray:  # of width bytes from each on
            m, k = scale, 1
            while k * 2 <= width:
                m, k = np.minimum(m, np.r_[m[k:], np.full(k, _MOST)]), k * 2
            r = width - k
            return np.minimum(m, np.r_[m[r:], np.full(r, _MOST)]) if r else m

        brief = (self.end - self.begin)[owner] <= BRIEF_BYTES
        starts = np.zeros(len(at), bool)
        for width, which in ((AROUND, ~brief), (CLOSE, brief)):
            low = least(width)
            starts |= which & (head < low[at - width]) & (head <= low[np.minimum(at + 1, n - 1)])
        at, owner, head = at[starts], owner[starts], head[starts]
        letters = mix((self.sums[np.minimum(self.at + 3, n)] - self.sums[self.at]) * self.inverse)
        marks = np.zeros(n + 1, np.uint64)
        marks[self.at + 1] = np.uint64(1) << (letters >> np.uint64(58))
        np.bitwise_xor.accumulate(marks, out=marks)
        low, high = np.maximum(at - BEFORE, self.begin[owner]), np.minimum(at - BEFORE + WIDTH, self.end[owner])
        return owner, head, marks[high] ^ marks[low]


#: For each byte its eight bits in eight lanes of eight bits, in np.unpackbits' order.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _similarity_hash(hashes: list[np.ndarray], owner: np.ndarray, texts: int) -> np.ndarray:
    """A bit for each bit of the hashes: whether most windows of the text have it. Counted eight bits at a time, 255 windows a chunk."""
    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = np.arange(len(owner)) - np.repeat(begin, np.diff(np.r_[begin, len(owner)]))
    chunk = np.flatnonzero(place % 255 == 0)
    parts = [np.add.reduceat(_LANES[h.view(np.uint8).reshape(-1, 8)[:, i]], chunk).view(np.uint8).reshape(-1, 8) for h in hashes for i in range(8)]
    counts = np.add.reduceat(np.concatenate(parts, axis=1), np.searchsorted(chunk, begin), axis=0, dtype=np.int64)
    size = np.diff(np.r_[begin, len(owner)])
    out = np.zeros((texts, len(hashes)), np.uint64)
    out[owner[begin]] = np.packbits(counts * 2 > size[:, None], axis=1).view(np.uint64)
    return out


def short_anchors(text: str, similar: float = SIMILAR, k: int = 8) -> np.ndarray:
    """Anchors by which a text of at most SHORT letters meets every such text that :func:`shared_share` finds similar.

    Similar texts share a window of k letters, or the whole of the shorter one if that has fewer; then its copies must cover
    ``similar`` of the longer one, which bounds the pieces to look at.
    """
    n = len(text)
    found = {text[i : i + k] for i in range(n - k + 1)}
    for m in range(1, min(k, n + 1)):
        times = Counter(text[i : i + m] for i in range(n - m + 1))
        found.update(piece for piece, c in times.items() if c * m >= similar * n)
    return np.array(sorted(xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), 29) for x in found), np.uint64)


def parts(texts: list[str], letters: int = 200_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some 200,000 letters together, which the processor's caches hold."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= letters):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


def fingerprints(texts: list[str]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A 128-bit similarity hash of each text's SHINGLE windows (two words), and the parts of all texts."""
    words, found = np.zeros((len(texts), 2), np.uint64), []
    for at, to in parts(texts):
        if any(texts[at:to]):
            windows = Windows(texts[at:to])
            h, owner = windows.hashes(SHINGLE)
            words[at:to] = _similarity_hash([h, mix(h, 0x5851F42D4C957F2D)], owner, to - at)
            owner, head, code = windows.parts()
            found.append((owner + at, head, code))
    empty = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    return words, tuple(np.concatenate(x) for x in zip(*(found or empty)))


@lru_cache(64)  # candidates come sorted by one of the two
def _windows_of(text: str, k: int) -> frozenset[str]:
    return frozenset([text[i : i + k] for i in range(len(text) - k + 1)])


def shared_share(a: str, b: str, k: int = 8, least: float = 0.0) -> float:
    """The part of the longer text that stands in the other: letters under k-letter windows that the other has too. 0 as soon as it can't reach ``least``."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0.0
    k = min(k, len(b))
    there = _windows_of(b, k)
    covered, upto, spare = 0, 0, len(a) * (1 - least) + 1e-6
    for i in range(len(a) - k + 1):
        if a[i : i + k] in there:
            covered += i + k - max(i, upto)
            upto = i + k
        elif i - covered > spare:  # letters before i that stand in no shared window, as those above i may be covered already
            return 0.0
    return covered / len(a)


def _texts(b: pa.RecordBatch, columns: int) -> list[str]:
    fields = [b.column(i).to_pylist() for i in range(1, 1 + columns)]
    return [normalise("\n".join(x for x in row if x)) for row in zip(*fields)]


def _content(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = _texts(b, columns)
        full = [i for i, t in enumerate(texts) if t]
        content = [xxhash.xxh3_128_digest(texts[i].encode("utf-8", "surrogatepass")) for i in full]
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(full, pa.int64())), pa.array(content, pa.binary())], names=["_key", "content"])


def contents(records: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """``_key, content`` (a hash of 128 bits) of every record with letters or digits, computed once into the shared folder."""
    kind, columns = dict(records.dtypes)[key], len(texts)
    rows = records.where(F.col(key).isNotNull()).select(key, *texts)
    return cut(rows.mapInArrow(lambda it: _content(it, columns), f"_key {kind}, content binary"))


def _describe(batches: Iterator[pa.RecordBatch], columns: int, similar: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = _texts(b, columns)
        words, (owner, head, code) = fingerprints(texts)
        some = np.array([len(t.encode("utf-8", "surrogatepass")) // SIZE + 1 for t in texts], np.int32)
        short = [(i, short_anchors(t, similar)) for i, t in enumerate(texts) if t and len(t) <= SHORT]
        nobody = np.zeros(0, np.int64)
        # windows of short texts: near whatever the code and the fingerprint
        whose, brief = (np.concatenate(x) for x in zip((nobody, nobody.astype(np.uint64)), *((np.full(len(a), i), a) for i, a in short)))
        none = np.zeros(len(brief), np.uint64)
        at = np.r_[owner, whose]
        columns_ = [b.column(0).take(pa.array(at, pa.int64())), np.r_[head, brief], np.r_[code, none], np.r_[words[owner, 0], none], np.r_[words[owner, 1], none], np.r_[some[owner], np.zeros(len(brief), np.int32)]]
        yield pa.RecordBatch.from_arrays([columns_[0], *(pa.array(c.view(np.int64)) for c in columns_[1:5]), pa.array(columns_[5])], names=["_key", "head", "code", "high", "low", "size"])


def describe(records: DataFrame, key: str, texts: list[str], similar: float = SIMILAR) -> DataFrame:
    """``_key, head, code, high, low, size``: the parts of every record with its fingerprint and its size in parts."""
    kind, columns = dict(records.dtypes)[key], len(texts)
    rows = records.where(F.col(key).isNotNull()).select(key, *texts)
    return rows.mapInArrow(lambda it: _describe(it, columns, similar), f"_key {kind}, head long, code long, high long, low long, size int")


def _is_standing(high: np.ndarray, low: np.ndarray) -> bool:
    """Whether the holders of a part are unlike each other, by the mean distance of all pairs of their fingerprints."""
    ones = np.unpackbits(np.stack([high, low], axis=1).view(np.uint8), axis=1).sum(axis=0, dtype=float)
    n = len(high)
    return (2 * ones * (n - ones)).sum() / (n * (n - 1)) >= UNLIKE


def _keys_aside(keys: pa.Array) -> pa.RecordBatch:
    keys = keys.unique()
    none = pa.array(np.zeros(len(keys), np.int32))
    return pa.RecordBatch.from_arrays([keys, pa.nulls(len(keys), keys.type), none, none], names=["_a", "_b", "few", "bits"])


def _search(batches: Iterator[pa.RecordBatch], limit: int, standing: int, stars: int) -> Iterator[pa.RecordBatch]:
    """Pairs with near parts; a key and a null for each holder of a standing phrase, or of a part near it; two nulls where stars left pairs out."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    cell = table.column("cell").to_numpy()
    if (cell < -1).any():
        yield _keys_aside(table.column("_key").filter(pa.array(cell < -1)).combine_chunks())
        table = table.filter(pa.array(cell >= -1)).combine_chunks()
        cell = table.column("cell").to_numpy()
        if not len(cell):
            return
    group = mix(table.column("head").to_numpy().view(np.uint64) ^ mix(cell.view(np.uint64), 1))
    # parts whose head nobody else has are most of them
    order = np.argsort(group)
    alone = np.r_[True, group[order][1:] != group[order][:-1]]
    alone &= np.r_[alone[1:], True]
    rows = order[~alone]
    code = table.column("code").to_numpy().view(np.uint64)
    key_rank = pa.compute.rank(table.column("_key").take(pa.array(rows))).to_numpy()
    rows = rows[np.lexsort((key_rank, gray_rank(code[rows], np.zeros(len(rows), np.uint64))[0], group[rows]))]
    table = table.take(pa.array(rows))
    group, cell, code = group[rows], cell[rows], code[rows]
    high, low = (table.column(c).to_numpy().view(np.uint64) for c in ("high", "low"))
    size, keys = table.column("size").to_numpy(), table.column("_key").combine_chunks()
    keep, aside = np.ones(len(rows), bool), np.zeros(len(rows), bool)
    ends = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(rows) else np.zeros(0, int)
    start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (code[1:] != code[:-1])]) if len(rows) else np.zeros(0, int)
    for at, n in zip(start.tolist(), np.diff(np.r_[start, len(rows)]).tolist()):
        if n > standing and size[at] and _is_standing(high[at : at + n], low[at : at + n]):
            keep[at : at + n] = False
            own = np.searchsorted(ends, at, side="right")
            own = slice(ends[own - 1], ends[own])
            aside[own] |= (np.bitwise_count(code[own] ^ code[at]) <= RADIUS) & (size[own] > 0)
    if aside.any():
        yield _keys_aside(keys.filter(pa.array(aside)))
    kept = np.flatnonzero(keep)
    first, others = _stars(group[kept], code[kept], stars)
    if len(others):  # these come again, once it is known what the stars join
        yield pa.RecordBatch.from_arrays([pa.nulls(1, keys.type), pa.nulls(1, keys.type), pa.array([0], pa.int32()), pa.array([0], pa.int32())], names=["_a", "_b", "few", "bits"])
        first, others, kept = kept[first], kept[others], np.delete(kept, others)
    forest = GrayForest(group[kept], code[kept], label=table.column("label").to_numpy()[kept])
    for a, b in chain([(first, others)], ((kept[a], kept[b]) for a, b, _ in forest.pairs_in_turn(RADIUS))):
        apart = np.bitwise_count(high[a] ^ high[b]).astype(np.int32) + np.bitwise_count(low[a] ^ low[b])
        near = apart <= limit
        split = np.flatnonzero(near & (cell[a] >= 0))  # a pair that meets in several blocks counts in the first
        if len(split):
            differ, own = code[a[split]] ^ code[b[split]], cell[a[split]] >> 13
            first = np.full(len(split), len(_SPREAD))
            for i in range(len(_SPREAD) - 1, -1, -1):
                first[(differ & _SPREAD[i][1]) == 0] = i
            near[split] = first == own
        a, b, apart = a[near], b[near], apart[near]
        for at in range(0, len(a), 50_000):
            p, q, d = a[at : at + 50_000], b[at : at + 50_000], apart[at : at + 50_000]
            x, y = keys.take(pa.array(p)), keys.take(pa.array(q))
            swap = pa.compute.greater(x, y)
            x, y = pa.compute.if_else(swap, y, x), pa.compute.if_else(swap, x, y)
            yield pa.RecordBatch.from_arrays([x, y, pa.array(np.minimum(size[p], size[q])), pa.array(d.astype(np.int32))], names=["_a", "_b", "few", "bits"])


def _stars(group: np.ndarray, code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of codes that more than ``most`` rows have, each row but the first, and that first one. 0 leaves all as they are."""
    start = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (code[1:] != code[:-1])]) if len(group) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(group)])
    first, many = np.repeat(start, size), np.repeat(size > most, size)
    rows = np.flatnonzero(many & (first != np.arange(len(group)))) if most else np.zeros(0, int)
    return first[rows], rows


#: Blocks of a code, RADIUS + 1 of them, so that near codes agree on one: place and mask.
_SPREAD = [(at, np.uint64(((1 << (to - at)) - 1) << at)) for at, to in ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))]


def _spread_large(rows: DataFrame, sample: DataFrame, every: int, group_rows: int, standing: int) -> DataFrame:
    """Adds ``cell``: -1, or for parts whose head has, by the sample, more than ``group_rows`` rows one row for each block of the code, so that no task holds such a group.

    Codes of a standing phrase leave large groups before the shuffle: their holders are counted, and the bits of their fingerprints added up, over all rows.
    Every row under their heads gets a row in a cell below -1 as well, which says that its record meets the others by windows (:func:`window_pairs`).
    """
    estimate = sample.groupBy("head").count().where(F.col("count") * every > group_rows)
    large = cut(estimate.select("head", F.lit(True).alias("_large")))
    if large.isEmpty():
        return rows.withColumn("cell", F.lit(-1).cast("long"))
    marked = rows.join(F.broadcast(large), "head", "left")  # at most rows / group_rows heads
    ones = [F.sum(F.shiftright(w, i).bitwiseAND(F.lit(1))).alias(f"{w}{i}") for w in ("high", "low") for i in range(64)]
    counted = marked.where("_large and size > 0").groupBy("head", "code").agg(F.count(F.lit(1)).alias("n"), *ones).where(F.col("n") > standing)
    apart = sum((2 * F.col(f"{w}{i}").cast("double") * (F.col("n") - F.col(f"{w}{i}")) for w in ("high", "low") for i in range(64)), F.lit(0.0)) / (F.col("n") * (F.col("n") - 1.0))
    hot = cut(counted.where(apart >= UNLIKE).select("head", "code", F.lit(True).alias("_hot")))
    marked = marked.join(F.broadcast(hot) if hot.count() <= COPIES else hot, ["head", "code"], "left")
    marked = marked.join(F.broadcast(hot.select("head", F.lit(True).alias("_phrased")).distinct()), "head", "left")  # some of the large heads
    blocks = F.array(*[F.lit(i << 13).cast("long").bitwiseOR(F.shiftrightunsigned("code", at).bitwiseAND(F.lit((1 << 13) - 1))) for i, (at, _) in enumerate(_SPREAD)])
    aside = F.array(F.lit(-2).cast("long") - F.pmod(F.xxhash64("_key"), F.lit(1024)))
    cells = F.when(F.col("size") == 0, blocks).when(F.col("_hot"), aside).when(F.col("_phrased"), F.concat(blocks, aside)).otherwise(blocks)
    return marked.withColumn("cell", F.explode(F.when(F.col("_large"), cells).otherwise(F.array(F.lit(-1).cast("long"))))).drop("_large", "_hot", "_phrased")


def _cleaned(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_texts(b, columns), pa.string())], names=["_key", "clean"])


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition as one row: its number, keys and texts."""
    held = [b for b in batches if b.num_rows]
    if held:
        columns = [pa.chunked_array([b.column(i) for b in held]).combine_chunks() for i in (0, 1)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *lists], names=["lot", "keys", "texts"])


def similar_by_windows(texts: list[str], others: int, similar: float = SIMILAR) -> Iterator[tuple[int, int]]:
    """All pairs of texts of which ``similar`` of the longer one stands in the other, the longer first; with ``others`` only those of one of the first so many and one of the rest.

    Of the longer text at most 1 - ``similar`` of the letters are outside of shared windows. So of a few more letters than that, taken where windows have
    fewest holders, some are in shared windows: these are among the windows that touch the letters, at least one for each WINDOW letters. Pairs that
    share so many are checked letter by letter; nothing else is left out. Texts of fewer than WINDOW letters are looked for as they are.
    """
    for x in (i for i, t in enumerate(texts) if 0 < len(t) < WINDOW):
        for y, t in enumerate(texts):
            if x != y and texts[x] in t and not (others and (x < others) == (y < others)) and shared_share(t, texts[x], WINDOW, similar) >= similar:
                yield y, x
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.r_[0, size.cumsum()[:-1]]
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    at = np.flatnonzero(np.arange(len(letters)) - begin[owner] + WINDOW <= size[owner])  # where windows start
    if not len(at):
        return
    window = np.zeros(len(letters) - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        window *= _ODD
        window += letters[j : j + len(window)]
    window = mix(window[at])
    order = np.argsort(window, kind="stable")  # texts stay in order
    number = np.empty(len(at), np.int32)
    fresh = np.r_[True, window[order][1:] != window[order][:-1]]
    number[order] = fresh.cumsum() - 1
    whose = owner[at]
    first = fresh | np.r_[True, whose[order][1:] != whose[order][:-1]]  # a text that has a window twice holds it once
    holder, held = whose[order][first], number[order][first]
    start = np.searchsorted(held, np.arange(held[-1] + 2))
    middle = start[:-1] + np.bincount(held[holder < others], minlength=len(start) - 1)
    del window, order, fresh, first, held, letters
    # the holders that each window asks for
    low, high = (np.where(whose < others, middle[number], start[number]), np.where(whose < others, start[number + 1], middle[number])) if others else (start[number], start[number + 1])
    cost = np.zeros(len(owner), np.int8)
    cost[at] = np.log2(high - low + 1).astype(np.int8)
    most = cost.copy()
    for j in range(1, WINDOW):
        np.maximum(most[j:], cost[:-j], out=most[j:])
    spared = (size * (1 - similar) + 1e-6).astype(np.int64)
    asked = np.minimum(size, spared + np.maximum(1, size // MORE))
    need = -(-(asked - spared) // WINDOW)
    order = np.argsort(owner.astype(np.int64) * 128 + most, kind="stable")
    chosen = np.zeros(len(owner) + 1, np.int32)
    chosen[1 + order[np.arange(len(owner)) - begin[owner] < asked[owner]]] = 1
    chosen = chosen.cumsum()
    asks = np.flatnonzero((chosen[at + WINDOW] > chosen[at]) & (high > low))
    low, count, whose = low[asks], (high - low)[asks], whose[asks]
    n = len(texts)
    edge = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]]) if len(whose) else np.zeros(0, int)
    total = np.r_[0, count.cumsum()]
    size_of = total[np.r_[edge[1:], len(whose)]] - total[edge] if len(edge) else np.zeros(0, np.int64)
    edge, i = np.r_[edge, len(whose)], 0
    while i < len(size_of):
        to = max(i + 1, int(np.searchsorted(size_of[i:].cumsum(), CHUNK, side="right")) + i)
        tally = np.zeros(0 if to > i + 1 else n, np.int64)
        rows = np.arange(edge[i], edge[to])
        for part in np.split(rows, np.flatnonzero(np.diff((total[rows + 1] - total[edge[i]]) // CHUNK)) + 1):
            c = count[part]
            nth = np.arange(int(c.sum())) - np.repeat(np.r_[0, c.cumsum()[:-1]], c)
            b = holder[np.repeat(low[part], c) + nth].astype(np.int64)
            if to == i + 1:  # one text, whose pairs may be more than a chunk
                tally += np.bincount(b, minlength=n)
            else:
                tally = np.concatenate([tally, np.repeat(whose[part].astype(np.int64), c) * n + b])
        if to == i + 1:
            b = np.flatnonzero(tally >= need[whose[edge[i]]])
            a = np.full(len(b), whose[edge[i]])
        else:
            pair, times = np.unique(tally, return_counts=True)
            a, b = pair // n, pair % n
            enough = times >= need[a]
            a, b = a[enough], b[enough]
        fits = (a != b) & (size[b] <= size[a])
        for x, y in sorted(zip(b[fits].tolist(), a[fits].tolist())):
            if shared_share(texts[y], texts[x], WINDOW, similar) >= similar:
                yield y, x
        i = to


def _tiles(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            one, other = b.column(0)[i].as_py(), b.column(3)[i].as_py()
            keys, texts = b.column(1)[i].values, b.column(2)[i].as_py()
            others = 0 if one == other else len(texts)
            if others:
                keys, texts = pa.concat_arrays([keys, b.column(4)[i].values]), texts + b.column(5)[i].as_py()
            found = np.array(list(similar_by_windows(texts, others, similar)), np.int64).reshape(-1, 2)
            x, y = keys.take(pa.array(found[:, 0])), keys.take(pa.array(found[:, 1]))
            swap = pa.compute.greater(x, y)
            yield pa.RecordBatch.from_arrays([pa.compute.if_else(swap, y, x), pa.compute.if_else(swap, x, y)], names=["_a", "_b"])


def window_pairs(clean: DataFrame, similar: float = SIMILAR, lot: int = LOT) -> DataFrame:
    """``_a, _b`` (smaller first): of ``_key, clean`` all pairs of :func:`similar_by_windows`, each lot of some ``lot`` letters held against each."""
    kind = clean.schema["_key"].dataType.simpleString()
    letters = clean.agg(F.coalesce(F.sum(F.length("clean")), F.lit(0))).first()[0]
    lots = cut(clean.repartition(max(1, -(-letters // lot)), F.xxhash64("_key")).mapInArrow(_lots, f"lot int, keys array<{kind}>, texts array<string>"))
    other = lots.toDF("lot2", "keys2", "texts2")
    both = lots.join(other.hint("shuffle_replicate_nl"), F.col("lot") <= F.col("lot2"))  # no copies of the lots are written
    return both.mapInArrow(lambda it: _tiles(it, similar), f"_a {kind}, _b {kind}").where("_a < _b").distinct()


def candidate_pairs(records: DataFrame, key: str, texts: list[str], described: DataFrame, similar: float = SIMILAR, limit: int = BITS, group_rows: int = GROUP_ROWS, standing: int = STANDING, stars: int = 0, labels: DataFrame | None = None) -> DataFrame:
    """``_a, _b`` (smaller first): pairs of records, one of each content, that have near parts and whose fingerprints differ in at most ``limit`` bits, in the shared folder.

    Records with a part that more than ``standing`` have, unlike each other in the mean, or near such a one meet by :func:`window_pairs` besides, as that part is left out.
    Parts meet by their head; in each group a Gray-order index over their codes finds those within RADIUS bits. Short texts meet by all their windows.
    With ``stars`` a part that more records have joins each of them with the first only, and a pair of nulls says that pairs were left out; with ``labels``
    (``_key, label``) no pairs of one label are sought, and none by windows, as the first search has these.
    """
    spark = records.sparkSession
    total = described.count()
    firsts = described.groupBy("content").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = cut(described.select("_key", "content").join(firsts, "content").where("_key <> _first").select(F.col("_key").alias(key)).distinct())
    few_copies = copies.count() <= COPIES  # then only they travel, not all records
    first = records.where(F.col(key).isNotNull()).select(key, *texts).join(F.broadcast(copies) if few_copies else copies, key, "left_anti")
    rows = describe(first, key, texts, similar)
    if total > group_rows:  # fewer records can't fill a large group
        every = max(1, -(-total // SAMPLE))
        sample = describe(first.where(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(every)) == 0), key, texts, similar)
        rows = _spread_large(rows, sample, every, group_rows, standing)
    else:
        rows = rows.withColumn("cell", F.lit(-1).cast("long"))
    if labels is None:
        rows = rows.withColumn("label", F.lit(0).cast("long"))
    else:
        rows = rows.join(F.broadcast(labels) if labels.count() <= COPIES else labels, "_key", "left").withColumn("label", F.coalesce("label", F.lit(0).cast("long")))
    kind = described.schema["_key"].dataType
    tasks = max(shuffle_partitions(spark), -(-total // 30_000))
    met = rows.repartition(tasks, "head", "cell").mapInArrow(lambda it: _search(it, limit, standing, stars), f"_a {kind.simpleString()}, _b {kind.simpleString()}, few int, bits int")
    counted = met.where("_a is null or _b is null or _a <> _b").groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("near"), F.max("few").alias("few"), F.min("bits").alias("bits"))
    found = cut(counted.where((F.col("bits") <= NEAR) | (F.col("near") * EVIDENCE >= F.col("few"))).select("_a", "_b"))
    pairs, aside = found.where("_a is null or _b is not null"), found.where("_a is not null and _b is null").select(F.col("_a").alias(key))
    number = aside.count() if labels is None else 0
    if not number:
        return pairs
    columns = len(texts)
    holders = first.join(F.broadcast(aside) if number <= COPIES else aside, key, "left_semi").select(key, *texts)
    clean = cut(holders.mapInArrow(lambda it: _cleaned(it, columns), f"_key {kind.simpleString()}, clean string"))
    return cut(pairs.unionByName(window_pairs(clean, similar)).distinct())


def _member_map(keys: DataFrame) -> np.ndarray:
    """A bit map of MAP_BITS bits of the keys' hashes: small, whatever their number."""
    place = keys.select(F.pmod(F.xxhash64("_key"), F.lit(MAP_BITS)).alias("p")).groupBy(F.floor(F.col("p") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("v"))
    out = np.zeros(MAP_BITS // 32, np.uint32)
    got = place.toPandas()
    out[got["w"].to_numpy()] = got["v"].to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _needed(batches: Iterator[pa.RecordBatch], columns: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = np.unpackbits(bits, bitorder="little")
    for b in batches:
        hit = np.flatnonzero(table[b.column(b.num_columns - 1).to_numpy()])
        if len(hit):
            part = b.take(pa.array(hit))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_texts(part, columns), pa.string())], names=["_key", "clean"])


def _confirm(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        share = np.array([shared_share(x, y, least=similar) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], float)
        keep = pa.array(share >= similar)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(share).filter(keep)], names=["_a", "_b", "share"])


def similar_pairs(records: DataFrame, key: str, texts: list[str], similar: float = SIMILAR, limit: int = BITS, group_rows: int = GROUP_ROWS, standing: int = STANDING) -> tuple[DataFrame, DataFrame]:
    """Links and membership of near-duplicate records.

    The first result has ``_a, _b, share``: pairs of different contents (each by its smallest key) of which at least ``similar`` of the longer
    text stands in the other in any order. The second has ``_key, _first`` for every record with text: the smallest key with the same content.
    Content is the letters and digits of ``texts`` together, whatever their case and width. Records with null key or without a letter or digit take
    no part; very short texts are compared whole. Keys should be unique; a repeated key counts as one record. Empty input gives empty results.
    """
    described = contents(records, key, texts)
    pairs = candidate_pairs(records, key, texts, described, similar, limit, group_rows, standing)
    return confirmed(records, key, texts, pairs, similar), _members(described)


def _members(described: DataFrame) -> DataFrame:
    firsts = described.groupBy("content").agg(F.min("_key").alias("_first"))
    return described.select("_key", "content").join(firsts, "content").select("_key", "_first")


def confirmed(records: DataFrame, key: str, texts: list[str], pairs: DataFrame, similar: float) -> DataFrame:
    """``_a, _b, share`` of the ``pairs`` of which at least ``similar`` of the longer text stands in the other, by the whole texts."""
    keys = pairs.select(F.explode(F.array("_a", "_b")).alias("_key"))
    packed = np.packbits(_member_map(keys), bitorder="little")
    kind, columns = dict(records.dtypes)[key], len(texts)
    rows = records.where(F.col(key).isNotNull()).select(key, *texts, F.pmod(F.xxhash64(key), F.lit(MAP_BITS)).cast("int").alias("_place"))
    clean = rows.mapInArrow(lambda it: _needed(it, columns, packed), f"_key {kind}, clean string")
    both = pairs.join(clean.withColumnsRenamed({"_key": "_a", "clean": "_x"}), "_a").join(clean.withColumnsRenamed({"_key": "_b", "clean": "_y"}), "_b").select("_a", "_b", "_x", "_y")
    return both.mapInArrow(lambda it: _confirm(it, similar), f"_a {kind}, _b {kind}, share double")


def similar_groups(records: DataFrame, key: str, texts: list[str], similar: float = SIMILAR, limit: int = BITS, group_rows: int = GROUP_ROWS, standing: int = STANDING, stars: int = STARS) -> DataFrame:
    """``_key, group_id`` for every record with text: the groups that the links of :func:`similar_pairs` make, without all pairs of a large group.

    A part that more than ``stars`` records have first joins each of them with one other only, which brings the versions of a story together; where that left
    pairs out, those whose groups still differ are sought then. A pair that is never looked at is in one group already, so the groups are the same.
    """
    described = contents(records, key, texts)
    pairs = candidate_pairs(records, key, texts, described, similar, limit, group_rows, standing, stars=stars)
    first = cut(confirmed(records, key, texts, pairs.where("_a is not null"), similar))
    if pairs.where("_a is null").isEmpty():
        return components(first, _members(described))
    labels = cut(group_labels(first).select(F.col("v").alias("_key"), F.xxhash64("g").alias("label")))
    more = confirmed(records, key, texts, candidate_pairs(records, key, texts, described, similar, limit, group_rows, standing, labels=labels), similar)
    return components(first.unionByName(cut(more)), _members(described))


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """``record_a, record_b`` (smaller first): every linked pair of records, exact copies included."""
    copies = members.where("_key <> _first")
    # only contents that a link or a copy needs are brought together
    wide = members.join(links.select(F.explode(F.array("_a", "_b")).alias("_first")).union(copies.select("_first")).distinct(), "_first", "left_semi")
    wide = cut(wide)
    left, right = wide.withColumnsRenamed({"_key": "x", "_first": "_a"}), wide.withColumnsRenamed({"_key": "y", "_first": "_b"})
    across = links.select("_a", "_b").join(left, "_a").join(right, "_b").select("x", "y")
    within = left.join(wide.withColumnsRenamed({"_key": "y", "_first": "_a"}), "_a").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"))


def components(links: DataFrame, members: DataFrame, rounds: int = 1000) -> DataFrame:
    """``_key, group_id`` for every record: the smallest key that links and copies lead to. Copies follow their first record."""
    label = group_labels(links, rounds)
    return members.join(label, members["_first"] == label.v, "left").select("_key", F.coalesce("g", "_first").alias("group_id"))


def group_labels(links: DataFrame, rounds: int = 1000) -> DataFrame:
    """``v, g`` for every record with a link: the smallest key that links lead to.

    Each round a label falls along links, a root is hooked to the smallest label next to any record that has it, and labels jump along
    themselves, so that long chains take few rounds; each is written to the shared folder. The walk ends when nothing changes, and raises after
    ``rounds``.
    """
    edges = cut(links.select("_a", "_b").union(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct())
    label = cut(edges.groupBy("_a").agg(F.min("_b").alias("m")).select(F.col("_a").alias("v"), F.least("_a", "m").alias("g")))
    for _ in range(rounds):
        near = edges.join(label.select(F.col("v").alias("_b"), F.col("g").alias("n")), "_b").groupBy("_a").agg(F.min("n").alias("n"))
        seen = cut(label.join(near, label.v == near["_a"]).select("v", "g", F.least("g", "n").alias("n")))
        hook = seen.groupBy(F.col("g").alias("root")).agg(F.min("n").alias("to"))
        fell = cut(seen.join(hook, seen.v == hook.root, "left").select("v", "g", F.least("n", F.coalesce("to", "n")).alias("h")))
        jump = fell.select(F.col("v").alias("h"), F.col("h").alias("hh"))
        new = cut(fell.join(jump, "h", "left").select("v", "g", F.least("h", F.coalesce("hh", "h")).alias("h")))
        changed = not new.where("g <> h").isEmpty()
        label = new.select("v", F.col("h").alias("g"))
        if not changed:
            break
    else:
        raise RuntimeError(f"groups not settled after {rounds} rounds")
    return label
