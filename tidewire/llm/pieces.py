"""Oversized texts cut at natural boundaries, by range-maximum queries over boundary strengths."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import tokens

LIMIT, OVERLAP = 512, 32
NAMES = {0: "none", 1: "space", 2: "clause", 3: "sentence", 4: "line", 5: "paragraph", 6: "end"}
_BREAK = re.compile("(?:\r\n|[\n\r \u0085])(?P<more>(?:[ \t　]*(?:\r\n|[\n\r \u0085]))+)?| |(?P<sentence>(?:[。！？!?…]+|\\.(?=[\\s\"'”’)\\]]|$))[\"'”’」』）)\\]]*[ \t]*)|(?P<clause>[，；：、,;:—]+[ \t]*)|(?P<space>[ \t　]+)")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``text`` (a cut there leaves the boundary's characters to the left) and their strengths 1 to 5."""
    at, strength = [], []
    for m in _BREAK.finditer(text):
        at.append(m.end())
        kind = m.lastgroup
        strength.append(3 if kind == "sentence" else 2 if kind == "clause" else 1 if kind == "space" else 5 if kind == "more" or m[0] == " " else 4)
    return np.array(at, np.int64), np.array(strength, np.int64)


class RangeMaximum:
    """Sparse table: the place of the largest value in any window, the rightmost on a tie, in constant time a query."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values * (len(values) + 1) + np.arange(len(values))]
        size = len(values) + 1
        self.size = size
        width = 1
        while width * 2 <= min(longest, len(values)):
            below = self.levels[-1]
            self.levels.append(np.maximum(below[:-width], below[width:]))
            width *= 2

    def query(self, low: int, high: int) -> int:
        """Of places low..high, both counted."""
        level = (high - low + 1).bit_length() - 1
        best = max(int(self.levels[level][low]), int(self.levels[level][high - (1 << level) + 1]))
        return best % self.size


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = tokens.VOCABULARY) -> list[tuple[int, int, int, int]]:
    """Pieces of ``text`` as (start, end, tokens, strength of the cut at the end); offsets in characters.

    Every piece encodes to at most ``limit`` tokens; the next piece starts ``overlap`` tokens before the cut, or as few more as a
    character's start needs. The cut is the strongest boundary that leaves between half the limit and the limit, the
    rightmost of equals; where there is none, the last character that fits.
    """
    if not text:
        return []
    ids = np.array(tokens.encoding(vocabulary)[0].encode_ordinary(text), np.int64)
    n = len(ids)
    if n <= limit:
        return [(0, len(text), n, 6)]
    ends = tokens.encoding(vocabulary)[1][ids].cumsum()  # byte offset after each token
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts_char = np.append((raw & 0xC0) != 0x80, True)
    char_at = np.append(0, (starts_char[:-1]).cumsum())  # characters before a byte offset, where one starts
    whole = starts_char[ends]
    strength = np.where(whole, 0, -1)
    at, strong = boundaries(text)
    byte_of = np.flatnonzero(starts_char)
    token = np.searchsorted(ends, byte_of[at])
    exact = token < n
    exact[exact] = ends[token[exact]] == byte_of[at[exact]]
    strength[token[exact]] = strong[exact]
    table = RangeMaximum(strength + 1, limit)
    chars = char_at[ends]
    pieces, start = [], 0
    least = max(limit // 2, overlap + 8)
    while True:
        begin = int(chars[start - 1]) if start else 0
        if n - start <= limit:
            end = n - 1
        else:
            room = limit
            while True:
                end = table.query(start + min(least, room) - 1, start + room - 1)
                if strength[end] < 0:  # not even a character ends in the window: take what precedes it
                    end = next((e for e in range(end, start, -1) if strength[e] >= 0), end)
                if end - start + 1 < limit - 4 or (over := tokens.count(text[begin : int(chars[end])], vocabulary) - limit) <= 0:
                    break
                room -= max(1, over)
        pieces.append((begin, int(chars[end]), end - start + 1, 6 if end == n - 1 else int(strength[end])))
        if end == n - 1:
            return pieces
        back = end + 1 - overlap
        while back > start + 1 and not whole[back - 1]:
            back -= 1
        start = max(back, start + 1)


def _pieces(batches: Iterator[pa.RecordBatch], limit: int, overlap: int, vocabulary: str, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    types = [key_type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
    names = ["_key", "piece_no", "pieces", "start_char", "end_char", "n_tokens", "boundary", "piece"]
    for b in batches:
        out, chars = [], 0
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = cut(text or "", limit, overlap, vocabulary) or [(0, 0, 0, 6)]
            for i, (s, e, n, kind) in enumerate(found, 1):
                out.append((key, i, len(found), s, e, n, NAMES[kind], (text or "")[s:e]))
                chars += e - s
            if chars > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def split_oversized(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """``key, piece_no, pieces, start_char, end_char, n_tokens, boundary, piece`` for every row of ``documents``.

    Texts within ``limit`` tokens are one piece; null and empty texts one empty piece of 0 tokens. Boundaries in falling strength:
    paragraph, line, sentence, clause, space. ``overlap`` must stay under half the limit. Each document is cut where it is read:
    there is no shuffle, and memory follows the longest single text. Rows with null or repeated keys are cut like any other.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and less than half the limit")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema[key].dataType
    arrow = to_arrow_type(kind)
    schema = f"_key {kind.simpleString()}, piece_no int, pieces int, start_char long, end_char long, n_tokens int, boundary string, piece string"
    return documents.select(key, text).mapInArrow(lambda it: _pieces(it, limit, overlap, vocabulary, arrow), schema).withColumnRenamed("_key", key)
