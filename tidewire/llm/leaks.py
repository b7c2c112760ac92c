"""Evaluation texts inside a corpus, found with a generalised suffix automaton of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tidewire.runtime import cut, written

MIN_RUN = 60  # letters or digits in a row that make a leak
ANCHOR = 20  # letters of the factors by which documents and blocks of items meet
BLOCK_CHARS = 400_000  # letters of the items of one automaton, at most about; more items go in several blocks
LOT_DOCUMENTS = 5_000  # documents that one task reads by the automaton of one block
_DROP = re.compile(r"[\W_]+")
_WIDE = re.compile("[！-～ｦ-ﾝ]")
#: Half-width katakana U+FF66..U+FF9D in full width, in code order.
_KANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
_FOLD = {0xFF01 + i: 0x21 + i for i in range(94)} | {0xFF66 + i: ord(c) for i, c in enumerate(_KANA)}


def normalise(text: str | None) -> str:
    """Letters and digits only, in lower case and ordinary width."""
    kept = _DROP.sub("", text or "")
    if _WIDE.search(kept):
        kept = kept.translate(_FOLD)
    return kept.lower()


def positions(text: str) -> list[int]:
    """For each character of ``normalise(text)`` its place in ``text``."""
    out = []
    for i, c in enumerate(text):
        if c != "_" and c.isalnum():
            out += [i] * len(c.translate(_FOLD).lower())
    return out


class SuffixAutomaton:
    """All factors of several texts. A state is a set of factors that end at the same places; ``own`` are the texts they occur in."""

    def __init__(self, texts: list[str], min_run: int, anchor: int = 0):
        self.next, self.link, self.length, self.own = [{}], [-1], [0], [0]
        for number, text in enumerate(texts):
            last = 0
            for c in text:
                last = self._extend(last, c, 1 << number)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.own[self.link[state]] |= self.own[state]
        self.min_run, self.anchor = min_run, anchor
        self.known: dict[int, tuple[tuple[int, int], ...]] = {}
        self.factors = {text[i : i + anchor] for text in texts for i in range(len(text) - anchor + 1)} if anchor else set()

    def _new(self, length: int, link: int, following: dict, own: int) -> int:
        self.next.append(following), self.link.append(link), self.length.append(length), self.own.append(own)
        return len(self.link) - 1

    def _split(self, p: int, q: int, c: str) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), 0)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: str, bit: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier text has this factor
            if self.length[q] != self.length[last] + 1:
                q = self._split(last, q, c)
            self.own[q] |= bit
            return q
        new = self._new(self.length[last] + 1, 0, {}, bit)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def items_of_run(self, state: int) -> tuple[tuple[int, int], ...]:
        """The texts that hold ``min_run`` or more of the last letters on the way to ``state``, each with how many of them at most."""
        if state not in self.known:
            found, seen, at = [], 0, state
            while self.length[at] >= self.min_run:
                bits = self.own[at] & ~seen
                seen |= bits
                while bits:
                    low = bits & -bits
                    found.append((low.bit_length() - 1, self.length[at]))
                    bits ^= low
                at = self.link[at]
            self.known[state] = tuple(found)
        return self.known[state]

    def matches(self, text: str) -> dict[int, tuple[int, list[list[int]]]]:
        """For each item its longest run in common with ``text``, and the spans (start, end) of ``text`` made of common runs of ``min_run`` or more.

        Every letter is read: the state follows the longest suffix of what has been read that is a factor of an item. With an ``anchor`` the
        stream moves on without reading from one multiple of ``min_run - anchor + 1`` to the next while the ``anchor`` letters there are no factor of an item; a run of
        ``min_run`` covers one of these places, so nothing is missed.
        """
        found: dict[int, list] = {}
        if self.anchor:
            self._jump(text, found)
        else:
            self._read(text, 0, len(text), found)
        for mine in found.values():  # a place read twice may have left touching spans
            mine[1].sort()
            mine[1] = merged(mine[1])
        return {item: (longest, spans) for item, (longest, spans) in found.items()}

    def spans(self, text: str) -> dict[int, list[list[int]]]:
        return {item: spans for item, (_, spans) in self.matches(text).items()}

    def _jump(self, text: str, found: dict[int, list]) -> None:
        n, q, step, i = len(text), self.anchor, self.min_run - self.anchor + 1, 0
        while i + q <= n:
            if text[i : i + q] not in self.factors:
                i += step
                continue
            read = self._read(text, max(0, i - step + 1), i + q, found)
            i = -(-max(i + 1, read) // step) * step

    def _read(self, text: str, at: int, least: int, found: dict[int, list]) -> int:
        """Reads from ``at`` to ``least`` and on while there is an anchor's match; returns where the open match starts."""
        follow, link, length, anchor, run = self.next, self.link, self.length, self.anchor, self.min_run
        here, state, size = follow[0], 0, 0
        for j in range(at, len(text)):
            c = text[j]
            to = here.get(c)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = follow[state].get(c)
                size = length[state] if state else 0
                if to is None:
                    here = follow[0]
                    if j + 1 >= least and anchor:
                        return j + 1
                    continue
            state, size = to, size + 1
            here = follow[to]
            if size >= run:
                for item, most in self.items_of_run(state):
                    mine = found.setdefault(item, [0, []])
                    mine[0] = max(mine[0], min(most, size))
                    spans = mine[1]
                    if spans and spans[-1][1] >= j + 1 - run:
                        spans[-1][1] = max(spans[-1][1], j + 1)
                    else:
                        spans.append([j + 1 - run, j + 1])
            elif anchor and j + 1 >= least and size < anchor:
                return j + 1 - size
        return len(text) - size


def merged(spans: list) -> list[list[int]]:
    """Sorted spans, touching ones as one."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def item_cover(item: str, text: str, spans: list[list[int]], run: int) -> int:
    """Letters of ``item`` under its windows of ``run`` letters that stand in the spans of ``text``."""
    there = {text[i : i + run] for s, e in spans for i in range(s, e - run + 1)}
    return sum(e - s for s, e in merged([[i, i + run] for i in range(len(item) - run + 1) if item[i : i + run] in there]))


@lru_cache(maxsize=2)
def _automaton(texts: tuple[str, ...], min_run: int, anchor: int) -> SuffixAutomaton:
    return SuffixAutomaton(list(texts), min_run, anchor)


def _item_rows(items: DataFrame, key: str, text: str) -> DataFrame:
    """``_item, _clean`` of every item with a key and a letter or digit; repeated rows once."""
    kind = items.schema[key].dataType.simpleString()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([normalise(t) for t in b.column(1).to_pylist()], pa.string())], names=["_item", "_clean"])

    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    return rows.mapInArrow(clean, f"_item {kind}, _clean string").where("_clean <> ''").distinct()


SPANS = "longest long, covered long, letters long, item_covered long, item_letters long, spans array<struct<s:long,e:long>>"


def _report(doc, clean: str, machine: SuffixAutomaton, keys: list, texts: list | tuple, out: list) -> None:
    for item, (longest, spans) in machine.matches(clean).items():
        out.append((doc, keys[item], longest, sum(e - s for s, e in spans), len(clean), item_cover(texts[item], clean, spans, machine.min_run), len(texts[item]), [{"s": s, "e": e} for s, e in spans]))


def _arrow_rows(out: list[tuple], doc_type: pa.DataType, item_type: pa.DataType) -> pa.RecordBatch:
    types = [doc_type, item_type, *[pa.int64()] * 5, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))]
    names = ["_doc", "_item", "longest", "covered", "letters", "item_covered", "item_letters", "spans"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def _scan(batches: Iterator[pa.RecordBatch], keys: list, texts: tuple[str, ...], min_run: int, anchor: int, doc_type: pa.DataType, item_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    machine = _automaton(texts, min_run, anchor)
    for b in batches:
        out: list[tuple] = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            _report(doc, normalise(text), machine, keys, texts, out)
        yield _arrow_rows(out, doc_type, item_type)


def _hash(factor: str) -> int:
    return xxhash.xxh3_64_intdigest(factor.encode("utf-8", "surrogatepass")) - (1 << 63)


def _factors(batches: Iterator[pa.RecordBatch], anchor: int, step: int) -> Iterator[pa.RecordBatch]:
    """For each row's text, the hashes of its factors of ``anchor`` letters at multiples of ``step``."""
    for b in batches:
        keys, found = [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            clean = normalise(t)
            here = {_hash(clean[p : p + anchor]) for p in range(0, len(clean) - anchor + 1, step)}
            keys += [i] * len(here)
            found += here
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), pa.array(found, pa.int64())], names=["_k", "factor"])


def _spans_by_block(rows: DataFrame, items: DataFrame, total: int, min_run: int, anchor: int, block_chars: int, doc_type, item_type) -> DataFrame:
    """The same for items beyond one automaton: documents and blocks of items meet by a factor, and each block's automaton is built where its documents come together.

    The corpus is read once for the factors and once more for the documents that meet a block; a block with many documents goes in lots to several tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(DataType.fromDDL(doc_type.simpleString())), to_arrow_type(item_type)  # every field of a key may be null
    blocks = -(-total // block_chars)
    dealt = written(items.withColumn("_block", F.pmod(F.xxhash64("_item"), F.lit(blocks)).cast("int")), "items")
    step = min_run - anchor + 1
    keyed = rows.select("_doc", "_text", F.xxhash64("_text").alias("_same"))
    seeds = dealt.select("_block", "_clean").mapInArrow(lambda it: _factors(it, anchor, 1), "_k int, factor long").distinct().withColumnRenamed("_k", "_block")
    packed = keyed.select(F.struct("_doc", "_same").alias("_k"), "_text")
    kind = packed.schema["_k"].dataType.simpleString()
    probes = packed.mapInArrow(lambda it: _factors(it, anchor, step), f"_k {kind}, factor long")
    meet = cut(probes.join(seeds, "factor").select(F.col("_k._doc").alias("_doc"), F.col("_k._same").alias("_same"), "_block").distinct())
    lots = meet.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / LOT_DOCUMENTS).cast("int").alias("_lots"))  # one row a block
    lot = meet.join(lots, "_block").withColumn("_lot", F.pmod(F.xxhash64("_doc", "_same"), "_lots").cast("int")).drop("_lots")
    texts = keyed.join(lot, ["_doc", "_same"]).select("_block", "_lot", "_doc", "_text")
    copies = dealt.join(lots, "_block").withColumn("_lot", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1))).select("_block", "_lot", "_item", "_clean")

    def run(documents: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        keys, cleans = block.column("_item").to_pylist(), block.column("_clean").to_pylist()
        order = sorted(range(len(keys)), key=lambda i: str(keys[i]))
        keys, cleans = [keys[i] for i in order], [cleans[i] for i in order]
        if keys and documents.num_rows:
            machine = SuffixAutomaton(cleans, min_run, anchor)
            for doc, text in zip(documents.column("_doc").to_pylist(), documents.column("_text").to_pylist()):
                _report(doc, normalise(text), machine, keys, cleans, out)
        return pa.Table.from_batches([_arrow_rows(out, *arrow)])

    schema = f"_doc {doc_type.simpleString()}, _item {item_type.simpleString()}, {SPANS}"
    return texts.groupBy("_block", "_lot").cogroup(copies.groupBy("_block", "_lot")).applyInArrow(run, schema)


def leaked_spans(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", min_run: int = MIN_RUN, anchor: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``_doc, _item`` with the length of the longest common run, the letters covered on either side, and the spans in the normalised document."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, doc_kind = items.schema[item_key].dataType, documents.schema[doc_key].dataType
    rows = documents.where(F.col(doc_text).isNotNull()).select(F.col(doc_key).alias("_doc"), F.col(doc_text).alias("_text"))
    clean = cut(_item_rows(items, item_key, item_text))
    total = clean.agg(F.sum(F.length("_clean"))).first()[0] or 0
    if total > block_chars:
        return _spans_by_block(rows, clean, total, min_run, anchor or ANCHOR, block_chars, doc_kind, kind)
    got = sorted(((r[0], r[1]) for r in clean.collect()), key=lambda r: (str(r[0]), r[1]))  # at most block_chars letters
    keys, texts, arrow = [k for k, _ in got], tuple(t for _, t in got), (to_arrow_type(DataType.fromDDL(doc_kind.simpleString())), to_arrow_type(kind))
    return rows.mapInArrow(lambda it: _scan(it, keys, texts, min_run, anchor, *arrow), f"_doc {doc_kind.simpleString()}, _item {kind.simpleString()}, {SPANS}")


def find_leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", min_run: int = MIN_RUN, anchor: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each document and item with ``min_run`` or more letters or digits in a row in common.

    Columns: the two keys (``doc_key``, ``item_key``), ``longest`` (letters of the longest run in common), ``covered`` (letters of the document under common
    runs), ``doc_share`` (of the document's letters) and ``item_share`` (the item's letters under common runs, of all of its letters). Everything that is no letter or
    digit, case and width make no difference. Null texts and keys of items take no part; null or empty documents leak nothing;
    repeated rows give one row. Documents are read once and not shuffled while the items together fit one automaton (``block_chars`` letters); larger
    sets of items: see :func:`_spans_by_block`.
    """
    found = leaked_spans(documents, items, doc_key, doc_text, item_key, item_text, min_run, anchor, block_chars)
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    return found.select(F.col("_doc").alias(doc_key), F.col("_item").alias(item_key), "longest", "covered", share("covered", "letters").alias("doc_share"), share("item_covered", "item_letters").alias("item_share")).distinct()


def _clean(batches: Iterator[pa.RecordBatch], max_span: int, max_share: float, doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Cuts the spans (third column) out of the texts (second)."""
    for b in batches:
        out = []
        for doc, text, listed in zip(*(b.column(i).to_pylist() for i in range(3))):
            place = positions(text)
            spans = merged(sorted((x["s"], x["e"]) for x in listed))
            gone = [(s, e) for s, e in spans if e - s >= max_span]
            share = sum(e - s for s, e in spans) / len(place)
            if not gone and share <= max_share:
                continue
            kept, at = [], 0
            for s, e in gone:
                kept.append(text[at : place[s]])
                at = place[e - 1] + 1
            result = None if share > max_share else "".join([*kept, text[at:]])
            out.append((doc, result, len(spans), len(text) - len(result or ""), share))
        types = [doc_type, pa.string(), pa.int32(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["_doc", "clean_text", "spans", "removed_chars", "doc_share"])


def remove_leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", min_run: int = MIN_RUN, anchor: int = 0, max_span: int = MIN_RUN, max_share: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that must change: ``doc_key, clean_text, spans, removed_chars, doc_share``.

    Leaked spans of ``max_span`` letters or more are cut out; a document of which more than ``max_share`` of the letters leaked
    is dropped whole (``clean_text`` null). Documents that are not listed stay as they are; rows that repeat key and text count once.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema[doc_key].dataType
    keyed = documents.where(F.col(doc_text).isNotNull()).select(F.struct(F.col(doc_key).alias("k"), F.xxhash64(doc_text).alias("same")).alias("_id"), F.col(doc_text).alias("_text"))
    found = leaked_spans(keyed, items, "_id", "_text", item_key, item_text, min_run, anchor, block_chars)
    spans = cut(found.groupBy("_doc").agg(F.flatten(F.collect_set("spans")).alias("_spans")))  # of one document each
    few = spans.count() <= LOT_DOCUMENTS
    leaked = keyed.dropDuplicates(["_id"]) if not few else keyed
    both = leaked.join(F.broadcast(spans) if few else spans, leaked["_id"].eqNullSafe(spans["_doc"])).select("_id.k", "_text", "_spans")
    arrow = to_arrow_type(kind)
    cleaned = both.mapInArrow(lambda it: _clean(it, max_span, max_share, arrow), f"_doc {kind.simpleString()}, clean_text string, spans int, removed_chars long, doc_share double")
    return cleaned.withColumnRenamed("_doc", doc_key).distinct()
