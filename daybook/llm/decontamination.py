"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ from a passage by
``k = floor(m * rate)`` edits. It is split into k + 1 pieces; k edits can't touch
all of them, so every such passage holds at least one piece unchanged. All
pieces of a block of items go into one multi-pattern automaton, every whole
text is read once against it, and the surroundings of each hit are verified
with Myers' bit-parallel edit distance.

Items are a query set: equal ones are grouped in Spark, and their distinct texts
are sent to the tasks in blocks of about ``BLOCK_BYTES`` characters (one text more
at most), cut by a running size, with one pass over the documents for each block.
A block's hits are written and what was sent is destroyed before the next one, so
driver and tasks hold one block however many items there are; ids are joined back
to the hits. Documents are neither
shuffled nor grouped.

Items and texts are compared in lower case, with every run of other characters
than letters and digits as one space. Null and empty texts and items match
nothing; an item shorter than ``least`` characters after that has the same budget,
none below 13 characters at 8 %, and its passage must begin and end at word
boundaries. Ids only name items: those without one match like all others. Equal
rows are reported alike, an item and a document at most once a row, at the
closest and then first passage. Empty tables give empty results; other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.store import cut, place

RATE = 0.08
LEAST = 40
BLOCK_BYTES = 8 << 20

_OTHER = re.compile(r"[\W_]+")


def normalized(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def distances(pattern: str, text: str, whole: bool = False) -> Iterator[int]:
    """For each character of ``text``, the least edit distance of ``pattern`` to a part that ends there (Myers 1999).

    ``whole``: to the one part that begins with ``text`` and ends there.
    """
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | whole) & full
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        yield score


def best_match(item: str, text: str, k: int) -> tuple[int, int, int] | None:
    """``distance, start, end`` of the closest, then first, part of ``text`` within ``k`` edits of ``item``."""
    end, low = 0, k + 1
    for i, d in enumerate(distances(item, text)):
        if d < low:
            low, end = d, i + 1
            if not d:
                break
    if low > k:
        return None
    # Backwards from that end: the shortest part whose distance is the least one.
    back = text[max(0, end - len(item) - k) : end][::-1]
    length = next(i for i, d in enumerate(distances(item[::-1], back)) if d == low) + 1
    return low, end - length, end


def best_words(item: str, text: str, lo: int, hi: int, k: int) -> tuple[int, int, int] | None:
    """As ``best_match`` in ``text[lo:hi]``, among the parts that begin and end at word boundaries."""
    found = []
    for a in range(max(1, lo), hi):
        if text[a - 1] == " " != text[a]:
            part = text[a : a + len(item) + k]
            found += [(d, a + i + 1, a) for i, d in enumerate(distances(item, part, whole=True)) if d <= k and text[a + i + 1 : a + i + 2] == " " != part[i]]
    d, end, start = min(found, key=lambda x: (x[0], x[1], -x[2]), default=(0, 0, None))
    return None if start is None else (d, start, end)


def pieces(item: str, k: int) -> list[tuple[str, int]]:
    """``item`` in k + 1 consecutive pieces of nearly equal length, with their offsets."""
    edges = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(item[a:b], a) for a, b in zip(edges, edges[1:], strict=False)]


class Matcher:
    """The automaton over all pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int) -> None:
        self.items: list[tuple[list[int], str, int, bool]] = []
        same: dict[str, list[int]] = {}
        for item_id, text in items:
            same.setdefault(text, []).append(item_id)
        found: dict[str, list[tuple[int, int]]] = {}
        for text, ids in same.items():
            if not text:
                continue
            short = len(text) < least
            k = int(len(text) * rate)
            for piece, offset in [(f" {text} ", -1)] if short and not k else pieces(text, k):
                found.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((ids, text, k, short))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """``item_id, distance, start, end`` in ``text``, normalized and with a space before and behind."""
        if not self.items:
            return []
        where: dict[int, list[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for n, offset in places:
                where.setdefault(n, []).append(end + 1 - length - offset)
        out = []
        for n, starts in where.items():
            ids, body, k, short = self.items[n]
            best = None
            for lo, hi in _windows(sorted(starts), len(body), k):
                lo = max(0, lo)
                hit = best_words(body, text, lo, min(hi, len(text)), k) if short else best_match(body, text[lo:hi], k)
                if hit and (best is None or hit[0] < best[0]):
                    best = hit if short else (hit[0], hit[1] + lo, hit[2] + lo)
                    if not hit[0]:
                        break
            if best:
                out += [(i, *best) for i in ids]
        return out


def _windows(starts: list[int], length: int, k: int) -> Iterator[tuple[int, int]]:
    """The parts of a text that may hold the item, merged where they overlap."""
    lo, hi = starts[0] - k, starts[0] + length + k
    for s in starts[1:]:
        if s - k <= hi:
            hi = max(hi, s + length + k)
        else:
            yield lo, hi
            lo, hi = s - k, s + length + k
    yield lo, hi


def _original(text: str, start: int, end: int) -> tuple[int, int]:
    """Offsets in a text from offsets in its normalized form with a space before and behind."""
    at, low = [-1], text.lower()
    # Lower case may be longer than the text; then each character is lowered by itself.
    origin = list(range(len(low))) if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
    last = 0
    for m in _OTHER.finditer(low):
        at.extend(origin[last : m.start()])
        if m.start() and m.end() < len(low):
            at.append(origin[m.start()])
        last = m.end()
    at.extend(origin[last:])
    inside = [p for p in at[start:end] if p >= 0]
    return (inside[0], inside[-1] + 1) if inside else (0, 0)


def _texts(items: DataFrame, item: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """Items as ``i, t`` with their normalized texts, and the distinct texts as ``n, t`` with the block they are sent in."""

    @F.pandas_udf("string")
    def plain(found: pd.Series) -> pd.Series:
        return pd.Series([normalized(t) for t in found], dtype=object)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, size = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            sizes = np.array([len(t) for t in batch.column(0).to_pylist()], np.int64)
            before = size + np.cumsum(sizes) - sizes
            columns = [pa.array([part] * len(sizes), pa.int32()), pa.array(np.arange(count, count + len(sizes))), pa.array(before), batch.column(0)]
            count, size = count + len(sizes), size + int(sizes.sum())
            yield pa.RecordBatch.from_arrays(columns, ["part", "number", "before", "t"])

    named = cut(items.select(F.col(item).alias("i"), plain(F.col(item_text)).alias("t")).where("t != ''"), "test-items")
    texts = cut(named.select("t").distinct().mapInArrow(number, "part int, number long, before long, t string"), "test-texts")
    # One row per written partition, whatever the items.
    base = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = texts.groupBy("part").agg(F.sum(F.char_length("t")).alias("size")).select("part", F.coalesce(base, F.lit(0)).alias("base"))
    n = F.shiftleft(F.col("part").cast("long"), 33) + F.col("number")
    block = F.floor((F.col("base") + F.col("before")) / BLOCK_BYTES).cast("long")
    return named, cut(texts.join(F.broadcast(bases), "part").select(n.alias("n"), "t", block.alias("block")), "test-blocks")


def _hits(docs: DataFrame, texts: DataFrame, doc: str, text: str, rate: float, least: int, row: str | None) -> DataFrame:
    """``d, n, distance, start, end, _place`` of every document and distinct text."""
    spark = docs.sparkSession
    kind = f"d {docs.schema[doc].dataType.simpleString()}, n long, distance int, start int, `end` int, _place long"
    slim = docs.select(F.col(doc).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"), (F.col(row) if row else F.lit(0).cast("long")).alias("_place"))
    last = texts.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    out = None
    for b in range(last + 1):
        sent = spark.sparkContext.broadcast([(r.n, r.t) for r in texts.where(F.col("block") == b).toLocalIterator()])

        def match(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate, least)
            for batch in batches:
                rows = []
                for d, t, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for n, distance, start, end in matcher.search(f" {normalized(t)} "):
                        rows.append((d, n, distance, *_original(t, start, end), p))
                kinds = (batch.column(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["d", "n", "distance", "start", "end", "_place"])

        hits = slim.mapInArrow(match, kind)
        if last:
            hits = cut(hits, "test-hits")
            sent.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out


def find(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, least: int = LEAST, row: str | None = None) -> DataFrame:
    """``doc``, ``item``, ``distance``, ``start``, ``end`` (code points of the whole text); ``row`` names a LONG column to keep as ``_place``."""
    named, texts = _texts(items, item, item_text)
    names = named.join(texts.select("n", "t"), "t").select("n", "i")
    out = _hits(docs, texts, doc, text, rate, least, row).join(names, "n")
    found = [F.col("d").alias(doc), F.col("i").alias(item), "distance", "start", "end"]
    return out.select(*found, *(["_place"] if row else []))


def drop_contaminated(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, least: int = LEAST) -> DataFrame:
    """``docs`` without the rows that hold a test item."""
    whole = cut(docs.select(F.struct(*docs.columns).alias("row"), place().alias("_place")), "decontaminate")
    seen = whole.select(F.col(f"row.{doc}").alias("d"), F.col(f"row.{text}").alias("t"), "_place")
    hit = cut(_hits(seen, _texts(items, item, item_text)[1], "d", "t", rate, least, "_place").select("_place").distinct(), "contaminated")
    return whole.join(hit, "_place", "left_anti").select("row.*")
