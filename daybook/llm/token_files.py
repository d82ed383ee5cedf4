"""Token-id files: an adaptive context-mixing range coder in independent blocks.

Documents are range-partitioned by id; each task encodes its texts, packs whole
documents into blocks of about ``BLOCK`` ids and yields one row per block. The
rows are written as Parquet, so tasks commit and retry as in any Spark job; the
body of a row is the block's own format (``encode_block``).

The coder predicts the next id from order 0 (adaptive counts of all ids), order 1
(the id that last followed this one) and order 2 (the id that last followed these
two). The three are mixed into one distribution: the counts, plus a weight for
each predicted id that follows from how often predictions of its confidence came
true so far. The mix drives a range coder of 48-bit state with 16-bit output,
whose numbers are whole and below 2^53, so that doubles hold and divide them
exactly; carries are added up when all is coded. A block is cut into lanes of ``STEPS`` ids
that are coded side by side and share the block's model, so each step is a few
array operations over all lanes. Every block starts from an empty model and ends
with a CRC-32 of all its bytes: a damaged block is found, and harms no other.

Null and empty texts have the end id alone; null ids sort first; documents with
equal ids keep their order in the scan, and however many there are, they spread
over partitions. An empty table writes no blocks. Other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.bpe import Vocabulary, encode_each, gather, packed, split
from daybook.llm.store import place
from daybook.session import shared_folder

BLOCK = 1 << 20
STEPS = 256
END = 0
#: Words a Python worker remembers.
CACHE_WORDS = 700_000

MAGIC = b"IDB3"
_HEAD = struct.Struct("<4sIQIII")
#: The range when coding starts, and below which 16 bits are told; the place of the bits that are.
_FULL, _NARROW = float(1 << 48), float(1 << 32)
_U16 = float(1 << 16)
_SLOTS = 1 << 17
_TABLE_BITS = 16
_LEVEL_BITS = 4
_LEVELS = 1 << _LEVEL_BITS
# By confidence and hit: the next confidence, times two, plus one if the prediction stays.
_AFTER = np.array(
    [n for c in range(_LEVELS) for n in (2 * (c >> 1) + 1 if c > 2 else 2, 2 * min(c + 1, _LEVELS - 1) + 1 if c else 2)], np.int32
)
_COUNT = 24
_UNIT = 8
#: A predicted id weighs at most this many times all counts.
_HEAVY = 16 << _UNIT
#: Sum of all counts, at most; with the heaviest predictions the line stays below 31 bits.
_MOST = 1 << 25
LARGEST_ID = 1 << 22


class Mixer:
    """The model of one block over symbols 0 to alphabet - 1, advanced by one symbol in every lane at a time."""

    def __init__(self, alphabet: int, lanes: int) -> None:
        self.alphabet = alphabet
        self.counts = np.ones(alphabet, np.int64)
        self.line = np.arange(alphabet + 1, dtype=np.int32)
        # Since the last refresh: the symbols, and by order the confidences and outcomes of all predictions.
        self.waiting: list[np.ndarray] = []
        self.outcomes: list[list[np.ndarray]] = [[], []]
        self.step = 0
        self.one = np.zeros(lanes, np.int64)  # the symbol before
        self.two = np.zeros(lanes, np.int64)  # and the one before that
        # Per order: predicted symbol and confidence (the low bits) of every context, and misses and hits of every confidence.
        self.guess = [np.zeros(alphabet, np.int32), np.zeros(_SLOTS, np.int32)]
        self.score = [np.ones((_LEVELS, 2), np.int64), np.ones((_LEVELS, 2), np.int64)]
        self._refresh()

    def _refresh(self) -> None:
        """What follows from the counts: the line, a table to search it, and the weight of each confidence."""
        np.cumsum(self.counts, out=self.line[1:])
        total = int(self.line[-1])
        self.shift = max(0, total.bit_length() - _TABLE_BITS)
        starts = self.line[:-1] >> self.shift
        self.table = np.cumsum(np.bincount(starts, minlength=(total >> self.shift) + 1)) - 1
        self.weight = []
        for score in self.score:
            odds = np.minimum((score[:, 1] << _UNIT) // score[:, 0], _HEAVY)
            odds[0] = 0  # nothing was seen in such a context
            self.weight.append(((total * odds) >> _UNIT).astype(np.int32))

    def predict(self) -> None:
        """The two predicted symbols of each lane, with their weights."""
        self.at = [self.one, (self.one * 40503 + self.two * 30011) & (_SLOTS - 1)]
        known = [g.take(a) for g, a in zip(self.guess, self.at, strict=True)]
        self.level = [k & (_LEVELS - 1) for k in known]
        self.said = [k >> _LEVEL_BITS for k in known]
        self.w1, self.w2 = (w.take(n) for w, n in zip(self.weight, self.level, strict=True))
        self.total = self.w1 + self.w2 + self.line[-1]

    def interval(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbols lie on the mixed line, and their widths."""
        ids, (g1, g2) = symbols.astype(np.int32), self.said
        low = self.line.take(symbols)
        size = self.line.take(symbols + 1) - low + self.w1 * (g1 == ids) + self.w2 * (g2 == ids)
        return low + self.w1 * (g1 < ids) + self.w2 * (g2 < ids), size

    def find(self, value: np.ndarray) -> np.ndarray:
        """The symbols in whose intervals the values lie.

        A predicted symbol's weight lies where its own part of the line begins: without both, values lie on the line of the counts.
        """
        g1, g2 = self.said
        past1 = value - self.line.take(g1) - self.w2 * (g2 < g1)
        past2 = value - self.line.take(g2) - self.w1 * (g1 <= g2)
        return self._search(value - np.minimum(np.maximum(past1, 0), self.w1) - np.minimum(np.maximum(past2, 0), self.w2))

    def _search(self, value: np.ndarray) -> np.ndarray:
        found = self.table.take(value >> self.shift)
        late = np.flatnonzero(self.line.take(found) > value)
        while len(late):
            if len(late) < 256:
                found[late] = np.searchsorted(self.line, value[late], side="right") - 1
                break
            found[late] -= 1
            late = late[self.line.take(found.take(late)) > value.take(late)]
        return found

    def learn(self, symbols: np.ndarray) -> None:
        self.step += 1
        fresh = self.step < 8 or not self.step % 8
        ids = symbols.astype(np.int32)
        for guess, outcomes, at, level, said in zip(self.guess, self.outcomes, self.at, self.level, self.said, strict=True):
            state = level + level + (said == ids)
            outcomes.append(state)
            after = _AFTER.take(state)
            guess[at] = ((ids + (said - ids) * (after & 1)) << _LEVEL_BITS) + (after >> 1)
        self.two, self.one = self.one, symbols
        self.waiting.append(symbols)
        if fresh:
            self.counts += _COUNT * np.bincount(np.concatenate(self.waiting), minlength=self.alphabet)
            self.waiting.clear()
            for score, outcomes in zip(self.score, self.outcomes, strict=True):
                score += np.bincount(np.concatenate(outcomes), minlength=2 * _LEVELS).reshape(_LEVELS, 2)
                outcomes.clear()
            while int(self.counts.sum()) > _MOST:
                self.counts = (self.counts + 1) >> 1
            self._refresh()


def _code(ids: np.ndarray, alphabet: int, lanes: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit words of each lane, one lane after another, and their numbers."""
    grid = np.zeros(lanes * steps, np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Mixer(alphabet, lanes)
    # A symbol has a part of 2^31 at least, so it narrows a range by 32 bits at most, rounding included.
    # The lanes' words lie side by side while they are written, since lanes write about as many.
    words = np.zeros((2 * steps + 4) * lanes, np.uint32)
    at = np.arange(lanes)
    low, width = np.zeros(lanes), np.full(lanes, _FULL)
    for row in grid:
        model.predict()
        first, size = model.interval(row)
        part = np.floor(width / model.total)
        low += part * first
        width = part * size
        lane = np.flatnonzero(width < _NARROW)
        while len(lane):
            l, w, place = low.take(lane), width.take(lane) * _U16, at.take(lane)
            top = np.floor(l / _NARROW)  # a 17th bit is a carry
            words[place] = top
            at[lane] = place + lanes
            low[lane], width[lane] = (l - top * _NARROW) * _U16, w
            lane = lane[w < _NARROW]
        model.learn(row)
    # Whatever follows these 32 bits, the number lies in the range.
    last = low.astype(np.int64) // (1 << 16) + 1
    words[at], words[at + lanes] = last >> 16, last & 0xFFFF
    sizes = at // lanes + 2
    most = int(sizes.max())
    words = words.reshape(-1, lanes)[:most].T[np.arange(most) < sizes[:, None]]
    while len(carry := np.flatnonzero(words >> 16)):
        words[carry] &= 0xFFFF
        words[carry - 1] += 1
    return words.astype(np.uint16), sizes


def _uncode(words: np.ndarray, sizes: np.ndarray, n: int, alphabet: int, lanes: int, steps: int) -> np.ndarray:
    model = Mixer(alphabet, lanes)
    # As in the coder; what is read behind a lane's end doesn't matter.
    most = int(sizes.max())
    beside = np.zeros((lanes, most + 2), np.uint16)
    beside[:, :most][np.arange(most) < sizes[:, None]] = words
    words = np.ascontiguousarray(beside.T).reshape(-1)
    at = np.arange(lanes)
    code = (words[at] * _U16 + words[at + lanes]) * _U16 + words[at + 2 * lanes]
    at += 3 * lanes
    width = np.full(lanes, _FULL)
    out = np.zeros((steps, lanes), np.int64)
    for row in out:
        model.predict()
        part = np.floor(width / model.total)
        row[:] = model.find(np.minimum(code / part, model.total - 1).astype(np.int32))
        first, size = model.interval(row)
        code -= part * first
        width = part * size
        lane = np.flatnonzero(width < _NARROW)
        while len(lane):
            w, place = width.take(lane) * _U16, at.take(lane)
            code[lane] = code.take(lane) * _U16 + words.take(place)
            at[lane] = place + lanes
            width[lane] = w
            lane = lane[w < _NARROW]
        model.learn(row)
    return out.T.reshape(-1)[:n]


def encode_block(keys: list[int | None], sizes: np.ndarray, ids: np.ndarray, steps: int = STEPS) -> bytes:
    """A block of whole documents.

    Header (magic, documents, ids, distinct ids, lanes, steps), then per document
    a null flag, key (signed 64 bits) and number of ids (32 bits), the distinct
    ids in rising order (32 bits), whose ranks are the coder's symbols, the number
    of words of each lane (32 bits), the lanes' 16-bit words, and the CRC-32 of
    all of it. Everything is little-endian.
    """
    n = len(ids)
    if n and not 0 <= int(ids.min()) <= int(ids.max()) < LARGEST_ID:
        raise ValueError(f"ids must be in 0 to {LARGEST_ID - 1}")
    rank = np.cumsum(np.bincount(ids, minlength=1) > 0) - 1
    distinct = np.nonzero(np.diff(rank, prepend=-1))[0]
    lanes = -(-n // steps)
    words, lengths = _code(rank[ids], len(distinct), lanes, steps) if n else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
    body = b"".join(
        (
            _HEAD.pack(MAGIC, len(keys), n, len(distinct), lanes, steps),
            np.array([k is None for k in keys], np.uint8).tobytes(),
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.asarray(sizes, "<u4").tobytes(),
            distinct.astype("<u4").tobytes(),
            lengths.astype("<u4").tobytes(),
            words.astype("<u2").tobytes(),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


def decode_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, numbers of ids, and all ids of a block; ValueError if it is damaged."""
    if len(block) < _HEAD.size + 4 or zlib.crc32(memoryview(block)[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block's checksum doesn't match")
    magic, docs, n, alphabet, lanes, steps = _HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    parts = []
    for kind, count in (("u1", docs), ("<i8", docs), ("<u4", docs), ("<u4", alphabet), ("<u4", lanes)):
        parts.append(np.frombuffer(block, kind, count, at))
        at += parts[-1].nbytes
    null, keys, sizes, distinct, lengths = parts
    words = np.frombuffer(block, "<u2", int(lengths.sum(dtype=np.int64)), at)
    ids = distinct[_uncode(words, lengths.astype(np.int64), n, alphabet, lanes, steps)] if n else np.zeros(0, np.uint32)
    return [None if z else int(k) for z, k in zip(null, keys, strict=True)], sizes.astype(np.int64), ids


class _Words:
    """Ids of the words a Python worker has met, over all of its tasks, up to ``CACHE_WORDS``."""

    def __init__(self, spec: str) -> None:
        self.spec = spec
        self.known: dict[str, int] = {}
        self.ids, self.edges = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def join(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known, base = self.known, len(self.edges) - 1
        at = np.fromiter(map(known.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        new = np.nonzero(at < 0)[0]
        words_new = [distinct[i] for i in new]
        flat, sizes = encode_each(self.spec, words_new)
        ids = np.concatenate([self.ids, flat])
        edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(sizes)])
        at[new] = base + np.arange(len(new))
        if room := max(0, min(len(new), CACHE_WORDS - base)):
            known.update(zip(words_new[:room], range(base, base + room), strict=False))
            self.edges = edges[: base + room + 1]
            self.ids = ids[: self.edges[-1]]
        at = at[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else at
        return gather(ids, edges[at], edges[at + 1] - edges[at])


@functools.lru_cache(maxsize=1)
def _met(spec: str) -> _Words:
    return _Words(spec)


def write(docs: DataFrame, vocabulary: Vocabulary, path: str | None = None, doc: str = "doc_id", text: str = "text", end: int = END, block: int = BLOCK) -> str:
    """Write the ids of all texts, each with the end id behind it, by rising id; returns the folder."""
    spark = docs.sparkSession
    path = path or shared_folder(spark, "token-ids")
    slim = docs.select(F.col(doc).cast("long").alias("key"), F.col(text).alias("text"), place().alias("_place"))
    ranged = slim.repartitionByRange("key", "_place").sortWithinPartitions("key", "_place")
    sent = spark.sparkContext.broadcast((vocabulary.text, list(vocabulary.added)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, added = sent.value
        words, part = _met(spec), TaskContext.get().partitionId()
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[int] = []
        count, number, before = 0, 0, 0

        def full() -> pa.RecordBatch:
            nonlocal count, number, before
            body = encode_block(keys, np.array(sizes), np.concatenate(held))
            row = [[part], [number], [before], [count], [body]]
            before, number, count = before + count, number + 1, 0
            keys.clear()
            held.clear()
            sizes.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "block", "before", "n_tokens", "body"])

        for batch in batches:
            pieces, edges = split(batch.column(1), added)
            ids, ends = words.join(pieces)
            ends = np.concatenate([[0], ends])[edges]
            ids = np.insert(ids, ends, end)
            ends += np.arange(1, len(ends) + 1)
            start = taken = 0
            for key, stop in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                keys.append(key)
                sizes.append(stop - start)
                count += stop - start
                start = stop
                if count >= block:
                    held.append(ids[taken:stop])
                    taken = stop
                    yield full()
            held.append(ids[taken:])
        if keys:
            yield full()

    kind = "part int, block int, before long, n_tokens long, body binary"
    ranged.select("key", "text").mapInArrow(pack, kind).write.option("compression", "none").parquet(path)
    return path


def read(spark: SparkSession, path: str, doc: str = "doc_id") -> DataFrame:
    """``doc``, ``start`` (ids of all documents before it), ``n_tokens`` and packed ``ids`` of every document."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per written partition, whatever the data.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    based = rows.join(F.broadcast(offsets), "part").select((F.col("base") + F.col("before")).alias("base"), "body")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, sizes, ids = decode_block(body.as_py())
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(base + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), packed(ids, ends)],
                    [doc, "start", "n_tokens", "ids"],
                )

    return based.mapInArrow(unpack, f"`{doc}` long, start long, n_tokens long, ids binary")
