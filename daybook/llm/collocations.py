"""Phrase collocations, counted by double-array tries of Apriori-safe candidates.

1. Texts are lower-cased (A-Z) and cut into pieces and words; every word becomes a
   64-bit code of language and word, a break the code 0. The codes are written once,
   as a slice's distinct ones and their places, with every task's counts of its words.
2. Candidates. A phrase can only be frequent if all phrases inside it are. Words and
   phrases are hashed into buckets, whose totals never fall below the count of what is
   in them. Words in frequent buckets are counted; if two of them share a code, all is
   coded anew with another seed, so codes that go on stand for one word. Then buckets
   count all pairs of frequent words, and all longer phrases whose pairs lie in
   frequent buckets. What passes the buckets of all phrases inside it is a candidate.
3. Counts. The candidates' trie is a double array (base and check), at most
   ``SHARD`` phrases at a time, and is sent to all tasks. A task looks up all its
   positions' words and advances the states of all positions by one word per step,
   in a few array operations; states that accept are counted by ``bincount``. The
   counts of all tasks are summed. Only these counts decide.
4. Scores, in decimals of 38 digits, come from joins of the frequent phrases alone.

What is broadcast has a bound: a bit per bucket, of which there are ``MOST_BUCKETS``
at most, and a trie's shard. If a corpus outgrows the buckets, more candidates pass,
in more shards, and the result stays the same.

Null texts are empty, null languages count as ``und``; phrases never go over a break
or from one document to the next. Words of any length count; repeated rows count
each time. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.store import cut
from daybook.session import shared_folder

MIN_COUNT = 100
LONGEST = 5
#: The best phrases of a language that are returned.
BEST = 2000
#: Phrases in one trie.
SHARD = 250_000
MOST_BUCKETS = 1 << 28
#: Words a task counts before it hands them on.
TALLY = 400_000
#: Bytes of text that are split at once, and on to the next break.
SLICE = 1 << 17
#: Codes that are searched at once, about, and rows of a batch that leaves a task: large ones cost the JVM memory beside its heap.
BLOCK, ROWS = 1 << 18, 1 << 14
#: Words for each bucket, at least until there are as many buckets as may be.
LOAD = 2
#: Slices of buckets that one task adds up, and bytes of codes that one task searches for phrases.
TASK_SLICES, TASK_BYTES = 256, 4 << 30
#: Parts of the last window, so that a language's phrases are ranked by many tasks first.
SALTS = 64

#: Positions whose buckets a task holds before it counts them, and phrases before it lists them.
HELD = 1 << 20

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = b"."
_PLAIN = bytes.maketrans(
    string.ascii_uppercase.encode() + _BREAKS + b"\t", string.ascii_lowercase.encode() + _BREAK * len(_BREAKS) + b" "
)
_WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
_SLICE_BITS = 16


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words and breaks (``.``) of a text, some at a time, always up to a break."""
    text = text.translate(_PLAIN)
    at = 0
    while at < len(text):
        stop = text.find(_BREAK, at + SLICE) + 1 or len(text)
        yield text[at:stop].replace(_BREAK, b" . ").split()
        at = stop


class _Tally:
    """Codes and counts of one language's words."""

    def __init__(self, lang: str, code: Callable[[bytes], int]) -> None:
        self.lang, self.code = lang, code
        self.number: dict[bytes, int] = {_BREAK: 0}
        # Filled up to as many places as there are words.
        self.codes, self.counts = np.zeros(1024, np.uint64), np.zeros(1024, np.int64)

    def take(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct codes of some words, and which of them each word has."""
        coded = pa.array(words, pa.binary()).dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        known = len(self.number)
        at = np.fromiter((self.number.setdefault(w, len(self.number)) for w in distinct), np.int64, len(distinct))
        fresh = [distinct[i] for i in np.flatnonzero(at >= known)]
        size = known + len(fresh)
        if size > len(self.codes):
            more = max(size, 2 * len(self.codes)) - len(self.codes)
            self.codes = np.append(self.codes, np.zeros(more, np.uint64))
            self.counts = np.append(self.counts, np.zeros(more, np.int64))
        self.codes[known:size] = np.fromiter(map(self.code, fresh), np.uint64, len(fresh))
        self.counts[at] += np.bincount(index, minlength=len(distinct))
        return self.codes[at], index

    def flush(self) -> Iterator[dict]:
        """Words, codes and counts so far, in columns."""
        words = list(self.number)
        for a in range(1, len(words), ROWS):
            some = words[a : a + ROWS]
            yield {"lang": [self.lang] * len(some), "word": some, "code": self.codes[a : a + len(some)].view(np.int64), "n": self.counts[a : a + len(some)]}
        self.__init__(self.lang, self.code)


def _code(seed: int, bits: int) -> Callable[[str], Callable[[bytes], int]]:
    # A word holds no space, so the last one parts language and word.
    return lambda lang: lambda word: xxhash.xxh3_64_intdigest(lang.encode() + b" " + word, seed) >> (64 - bits)


def _places(distinct: int) -> type:
    return np.uint16 if distinct <= 1 << 16 else np.uint32


_CODED = pa.schema([("codes", pa.binary()), ("places", pa.binary()), ("lang", pa.string()), ("word", pa.binary()), ("code", pa.int64()), ("n", pa.int64())])


def _columns(found: dict, schema: pa.Schema) -> pa.RecordBatch:
    size = len(next(iter(found.values())))
    return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) if f.name in found else pa.nulls(size, f.type) for f in schema], schema=schema)


def _coded(docs: DataFrame, text: str, lang: str, seed: int, bits: int) -> DataFrame:
    """Rows of either ``codes`` and ``places`` (of many documents, no piece in two rows) or a task's count of a word."""
    slim = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, _Tally] = {}
        code = _code(seed, bits)
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            texts = batch.column(1)
            for i, name in enumerate(langs.dictionary.to_pylist()):
                tally = tallies.setdefault(name, _Tally(name, code(name)))
                whole = _BREAK.join(texts.filter(pc.equal(langs.indices, i)).to_pylist())
                for words in tokens(whole):
                    distinct, at = tally.take(words)
                    yield _columns({"codes": [distinct.tobytes()], "places": [at.astype(_places(len(distinct))).tobytes()]}, _CODED)
            if sum(len(t.number) for t in tallies.values()) > TALLY:
                for tally in tallies.values():
                    yield from (_columns(f, _CODED) for f in tally.flush())
                tallies.clear()
        for tally in tallies.values():
            yield from (_columns(f, _CODED) for f in tally.flush())

    return slim.mapInArrow(run, "codes binary, places binary, lang string, word binary, code long, n long")


class Bits:
    """A bit for each bucket: the highest bits of a hash choose it."""

    def __init__(self, power: int, data: np.ndarray) -> None:
        self.shift, self.data = np.uint64(64 - power), data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> self.shift).astype(np.int64)
        return (self.data[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    def __reduce__(self) -> tuple:
        """Frequent buckets are few, so what is broadcast is mostly the bytes that aren't 0."""
        power, at = 64 - int(self.shift), np.flatnonzero(self.data).astype(np.uint32)
        if 5 * len(at) < len(self.data):
            return _sparse_bits, (power, len(self.data), at, self.data[at])
        return Bits, (power, self.data)


def _sparse_bits(power: int, size: int, at: np.ndarray, values: np.ndarray) -> Bits:
    data = np.zeros(size, np.uint8)
    data[at] = values
    return Bits(power, data)


_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)


def _longer(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    mixed = (hashes ^ (hashes >> _TURN)) * _MIX + codes
    return (mixed ^ (mixed >> _TURN)) * _MIX


def survivors(codes: np.ndarray, filters: dict[int, Bits], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length from two on, the positions of phrases that may be frequent, with the phrases' hashes.

    A phrase goes on if it passes its length's filter, if there is one, and both phrases one word shorter went on.
    """
    alive = filters[1].has(codes) & (codes != 0)
    at = np.flatnonzero(alive)
    hashes = codes[at]
    for k in range(2, longest + 1):
        alive = np.append(alive, False)
        keep = alive[at + 1]
        at = at[keep]
        hashes = _longer(hashes[keep], codes[at + k - 1])
        if k in filters:
            passed = filters[k].has(hashes)
            at, hashes = at[passed], hashes[passed]
        alive = np.zeros(len(codes), bool)
        alive[at] = True
        yield k, at, hashes


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Codes of some rows at a time; every row ends where a piece does."""
    held: list[np.ndarray] = []
    for batch in batches:
        for codes, places in zip(*batch.columns, strict=True):
            distinct = np.frombuffer(codes.as_py(), np.uint64)
            held.append(np.append(distinct[np.frombuffer(places.as_py(), _places(len(distinct)))], np.uint64(0)))
            if sum(map(len, held)) >= BLOCK:
                yield np.concatenate(held)
                held = []
    if held:
        yield np.concatenate(held)


def _written(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, in small row groups: a writer holds one, and a reader takes a whole one at a time.

    Rows are large, so their size is looked at more often than every hundred rows.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).option("parquet.page.size.row.check.min", 16).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _power(size: int, least: int = _SLICE_BITS) -> int:
    return min(max(least, int(size).bit_length()), MOST_BUCKETS.bit_length() - 1)


def _slices(level: int, slots: np.ndarray, counts: np.ndarray, least: int) -> pa.RecordBatch:
    """Counts of distinct, rising slots, in runs of 65,536 slots; no count need go beyond ``least``.

    A slot is told by the free slots before it: a byte below 255, after a 255 for every 255 of them.
    """
    part = slots >> _SLICE_BITS
    starts = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    free = (slots & ((1 << _SLICE_BITS) - 1)).astype(np.int32)
    free[1:] -= np.where(part[1:] == part[:-1], free[:-1] + 1, 0)
    ends = np.cumsum(free // 255 + 1)
    gaps = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    gaps[ends - 1] = free % 255
    ends, counts = np.append(0, ends), np.minimum(counts, least).astype(_counter(least))
    rows: dict[str, list] = {"level": [], "slice": [], "slots": [], "counts": []}
    for a, z in zip(starts, [*starts[1:], len(slots)], strict=True):
        rows["level"].append(level)
        rows["slice"].append(int(part[a]))
        rows["slots"].append(gaps[ends[a] : ends[z]].tobytes())
        rows["counts"].append(counts[a:z].tobytes())
    return _columns(rows, _SPREAD)


def _slots(gaps: bytes) -> np.ndarray:
    """The slots of a row of ``_slices``."""
    steps = np.frombuffer(gaps, np.uint8)
    return (np.cumsum(steps + (steps < 255), dtype=np.int64) - 1)[steps < 255]


def _slice_count(power: int) -> int:
    return max(1, 1 << power >> _SLICE_BITS)


def _counter(least: int) -> type:
    """The smallest kind of number that holds the sum of two counts."""
    return np.uint8 if least < 1 << 7 else np.uint16 if least < 1 << 15 else np.uint32


def _frequent_slots(slices: DataFrame, levels: range, power: int, least: int) -> dict[int, Bits]:
    """Rows of ``_slices`` added up: by level, the slots whose totals reach ``least``."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for level, number, slots, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = sums.setdefault((level, number), np.zeros(1 << _SLICE_BITS, _counter(least)))
                at = _slots(slots)
                have[at] = np.minimum(have[at] + np.frombuffer(counts, _counter(least)), least)
        for (level, number), have in sums.items():
            if (have >= least).any():
                yield _columns({"level": [level], "slice": [number], "bits": [np.packbits(have >= least, bitorder="little").tobytes()]}, _FLAGS)

    data = {k: np.zeros(1 << power >> 3, np.uint8) for k in levels}
    step = (1 << _SLICE_BITS) // 8
    tasks = max(1, len(levels) * _slice_count(power) // TASK_SLICES)
    for level, number, bits in slices.repartition(tasks, "level", "slice").mapInArrow(total, "level int, slice int, bits binary").collect():
        data[level][number * step : (number + 1) * step] = np.frombuffer(bits, np.uint8)
    return {k: Bits(power, d) for k, d in data.items()}


_SLICE_ROW = "level int, slice int, slots binary, counts binary"


def _tally_bits(tallies: DataFrame, power: int, least: int) -> Bits:
    """Buckets of words whose totals reach ``least``."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - power)
        slots: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def added() -> pa.RecordBatch:
            distinct, which = np.unique(np.concatenate(slots), return_inverse=True)
            total = np.bincount(which, weights=np.concatenate(counts))
            slots.clear()
            counts.clear()
            return _slices(1, distinct, total, least)

        for batch in batches:
            slots.append((batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> shift).astype(np.uint32))
            counts.append(batch.column(1).to_numpy(zero_copy_only=False))
            if sum(map(len, slots)) > HELD // 4:
                yield added()
        if slots:
            yield added()

    return _frequent_slots(tallies.select("code", "n").mapInArrow(tell, _SLICE_ROW), range(1, 2), power, least)[1]


def _passing(tallies: DataFrame, bits: Bits) -> DataFrame:
    """Words in frequent buckets, each about once a task, with the task's count."""
    sent = tallies.sparkSession.sparkContext.broadcast(bits)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def added() -> pa.Table:
            found = pa.Table.from_batches(held).group_by(["lang", "word", "code"]).aggregate([("n", "sum")])
            return found.rename_columns({"n_sum": "n"}).select(["lang", "word", "code", "n"])

        for batch in batches:
            held.append(batch.filter(pa.array(sent.value.has(batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64)))))
            if sum(b.num_rows for b in held) > HELD // 2:
                found = added()
                held = found.to_batches()
                if found.num_rows > HELD // 4:
                    yield from found.to_batches(max_chunksize=ROWS)
                    held = []
        if held:
            yield from added().to_batches(max_chunksize=ROWS)

    return tallies.mapInArrow(passing, tallies.schema)


def _word_bits(words: DataFrame, power: int) -> Bits:
    slot = F.shiftrightunsigned("code", 64 - power)
    rows = words.groupBy(F.bitmap_bucket_number(slot + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits"))
    data = np.zeros(max(1 << power >> 3, 4096), np.uint8)
    for b, bits in rows.collect():
        data[(b - 1) * 4096 : b * 4096] = np.frombuffer(bits, np.uint8)
    return Bits(power, data)


_U32, _LOW = np.uint64(32), np.uint64((1 << 32) - 1)


def _added(counted: list[np.ndarray], least: int) -> np.ndarray:
    """Slots (the high 32 bits) with their counts, each slot once; no count need go beyond ``least``."""
    rows = np.sort(np.concatenate(counted))
    slots = rows >> _U32
    first = np.flatnonzero(np.append(True, slots[1:] != slots[:-1]))
    return slots[first] << _U32 | np.minimum(np.add.reduceat(rows & _LOW, first), np.uint64(least))


def _bucket_bits(codes: DataFrame, filters: dict[int, Bits], first: int, longest: int, power: int, least: int) -> dict[int, Bits]:
    """Buckets of phrases of ``first`` to ``longest`` words whose totals reach ``least``."""
    sent = codes.sparkSession.sparkContext.broadcast(filters)
    levels = range(first, longest + 1)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - power)
        held: dict[int, list[np.ndarray]] = {k: [] for k in levels}
        counted: dict[int, list[np.ndarray]] = {k: [] for k in levels}

        def count(k: int) -> None:
            slots, counts = np.unique(np.concatenate(held[k]), return_counts=True)
            counted[k].append(slots.astype(np.uint64) << _U32 | counts.astype(np.uint64))
            held[k] = []

        def told(k: int) -> pa.RecordBatch:
            sums = counted[k].pop()
            return _slices(k, (sums >> _U32).astype(np.uint32), sums & _LOW, least)

        for block in _blocks(batches):
            for k, _, hashes in survivors(block, sent.value, longest):
                if k >= first and len(hashes):
                    held[k].append((hashes >> shift).astype(np.uint32))
                    if sum(map(len, held[k])) > HELD:
                        count(k)
            # A slot is told anew only when the slots met since it was told no longer fit.
            if sum(len(c) for cs in counted.values() for c in cs) > 3 * HELD:
                for k in levels:
                    if counted[k]:
                        counted[k] = [_added(counted[k], least)]
                while sum(len(c) for cs in counted.values() for c in cs) > 2 * HELD:
                    yield told(max(levels, key=lambda k: sum(map(len, counted[k]))))
        for k in levels:
            if held[k]:
                count(k)
            if counted[k]:
                counted[k] = [_added(counted[k], least)]
                yield told(k)

    return _frequent_slots(codes.mapInArrow(tell, _SLICE_ROW), levels, power, least)


_SPREAD = pa.schema([("level", pa.int32()), ("slice", pa.int32()), ("slots", pa.binary()), ("counts", pa.binary())])
_FLAGS = pa.schema([("level", pa.int32()), ("slice", pa.int32()), ("bits", pa.binary())])
_PHRASE = pa.schema([(w, pa.int64()) for w in _WORDS])
_COUNTED = pa.schema([*_PHRASE, ("a", pa.int64())])


def _rows_at(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(at), LONGEST), np.uint64)
    for j in range(k):
        out[:, j] = codes[at + j]
    return out


def _distinct(codes: np.ndarray, at: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """The distinct phrases at some positions, as rows of codes."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    there = at[first]
    if all((codes[at + j] == codes[there + j][which]).all() for j in range(k)):
        return _rows_at(codes, there, k)
    return np.unique(_rows_at(codes, at, k), axis=0)


class _Met:
    """Phrases that a task has handed on, by hash, up to ``HELD`` // 2 of them."""

    def __init__(self) -> None:
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros((0, LONGEST), np.uint64)

    def new(self, rows: np.ndarray) -> np.ndarray:
        """Those of some phrases that weren't met; what shares the hash of another one is new each time."""
        hashes = rows[:, 0]
        for j in range(1, LONGEST):
            hashes = _longer(hashes, rows[:, j])
        hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        others = rows[(rows != rows[first][which]).any(axis=1)]
        rows = rows[first]
        at = np.searchsorted(self.hashes, hashes)
        there = np.minimum(at, max(len(self.hashes) - 1, 0))
        taken = self.hashes[there] == hashes if len(self.hashes) else np.zeros(len(rows), bool)
        same = taken.copy()
        same[taken] = (self.rows[there[taken]] == rows[taken]).all(axis=1)
        fresh = np.flatnonzero(~taken)[: max(0, HELD // 2 - len(self.hashes))]
        self.hashes = np.insert(self.hashes, at[fresh], hashes[fresh])
        self.rows = np.insert(self.rows, at[fresh], rows[fresh], axis=0)
        return np.concatenate([rows[~same], others])


def _candidates(codes: DataFrame, filters: dict[int, Bits], longest: int) -> DataFrame:
    """All phrases that pass the filters, as columns of codes, 0 behind the last word."""
    sent = codes.sparkSession.sparkContext.broadcast(filters)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        met = _Met()
        for block in _blocks(batches):
            held += [_distinct(block, at, hashes, k) for k, at, hashes in survivors(block, sent.value, longest) if len(at)]
            if sum(map(len, held)) > HELD // 16:
                yield from _phrases(met.new(np.concatenate(held)))
                held = []
        if held:
            yield from _phrases(met.new(np.concatenate(held)))

    return codes.mapInArrow(find, ", ".join(f"{w} long" for w in _WORDS)).distinct()


def _phrases(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), ROWS):
        some = rows[a : a + ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[:, j]).view(np.int64)) for j in range(LONGEST)], schema=_PHRASE)


class DoubleArray:
    """A trie of phrases over the digits of their words' numbers: from state s digit d goes to ``base[s] + d``, if ``check`` there is s.

    Words are numbered, and a number has ``digits`` digits of ``RADIX`` values, so that no state has more children than that
    and the arrays stay close to the number of states.
    """

    RADIX_BITS = 8
    RADIX = 1 << RADIX_BITS

    def __init__(self, rows: np.ndarray) -> None:
        self.words = np.unique(rows[rows != 0])
        numbers = np.searchsorted(self.words, rows).astype(np.int64)
        numbers[rows == 0] = -1
        order = np.lexsort(numbers.T[::-1])
        self.rows, numbers = rows[order], numbers[order]
        self.digits = max(1, -(-(len(self.words) - 1).bit_length() // self.RADIX_BITS))
        room = int((numbers >= 0).sum()) + 4 * self.RADIX
        self.base, self.check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        self.free = self.RADIX + 1  # slots before it are the root's, or taken but for a few
        self.last = self.RADIX  # no slot behind it is taken
        self.base[0] = 1
        state = np.zeros(len(rows), np.int64)
        for j in range(rows.shape[1]):
            at = np.flatnonzero(numbers[:, j] >= 0)
            if not len(at):
                break
            for shift in self.shifts():
                parent, digit = state[at], (numbers[at, j] >> shift) & (self.RADIX - 1)
                new = np.append(True, (np.diff(parent) != 0) | (np.diff(digit) != 0))
                slots = self._place(parent[new], digit[new])
                state[at] = slots[np.cumsum(new) - 1]
        # A base of any state and any digit stay inside the arrays.
        size = self.last + self.RADIX + 1
        self._grow(size)
        self.base, self.check = self.base[:size].copy(), self.check[:size].copy()
        self.accept = np.full(size, -1, np.int32)
        self.accept[state] = np.arange(len(rows))

    def shifts(self) -> range:
        return range(self.RADIX_BITS * (self.digits - 1), -1, -self.RADIX_BITS)

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int32))
            self.check = np.append(self.check, np.full(more, -1, np.int32))

    def _place(self, parents: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """Slots for children, given in order of their parents."""
        slots = np.zeros(len(digits), np.int64)
        if parents[0] == 0:
            slots = 1 + digits
            self.check[slots] = 0
            return slots
        starts = np.flatnonzero(np.append(True, np.diff(parents) != 0))
        sizes = np.diff(np.append(starts, len(digits)))
        for g in np.argsort(-sizes, kind="stable"):
            if sizes[g] == 1:
                break
            own = digits[starts[g] : starts[g] + sizes[g]]
            base = self._fit(own)
            slots[starts[g] : starts[g] + sizes[g]] = base + own
            self.last = max(self.last, base + int(own[-1]))
            self.check[base + own] = parents[starts[g]]
            self.base[parents[starts[g]]] = base
        lone = starts[sizes == 1]
        if len(lone):
            self._grow(self.last + len(lone) + 2)
            open_ = np.flatnonzero(self.check[self.free : self.last + len(lone) + 2] < 0)[: len(lone)] + self.free
            slots[lone] = open_
            self.check[open_] = parents[lone]
            self.base[parents[lone]] = open_ - digits[lone]
            self.free = int(open_[-1]) + 1
            self.last = max(self.last, int(open_[-1]))
        return slots

    def _fit(self, own: np.ndarray) -> int:
        """A base at which all of a state's children find free slots."""
        shape = own - own[0]
        at = self.free
        while at <= self.last:
            self._grow(at + 2 * self.RADIX)
            open_ = np.flatnonzero(self.check[at : at + self.RADIX] < 0) + at
            if len(open_):
                fits = (self.check[open_[:, None] + shape] < 0).all(axis=1)
                if fits.any():
                    return int(open_[np.argmax(fits)] - own[0])
            if at == self.free and len(open_) < 16:
                self.free += self.RADIX
            at += self.RADIX
            if at > self.free + 6 * self.RADIX:
                break
        at = max(self.last + 1, self.free)
        self._grow(at + self.RADIX)
        return int(at - own[0])

    def look_up(self, codes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for those in no phrase."""
        found = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        return np.where(self.words[found] == codes, found, -1)

    def accepted(self, codes: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """The phrases that begin at some positions, as rows' numbers, all positions a word further at a time."""
        states = np.zeros(len(at), np.int64)
        for j in range(self.rows.shape[1]):
            inside = at + j < len(codes)
            at, states = at[inside], states[inside]
            word = self.look_up(codes[at + j])
            known = word >= 0
            at, states, word = at[known], states[known], word[known]
            for shift in self.shifts():
                after = self.base[states] + ((word >> shift) & (self.RADIX - 1))
                moved = self.check[after] == states
                at, states, word = at[moved], after[moved], word[moved]
            found = self.accept[states]
            yield found[found >= 0]


def _counted(codes: DataFrame, filters: dict[int, Bits], trie: DoubleArray) -> DataFrame:
    sent = codes.sparkSession.sparkContext.broadcast(({k: filters[k] for k in (1, 2)}, trie))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, trie = sent.value
        counts = np.zeros(len(trie.rows), np.int64)
        met: list[np.ndarray] = []
        for block in _blocks(batches):
            for _, at, _ in survivors(block, near, 2):
                met += trie.accepted(block, at)
            if sum(map(len, met)) > HELD // 4:
                counts += np.bincount(np.concatenate(met), minlength=len(counts))
                met.clear()
        if met:
            counts += np.bincount(np.concatenate(met), minlength=len(counts))
        found = np.flatnonzero(counts)
        for a in range(0, len(found), ROWS):
            some = found[a : a + ROWS]
            words = [pa.array(np.ascontiguousarray(trie.rows[some, j]).view(np.int64)) for j in range(LONGEST)]
            yield pa.RecordBatch.from_arrays([*words, pa.array(counts[some])], schema=_COUNTED)

    return codes.mapInArrow(count, ", ".join(f"{w} long" for w in _WORDS) + ", a long").groupBy(*_WORDS).agg(F.sum("a").alias("a"))


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    over, under = wide(a) * wide(n) * F.lit(1000).cast("decimal(4,0)"), wide(left) * wide(right)
    return F.call_function("div", over, under)


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, longest: int = LONGEST, shard: int = SHARD, bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``n`` of every language, words (``lang``, ``word``, ``code``, ``n``), all frequent ones among them, and frequent phrases of two and more words (``key``, an array of codes, and ``a``)."""
    spark = docs.sparkSession
    seed = 0
    while True:
        coded = _written(_coded(docs, text, lang, seed, bits), "codes")
        tallies = coded.where("codes IS NULL").select("lang", "word", "code", "n")
        totals = cut(tallies.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        total = totals.agg(F.sum("n")).first()[0] or 0
        power = _power(total // LOAD)
        # Every task tells its words and phrases once, so longer tasks tell less: one a core, unless their codes would be too many.
        tasks = max(spark.sparkContext.defaultParallelism, 8 * total // TASK_BYTES)
        words = _passing(tallies.coalesce(tasks), _tally_bits(tallies, power, least)).groupBy("lang", "word", "code").agg(F.sum("n").alias("n"))
        words = cut(words, "words")
        # Words of rarer codes never go on, so it doesn't matter whether two of them share one.
        shared = words.groupBy("code").count().where("count > 1 OR code = 0").limit(1).count()
        if not shared:
            break
        seed, bits = seed + 1, 64
    codes = coded.where("codes IS NOT NULL").select("codes", "places").coalesce(tasks)
    known = words.where(F.col("n") >= least)
    filters = {1: _word_bits(known, _power(8 * known.count()))}
    filters |= _bucket_bits(codes, filters, 2, 2, power, least)
    if longest > 2:
        filters |= _bucket_bits(codes, filters, 3, longest, power, least)
    candidates = cut(_candidates(codes, filters, longest), "candidates")
    shards = -(-candidates.count() // shard)
    counted = spark.createDataFrame([], ", ".join(f"{w} long" for w in _WORDS) + ", a long")
    for i in range(shards):
        part = candidates.where(F.pmod(F.xxhash64(*_WORDS), F.lit(shards)) == i).toArrow()
        if part.num_rows:
            rows = np.stack([c.to_numpy().view(np.uint64) for c in part.columns], axis=1)
            counted = counted.unionByName(cut(_counted(codes, filters, DoubleArray(rows)).where(F.col("a") >= least), f"phrases-{i}"))
    key = F.filter(F.array(*_WORDS), lambda c: c != 0)
    return totals, words, counted.select(key.alias("key"), "a")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = MIN_COUNT, longest: int = LONGEST, best: int = BEST, shard: int = SHARD, bits: int = 64) -> DataFrame:
    """Each language's best phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    ``bits`` below 64 shortens the codes of the first try, for tests of shared ones.
    """
    totals, words, phrases = frequent(docs, text, lang, least, longest, shard, bits)
    known = words.where(F.col("n") >= least)
    parts = phrases.unionByName(known.select(F.array("code").alias("key"), F.col("n").alias("a")))
    inner = "flatten(transform(sequence(2, size(key) - 1), m -> transform(sequence(1, size(key) - m + 1), i -> slice(key, i, m))))"
    covered = phrases.where(F.size("key") > 2).select("a", F.explode(F.expr(inner)).alias("key")).groupBy("key").agg(F.max("a").alias("_longer"))
    kept = phrases.join(covered, "key", "left").where("_longer IS NULL OR 100 * _longer < 100 * a").drop("_longer")
    spelled = kept.select("key", F.posexplode("key").alias("_at", "code")).join(known.select("code", "lang", F.col("word").cast("string").alias("word")), "code")
    spelled = spelled.groupBy("key").agg(F.max("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("_at", "word"))).alias("_w"))
    named = spelled.select("key", "lang", F.concat_ws(" ", F.col("_w.word")).alias("phrase"))
    halves = kept.select("key", "a", F.explode(F.expr("sequence(1, size(key) - 1)")).alias("k"))
    halves = halves.selectExpr("key", "a", "k", "slice(key, 1, k) AS _left", "slice(key, k + 1, size(key) - k) AS _right")
    halves = halves.join(parts.select(F.col("key").alias("_left"), F.col("a").alias("l")), "_left").join(parts.select(F.col("key").alias("_right"), F.col("a").alias("r")), "_right")
    scored = halves.join(named, "key").join(totals, "lang").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    ranked = lowest.select("lang", "phrase", "a", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), "n", F.col("_b.score").alias("score"))
    by = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = ranked.withColumn("_salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*by))).where(F.col("_r") <= best)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
