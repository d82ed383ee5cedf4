"""Byte-level BPE over a distinct-word table.

Texts are split into words by Spark's own regular expressions, or, where no table
is made, by ``split``, whose array operations find the same words in whole batches.
Words are counted
over the whole corpus; the table takes those that recur, most frequent first, up
to ``TABLE_WORDS`` entries, encodes each of them once, and is sent to the tasks,
its size bounded by that parameter. Ids are joined back by position: a batch's
words are reduced to its distinct ones, those are looked up, and the ids are
gathered along the word positions. The words outside the table, most of which
occur once in the corpus, are encoded where they stand, each once a batch; a
shuffle of their positions would move many times what encoding them costs.
Decoding joins ids to the vocabulary's pieces, a table of fixed size, and reads
the bytes.

Words longer than ``LONG_WORD`` characters never enter the table. A text with a
code point that this JVM's Unicode tables don't know is one word, so that the
library's own rules split it. Added tokens of the tokenizer file are found
first, as the library does. Null and empty texts have no ids; rows keep their
multiplicity and carried columns; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from daybook.llm.store import cut

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

TABLE_WORDS = 1 << 19
LONG_WORD = 64
#: Space characters of Unicode, as the library's expressions have them; Java's \s is ASCII.
_WS = r"\s\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


class Vocabulary:
    """A byte-level BPE tokenizer file, read on the driver and sent as text."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec["model"]["type"], spec["pre_tokenizer"]["type"], spec["pre_tokenizer"].get("add_prefix_space"), spec["normalizer"], spec["post_processor"])
        if kind != ("BPE", "ByteLevel", False, None, None):
            raise ValueError(f"a plain byte-level BPE file is needed, not {kind}")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        spec["truncation"] = spec["padding"] = None
        self.text = json.dumps(spec, ensure_ascii=False)
        self.vocab = spec["model"]["vocab"] | self.added

    def pieces(self) -> pa.Array:
        """The bytes of every id; ids without a piece are empty."""
        to_byte = {c: b for b, c in byte_characters().items()}
        out = [b""] * (max(self.vocab.values()) + 1)
        for piece, i in self.vocab.items():
            known = i not in self.added.values() and all(c in to_byte for c in piece)
            out[i] = bytes(to_byte[c] for c in piece) if known else piece.encode()
        return pa.array(out, pa.binary())

    def words(self, text: Column) -> Column:
        """A text as an array of words whose ids, joined, are the text's ids."""
        text = F.coalesce(text, F.lit(""))
        plain = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
        out = plain(text)
        if self.added:
            marks = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
            between = F.transform(F.split(text, marks, -1), plain)
            own = F.regexp_extract_all(text, F.lit(f"({marks})"), F.lit(1))
            joined = F.flatten(F.zip_with(between, own, lambda w, t: F.concat(w, F.array_compact(F.array(t)))))
            has = functools.reduce(lambda a, b: a | b, [text.contains(t) for t in self.added])
            out = F.when(has, joined).otherwise(out)
        return F.when(text.rlike(r"\p{Cn}"), F.array(text)).otherwise(out)


_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = range(5)
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def _kinds(points: int) -> np.ndarray:
    """Whether code points below ``points`` are letters, numbers, white space, others or unassigned."""
    letter = {"L": _LETTER, "N": _NUMBER}
    names = (unicodedata.category(chr(i)) for i in range(points))
    out = np.fromiter((_UNKNOWN if n == "Cn" else letter.get(n[0], _OTHER) for n in names), np.uint8, points)
    out[[i for i in _SPACES if i < points]] = _SPACE
    return out


def word_starts(points: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where ``WORD`` begins a word in texts that lie end to end and begin at ``firsts``."""
    first = np.zeros(len(points) + 1, bool)
    first[firsts] = first[-1] = True
    run = first.copy()
    run[1:-1] |= kinds[1:] != kinds[:-1]
    start = run[:-1].copy()
    # White space before a word keeps its last character back; a blank goes on with the word.
    last = (kinds == _SPACE) & run[1:] & ~first[1:]
    start |= last
    start[1:] &= ~(last & (points == 32))[:-1]
    at = np.flatnonzero(points == ord("'"))
    at = at[start[at] & ~first[at + 1]]
    one = points[at + 1]
    short = np.isin(one, [ord(c) for c in "stmd"])
    two = np.where(first[at + 2 - short], 0, points[np.minimum(at + 2, len(points) - 1)])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[at[short | long] + 1] = False
    after = np.concatenate([at[short] + 2, at[long] + 3])
    start[after[after < len(start)]] = True
    return start


def split(texts: pa.Array, added: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All texts' words, as ``Vocabulary.words`` has them, and the number of words up to each text's end."""
    texts = pc.fill_null(texts, "").cast(pa.binary())
    raw = texts.to_pylist()
    data = b"".join(raw)
    try:
        text = data.decode()
    except UnicodeDecodeError:
        raw = [t.decode("utf-8", "replace").encode() for t in raw]
        data = b"".join(raw)
        text = data.decode()
    held = np.frombuffer(data, np.uint8)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    edges = np.append(0, ends)
    marks = [t.encode() for t in sorted(added, key=len, reverse=True)]
    spans = []
    if any(m in data for m in marks):
        pattern = re.compile(b"|".join(map(re.escape, marks)))
        spans = [(a + m.start(), a + m.end()) for a, t in zip(edges.tolist(), raw, strict=False) for m in pattern.finditer(t)]
    firsts = np.append(edges, np.array(spans, np.int64).reshape(-1))
    place = None
    if len(text) == len(data):
        points, kinds = held, _kinds(128)[held]
    else:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = _kinds(0x110000)[points]
        place = np.flatnonzero((held & 0xC0) != 0x80)
        firsts = np.searchsorted(place, firsts)
    starts = np.flatnonzero(word_starts(points, kinds, firsts))
    unknown = np.flatnonzero(kinds == _UNKNOWN)
    if place is not None:
        starts, unknown = place[starts], place[unknown]
    for a, z in spans:
        starts = starts[(starts <= a) | (starts >= z)]
    for i in np.unique(np.searchsorted(ends, unknown, side="right")):
        starts = starts[(starts <= edges[i]) | (starts >= ends[i])]
    offsets = np.append(starts, len(data)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))
    return words, np.searchsorted(starts, ends)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next free one above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.cache
def _tokenizer(spec: str) -> tuple[Tokenizer, frozenset[str], Callable[[bytes], list[int]]]:
    """The tokenizer, its added tokens, and its BPE model as a function of a word's bytes."""
    out = Tokenizer.from_str(spec)
    return out, frozenset(t.content for t in out.get_added_tokens_decoder().values()), _merger(spec) or _model(out)


def _model(tokenizer: Tokenizer) -> Callable[[bytes], list[int]]:
    return lambda word: [t.id for t in tokenizer.model.tokenize(word.decode("latin-1").translate(_AS_CHARACTERS))]


def _merger(spec: str) -> Callable[[bytes], list[int]] | None:
    """The same merges from a table of ranks, which is several times as fast; None where it could differ.

    A table joins neighbours whenever their bytes are a piece, the model only if they are one of its pairs. Where pieces are
    numbered in the order of their merges, and every byte is a piece, both do the same: neighbours whose bytes are a piece have
    come about by earlier merges inside these bytes alone, as they had when the pair was made.
    """
    model = json.loads(spec)["model"]
    vocab, to_byte = model["vocab"], {c: b for b, c in byte_characters().items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in pairs]
    ranks = {bytes(to_byte[c] for c in p): i for p, i in vocab.items() if all(c in to_byte for c in p)}
    bytes_ = [ranks.get(bytes([b])) for b in range(256)]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or None in bytes_ or any(a >= b for a, b in itertools.pairwise([max(bytes_), *made])) or len(ranks) != 256 + len(made):
        return None
    return tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


_AS_CHARACTERS = byte_characters()
#: Letters up to here are letters in every version of Unicode that any part may have.
_LATIN = "\u024f"


def encode_each(spec: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words (as ``Vocabulary.words`` splits them) in a row, and the number of each word's ids.

    ASCII words and Latin letters are sure to be one word to the library too and
    go to its merges directly; all others, added tokens too, take its whole way.
    """
    tokenizer, added, merged = _tokenizer(spec)
    sure = [w not in added if w.isascii() else max(w) <= _LATIN and w.lstrip(" ").isalpha() for w in words]
    found = [merged(w.encode()) if s else None for w, s in zip(words, sure, strict=True)]
    if not all(sure):
        other = [i for i, s in enumerate(sure) if not s]
        for i, e in zip(other, tokenizer.encode_batch([words[i] for i in other], add_special_tokens=False), strict=True):
            found[i] = e.ids
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    flat = np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(sizes.sum()))
    return flat, sizes


class WordTable:
    """Words and their ids: the ids of word n are ``ids[edges[n]:edges[n + 1]]``."""

    def __init__(self, words: pa.Array, ids: np.ndarray, edges: np.ndarray) -> None:
        self.words, self.ids, self.edges = words, ids, edges

    def join(self, spec: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sequence of words, and the position behind each word's ids."""
        coded = words.dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        at = pc.index_in(distinct, value_set=self.words)
        new = pc.is_null(at).to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy(zero_copy_only=False)
        own, own_sizes = encode_each(spec, distinct.filter(pa.array(new)).to_pylist())
        pool = np.concatenate([self.ids, own])
        start, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        if len(self.words):
            start[~new] = self.edges[at[~new]]
            size[~new] = self.edges[at[~new] + 1] - start[~new]
        start[new] = len(self.ids) + np.cumsum(own_sizes) - own_sizes
        size[new] = own_sizes
        return gather(pool, start[index], size[index])


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``pool[start:start + size]`` one after another, and the position behind each."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at))
    return pool[at], ends


EMPTY = WordTable(pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64))


def word_table(words: DataFrame, vocabulary: Vocabulary, limit: int = TABLE_WORDS) -> WordTable:
    """The table for a DataFrame with an array column ``words``: the most frequent words that recur."""
    spark, spec = words.sparkSession, vocabulary.text
    counts = words.select(F.explode("words").alias("word")).where(F.char_length("word") <= LONG_WORD).groupBy("word").count()
    level = F.floor(F.log2("count") * 8).cast("int")
    counts = cut(counts.where("count > 1").withColumn("level", level), "word-counts")
    # At most a few hundred levels, whatever the corpus.
    lowest, total = None, 0
    for row in sorted(counts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.level):
        total += row.n
        if total > limit:
            break
        lowest = row.level
    if lowest is None:
        return EMPTY
    sent = spark.sparkContext.broadcast(spec)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = encode_each(sent.value, batch.column(0).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["word", "ids"])

    table = cut(counts.where(F.col("level") >= lowest).select("word").mapInArrow(encode, "word string, ids array<int>"), "distinct-words")
    rows = table.toArrow().combine_chunks()
    ids = rows.column("ids").combine_chunks()
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return WordTable(rows.column("word").combine_chunks().cast(pa.string()), ids.flatten().to_numpy().astype(np.int32), edges)


def packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ids as little-endian unsigned 32-bit binary values."""
    edges = np.concatenate([[0], ends]).astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]).cast(pa.binary())


def list_edges(lists: pa.Array) -> np.ndarray:
    """Positions behind each list's elements in ``lists.flatten()``."""
    return np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))


def texts_of(pieces: pa.Array, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """Runs of ids as texts, read from their pieces' bytes; what is no UTF-8 becomes U+FFFD."""
    if not len(ids):
        return [""] * len(ends)
    found = pieces.take(pa.array(ids))
    edges = np.frombuffer(found.buffers()[1], dtype=np.int32)[: len(found) + 1]
    data = memoryview(found.buffers()[2] or b"")
    at = edges[np.concatenate([[0], ends])]
    return [str(data[a:b], "utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]


def encode(docs: DataFrame, vocabulary: Vocabulary, carry: list[str], text: str = "text", limit: int = TABLE_WORDS, decoded: str | None = None) -> DataFrame:
    """The carried columns, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every row.

    ``decoded`` names a column for the texts that the ids decode to, made by the
    same tasks, so that no second Python worker is needed beside the first.
    """
    spark = docs.sparkSession
    table = word_table(docs.select(vocabulary.words(F.col(text)).alias("words")), vocabulary, limit)
    sent = spark.sparkContext.broadcast((vocabulary.text, table, vocabulary.pieces() if decoded else None))
    rows = docs.select(F.struct(*carry).alias("row"), vocabulary.words(F.col(text)).alias("words"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, table, pieces = sent.value
        for batch in batches:
            words = batch.column(1)
            ids, ends = table.join(spec, words.flatten())
            ends = np.concatenate([[0], ends])[list_edges(words)]
            sizes = pa.array(np.diff(ends, prepend=0), pa.int64())
            out = {"row": batch.column(0), "n_tokens": sizes, "ids": packed(ids, ends)}
            if pieces is not None:
                out["decoded"] = pa.array(texts_of(pieces, ids, ends), pa.string())
            yield pa.RecordBatch.from_pydict(out)

    kind = f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, ids binary" + ", decoded string" * bool(decoded)
    found = rows.mapInArrow(join, kind)
    return found.select("row.*", "n_tokens", "ids", *([F.col("decoded").alias(decoded)] if decoded else []))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The rows and the text of their packed ids; bytes that are no UTF-8 become U+FFFD."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary.pieces())

    @F.pandas_udf("string")
    def read(packed_ids):
        values = [np.frombuffer(v or b"", dtype="<u4") for v in packed_ids]
        flat = np.concatenate([np.zeros(0, np.uint32), *values]).astype(np.int64)
        ends = np.cumsum([len(v) for v in values], dtype=np.int64)
        return type(packed_ids)(texts_of(sent.value, flat, ends), dtype=object)

    return encoded.withColumn(name, read(F.col(ids)))
