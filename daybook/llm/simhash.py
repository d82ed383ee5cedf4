"""SimHash near-duplicates over pivot distance tables.

Every distinct fingerprint is dealt to buckets in which all members agree on
some blocks of bits: of ``max_bits + 2`` blocks, two at least are equal for any
pair that links, so each pair that links meets in a bucket. Inside a bucket the
distances to ``PIVOTS`` fixed reference fingerprints are computed once per
member; by the triangle inequality a pair whose tables differ by more than
``max_bits`` in any coordinate can't link and is discarded. Survivors are
verified by their own Hamming distance. A bucket yields a spanning forest of its
links, never its pairs.

A bucket of more than ``BUCKET`` distinct fingerprints is not gathered. Its
members take an exact way of linear cost: two fingerprints link if and only if
some value lies within ceil(max_bits/2) bits of one and floor(max_bits/2) bits of
the other, so members meet at those values and link to the smallest one there;
such a meeting has no more members than there are values around it.

Copies share a fingerprint and are grouped before any of this. A text without
words has fingerprint zero and links like any other; null text is such a text.
Null ids are allowed; an empty table gives an empty result; rows keep their
multiplicity; columns that aren't named are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.components import components
from daybook.llm.store import cut, place

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Reference fingerprints; fixed by rule, so that tables of different runs agree.
PIVOTS = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) for i in range(32)], dtype=np.uint64)
BUCKET = 4096

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; a bit is set if it is in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in joined), dtype=np.uint64, count=max(1, len(words) - shingle + 1))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` and the fingerprint as a signed LONG."""

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, prints(F.coalesce(F.col(text), F.lit(""))))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _block_masks(max_bits: int) -> list[int]:
    """Masks of every two of ``max_bits + 2`` blocks; a pair within ``max_bits`` bits agrees on one of them."""
    blocks = max_bits + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [x | y for x, y in itertools.combinations(masks, 2)]


def _forest(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join the members of a bucket as all of its links do."""
    n = len(prints)
    table = np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    step = max(16, min(512, (1 << 21) // n))
    for lo in range(0, n, step):
        left, right = np.nonzero(np.abs(table[lo : lo + step, None, 0] - table[None, lo:, 0]) <= max_bits)
        keep = left < right
        left, right = left[keep] + lo, right[keep] + lo
        for p in range(1, table.shape[1], 8):
            keep = (np.abs(table[left, p : p + 8] - table[right, p : p + 8]) <= max_bits).all(axis=1)
            left, right = left[keep], right[keep]
        sure = np.bitwise_count(prints[left] ^ prints[right]) <= max_bits
        for i, j in zip(left[sure].tolist(), right[sure].tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _bucket_links(members: DataFrame, max_bits: int) -> DataFrame:
    gathered = members.groupBy("i", "bits").agg(F.collect_list("fp").alias("fps")).select("fps")

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for fps in batch["fps"]:
                signed = np.asarray(fps, dtype=np.int64)
                for i, j in _forest(signed.view(np.uint64), max_bits):
                    a.append(signed[i])
                    b.append(signed[j])
            yield pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return gathered.mapInPandas(link, "a long, b long")


def _meeting_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links of any number of fingerprints ``fp`` over shared values nearby."""
    outer, inner = (max_bits + 1) // 2, max_bits // 2
    flips = [
        (_signed(sum(1 << b for b in bits)), r <= inner) for r in range(outer + 1) for bits in itertools.combinations(range(64), r)
    ]
    near = F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(i).alias("inner")) for m, i in flips]))
    around = prints.select("fp", near.alias("n")).select("fp", F.col("fp").bitwiseXOR(F.col("n.m")).alias("z"), "n.inner")
    met = around.groupBy("z").agg(F.collect_set("fp").alias("fps"), F.min(F.when(F.col("inner"), F.col("fp"))).alias("b"))
    return met.where((F.size("fps") > 1) & F.col("b").isNotNull()).select(F.explode("fps").alias("a"), "b").where("a != b")


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that join all that ``max_bits`` or fewer bits join."""
    masks = _block_masks(max_bits)
    keys = F.explode(
        F.array(*[F.struct(F.lit(i).cast("byte").alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("bits")) for i, m in enumerate(masks)])
    )
    dealt = prints.select("fp", keys.alias("k")).select("fp", "k.i", "k.bits")
    sizes = cut(dealt.groupBy("i", "bits").count().where("count > 1"), "bucket-sizes")
    members = cut(dealt.join(sizes, ["i", "bits"]), "bucket-members")
    few = _bucket_links(members.where(F.col("count") <= bucket), max_bits)
    many = members.where(F.col("count") > bucket).select("fp").distinct()
    return few if many.isEmpty() else few.unionByName(_meeting_links(many, max_bits))


def classes(prints: DataFrame, doc: str, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """``fp, root, component_id`` of every distinct ``fp``: its component's key and the smallest id that can be reached."""
    distinct = cut(prints.groupBy("fp").agg(F.min(doc).alias("least")), "fingerprints")
    labels = components(links(distinct.select("fp"), max_bits, bucket)).withColumnRenamed("node", "fp")
    labelled = distinct.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = cut(labelled, "fingerprint-roots")
    least = cut(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return cut(labelled.join(least, "root").select("fp", "root", "component_id"), "fingerprint-classes")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row."""
    prints = cut(with_fingerprints(docs.select(doc, text), text, shingle=shingle).select(doc, "fp"), "doc-fingerprints")
    return prints.join(classes(prints, doc, max_bits), "fp").select(doc, as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, that of the smallest id (then the first in the scan), with the columns of ``docs``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), place().alias("_place"))
    whole = cut(with_fingerprints(rows, f"row.{text}", shingle=shingle), "fingerprinted")
    slim = whole.select(F.col(f"row.{doc}").alias("_doc"), "fp", "_place")
    member = slim.join(classes(slim, "_doc", max_bits), "fp")
    order = F.struct(F.col("_doc").isNull().alias("n"), F.col("_doc").alias("d"), F.col("_place").alias("p"))
    first = member.groupBy("root").agg(F.min(order).alias("f"))
    kept = cut(first.select(F.col("f.p").alias("_place")), "kept-places")
    # Kept places grow with the rows, so this is a shuffle join at every size, never a broadcast.
    return whole.join(kept.hint("merge"), "_place", "left_semi").select("row.*")
