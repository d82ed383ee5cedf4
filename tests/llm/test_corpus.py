"""Exact duplicates, collocations and the manifest against brute force."""

import collections
import functools
import hashlib
import pickle
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_documents import AWKWARD

from daybook.llm import collocations, merkle, patricia

FULL = "doc_id long, text string, lang string, source string, n_chars long, node string, tree int, path string"


def rows_of(spark, rows):
    """(doc_id, text, lang, source) as documents, with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), "x", 1, "y") for i, t, g, s in rows], FULL)


# --- exact duplicates


def brute_owners(rows):
    """Ids of owners, sizes and digests per row; one row of a group is kept."""
    texts = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    ids = collections.defaultdict(list)
    for (i, _), t in zip(rows, texts, strict=True):
        ids[t].append(i)
    keep = {t: min((i for i in v if i is not None), default=None) for t, v in ids.items()}
    return collections.Counter((i, keep[t], len(ids[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, texts, strict=True))


def check_owners(found, rows):
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == brute_owners(rows)
    kept = collections.Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) <= {1} and set(kept) == {r.text_sha256 for r in found}
    assert all(r.doc_id == r.keep_id for r in found if r.kept)


def test_owners_of_awkward_rows(docs):
    rows = [*AWKWARD, (20, "one"), (0, "tabs and double spaces end "), (21, " one"), (22, " one"), (None, "one")]
    check_owners(patricia.owners(docs(*rows)).collect(), rows)
    assert patricia.owners(docs().limit(0)).count() == 0


@pytest.mark.parametrize("budget", [4000, 20000])
def test_subtrees_that_leave_meet_their_copies_in_later_rounds(spark, docs, budget):
    rng = random.Random(budget)
    texts = ["".join(rng.choice("ab \t") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["long " * 400 + str(i) for i in range(12)]
    rows = [(i, rng.choice(texts)) for i in range(500)]
    check_owners(patricia.owners(docs(*rows).repartition(3), budget=budget).collect(), rows)


def test_a_hot_text_leaves_each_map_task_once(spark):
    rows = spark.range(3000, numPartitions=3).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    met = rows.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(patricia._meet(1 << 20), patricia._KIND)
    assert met.where(F.col("kind") == patricia._TEXT).count() == 3
    assert {(r.keep_id, r.group_size) for r in patricia.owners(rows).collect()} == {(0, 3000)}


def test_trie_numbers_texts_and_holds_them_compressed():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(400)] + [b"x" * 1000 + bytes([i]) for i in range(50)]
    trie, numbers = patricia.Trie(), {}
    for t in texts:
        assert trie.insert(t) == numbers.setdefault(t, len(numbers))
    assert dict((t, n) for n, t in trie.texts()) == numbers
    assert trie.bytes < patricia.NODE * 2 * len(numbers) + 12 * 400 + 1200  # the shared thousand bytes are held once
    before, gone = trie.bytes, dict((t, n) for n, t in trie.close())
    assert gone and trie.bytes <= before // 2 and trie.alive == len(numbers) - len(gone)
    for t, n in numbers.items():
        assert trie.insert(t) == (-1 if t in gone else n)
    assert trie.insert(next(iter(gone)) + b"~longer") in (-1, len(numbers))


# --- collocations


def brute_phrases(rows, least, longest=5, best=2000):
    count = collections.Counter()
    total = collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    often = {p: a for p, a in count.items() if a >= least}
    inside = collections.defaultdict(int)
    for (lang, p), a in often.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    inside[lang, p[i:j]] = max(inside[lang, p[i:j]], a)
    out = []
    for lang in total:
        found = []
        for (g, p), a in often.items():
            if g != lang or len(p) < 2 or ((g, p) in inside and 100 * inside[g, p] >= 100 * a):
                continue
            cuts = [(1000 * a * total[g] // (often[g, p[:k]] * often[g, p[k:]]), k, often[g, p[:k]], often[g, p[k:]]) for k in range(1, len(p))]
            s, _, left, right = min(cuts)
            found.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, w.decode(), -a, left, right, total[lang], -s) for i, (s, a, w, left, right) in enumerate(sorted(found)[:best])]
    return sorted(out)


def texts_of(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "Cat", "sat", "ON", "mat", "über", "a", "b", "c", "\x85", "\x1cx", "it's", "the\tcat", "new york city hall"]
    ends = [" ", " ", " ", "  ", ". ", "\n", ", ", ";"]
    return [("".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 80))), rng.choice(["en", "en", "de", "x y", None])) for _ in range(n)]


def mined(df, **options):
    return sorted(tuple(r) for r in collocations.mine(df, **options).collect())


@pytest.mark.parametrize("options", [{}, {"shard": 7}, {"bits": 3}, {"longest": 2}, {"best": 3}])
def test_phrases_equal_brute_force(spark, options):
    rows = [*texts_of(3), *[(t, "en") for _, t in AWKWARD], ("", "en"), (None, None)]
    df = rows_of(spark, [(i, t, g, "s") for i, (t, g) in enumerate(rows)]).repartition(3)
    want = brute_phrases(rows, 6, options.get("longest", 5), options.get("best", 2000))
    assert want and mined(df, least=6, **options) == want


def test_counts_above_a_byte_and_a_hot_phrase(spark):
    rows = [("one two three four five six. " * 400, "en"), ("one two " * 50, "en"), *texts_of(4, 10)]
    df = rows_of(spark, [(i, t, g, "s") for i, (t, g) in enumerate(rows)])
    assert mined(df, least=300) == brute_phrases(rows, 300) != []


def test_no_phrase_in_empty_tables_or_rare_words(spark):
    assert mined(rows_of(spark, [])) == [] == mined(rows_of(spark, [(1, "a b c", "en", "s"), (2, None, None, None)]))


def test_text_is_split_at_breaks_in_any_slice(monkeypatch):
    text = ("Some words here, and\tthere. " * 50 + "no break " * 40).encode()
    whole = [w for part in collocations.tokens(text) for w in part]
    monkeypatch.setattr(collocations, "SLICE", 7)
    parts = list(collocations.tokens(text))
    assert [w for part in parts for w in part] == whole and len(parts) > 50
    assert all(part[-1] == b"." for part in parts[:-1])


@pytest.mark.parametrize("seed", range(4))
def test_double_array_finds_all_phrases_and_no_others(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(1, 12 if seed else 900, 4000).astype(np.uint64) * np.uint64(7919)
    rows = np.zeros((600, 5), np.uint64)
    for i in range(len(rows)):
        k, at = rng.integers(2, 6), rng.integers(0, 3900)
        rows[i, :k] = codes[at : at + k]
    rows = np.unique(rows, axis=0)
    trie = collocations.DoubleArray(rows)
    codes[::17] = 5  # in no phrase
    counts = np.bincount(np.concatenate(list(trie.accepted(codes, np.arange(len(codes))))), minlength=len(rows))
    listed, want = codes.tolist(), collections.Counter()
    for k in range(2, 6):
        want.update(tuple(listed[i : i + k]) for i in range(len(listed) - k + 1))
    assert [want[tuple(c for c in r if c)] for r in trie.rows.tolist()] == counts.tolist()


def test_scores_beyond_64_bits(spark):
    cases = [(9 * 10**12, 10**13, 9 * 10**12, 3 * 10**9), (100, 10**13, 100, 100), (7, 9, 5, 3), (10**13, 10**13, 10**13, 10**13)]
    df = spark.createDataFrame(cases, "a long, n long, l long, r long")
    got = [r.s for r in df.select(collocations.score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in cases]


def test_different_phrases_of_one_hash_are_kept_apart():
    codes = np.array([1, 2, 3, 4, 1, 2, 0], np.uint64)
    found = collocations._distinct(codes, np.array([0, 2, 4]), np.array([9, 9, 9], np.uint64), 2)
    assert found[:, :2].tolist() == [[1, 2], [3, 4]]


@pytest.mark.parametrize("least", [100, 300])
def test_slices_come_back(least):
    rng = np.random.default_rng(least)
    for slots in ([0], [65535, 65536], [3, 258, 259, 514, 515, 70000, 300000], np.unique(rng.integers(0, 1 << 20, 30000)), np.arange(70000)):
        slots = np.asarray(slots, np.uint32)
        counts = rng.integers(1, 2 * least, len(slots))
        rows = collocations._slices(2, slots, counts, least).to_pylist()
        assert [r["slice"] for r in rows] == sorted({int(x) >> 16 for x in slots})
        assert np.concatenate([(r["slice"] << 16) + collocations._slots(r["slots"]) for r in rows]).tolist() == slots.tolist()
        assert np.concatenate([np.frombuffer(r["counts"], collocations._counter(least)) for r in rows]).tolist() == np.minimum(counts, least).tolist()


def test_a_task_hands_on_each_phrase_once(monkeypatch):
    rng = np.random.default_rng(5)
    rows = rng.integers(1, 9, (4000, 5)).astype(np.uint64)
    rows[rng.random(4000) < 0.5, 3:] = 0
    once = {tuple(r) for r in rows.tolist()}
    met = collocations._Met()
    told = [tuple(r) for part in (rows[:3000], rows[1000:], rows) for r in met.new(part).tolist()]
    assert len(told) == len(once) and set(told) == once
    # All of one hash: none is lost.
    monkeypatch.setattr(collocations, "_longer", lambda hashes, codes: hashes * np.uint64(0) + np.uint64(7))
    met = collocations._Met()
    assert {tuple(r) for r in met.new(rows[:500]).tolist()} == {tuple(r) for r in rows[:500].tolist()}
    assert {tuple(r) for part in (rows[:500], rows) for r in met.new(part).tolist()} | {tuple(r) for r in met.rows.tolist()} == once


def test_codes_of_words_take_less_than_eight_bytes(spark):
    coded = collocations._coded(rows_of(spark, [(1, "the cat sat on the mat " * 5000, "en", "s")]), "text", "lang", 0, 64).where("codes IS NOT NULL").collect()
    assert sum(len(r.codes) + len(r.places) for r in coded) < 3 * 30000


def test_counts_of_slots_add_up():
    slots, counts = np.array([1, 5, 9, 1, 9, (1 << 28) - 1], np.uint64), np.array([1, 40, 3, 2, 250, 7], np.uint64)
    got = collocations._added([slots[:3] << np.uint64(32) | counts[:3], slots[3:] << np.uint64(32) | counts[3:]], 100)
    assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in got] == [(1, 3), (5, 40), (9, 100), ((1 << 28) - 1, 7)]


def test_few_frequent_buckets_are_sent_in_few_bytes():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.001, 0.9):
        bits = collocations.Bits(20, np.where(rng.random(1 << 17) < share, rng.integers(1, 256, 1 << 17), 0).astype(np.uint8))
        sent = pickle.dumps(bits)
        back = pickle.loads(sent)
        assert back.shift == bits.shift and (back.data == bits.data).all()
        assert len(sent) < ((1 << 17) * 1.01 if share > 0.5 else 2000)


# --- manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row, lower=False):
    i, t, g, s = row
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower and t is not None else t
    values = [i, s, g, None if row[1] is None else len(row[1]), t]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves):
    """The root, and of every leaf its (left, right) siblings from below."""
    paths, places, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for n, p in enumerate(places):
            run, slot = runs[p // 16], p % 16
            paths[n].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            places[n] = p // 16
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def brute_manifest(rows, picked):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: brute_tree([brute_leaf(r) for r in sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))]) for s in names}
    root, above = brute_tree([trees[s][0] for s in names])
    out = []
    for s, stem in zip(names, above, strict=True):
        ordered = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r)))
        for row, path in zip(ordered, trees[s][1], strict=True):
            path = path + stem
            node = functools.reduce(lambda a, p: sha(p[0] + a + p[1]), path, brute_leaf(row, picked(row[0])))
            out.append((row[0], brute_leaf(row), trees[s][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [(1,), (16,), (17, 1), (300, 16, 2, 1, 33), tuple([1] * 20 + [5])])
def test_manifest_equals_brute_force(spark, sizes):
    rng = random.Random(len(sizes))
    names = [None, *(f"sö{i}" for i in range(len(sizes)))]
    rows = [(rng.randint(0, 10**6), rng.choice(["Abc", "abc", "", None, "Ü" * 50]), rng.choice(["en", None]), s) for s, n in zip(names, sizes, strict=False) for _ in range(n)]
    picked = lambda i: i is not None and i % 5 == 0
    df = rows_of(spark, rows).repartition(3)
    lowered = F.when(F.col("doc_id") % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = merkle.manifest(df, {"text": lowered}).drop("path")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_manifest(rows, picked)


def test_manifest_of_awkward_rows_and_of_none(spark):
    rows = [(i, t, "en", "s") for i, t in AWKWARD] + [(3, "same", None, None)] * 40
    got = merkle.manifest(rows_of(spark, rows)).drop("path").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_manifest(rows, lambda i: False)
    assert all(r.verified for r in got)
    assert merkle.manifest(rows_of(spark, [])).count() == 0
