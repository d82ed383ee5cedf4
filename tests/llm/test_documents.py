"""Operators over documents against brute force, on small and awkward fixtures."""

import collections
import itertools
import json
import random
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

import public_tokenizers
from daybook.llm import bpe, components, decontamination, quality_rules, secrets, sharding, simhash, token_files, toxicity
from daybook.llm.queries import vocabulary

AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one"), (5, "one"), (None, "no id"), (None, None),
    (7, "Ünïcödé straße ＡＢＣ 😀😀 a b c\x85d\x1ce"), (8, "x" * 30000), (9, "the cat sat on the mat " * 3000),
    (10, "it's <|endoftext|> we'll <|endoftext|><|endoftext|>  "), (11, "A b\nA b\nA b\n\n c ... 12345 $$##"),
    (12, "tabs\tand  double   spaces\r\n\r\n  end "), (13, "\U0001fae0\U0001fae8 new ͸ points"), (14, "THE Cat SAT on THE mat " * 40),
]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def test_merges_by_rank_equal_the_model(docs):
    spec = vocabulary().text
    tokenizer, _, merged = bpe._tokenizer(spec)
    model = bpe._model(tokenizer)
    assert bpe._merger(spec) is not None
    rng = random.Random(12)
    parts = [" ", "a", "e", "th", "ing", "é", "ü", "1", "00", "--", "==", "  ", "\n", ".", "中", "😀", "Z", "aaaa", "\x00"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(20000)] + ["a" * n for n in range(1, 200)]
    assert all(merged(w.encode()) == model(w.encode()) for w in words)
    # merges out of the order of their ids, or a byte without a piece: the model itself is used
    other = json.loads(spec)
    other["model"]["merges"][5], other["model"]["merges"][6] = other["model"]["merges"][6], other["model"]["merges"][5]
    assert bpe._merger(json.dumps(other)) is None


# --- quality rules


def test_quality_measures_equal_brute_force(docs):
    rng = random.Random(4)
    more = [(100 + i, "".join(rng.choice(["a ", "b ", "c ", "dd ", "\n", "#", "... "]) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    rows = AWKWARD + more
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs(*rows)).collect())
    want = []
    for i, t in rows:
        w, t = words_of(t), t or ""
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want.append((i or 0, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed))
    assert got == sorted(want)


def test_quality_is_one_projection_without_functions_of_users(docs):
    plan = quality_rules.judge(docs((1, "a b")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_thresholds_decide_and_columns_survive(docs):
    clean = "The committee of the town met in the evening and it was agreed that the road to the mill is to be mended before winter."
    rows = [(1, clean), (2, clean + " ###" * 20), (3, "w " * 5), (4, None), (1, clean)]
    kept = quality_rules.keep_good(docs(*rows))
    assert kept.columns == docs(*rows).columns and sorted(r.doc_id for r in kept.collect()) == [1, 1]
    only = (quality_rules.Threshold("long", "n_words", at_most=10),)
    assert quality_rules.keep_good(docs(*rows), thresholds=only).isEmpty()
    assert quality_rules.keep_good(docs(*rows).limit(0)).isEmpty()


# --- SimHash


def brute_print(text):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), seed=42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_classes_of_awkward_texts(docs):
    got = simhash.near_duplicates(docs(*AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by_print = collections.defaultdict(set)
    for i, t in AWKWARD:
        by_print[f"{brute_print(t):016x}"].add(i)
    assert {(r.doc_id, r.fingerprint) for r in got} == {(i, p) for p, ids in by_print.items() for i in ids}
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert {r.component_id for r in got if r.doc_id == 5} == {4}
    assert simhash.near_duplicates(docs(*AWKWARD).limit(0)).isEmpty()


def brute_classes(prints, bits):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("bits, bucket", [(2, 4096), (2, 3), (0, 4096), (1, 2), (3, 2), (4, 5)])
def test_links_join_what_brute_force_joins(spark, bits, bucket):
    """Chains and dense clusters, with buckets that are gathered and buckets that are too large for it."""
    rng = random.Random(bits * 10 + bucket)
    prints = []
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.randint(1, 14)):
            prints.append(at)
            for b in rng.sample(range(64), rng.randint(0, bits + 1)):
                at ^= 1 << b
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(rows, "doc long, fp long")
    got = {r.doc: r.component_id for r in df.join(simhash.classes(df, "doc", bits, bucket), "fp").collect()}
    assert [got[i] for i in range(len(prints))] == brute_classes(prints, bits)


def test_the_first_row_of_each_class_stays(docs):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(9, base), (3, base), (3, base), (20, base + " tail"), (5, "something else entirely here"), (None, "lost"), (None, "lost"), (6, None), (2, "")]
    kept = simhash.keep_first(docs(*rows))
    assert kept.columns == docs(*rows).columns
    got = sorted((r.doc_id or -1, r.text) for r in kept.collect())
    linked = (brute_print(base) ^ brute_print(base + " tail")).bit_count() <= 2
    assert got == sorted([(3, base), (5, "something else entirely here"), (-1, "lost"), (2, "")] + ([] if linked else [(20, base + " tail")]))


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(2)
    path = list(range(300))
    rng.shuffle(path)
    links = [(path[i], path[i + 1]) for i in range(299)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(300)} | {1000 + i: 1000 for i in range(200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# --- decontamination


def test_myers_distances_equal_the_table():
    rng = random.Random(8)
    for _ in range(300):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 90)))
        b = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 120)))
        row = [0] * (len(b) + 1)
        for i, c in enumerate(a, 1):
            row = _next(row, i, c, b)
        assert list(decontamination.distances(a, b)) == row[1:]


def _next(before, i, c, b):
    now = [i]
    for j, x in enumerate(b, 1):
        now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (c != x)))
    return now


def test_passages_are_found_within_the_budget_and_no_others(spark, docs, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(20)] + [(90, None), (91, ""), (92, "short one"), (93, "!?")]
    rows, want = [], set()
    for n in range(160):
        text = " ".join(word() for _ in range(rng.randint(0, 300)))
        if n % 2:
            i, item = items[n % 20]
            k = int(len(decontamination.normalized(item)) * decontamination.RATE)
            cut, out = rng.randint(0, len(text)), list(item.upper() if n % 3 else item.replace(" ", ",\n "))
            for _ in range(k if n % 4 == 1 else 0):
                at = rng.randrange(len(out))
                out[at] = rng.choice(["", "q", out[at] + "q"])
            text = f"{text[:cut]} {''.join(out)} {text[cut:]}"
        rows.append((n, text))
    rows += [(500, None), (501, ""), (502, "a SHORT, one here"), (503, "shorter ones"), (None, items[0][1]), (1, rows[1][1])]
    for d, t in rows:
        text = f" {decontamination.normalized(t)} "
        for i, item in items:
            item = decontamination.normalized(item)
            if item and len(item) < decontamination.LEAST and f" {item} " in text:
                want.add((d, i, 0))
            elif len(item) >= decontamination.LEAST and (best := min(decontamination.distances(item, text))) <= int(len(item) * decontamination.RATE):
                want.add((d, i, best))
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontamination.BLOCK_BYTES, 700):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        got = decontamination.find(docs(*rows), table).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want) + sum(d == 1 for d, *_ in want)
    text = dict(rows)
    exact = [r for r in got if r.distance == 0 and r.doc_id is not None]
    assert exact and all(decontamination.normalized(text[r.doc_id][r.start : r.end]) == decontamination.normalized(dict(items)[r.item_id]) for r in exact)
    left = decontamination.drop_contaminated(docs(*rows), table)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in rows if d not in {x[0] for x in want})
    assert left.columns == docs(*rows).columns
    assert decontamination.find(docs(*rows), table.limit(0)).isEmpty() and decontamination.find(docs(*rows).limit(0), table).isEmpty()


def test_repeated_items_are_sent_once_and_one_block_at_a_time(spark, docs, monkeypatch):
    items = [(i, "the one row that a third of the benchmark is, over and over again") for i in range(40)]
    items += [(100 + i, f"item {i} asks for the number {i * 7919} in so many words as it can find") for i in range(40)]
    sent, alive, most = [], [], [0]
    broadcast = type(spark.sparkContext).broadcast

    def spy(self, value):
        out = broadcast(self, value)
        if isinstance(value, list):
            sent.append(value)
            alive.append(out)
            most[0] = max(most[0], len(alive))
            destroy = out.destroy
            out.destroy = lambda *a, **b: (alive.remove(out), destroy(*a, **b))
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", spy)
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    got = decontamination.find(docs((1, items[0][1]), (2, items[45][1]), (2, items[45][1])), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if not r.distance) == [(1, i) for i in range(40)] + [(2, 105)] * 2
    assert len([t for block in sent for _, t in block]) == 41 and len(sent) > 3
    assert max(sum(len(t) for _, t in block) for block in sent) < 600 and most[0] == 1 and not alive


def test_short_items_have_their_budget_at_word_boundaries_and_ids_are_only_names(spark, docs):
    items = [(1, "which town is the capital of Peru"), (2, "short questions"), (3, "tiny text"), (None, "a question that has no id"), (2**62 + 1, "what is the answer")]
    rng, rows, want = random.Random(6), [(2**61 + 1, "x what is the answer y"), (None, "what is the answer")], set()
    for n in range(400):
        out = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            out[rng.randrange(len(out))] = rng.choice(["", "q", " ", "qq"])
        rows.append((n, rng.choice(["", "Ab ", "and, ", "x"]) + "".join(out) + rng.choice(["", " cd", "? No", "y"])))
    for d, t in rows:
        words = decontamination.normalized(t).split()
        for i, item in items:
            item, best = decontamination.normalized(item), 99
            for part in {" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)}:
                row = range(len(item) + 1)
                for k, c in enumerate(part, 1):
                    now = [k]
                    for j, x in enumerate(item, 1):
                        now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != x)))
                    row = now
                best = min(best, row[-1])
            if best <= int(len(item) * decontamination.RATE):
                want.add((d, i, best))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find(docs(*rows), table).collect()
    assert len(got) == len(want) and {(r.doc_id, r.item_id, r.distance) for r in got} == want and {0, 1, 2} <= {x[2] for x in want}
    assert all(r.end > r.start and dict(rows)[r.doc_id][r.start - 1 : r.start].strip(" ,") == "" for r in got)
    left = [r.doc_id for r in decontamination.drop_contaminated(docs(*rows), table).collect()]
    assert sorted(map(str, left)) == sorted(str(d) for d, _ in rows if d not in {x[0] for x in want})


# --- secrets

HEX, KEY, LIVE = "0123456789abcdef" * 2, "AKIA" + "ABCDEFGHIJKLMNOP", "Zx9Kq27LmN84bVt6Wd1cRf3YgH5j"
SECRETS = [
    (1, f'token = "{HEX}" and {KEY}'), (2, f"Password:hunter2 secret=abc secret=token:abcdefg {LIVE}"), (3, f"{LIVE} {KEY}x AKIAAKIA{KEY} AKIA"),
    (4, None), (5, ""), (6, "pässword = geheim123 api_key='k-1234' APIKEY=zzzzzz"), (7, "deadbeef" * 3 + "g" + "abc" * 7), (None, f"x {HEX}"),
    (8, "password=" * 400 + "secret1"), (9, "😀" * 5 + f" token:{LIVE}"), (1, f'token = "{HEX}" and {KEY}'), (10, " ".join(f"secret=abcdef{i}" for i in range(700))),
]


def brute_spans(text):
    rules = (
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    )
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, rule, ok) in enumerate(rules) for m in rule.finditer(text or "") if ok(m)]
    return ",".join(x[2] for x in sorted(found))


def test_base_spans_equal_brute_force(docs):
    out = secrets.scan(docs(*SECRETS), {"doc_id": F.col("doc_id")})
    base = secrets.as_text(F.filter("spans", lambda s: s["kind"] < 3))
    got = sorted((str(r.doc_id), r.base) for r in out.select("doc_id", base.alias("base")).collect())
    assert got == sorted((str(i), brute_spans(t)) for i, t in SECRETS)
    assert secrets.scan(docs(*SECRETS).limit(0), {"doc_id": F.col("doc_id")}).isEmpty()


def test_running_sums(spark):
    sizes = [0, 1, 5, 255, 256, 257, 1000]
    df = spark.createDataFrame([(list(range(n)),) for n in sizes], "v array<int>")
    got = [r.s for r in df.select(secrets.running_sums(F.col("v")).alias("s")).collect()]
    assert got == [[sum(range(i)) for i in range(n)] for n in sizes]


def test_ownership_tells_copied_examples_from_live_values(docs):
    copied, own = "Ab1" * 9, "Cd2" * 9
    rows = [(i, f"example {copied}") for i in range(9)] + [(30, f"mine {own}"), (33, f"mine {own}")]
    spans = {r.doc_id: r.spans for r in secrets.scan(docs(*rows), {"doc_id": F.col("doc_id")}).collect()}
    assert all(spans[i] == [] for i in range(9))
    assert [(s.kind, s.value, s.n_owners, s.n_repos, s.live) for s in spans[30]] == [(3, own, 1, 1, True)]


def test_only_live_values_are_masked(docs):
    rows = [(1, f"a token = {HEX}, again {HEX}"), (2, f"password=example1 {KEY}"), (3, f"password=example1 {KEY}"), (4, None), (5, "nothing")]
    out = secrets.redact(docs(*rows))
    assert out.columns == docs(*rows).columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    masked = f"a token = {secrets.MASK}, again {secrets.MASK}"
    assert got[1] == (masked, len(masked)) and got[4] == (None, None) and got[5] == ("nothing", 7)
    assert got[2][0] == rows[1][1] and got[3][0] == rows[2][1]


def brute_masked(text, values):
    """``values``: (start, end) of the live values, and their texts masked elsewhere if they are no plain words."""
    out, at = "", 0
    for a, z in sorted(values):
        if a >= at:
            out += text[at:a] + secrets.MASK
        at = max(at, z)
    out += text[at:]
    words = {text[a:z] for a, z in values if not re.fullmatch(r"[a-z]+|[A-Z]?[a-z]+|[A-Z]+|[0-9]+", text[a:z])}
    for v in sorted(words, key=lambda v: (-len(v), v)):
        out = re.sub(rf"(?<![A-Za-z0-9+/_=-]){re.escape(v)}(?![A-Za-z0-9+/_=-])", secrets.MASK, out)
    return out


def test_words_of_prose_are_masked_at_their_span_only(docs):
    prose = "api token: because the harbour opened. It closed because of rain; becauseway street."
    mixed = "Xy9kQ2"
    rows = [
        (1, prose), (2, f"secret={mixed}7, and {mixed}7 alone, x{mixed}7 not, {mixed}78 not, ({mixed}7)."),
        (3, "password=abcdef0123456789abcdef0123 token=\\E$1.b\\Q"), (4, f"ünï 😀 token: {mixed}Zz 😀 {mixed}Zz" * 3),
    ]
    got = {r.doc_id: r.text for r in secrets.redact(docs(*rows)).collect()}
    assert got[1] == prose.replace("because", secrets.MASK, 1)
    assert got[2] == f"secret={secrets.MASK}, and {secrets.MASK} alone, x{mixed}7 not, {mixed}78 not, ({secrets.MASK})."
    assert got[3].startswith(f"password={secrets.MASK} token=") and "abcdef" not in got[3]
    assert got[4].count(secrets.MASK) == 6 and mixed not in got[4] and got[4].count("😀") == 6


def test_secret_plans_have_no_python(docs):
    plan = secrets.scan(docs(*SECRETS), {"doc_id": F.col("doc_id")})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# --- BPE and token files


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def strange_texts():
    rng = random.Random(6)
    pool = "aB1é ß\t\n\r\x0b\x1c\x85\xa0   　﻿'’sSt<|>.!😀中٣½²Ⅷ́͸\U0001fae8"
    return [(200 + i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(300)]


@pytest.mark.parametrize("limit", [1 << 19, 5, 0])
def test_ids_and_texts_equal_the_library(docs, library, limit):
    rows = AWKWARD + strange_texts()
    df = bpe.decode(bpe.encode(docs(*rows), vocabulary(), ["doc_id", "text"], limit=limit, decoded="again"), vocabulary())
    got = df.collect()
    assert len(got) == len(rows) and all(r.again == r.decoded for r in got)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))) == (len(ids), ids), repr(r.text)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs(*rows).limit(0), vocabulary(), ["doc_id"]).isEmpty()


def test_ids_that_are_no_text_decode_as_the_library_does(spark, library):
    rng = random.Random(9)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 30))] for _ in range(100)]
    df = spark.createDataFrame([(i, struct.pack(f"<{len(x)}I", *x)) for i, x in enumerate(lists)], "i int, ids binary")
    got = {r.i: r.decoded for r in bpe.decode(df, vocabulary()).collect()}
    assert [got[i] for i in range(100)] == [library.decode(x, skip_special_tokens=False) for x in lists]


def test_texts_are_split_in_arrays_as_the_library_splits_them():
    rng = random.Random(11)
    marks = ["'", "'", *"stdmlrveS", "re", "ve", "ll", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "é", "1", "²", "!", "\u0301", "漢", "😀"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    own = pre_tokenizers.ByteLevel(add_prefix_space=False)
    for some in (texts, ["".join(c for c in t if c.isascii()) for t in texts]):
        words, edges = bpe.split(pa.array(some), ["<|endoftext|>"])
        words, edges = words.to_pylist(), [0, *edges.tolist()]
        assert [words[a:z] for a, z in itertools.pairwise(edges)] == [[t[a:z] for _, (a, z) in own.pre_tokenize_str(t)] for t in some]
    for some in ([None, "", "a <|endoftext|> 's", "a \u0378 b", "<|endoftext|><|endoftext|>", "<|endof", "text|>", ""], ["a<|endoftext|>b ", "\n'll"], [], [""]):
        words, edges = bpe.split(pa.array(some, pa.string()), ["<|endoftext|>"])
        want = {None: [], "": [], "a <|endoftext|> 's": ["a", " ", "<|endoftext|>", " '", "s"], "a \u0378 b": ["a \u0378 b"], "<|endof": ["<|", "endof"], "text|>": ["text", "|>"]}
        want |= {"<|endoftext|><|endoftext|>": ["<|endoftext|>"] * 2, "a<|endoftext|>b ": ["a", "<|endoftext|>", "b", " "], "\n'll": ["\n", "'ll"]}
        assert words.to_pylist() == [w for t in some for w in want[t]] and np.diff(edges, prepend=0).tolist() == [len(want[t]) for t in some]


@pytest.mark.parametrize("lanes", [1, 3, 200])
def test_carries_and_lanes_of_unlike_lengths_come_back(lanes):
    rng = np.random.default_rng(lanes)
    steps = 300
    even, odd = rng.integers(0, 3000, (lanes, steps)), np.zeros((lanes, steps), np.int64)
    for ids in (even, odd, np.where(np.arange(lanes)[:, None] % 2, even, odd), np.full((lanes, steps), 2999)):
        words, sizes = token_files._code(ids.reshape(-1), 3000, lanes, steps)
        assert int(sizes.sum()) == len(words)
        assert (token_files._uncode(words, sizes, lanes * steps, 3000, lanes, steps) == ids.reshape(-1)).all()


def test_counts_stay_below_their_limit():
    model = token_files.Mixer(3, 1 << 22)
    for _ in range(3):
        model.predict()
        model.learn(np.zeros(1 << 22, np.int64))
        assert 0 < int(model.line[-1]) <= token_files._MOST and int(model.total.min()) > 0


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_blocks_come_back(n):
    rng = np.random.default_rng(n)
    for ids in (rng.zipf(1.2, n) % 50257, np.full(n, 7), rng.integers(0, 1 << 21, n), np.arange(n) % 3):
        block = token_files.encode_block([None, -5, 1 << 62], np.array([0, n // 3, n - n // 3]), ids)
        keys, sizes, back = token_files.decode_block(block)
        assert keys == [None, -5, 1 << 62] and sizes.tolist() == [0, n // 3, n - n // 3] and back.tolist() == ids.tolist()


def test_damage_is_noticed_and_repetition_is_cheap():
    block = token_files.encode_block([1], np.array([4000]), np.tile(np.arange(20), 200))
    assert len(block) < 900
    for at in (0, 10, len(block) // 2, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.decode_block(bytes(bad))
    with pytest.raises(ValueError):
        token_files.encode_block([1], np.array([1]), np.array([1 << 30]))


@pytest.mark.parametrize("block", [1, 300, 1 << 20])
def test_files_hold_all_documents_in_order(docs, library, spark, block):
    rows = AWKWARD + strange_texts()[:40]
    path = token_files.write(docs(*rows).repartition(5), vocabulary(), block=block)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(i for i, _ in rows if i is not None)
    assert [r.doc_id for r in got[:2]] == [None, None]
    want = collections.Counter((i, zlib.crc32(struct.pack(f"<{len(e) + 1}I", *e, 0))) for i, t in rows for e in [library.encode(t or "", add_special_tokens=False).ids])
    assert collections.Counter((r.doc_id, zlib.crc32(r.ids)) for r in got) == want
    ends = [0, *np.cumsum([r.n_tokens for r in got]).tolist()]
    assert [r.start for r in got] == ends[:-1]
    empty = token_files.write(docs(*rows).limit(0), vocabulary())
    assert token_files.read(spark, empty).isEmpty()


# --- sharding


def test_shards_are_contiguous_balanced_and_gapless(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(400) if i % 3 else 77, "z" * rng.randint(0, 60)) for i in range(3000)] + [(None, None), (None, ""), (77, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    got = sharding.assign(df, "doc_id", size, 24, {"text": F.col("text")}).collect()
    assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(rows)
    shards = collections.defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    total = sum(r.size for r in got)
    assert sorted(shards) == list(range(24))
    last = -2
    for s in range(24):
        rs = sorted(shards[s], key=lambda r: r.slot)
        assert [r.slot for r in rs] == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - total / 24) <= 68
        keys = [-1 if r.doc_id is None else r.doc_id for r in rs]
        assert keys == sorted(keys) and keys[0] >= last
        last = keys[-1]
    assert sharding.assign(df.limit(0), "doc_id", size, 24).isEmpty()
    few = sharding.assign(df.limit(2), "doc_id", size, 24).collect()
    assert len(few) == 2 and len({r.shard for r in few}) == 2


def test_every_outcome_reaches_the_mixing_weights():
    model, rng, steps, lanes = token_files.Mixer(50, 30), np.random.default_rng(3), 64, 30
    for _ in range(steps):
        model.predict()
        model.learn(rng.integers(0, 50, lanes))
    start = 2 * token_files._LEVELS
    assert [int(s.sum()) - start for s in model.score] == [steps * lanes] * 2 and not any(model.outcomes)


# --- toxicity


def test_segments_equal_the_recursive_definition():
    def brute(seq, lo, hi):
        best = max(((sum(seq[i : j + 1]), -i, -j) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[1], -best[2]
        return [*brute(seq, lo, i), (i, j, round(best[0], 6)), *brute(seq, j + 1, hi)]

    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 18)
        step, seq = -rng.random() - 0.01, []
        scores = {i: rng.random() * 3 + 0.01 for i in range(n) if rng.random() < 0.5}
        seq = [scores.get(i, step) for i in range(n)]
        assert [(a, b, round(s, 6)) for a, b, s in toxicity.segments(sorted(scores.items()), step)] == brute(seq, 0, n)


def test_segments_of_a_long_sequence_take_linear_time():
    n = 300_000
    found = toxicity.segments([(i, 1.0 + (i % 7) / 10) for i in range(0, n, 3)], -1.0)
    assert found and found[-1][1] < n


def corpus(rng, n, toxic):
    plain = ["river", "stone", "bread", "light", "seven", "window", "garden", "paper", "music", "winter"]
    bad = ["vilewort", "grubbish", "snarlkin"]
    out = []
    for i in range(n):
        words = [rng.choice(plain) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(3, 80))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", "ed", "ous"]))
        out.append(" ".join(words))
    return out


def test_scores_separate_held_out_texts(spark, docs):
    rng = random.Random(7)
    rows = [(i, t, y) for i, (t, y) in enumerate([(t, 0) for t in corpus(rng, 300, False)] + [(t, 1) for t in corpus(rng, 60, True)])]
    rows += [(1000 + i, rows[310][1], 1) for i in range(200)]  # a much copied toxic text: its plain words must not count
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5] + [(3, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    table = docs(*[(i, t) for i, t, _ in rows])
    model = toxicity.fit(toxicity.training_rows(table, labels))
    assert all(f.startswith(("vile", "grub", "snar")) for f in model.weights)
    test = [(i, t) for i, t, _ in rows if i % 5 == 0 and i < 1000] + [(5000, None), (5001, ""), (5002, "vilewort"), (5003, "river " * 20000), (5003, "stone")]
    truth = {i: y for i, _, y in rows} | {5000: 0, 5001: 0, 5002: 1, 5003: 0}
    got = toxicity.score(docs(*test), model, ["doc_id"]).collect()
    assert len(got) == len(test) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    wrong = [r.doc_id for r in got if r.predicted != truth[r.doc_id]]
    assert len(wrong) <= 0.03 * len(got) and 5002 not in wrong and 5003 not in wrong
    again = toxicity.fit(toxicity.training_rows(table.repartition(9), labels))
    assert again.weights == pytest.approx(model.weights) and again.slope == pytest.approx(model.slope)


def test_without_two_classes_the_score_is_the_share(spark, docs):
    for labels, low in (([(1, 0), (2, 0)], True), ([(1, 1)], False), ([], None)):
        rows = toxicity.training_rows(docs((1, "a"), (2, "b")), spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score(docs((1, "x"), (2, None)), toxicity.fit(rows), ["doc_id"]).collect()
        assert len({r.score for r in got}) == 1 and (low is None or (got[0].score < 0.5) == low)
    assert toxicity.score(docs((1, "x")).limit(0), toxicity.Model(), ["doc_id"]).isEmpty()


def test_sampled_labels_stay_below_the_limit(spark, docs):
    table = docs(*[(i, "t") for i in range(2000)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    n = toxicity.training_rows(table, labels, limit=500).count()
    assert 380 < n < 620


def test_training_texts_are_read_once(spark, docs, monkeypatch):
    read = []
    plain = type(spark.range(0)).mapInPandas
    monkeypatch.setattr(type(spark.range(0)), "mapInPandas", lambda df, *a, **k: (read.append("text" in df.columns), plain(df, *a, **k))[1])
    rng = random.Random(8)
    texts = corpus(rng, 200, False) + corpus(rng, 60, True) + ["", None, "vilewort grubbish"]
    labels = spark.createDataFrame([(i, int(200 <= i < 260)) for i in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs(*enumerate(texts)), labels))
    assert sum(read) == 1 and model.weights
    # What the tasks hand on gives the same scores, segments and evidence as the texts themselves.
    sent = type("Sent", (), {"value": model})
    rows = pd.DataFrame({"text": texts, "y": 0, "weight": 1.0})
    first = pd.concat(toxicity._word_scores(sent)([rows]))
    for text, n, scores, counts in zip(texts, first["n"], first["scores"], first["counts"], strict=True):
        want = collections.Counter(round(model.weight(w), 2) or toxicity.STEP for w in toxicity.words(text))
        assert n == len(toxicity.words(text)) and dict(zip(scores, counts, strict=True)) == want
    second = pd.concat(toxicity._best_segments(model.scale, model.factor)([first]))
    assert second["evidence"].tolist() == [model.evidence(t)[0] for t in texts]
