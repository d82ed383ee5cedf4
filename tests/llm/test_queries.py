"""The registered queries on the smallest tables: against their SQL, or against brute force."""

import collections
import glob
import hashlib
import html
import os
import re
import struct
import zlib

import duckdb
import pytest
from test_documents import brute_classes, brute_masked, brute_print, brute_spans, words_of
from tokenizers import Tokenizer

import __spark_entry__ as entry
import check
import corpus_pipeline
import public_tokenizers
from daybook.llm import decontamination, queries, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall())


@pytest.fixture(scope="module")
def ids(texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: e.ids for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, con, name):
    _, rows, verdict = check.compare(spark, con, SF, name)
    assert verdict == "match" and rows > 0


def test_all_are_registered():
    assert [n for n in entry.queries() if re.match(r"op\d+_", n)] == list(queries.QUERIES) and len(queries.QUERIES) == 13
    assert "pipeline" in entry.queries() and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_op1(spark, con, texts):
    got = {r.doc_id: r for r in queries.op1_toxicity(spark, SF).collect()}
    assert set(got) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())


def test_op2(spark, texts):
    prints = [brute_print(t) for t in texts.values()]
    keys = list(texts)
    want = {(i, f"{p:016x}", keys[c]) for i, p, c in zip(keys, prints, brute_classes(prints, 2), strict=True)}
    assert {tuple(r) for r in queries.op2_simhash(spark, SF).collect()} == want


def test_op3(spark, con):
    pages = con.execute("SELECT page_id, url, html FROM pages").fetchall()
    want = set()
    for i, url, page in pages:
        inner = page.partition("<article>")[2].partition("</article>")[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n".join(p for p in parts if p)
        want.add((i, url, text, len(text)))
    assert {tuple(r) for r in queries.op3_html_text(spark, SF).collect()} == want


def test_op4(spark, texts):
    got = {r.doc_id: r for r in queries.op4_secrets(spark, SF).collect()}
    for i, t in texts.items():
        base = brute_spans(t)
        counts = collections.Counter(s.split(":")[0] for s in base.split(",") if s)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(counts[k] for k in ("assign", "access", "hex"))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(got[i].spans.split(","))


def contaminated(con, texts):
    items = [(i, decontamination.normalized(t)) for i, t in con.execute("SELECT item_id, text FROM benchmark").fetchall()]
    out = {}
    for d, t in texts.items():
        plain = f" {decontamination.normalized(t)} "
        for i, item in items:
            # A passage within the budget shares a piece of the item; without one there is no need to measure.
            k = int(len(item) * decontamination.RATE)
            if any(p in plain for p, _ in decontamination.pieces(item, k)) and (best := min(decontamination.distances(item, plain))) <= k:
                out[d, i] = best
    return out


def test_op5(spark, con, texts):
    got = {(r.doc_id, r.item_id): r.distance for r in queries.op5_decontamination(spark, SF).collect()}
    assert got == contaminated(con, texts)
    exact = {(d, i) for i, item in con.execute("SELECT item_id, text FROM benchmark").fetchall() for d, t in texts.items() if item in t}
    assert exact and exact <= set(got)


def packed(values):
    return struct.pack(f"<{len(values)}I", *values)


def test_op6(spark, texts, ids):
    want = {(i, len(e), hashlib.sha256(packed(e)).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i, e in ids.items()}
    assert {tuple(r) for r in queries.op6_bpe(spark, SF).collect()} == want


def test_op7(spark, texts):
    got = queries.op7_sharding(spark, SF).orderBy("doc_id").collect()
    assert [(r.doc_id, r.size, r.text_crc32) for r in got] == [(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()]
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(abs(sizes[s] - sum(sizes.values()) / 24) for s in range(24)) <= max(r.size for r in got)
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(24))


def test_op8(spark, ids):
    want, start = set(), 0
    for i, e in ids.items():
        want.add((i, start, len(e) + 1, zlib.crc32(packed([*e, 0]))))
        start += len(e) + 1
    assert {tuple(r) for r in queries.op8_token_files(spark, SF).collect()} == want


def test_pipeline(spark):
    """The five stages, one after another, by brute force; these tables hold secrets too."""
    folder = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    texts = dict(con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall())
    kept = {r.doc_id for r in queries.op9_quality_rules(spark, folder).collect() if r.kept}
    rows = {i: t for i, t in texts.items() if i in kept}
    assert all(len(words_of(t)) >= 10 for t in rows.values()) and len(rows) < len(texts)
    keys = list(rows)
    rows = {keys[c]: rows[keys[c]] for c in brute_classes([brute_print(t) for t in rows.values()], 2)}
    leaks = {d for d, _ in contaminated(con, rows)}
    rows = {i: t for i, t in rows.items() if i not in leaks}
    sources = dict(con.execute("SELECT doc_id, source FROM documents").fetchall())
    rules = {0: secrets.ASSIGN, 1: secrets.ACCESS, 2: secrets.HEX}
    owners = collections.defaultdict(set)
    found = collections.defaultdict(list)
    for i, t in rows.items():
        for span in filter(None, brute_spans(t).split(",")):
            kind, a, b = span.split(":")
            value = re.fullmatch(rules[secrets.KINDS.index(kind)].replace("(?i)", ""), t[int(a) : int(b)], re.I if kind == "assign" else 0)
            value = value[2] if kind == "assign" else value[0]
            owners[value].add(sources[i])
            found[i].append((int(b) - len(value), int(b), value))
    for i, spans in found.items():
        rows[i] = brute_masked(rows[i], [(a, z) for a, z, v in spans if len(owners[v]) <= secrets.MAX_OWNERS])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(rows) and any(found.values()) and leaks
    for i, t in rows.items():
        e = library.encode(t, add_special_tokens=False).ids
        assert (got[i].text, got[i].n_chars, got[i].n_tokens, bytes(got[i].ids), got[i].round_trip) == (t, len(t), len(e), packed(e), True)


def test_every_stage_takes_odd_rows_and_other_columns(spark, docs):
    odd = docs((1, None), (2, ""), (None, "the cat and the dog went to the house of a man by the river " * 2), (3, "x" * 50000), (3, "x" * 50000), (4, "a b c"))
    for frame in (odd, odd.limit(0), odd.withColumn("ids", odd.doc_id).withColumn("row", odd.text).withColumn("spans", odd.text)):
        out = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == frame.columns and out.dtypes == frame.dtypes, name
            out.collect()
        assert {"n_tokens", "ids", "round_trip"} <= set(out.columns)
