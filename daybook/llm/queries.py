"""The registered queries of the operators and the SQL that checks them.

Each query reads whole tables, applies its operator with production settings and
derives the columns it returns from the operator's own output.
"""

from __future__ import annotations

import functools
import string

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import bpe, collocations, decontamination, html_text, merkle, patricia, quality_rules, secrets, sharding, simhash, token_files, toxicity, warc
from daybook.llm.store import prepare

SHARDS = 24
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def vocabulary(name: str = TOKENIZER) -> bpe.Vocabulary:
    return bpe.Vocabulary(public_tokenizers.path(name))


def held_out(doc: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc.cast("string"), F.lit(""))), F.lit(5)) == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), {"doc_id": F.col("doc_id")})
    base = F.filter("spans", lambda s: s["kind"] < 3)
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[of(i).alias(f"n_{k}") for i, k in enumerate(secrets.KINDS[:3])],
        F.sha2(secrets.as_text(base), 256).alias("base_sha256"),
        secrets.as_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), ["doc_id"], decoded="decoded")
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = sharding.assign(docs, "doc_id", F.octet_length(text) + 8, SHARDS, {"text_crc32": F.crc32(text)})
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write(table(spark, sf_dir, "documents"), vocabulary())
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *names)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, archive = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, path, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patricia.owners(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    found = merkle.manifest(docs, {"text": F.when(picked, lowered).otherwise(F.col("text"))})
    return found.drop("path")


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_simhash, op3_html_text, op4_secrets, op5_decontamination, op6_bpe, op7_sharding, op8_token_files,
        op9_quality_rules, op10_warc, op11_exact_dedup, op12_collocations, op13_merkle,
    )
}


def _rule_sql(row: quality_rules.Threshold) -> str:
    value, scale = (f"100 * {row.part}", row.whole) if row.whole else (row.part, "1")
    broken = [f"{value} < {row.at_least} * {scale}"] if row.at_least is not None else []
    broken += [f"{value} > {row.at_most} * {scale}"] if row.at_most is not None else []
    return f"(({' OR '.join(broken)}) AND n_words >= {row.from_words})"


_QUALITY = rf"""
WITH w AS (
  SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS words FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_alpha_words,
         len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{{L}}]+'), lambda x: x IN ({", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)})))::BIGINT AS n_stop_words,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\t]*[-*•‣·][\x20\t]')))::BIGINT AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\t\r]*$')))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN covered USING (doc_id)),
j AS (SELECT *, {" OR ".join(map(_rule_sql, quality_rules.BASE))} AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {" OR ".join(map(_rule_sql, quality_rules.THRESHOLDS))}) AS kept
FROM j"""

_WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= {warc.LEAST} THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS response FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to, TRUE AS intact
FROM r"""

_EXACT = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)"""

_PHRASES = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, k, ws[i:i + k - 1] AS ph FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, {collocations.LONGEST + 1}) r(k))),
f AS (SELECT lang, ph, k, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {collocations.MIN_COUNT}),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY 1),
inner_ AS (SELECT lang, a, k, m, unnest(range(1, k - m + 2)) AS i, ph FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)),
covered AS (SELECT lang, ph[i:i + m - 1] AS ph, max(a) AS longer FROM inner_ GROUP BY ALL),
c AS (SELECT f.lang, f.ph, f.k, f.a FROM f LEFT JOIN covered USING (lang, ph) WHERE f.k > 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
h AS (SELECT lang, ph, a, j, ph[1:j] AS x, ph[j + 1:] AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT h.lang, h.ph, h.a, h.j, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * h.a * n.n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM h JOIN f l ON l.lang = h.lang AND l.ph = h.x JOIN f r ON r.lang = h.lang AND r.ph = h.y JOIN n ON n.lang = h.lang),
b AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= {collocations.BEST}"""

# CRC-32 over the bytes of a text, with its table built by the rule of the polynomial; then cuts of the byte line.
_CRC_TABLE = """
  SELECT list(c ORDER BY n) AS tab FROM (
    SELECT n, list_reduce([n] || list_transform(range(8), lambda k: 0::BIGINT),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c
    FROM range(256) AS r(n))"""
_SHARDS = f"""
WITH crc AS ({_CRC_TABLE}),
d AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 8)::BIGINT AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
c AS (
  SELECT doc_id, size, xor(list_reduce([4294967295::BIGINT] || bytes, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, crc),
s AS (SELECT *, least({SHARDS - 1}, (2 * sum(size) OVER (ORDER BY doc_id) - size) * {SHARDS} // (2 * sum(size) OVER ()))::INT AS shard FROM c)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot,
       NULL::INT AS grown_shard
FROM s"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches_sql(kind: int, pattern: str, group: int) -> str:
    p = _quoted(pattern)
    return f"SELECT doc_id, owner, repo, {kind} AS kind, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS found, regexp_extract_all(t, {p}, {group}) AS vals FROM d"


# Runs are maximal without a look behind them, which this engine's patterns lack.
_RULES = ((secrets.ASSIGN, 2), (secrets.ACCESS, 0), (secrets.HEX, 0), (secrets.OWNED.partition(")")[2], 0))
_SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', coalesce(source, ''), lang) AS repo FROM documents),
m AS ({" UNION ALL ".join(_matches_sql(k, *rule) for k, rule in enumerate(_RULES))}),
e AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM m),
s AS (
  SELECT doc_id, owner, repo, kind, vals[k] AS value, length(found[k]) AS size,
         list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS a
  FROM e),
base AS (SELECT *, a + size AS z FROM s WHERE kind < 3 AND (kind > 0 OR length(value) >= 6)),
own AS (
  SELECT *, a + size AS z FROM s WHERE kind = 3 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id IS NOT DISTINCT FROM s.doc_id AND base.a + base.size = s.a + s.size)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM own),
owners AS (SELECT value, count(DISTINCT owner) AS n_owners, count(DISTINCT (owner, repo)) AS n_repos FROM spans GROUP BY 1),
kept AS (
  SELECT *, n_owners <= {secrets.MAX_OWNERS} AND n_repos <= {secrets.MAX_REPOS} AS live,
         ({list(secrets.KINDS)!r})[kind + 1] || ':' || a::BIGINT || ':' || z::BIGINT AS shown
  FROM spans JOIN owners USING (value) WHERE kind < 3 OR (n_owners <= {secrets.MAX_OWNERS} AND n_repos <= {secrets.MAX_REPOS})),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg(shown, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, string_agg(shown, ',' ORDER BY a, kind) AS spans,
         count(*) FILTER (WHERE live) AS n_live
  FROM kept GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g USING (doc_id)"""


def _levels_sql(nodes: str, name: str, tree: str, heights: int) -> str:
    """Common tables of ``heights`` levels above ``nodes`` (tree, pos, n, h): runs of siblings, and the parents they make."""
    out = []
    for k in range(heights):
        below = f"{name}{k - 1}" if k else nodes
        out.append(f"{name}run{k} AS (SELECT {tree}, pos // {merkle.FANOUT} AS pos, min(n) AS n, list(h ORDER BY pos) AS hs FROM {below} GROUP BY 1, 2)")
        out.append(
            f"{name}{k} AS (SELECT {tree}, pos, CASE WHEN n > 1 THEN (n + {merkle.FANOUT - 1}) // {merkle.FANOUT} ELSE 1 END AS n, "
            f"CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}run{k})"
        )
    return ", ".join(out)


def _path_sql(name: str, tree: str, heights: int) -> tuple[str, str, str]:
    """Joins that lead from a node's ``pos`` upwards, its siblings in a row, and the fold of ``acc``."""
    joins, beside, acc = "", [], "altered"
    for k in range(heights):
        run, slot = f"{name}run{k}", f"(c.pos // {merkle.FANOUT**k} % {merkle.FANOUT})"
        joins += f" JOIN {run} ON {run}.{tree} = c.{tree} AND {run}.pos = c.pos // {merkle.FANOUT ** (k + 1)}"
        left, right = f"array_to_string({run}.hs[1:{slot}], '')", f"array_to_string({run}.hs[{slot} + 2:], '')"
        beside += [left, right]
        acc = f"CASE WHEN {run}.n > 1 THEN sha256({left} || {acc} || {right}) ELSE {acc} END"
    return joins, " || ".join(beside), acc


# Enough levels for 16 million documents of a source, and for 65,000 sources.
_HEIGHT, _STEM = 6, 4


def _merkle_sql() -> str:
    part = lambda c, size: f"CASE WHEN {c} IS NULL THEN '-' ELSE {size} || ':' || {c} END"
    plain = [part(f"{c}::VARCHAR", f"strlen({c}::VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")]
    whole = lambda text: "sha256(" + " || ".join([*plain, part(text, f"strlen({text})")]) + ")"
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    up, beside, acc = _path_sql("tree", "tree", _HEIGHT)
    up2, beside2, acc2 = _path_sql("stem", "tree", _STEM)
    return f"""
WITH crc AS ({_CRC_TABLE}),
d AS (
  SELECT *, coalesce('1' || source, '0') AS tree,
         list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
p AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || bytes, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) % 5 = 0 AS picked FROM d, crc),
e AS (SELECT doc_id, tree, {whole("text")} AS h, CASE WHEN picked THEN {whole(lowered)} ELSE {whole("text")} END AS altered FROM p),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM e),
{_levels_sql("leaves", "tree", "tree", _HEIGHT)},
stems AS (SELECT tree AS source_key, 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h FROM tree{_HEIGHT - 1}),
{_levels_sql("stems", "stem", "tree", _STEM)},
lower AS (SELECT c.*, {beside} AS beside, {acc} AS acc FROM leaves c{up}),
upper AS (SELECT l.doc_id, l.h AS leaf, l.beside, l.acc AS altered, s.pos, s.tree, s.h AS subroot FROM lower l JOIN stems s ON s.source_key = l.tree)
SELECT c.doc_id, leaf, subroot, root.h AS root, sha256(beside || {beside2}) AS proof_sha256, {acc2} AS folded_root, {acc2} = root.h AS verified
FROM upper c{up2}, stem{_STEM - 1} root"""


ORACLES = {"op4_secrets": _SECRETS, "op7_sharding": _SHARDS, "op9_quality_rules": _QUALITY, "op10_warc": _WARC, "op11_exact_dedup": _EXACT, "op12_collocations": _PHRASES, "op13_merkle": _merkle_sql()}
