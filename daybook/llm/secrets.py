"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

One projection finds the candidates of a text with their offsets: the three
base kinds (assignments, access key ids, long hex runs) and ``owned``, tokens of
mixed upper case, lower case and digits. Candidate hashes are aggregated by
distinct repositories and owners over the whole corpus: a value seen with at
most ``max_owners`` owners and ``max_repos`` repositories is a live-looking
credential, one that many owners share is a copied example. Base spans are
always reported; ``owned`` spans only if they are live-looking.

Hashes are counted by partial aggregates, first by (hash, owner, repository),
so a value in a third of all rows costs a row per task; the verdicts come from
a written table, so joining them back can split such a value. Only candidates
are shuffled, never texts.

Null text is empty, null owners and repositories are one owner and repository
named "". Texts without candidates, empty and blank ones have no spans. Equal
rows are found and reported alike and count as one repository. Offsets are code
points, ends exclusive. Time is linear in the text, also with many matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.store import cut, let, place

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a least length in the pattern finds what a later length check would keep.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OWNED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}"
CHUNK = 256
MAX_OWNERS = 1
MAX_REPOS = 2
MASK = "[secret]"


def running_sums(values: Column) -> Column:
    """Sums of all values before each one, in chunks: linear in practice where one fold would copy its result each step."""

    def fold(v: Column) -> Column:
        start = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("a"))
        step = lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"])).alias("a"))
        return F.aggregate(v, start, step)

    def chunked(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(CHUNK))
        parts = F.transform(starts, lambda i: fold(F.slice(v, i, F.lit(CHUNK))))

        def joined(p: Column) -> Column:
            base = fold(F.transform(p, lambda x: x["s"]))["a"]
            return F.flatten(F.zip_with(p, base, lambda x, b: F.transform(x["a"], lambda s: s + b)))

        return let(parts, joined)

    return let(values, chunked)


def _empty() -> Column:
    return F.array().cast("array<struct<kind:int,start:int,end:int,value:string>>")


def matches(text: Column, pattern: str, kind: int, group: int = 0, likely: Column | None = None) -> Column:
    """``kind, start, end, value`` of the leftmost matches that don't overlap."""

    def placed(parts: Column) -> Column:
        gaps = F.transform(parts["gaps"], lambda x: F.char_length(x))
        sizes = F.transform(parts["all"], lambda x: F.char_length(x))
        before = F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), sizes, lambda g, s: g + s)

        def spans(b: Column) -> Column:
            return F.transform(
                b["before"],
                lambda x, i: F.struct(
                    F.lit(kind).alias("kind"),
                    (x + F.get(b["gaps"], i)).alias("start"),
                    (x + F.get(b["gaps"], i) + F.get(b["sizes"], i)).alias("end"),
                    F.get(parts["values"], i).alias("value"),
                ),
            )

        return let(F.struct(running_sums(before).alias("before"), gaps.alias("gaps"), sizes.alias("sizes")), spans)

    found = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
    )
    hit = text.rlike(pattern) if likely is None else likely & text.rlike(pattern)
    return F.when(hit, let(found, placed)).otherwise(_empty())


def candidates(text: Column) -> Column:
    """All candidates of a text by start, then kind."""
    body = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        assign = F.filter(matches(t, ASSIGN, 0, 2), lambda m: F.char_length(m["value"]) >= 6)
        base = F.concat(assign, matches(t, ACCESS, 1, likely=t.contains("AKIA")), matches(t, HEX, 2))
        mixed = lambda m: m["value"].rlike("[a-z]") & m["value"].rlike("[A-Z]") & m["value"].rlike("[0-9]")
        owned = F.filter(matches(t, OWNED, 3), mixed)

        def both(b: Column) -> Column:
            ends = F.transform(b, lambda m: m["end"])
            return F.concat(b, let(ends, lambda e: F.filter(owned, lambda m: ~F.array_contains(e, m["end"]))))

        ordered = lambda c: F.array_sort(F.transform(c, lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), m["value"].alias("value"))))
        return ordered(let(base, both))

    return let(body, of)


def ownership(found: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """``hash, n_repos, n_owners, live`` of every candidate value, from rows ``hash, owner, repo``."""
    seen = found.groupBy("hash", "owner", "repo").count()
    counted = seen.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    out = counted.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))
    return out.withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def scan(docs: DataFrame, carry: dict[str, Column], text: str = "text", owner: Column | None = None, repo: Column | None = None, **limits: int) -> DataFrame:
    """The carried columns and ``spans`` of every row.

    A span has ``start, kind, end, value, n_repos, n_owners, live``; spans are
    sorted by start, then kind. ``owner`` is ``source`` unless given, ``repo``
    the owner and the language.
    """
    owner = F.coalesce(owner if owner is not None else F.col("source"), F.lit(""))
    repo = repo if repo is not None else F.concat_ws("/", owner, F.col("lang"))
    own = F.struct(*[c.alias(n) for n, c in carry.items()]).alias("row")
    found = docs.select(own, candidates(F.col(text)).alias("found"), owner.alias("owner"), F.coalesce(repo, F.lit("")).alias("repo"), place().alias("_place"))
    found = cut(found, "secret-candidates")
    each = found.where(F.size("found") > 0).select("_place", "owner", "repo", F.explode("found").alias("m"))
    each = each.withColumn("hash", F.sha2(F.col("m.value"), 256))
    verdict = cut(ownership(each, **limits), "secret-ownership")
    judged = each.join(verdict, "hash").where((F.col("m.kind") < 3) | F.col("live"))
    span = F.struct("m.start", "m.kind", "m.end", "m.value", "n_repos", "n_owners", "live")
    spans = judged.groupBy("_place").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    out = found.select("row", "_place").join(cut(spans, "secret-spans"), "_place", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,n_repos:bigint,n_owners:bigint,live:boolean>>")
    return out.select("row.*", F.coalesce("spans", none).alias("spans"))


def kind_name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"], s["end"])), ",")


#: Values of letters of one case only, or of digits only, are words or numbers that may stand elsewhere by chance.
_PLAIN = r"^(?:[a-z]+|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)$"
#: A value elsewhere in its text counts where no character beside it could belong to it.
_EDGE = r"[A-Za-z0-9+/_=-]"


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """``text`` with the values of ``spans`` masked where they stand, and distinctive ones wherever else they stand alone.

    A value is the end of its span. Overlapping values share one mask. A value that is a plain word or
    number is masked at its span only.
    """
    places = F.array_sort(F.transform(spans, lambda s: F.struct((s["end"] - F.char_length(s["value"])).alias("a"), s["end"].alias("z"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, p: Column) -> Column:
        between = F.substr(text, done["at"] + 1, p["a"] - done["at"])
        fresh = F.concat(done["out"], F.array(between, F.lit(mask)))
        return F.struct(F.greatest(done["at"], p["z"]).alias("at"), F.when(p["a"] >= done["at"], fresh).otherwise(done["out"]).alias("out"))

    def rest(done: Column) -> Column:
        return F.concat(F.array_join(done["out"], ""), F.substr(text, done["at"] + 1, F.char_length(text)))

    values = F.filter(F.array_distinct(F.transform(spans, lambda s: s["value"])), lambda v: ~v.rlike(_PLAIN))
    longest = F.array_sort(F.transform(values, lambda v: F.struct((-F.char_length(v)).alias("n"), v.alias("v"))))
    alone = lambda v: F.concat(F.lit(f"(?<!{_EDGE})\\Q"), v, F.lit(f"\\E(?!{_EDGE})"))
    elsewhere = lambda t, v: F.when(F.contains(t, v["v"]), F.regexp_replace(t, alone(v["v"]), F.lit(mask))).otherwise(t)
    return F.aggregate(longest, F.aggregate(places, start, step, rest), elsewhere)


def redact(docs: DataFrame, text: str = "text", chars: str | None = "n_chars", mask: str = MASK, **options) -> DataFrame:
    """``docs`` with every live-looking value masked in its text (see ``masked``); ``chars`` is counted anew."""
    carry = {"_row": F.struct(*docs.columns)}
    out = scan(docs, carry, text, **options)
    live = F.filter("spans", lambda s: s["live"])
    clean = F.when(F.exists("spans", lambda s: s["live"]), masked(F.col(f"_row.{text}"), live, mask)).otherwise(F.col(f"_row.{text}"))
    out = out.select("_row", clean.alias("_text"))
    new = {text: F.col("_text")} | ({chars: F.char_length("_text").cast(docs.schema[chars].dataType)} if chars in docs.columns else {})
    # An unchanged text keeps its own count.
    same = F.col("_text").eqNullSafe(F.col(f"_row.{text}"))
    return out.select(*[F.when(same, F.col(f"_row.`{c}`")).otherwise(new[c]).alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
