"""Quality rules: a threshold table compiled into one Spark projection.

``THRESHOLDS`` is the whole configuration: a row bounds one ratio of two
measures. ``judge`` turns the rows into boolean columns over measures that are
built-in functions of the text, so the whole filter is a single map stage
without user functions, shuffles or state.

Null text counts as empty. Empty and blank texts have no words and fail
``few_words``. Equal rows get equal answers, ids and other columns are not
read. ``judge`` puts its columns in place of columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.store import let, words_of

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"

#: Common function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "as", "was", "on", "are", "be", "at", "by", "this", "from", "or", "an",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "für", "ein", "eine", "auf", "des", "im", "dem", "nicht", "auch", "als",
    "le", "la", "les", "de", "du", "et", "un", "une", "en", "que", "qui", "est", "pour", "dans", "au", "sur", "par", "pas", "avec",
    "el", "los", "las", "y", "del", "por", "con", "su", "se", "no", "lo", "para",
)


@dataclass(frozen=True)
class Threshold:
    """``at_least <= 100 * part / whole <= at_most`` in percent, for texts of ``from_words`` words or more.

    A bound of None is open. With ``whole`` None the measure itself is bounded.
    """

    name: str
    part: str
    whole: str | None = None
    at_least: int | None = None
    at_most: int | None = None
    from_words: int = 0

    def broken(self, measures: Column) -> Column:
        value = measures[self.part] * (100 if self.whole else 1)
        scale = measures[self.whole] if self.whole else F.lit(1)
        out = F.lit(False)
        if self.at_least is not None:
            out = out | (value < scale * self.at_least)
        if self.at_most is not None:
            out = out | (value > scale * self.at_most)
        return out & (measures["n_words"] >= self.from_words) if self.from_words else out


BASE = (
    Threshold("few_words", "n_words", at_least=10),
    Threshold("repeated_passages", "n_repeat_words", "n_words", at_most=20),
)

THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", at_least=200, at_most=1200),
    Threshold("symbols", "n_symbols", "n_words", at_most=10),
    Threshold("wordless_tokens", "n_alpha_words", "n_words", at_least=50),
    Threshold("stop_words", "n_stop_words", "n_words", at_least=2, from_words=100),
    Threshold("duplicate_lines", "n_dup_lines", "n_lines", at_most=70),
    Threshold("bullet_lines", "n_bullet_lines", "n_lines", at_most=90),
    Threshold("ellipsis_lines", "n_ellipsis_lines", "n_lines", at_most=30),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more, the first finding included.

    Windows are compared by a chained 64-bit hash of their words. The sort by
    hash only runs for texts in which two windows agree, and costs n log n.
    """

    def covered(at: Column) -> Column:
        # Each window adds the words up to the next one's start; the last adds all of its own.
        steps = F.transform(
            F.sequence(F.lit(1), F.size(at) - 1),
            lambda i: F.least(F.lit(window), F.element_at(at, i + 1) - F.element_at(at, i)),
        )
        return F.when(F.size(at) < 1, F.lit(0)).otherwise(
            F.lit(window) + F.when(F.size(at) < 2, F.lit(0)).otherwise(F.aggregate(steps, F.lit(0), lambda a, x: a + x))
        )

    def places(sorted_: Column) -> Column:
        def twin(i: Column, other: Column) -> Column:
            return F.coalesce(F.get(sorted_, i)["h"] == F.get(sorted_, other)["h"], F.lit(False))

        index = F.sequence(F.lit(0), F.size(sorted_) - 1)
        kept = F.filter(index, lambda i: twin(i, i - 1) | twin(i, i + 1))
        return F.array_sort(F.transform(kept, lambda i: F.get(sorted_, i)["i"]))

    def of_hashes(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(ranked, lambda s: let(places(s), covered))
        )

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - window + 1)
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, F.lit(window)))), of_hashes)

    return let(words, lambda w: F.when(F.size(w) <= window, F.lit(0)).otherwise(of_words(w)))


def measures(text: Column) -> Column:
    """A struct of the LONG measures that ``THRESHOLDS`` may name."""
    body = F.coalesce(text, F.lit(""))
    long = lambda name, value: value.cast("long").alias(name)

    def of_words(w: Column) -> Column:
        return F.struct(long("n_words", F.size(w)), long("chars", F.char_length(F.array_join(w, ""))), long("repeats", repeated_words(w)))

    def of_lines(x: Column) -> Column:
        return F.struct(
            long("n", F.size(x)),
            long("dup", F.size(x) - F.size(F.array_distinct(x))),
            long("bullet", F.size(F.filter(x, lambda y: y.rlike(r"^[\x20\t]*[-*•‣·][\x20\t]")))),
            long("ellipsis", F.size(F.filter(x, lambda y: y.rlike(r"(\.\.\.|…)[\x20\t\r]*$")))),
        )

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.char_length(F.regexp_replace(body, SYMBOLS.replace("[", "[^") + "+", ""))
    # A match starts at a word's first letter and ends with the word, so there is one for each word with a letter.
    alpha = F.regexp_count(body, F.lit(r"\p{L}[^\x20\x09-\x0D]*"))
    stops = let(F.split(F.lower(body), r"[^\p{L}]+"), lambda w: F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))))
    parts = F.struct(let(words_of(text), of_words).alias("w"), let(lines, of_lines).alias("l"))
    return let(
        parts,
        lambda p: F.struct(
            p["w"]["n_words"].alias("n_words"),
            p["w"]["chars"].alias("word_chars"),
            long("n_symbols", symbols),
            p["l"]["dup"].alias("n_dup_lines"),
            p["w"]["repeats"].alias("n_repeat_words"),
            p["l"]["n"].alias("n_lines"),
            p["l"]["bullet"].alias("n_bullet_lines"),
            p["l"]["ellipsis"].alias("n_ellipsis_lines"),
            long("n_alpha_words", alpha),
            long("n_stop_words", stops),
        ),
    )


def verdict(text: Column, thresholds: tuple[Threshold, ...] = THRESHOLDS) -> Column:
    """A struct of all measures, ``base_failed``, ``failed_rules`` (names, in table order) and ``kept``.

    It is one expression that evaluates each measure once, so a filter on it can
    be pushed through projections without repeating the work.
    """

    def judged(m: Column) -> Column:
        base = F.lit(False)
        for row in BASE:
            base = base | row.broken(m)
        failed = F.array_compact(F.array(*[F.when(row.broken(m), F.lit(row.name)) for row in (*BASE, *thresholds)]))
        return F.struct(m.alias("m"), base.alias("base_failed"), failed.alias("failed_rules"), (F.size(failed) == 0).alias("kept"))

    return let(measures(text), judged)


def judge(df: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows with all measures, ``base_failed``, ``failed_rules`` and ``kept``, in place of columns of these names."""
    found = df.withColumn("_verdict", verdict(F.col(text), thresholds))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "n_alpha_words", "n_stop_words")
    columns = {n: F.col(f"_verdict.m.{n}") for n in names} | {n: F.col(f"_verdict.{n}") for n in ("base_failed", "failed_rules", "kept")}
    return found.withColumns(columns).drop("_verdict")


def keep_good(df: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS) -> DataFrame:
    """The rows that break no rule, with the columns of ``df``."""
    return df.where(verdict(F.col(text), thresholds)["kept"])
