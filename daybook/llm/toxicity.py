"""Toxicity by maximum-scoring segments of token log-odds.

Training: tokens of the labelled training rows are counted by class in Spark.
The log-odds of a token between the classes carries an informative Dirichlet
prior, the token's share of both classes together, which shrinks rare tokens to
no preference; a likelihood ratio above the number of tokens tried says which
ones are sure, and copies of a text count once. A token is a word or one of
its first 4, 5 and 6 characters, so that inflected forms count together.

Scoring: every word of a whole text scores its surest feature's log-odds, all
other words a small negative value that makes the expected score of clean text
negative. A linear scan finds all maximal-scoring segments (Ruzzo and Tompa
1999). By extreme-value statistics (Karlin and Altschul 1990) a segment of score
s is expected ``K * n * exp(-lambda * s)`` times by chance in n words; lambda
solves the score distribution of clean training words, K is fitted to the best
segments of clean training texts. A text's evidence sums -log E over its
significant segments, and a logistic curve, fitted on training rows, maps it to
a score.

Only ``text`` is an input of a score. Null and empty texts have no segment and
get the curve's lowest score. With one class only, or no labelled rows, all
scores are the smoothed share of toxic rows. Rows keep their multiplicity.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.store import cut, let, place, words_of

#: Labelled rows that a model is fitted on, at most; the sample is by hash of the id.
FIT_ROWS = 120_000
#: Features a model keeps, at most, the surest first.
FEATURES = 50_000
#: Weight of the prior, in tokens, and what it gives every token beside its share.
PRIOR = 500.0
FLOOR = 0.5
#: How far a feature's log-likelihood ratio must exceed the logarithm of the number of features tried.
SURE = 2.0
#: Shingles and hashes that tell copies among training rows.
COPY_WORDS = 3
COPY_HASHES = 3
#: What a word without a sure feature scores.
STEP = -0.5
PREFIXES = (4, 5, 6)

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(word: str) -> list[str]:
    """The word itself, marked as whole, and its beginnings."""
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def segments(scores: list[tuple[int, float]], step: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``start, end, score`` of a sequence, in order.

    ``scores`` holds the positions that score above zero; every other position
    scores ``step``. Time and space are linear in the number of those positions.
    """
    # Each candidate: first and last position, total before it and at its end, and
    # the nearest earlier candidate that began lower, which spares searching those between.
    stack: list[tuple[int, int, float, float, int]] = []
    total, last = 0.0, -1
    for at, value in scores:
        left = total + step * (at - last - 1)
        total, last, start = left + value, at, at
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][3] >= total:
                break
            # It ended lower than this one does: both and all between are one segment.
            start, left = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((start, at, left, total, k))
    return [(a, b, end - left) for a, b, left, end, _ in stack]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0  # lambda
    factor: float = 0.1  # K
    slope: float = 0.0
    offset: float = 0.0
    cache: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        """The score of a word's surest feature; 0 if it has none."""
        if (w := self.cache.get(word)) is None:
            w = max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[word] = w
        return w

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """The number of words, and those that score above zero: position and score."""
        found = words(text)
        weight = self.weight
        return len(found), [(i, w) for i, word in enumerate(found) if (w := weight(word)) > 0.0]

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and all segments with their -log E, in word positions."""
        size, hits = self.hits(text)
        n = max(1, size)
        return size, [(a, b + 1, self.scale * s - math.log(self.factor * n)) for a, b, s in segments(hits, STEP)]

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        sure = [p for p in self.passages(text)[1] if p[2] > 0.0]
        return math.log1p(sum(p[2] for p in sure)), sure

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, self.offset + self.slope * evidence))))


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of every token between two classes under an informative Dirichlet prior, and its z-score."""
    both = toxic + clean
    alpha = prior * both / max(1.0, both.sum()) + FLOOR
    a, b = toxic + alpha, clean + alpha
    odds = lambda x, all_: np.log(x / np.maximum(all_ + alpha.sum() - x, FLOOR))
    delta = odds(a, toxic.sum()) - odds(b, clean.sum())
    return delta, delta / np.sqrt(1.0 / a + 1.0 / b)


def karlin_lambda(values: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E[exp(lambda * score)] = 1, at most 4, as words without any positive score have none."""
    lo, hi = 1e-6, 1.0
    total = lambda x: float((share * np.exp(np.minimum(700.0, x * values))).sum())
    while total(hi) < 1.0 and hi < 4:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) < 1.0 else (lo, mid)
    return hi


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with targets smoothed as Platt does."""
    n1, n0 = (y * weight).sum(), ((1 - y) * weight).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (weight * (t - p)) - 1e-6 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _features(text: Column) -> Column:
    """The features of every word of a text, as ``features`` names them."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return F.flatten(
        F.transform(
            found,
            lambda w: F.array_compact(
                F.array(F.concat(w, F.lit("$")), *[F.when(F.char_length(w) >= n, F.substring(w, 1, n)) for n in PREFIXES])
            ),
        )
    )


def training_rows(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = FIT_ROWS) -> DataFrame:
    """``text, y, o`` of the labelled rows: at most about ``limit``, by hash of the id where there are more.

    The sampled labels have that size bound, so they are broadcast and no text is shuffled.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull())
    known = cut(known.groupBy(F.col(doc).alias("_doc")).agg(F.max((F.col(label) > 0).cast("int")).alias("y")), "toxicity-labels")
    total = known.count()
    order = F.pmod(F.xxhash64("_doc"), F.lit(1_000_000))
    known = known.withColumn("o", order).where(F.col("o") < 1_000_000 * min(1.0, limit / max(1, total)))
    texts = docs.select(F.col(doc).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return texts.join(F.broadcast(known), "_doc").select("text", "y", "o")


def _weighted(known: DataFrame) -> DataFrame:
    """Training rows with ``weight``: one over the size of the largest group of copies a row is in.

    Rows of one class that share the least hash of their shingles, under any of
    a few hashes, are copies; a much copied text then counts as one piece of
    evidence. The rows are bounded by the sample.
    """

    def least(seed: int) -> Column:
        def of(w: Column) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(w) - COPY_WORDS + 1, F.lit(1)))
            return F.array_min(F.transform(starts, lambda i: F.xxhash64(F.lit(seed), F.slice(w, i, F.lit(COPY_WORDS)))))

        return let(words_of(F.col("text")), of)

    slim = cut(known.select("_place", "y", *[least(i).alias(f"h{i}") for i in range(COPY_HASHES)]), "toxicity-copies")
    sizes = [F.count(F.lit(1)).over(Window.partitionBy("y", f"h{i}")) for i in range(COPY_HASHES)]
    weights = slim.select("_place", (1.0 / F.greatest(*sizes)).alias("weight"))
    return known.join(F.broadcast(cut(weights, "toxicity-weights")), "_place")


def fit(known: DataFrame) -> Model:
    """A model from ``training_rows``."""
    spark = known.sparkSession
    known = cut(known.withColumn("_place", place()), "toxicity-training")
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    if not sizes.get(1) or not sizes.get(0):
        return Model(offset=math.log(share / (1 - share)))
    known = _weighted(known)
    each = known.select("y", "weight", F.explode(F.array_distinct(_features(F.col("text")))).alias("f"))
    counts = each.groupBy("f").agg(F.sum(F.col("y") * F.col("weight")).alias("toxic"), F.sum((1 - F.col("y")) * F.col("weight")).alias("clean"))
    counts = cut(counts, "toxicity-counts")
    sums = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.count(F.lit(1)).alias("n")).first()
    if sums.t and sums.c:
        # Only features that lean to the toxic class can score above zero; few are sure, and their number is bounded.
        rate = sums.t / (sums.t + sums.c)
        n = F.col("toxic") + F.col("clean")
        part = lambda x, p: F.when(x > 0, x * F.log(x / (n * p))).otherwise(0.0)
        ratio = part(F.col("toxic"), rate) + part(F.col("clean"), 1 - rate)
        sure = counts.withColumn("ratio", ratio).where((F.col("toxic") > n * rate) & (F.col("ratio") >= math.log(sums.n) + SURE))
        some = sure.orderBy(F.col("ratio").desc(), "f").limit(FEATURES).toPandas()
        t, c = some["toxic"].to_numpy(float), some["clean"].to_numpy(float)
        delta = log_odds(np.append(t, max(0.0, sums.t - t.sum())), np.append(c, max(0.0, sums.c - c.sum())))[0][:-1]
        weights = {f: float(d) for f, d in zip(some["f"], delta, strict=True) if d > 0}
    else:
        weights = {}
    model = Model(weights)
    # Texts are read once: the scores of their words, and of their segments, follow from the weights alone.
    sent = spark.sparkContext.broadcast(model)
    seen_words = "y int, weight double, n long, segments array<double>, scores array<double>, counts array<long>"
    read = cut(known.mapInPandas(_word_scores(sent), seen_words), "toxicity-segments")
    # The scores of clean words give lambda; the fit sees words, not texts.
    clean = read.where("y = 0").select(F.inline(F.arrays_zip("scores", "counts")))
    stats = clean.groupBy("scores").agg(F.sum("counts").alias("n")).toPandas()
    if len(stats):
        values, n = stats["scores"].to_numpy(float), stats["n"].to_numpy(float)
        model.scale = karlin_lambda(values, n / n.sum())
    # K from the best segment of clean texts: P(best < s) = exp(-K n exp(-lambda s)).
    best_of = lambda: read.mapInPandas(_best_segments(model.scale, model.factor), "y int, weight double, n long, best double, evidence double").toPandas()
    seen = best_of()
    none = seen[(seen["y"] == 0) & (seen["n"] > 0)]
    if len(none):
        best = none["best"].to_numpy(float)
        mean = float(np.average(none["n"].to_numpy(float) * np.exp(-model.scale * best), weights=none["weight"].to_numpy(float)))
        model.factor = min(10.0, max(1e-4, 1.0 / max(mean, 1e-9)))
    seen = best_of()
    model.slope, model.offset = logistic(seen["evidence"].to_numpy(float), seen["y"].to_numpy(float), seen["weight"].to_numpy(float))
    model.cache.clear()
    return model


def _word_scores(sent):
    """Of every text: its words, the scores of its segments, and how often each rounded word score occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            out = []
            for text, y, weight in zip(batch["text"], batch["y"], batch["weight"], strict=True):
                size, hits = model.hits(text)
                n = {STEP: size - len(hits)} if size > len(hits) else {}
                for _, w in hits:
                    w = round(w, 2) or STEP
                    n[w] = n.get(w, 0) + 1
                out.append((y, weight, size, [s for _, _, s in segments(hits, STEP)], list(n), list(n.values())))
            columns = ["y", "weight", "n", "segments", "scores", "counts"]
            yield pd.DataFrame(out, columns=columns).astype({"y": "int32", "weight": float, "n": "int64"})

    return run


def _best_segments(scale: float, factor: float):
    """The best segment of every text and its evidence, from the scores of its segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for y, weight, n, found in zip(batch["y"], batch["weight"], batch["n"], batch["segments"], strict=True):
                chance = math.log(factor * max(1, n))
                found = [scale * s - chance for s in found]
                best = max(found, default=None)
                raw = 0.0 if best is None else (best + chance) / scale
                out.append((y, weight, n, raw, math.log1p(sum(e for e in found if e > 0.0))))
            yield pd.DataFrame(out, columns=["y", "weight", "n", "best", "evidence"]).astype({"y": "int32", "weight": float, "n": "int64", "best": float, "evidence": float})

    return run


def score(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns, ``score``, ``predicted``, ``n_passages`` and ``passages`` (start and end word, evidence)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<start:int,end:int,evidence:double>>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        scores, found = [], []
        for text in texts:
            evidence, passages = model.evidence(text)
            scores.append(model.score(evidence))
            found.append([{"start": a, "end": b, "evidence": e} for a, b, e in passages])
        return pd.DataFrame({"score": scores, "passages": found})

    out = docs.select(F.struct(*carry).alias("row"), judge(F.col(text)).alias("j"))
    return out.select(
        "row.*", "j.score", (F.col("j.score") >= 0.5).cast("int").alias("predicted"), F.size("j.passages").alias("n_passages"), "j.passages"
    )
