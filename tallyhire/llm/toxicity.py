"""Toxicity: maximum-scoring segments of token log-odds, aggregated by their extreme-value statistics.

Fitting works on a bounded sample of labelled rows (``FIT_ROWS``, by hash of the id, never from the held-out fold).  A
form - a word, or the first ``STEMS`` letters of one - has as score its log-odds between toxic and clean texts under a
Dirichlet prior proportional to its share of both; it counts if it is found in significantly more, or fewer, toxic texts
than chance (a likelihood ratio over text frequencies).  A token scores by its most significant form, so inflected words
score by their stem; tokens without any share one score, that of all of them together.  In clean text the expected score
is negative, so a run of text can only reach a high total by being unlike it.

Scoring reads the whole text.  One linear scan (the algorithm of Ruzzo and Tompa) finds all maximal scoring segments,
also several in one text.  The total of the best segment of *n* clean tokens follows an extreme-value distribution with
rate ``lam`` and size factor ``k``: a segment of score *s* is expected ``k * n * exp(-lam * s)`` times by chance.  The
evidence of a text is the sum, over its significant segments, of minus the logarithm of that number, and a logistic
curve fitted on the same sample maps evidence to a score between 0 and 1.

Cases: a null or empty text has no segment and the lowest score; repeated rows get equal scores; a null doc_id is scored
and never held out; other columns are not read; without labels of both kinds every score is the smoothed rate of the
label; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyhire.llm.common import fit_rows, held_out, slices
from tallyhire.operators.settle import settled

#: Labelled rows that tokens and curve are fitted on, at most.
FIT_ROWS = 20_000
STEMS = range(3, 9)
PRIOR_TOKENS = 1000.0
LEAST_RATIO = 18.0
LEAST_TEXTS = 3
SCORE_LIMIT = 8.0
SIGNIFICANT = 0.05
THRESHOLD = 0.5
EULER = 0.5772156649
TOKEN = re.compile(r"\w+")
FLUSH_FORMS = 300_000
CACHE_WORDS = 200_000
#: Scores are counted in steps of a hundredth when their distribution in clean text is taken.
STEP = 100


def forms(word: str) -> list[str]:
    """The word and its stems; the mark keeps a stem apart from a word of the same letters."""
    return [word, *[word[:n] + "*" for n in STEMS if n <= len(word)]]


class WordScores(dict):
    """Scores of the words met so far, by the most significant of their forms."""

    def __init__(self, chosen: dict[str, tuple[float, float]], other: float | None) -> None:
        super().__init__()
        self.chosen, self.other = chosen, other

    def __missing__(self, word: str) -> float | None:
        if len(self) >= CACHE_WORDS:
            self.clear()
        known = [self.chosen[f] for f in forms(word) if f in self.chosen]
        score = self[word] = max(known)[1] if known else self.other
        return score


@dataclass(frozen=True)
class Model:
    #: form -> (significance, score)
    chosen: dict[str, tuple[float, float]] = field(default_factory=dict)
    other: float = -1.0
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    intercept: float = 0.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "words", WordScores(self.chosen, self.other))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens, and every maximal scoring segment as (first token, token after the last, score)."""
        scores = list(map(self.words.__getitem__, TOKEN.findall(text.lower())))
        return len(scores), maximal_segments(scores) if scores and max(scores) > 0 else []

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """The significant segments as (first token, token after the last, evidence)."""
        n, found = self.segments(text)
        least = -math.log(SIGNIFICANT)
        graded = [(a, b, self.lam * s - math.log(self.k * n)) for a, b, s in found]
        return [g for g in graded if g[2] >= least]

    def score(self, text: str) -> float:
        evidence = sum(e for _, _, e in self.passages(text))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * evidence + self.intercept))))


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in linear time: each candidate keeps the totals before it and at its end.

    A new positive score starts a candidate.  The nearest earlier candidate that began at a lower total is looked up
    through the links between candidates; if it also ended lower, everything from it on becomes one candidate.
    """
    total, stack = 0.0, []  # (first, after, total before, total at the end, place of the nearest lower start)
    for i, score in enumerate(scores):
        before = total
        total += score
        if score <= 0:
            continue
        first, low = i, before
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                stack.append((first, i + 1, low, total, j))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, end - start) for a, b, start, end, _ in stack]


def _count_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (form, tokens and texts by label), combined within the task before anything is shuffled."""
    words, texts = (Counter(), Counter()), (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        tokens = (Counter(), Counter())
        for label, own in enumerate(words):
            for word, n in own.items():
                for form in forms(word):
                    tokens[label][form] += n
        found = list(tokens[0].keys() | tokens[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *[
            pa.array([c.get(f, 0) for f in found], pa.int64()) for c in (tokens[1], tokens[0], texts[1], texts[0])
        ]], names=["form", "toxic", "clean", "toxic_texts", "clean_texts"])
        for c in (*words, *texts):
            c.clear()
        return out

    for batch in slices(batches):
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = TOKEN.findall((text or "").lower())
            words[label].update(own)
            texts[label].update({f for w in set(own) for f in forms(w)})
        if len(texts[0]) + len(texts[1]) > FLUSH_FORMS:
            yield flush()
    if words[0] or words[1]:
        yield flush()


def _rate(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(lam * value)) = 1, by bisection; the mean value is negative."""
    low, high = 1e-6, 1.0
    while (shares * np.exp(high * values)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (shares * np.exp(middle * values)).sum() < 1 else (low, middle)
    return (low + high) / 2


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a lightly penalised logistic curve, by Newton steps."""
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -60, 60)))
        gradient = design.T @ (y - p) - 1e-2 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w += np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return float(w[0]), float(w[1])


def fitted(documents: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out fold; nothing but counts and evidence is collected."""
    rows = fit_rows(documents, labels, "toxic", most)
    sample = settled(rows.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("r")).select("r.text", "r.label"))
    kinds = dict(sample.groupBy("label").count().collect())
    rate = (kinds.get(1, 0) + 1) / (sum(kinds.values()) + 2)
    if len(kinds) < 2:
        return Model(intercept=math.log(rate / (1 - rate)))
    counted = settled(sample.mapInArrow(
        _count_forms, "form string, toxic long, clean long, toxic_texts long, clean_texts long",
    ).groupBy("form").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_texts", "clean_texts")]))
    total = counted.where(~F.col("form").endswith("*")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    if not total["toxic"] or not total["clean"]:
        return Model(intercept=math.log(rate / (1 - rate)))

    # prior counts in proportion to a form's share of all text
    prior = PRIOR_TOKENS * (F.col("toxic") + F.col("clean")) / float(total["toxic"] + total["clean"])
    odds = [F.log((F.col(c) + prior) / (float(total[c]) + PRIOR_TOKENS - F.col(c) - prior)) for c in ("toxic", "clean")]
    share = kinds[1] / sum(kinds.values())
    texts = F.col("toxic_texts") + F.col("clean_texts")
    ratio = F.lit(0.0)
    for c, p in (("toxic_texts", share), ("clean_texts", 1 - share)):
        ratio = ratio + F.when(F.col(c) > 0, 2 * F.col(c) * F.log(F.col(c) / (texts * p))).otherwise(0.0)
    graded = counted.withColumn("delta", odds[0] - odds[1]).withColumn("ratio", ratio)
    # as many forms as are significant in the bounded sample
    picked = graded.where((F.col("ratio") >= LEAST_RATIO) & (texts >= LEAST_TEXTS)).select("form", "ratio", "delta").collect()
    chosen = {r["form"]: (r["ratio"], max(-SCORE_LIMIT, min(SCORE_LIMIT, r["delta"]))) for r in picked}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = WordScores(chosen, None), Counter()
        for batch in slices(batches):
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((None if s is None else round(s * STEP), label)
                            for s in map(own.__getitem__, TOKEN.findall((text or "").lower())))
        step, label = zip(*seen) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(step, pa.int64()), pa.array(label, pa.int32()),
                                          pa.array(list(seen.values()), pa.int64())], names=["step", "label", "n"])

    by_step = sample.mapInArrow(spread, "step long, label int, n long").groupBy("step", "label").agg(F.sum("n").alias("n")).collect()
    left = {r["label"]: r["n"] for r in by_step if r["step"] is None}
    shared = math.log((left.get(1, 0) + 1) / (total["toxic"] + 1)) - math.log((left.get(0, 0) + 1) / (total["clean"] + 1))
    other = min(shared, -0.05)
    clean = [(other if r["step"] is None else r["step"] / STEP, r["n"]) for r in by_step if not r["label"]]
    values = np.array([v for v, _ in clean] + [SCORE_LIMIT])
    shares = np.array([n for _, n in clean] + [0.5], float)
    shares /= shares.sum()
    # a mean that is not negative has no rate; every score is then lowered until it is
    drift = max(0.0, float((shares * values).sum()) + 0.02)
    if drift:
        chosen = {f: (r, s - drift) for f, (r, s) in chosen.items()}
        other, values = other - drift, values - drift
    lam = _rate(values, shares)
    model = Model(chosen, other, lam)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.segments(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([n for n, _ in found], pa.int64()),
                pa.array([[s for _, _, s in segments] for _, segments in found], pa.list_(pa.float64())), batch.column(1),
            ], names=["n", "scores", "label"])

    seen = sample.mapInArrow(best, "n long, scores array<double>, label int").toArrow().to_pylist()
    top = [lam * max(s["scores"], default=0.0) - math.log(s["n"]) for s in seen if s["n"] and not s["label"]]
    k = math.exp(np.mean(top) - EULER) if top else 1.0
    model = Model(chosen, other, lam, k)
    least = -math.log(SIGNIFICANT)
    evidence = np.array([sum(e for e in (lam * x - math.log(k * s["n"]) for x in s["scores"]) if e >= least) for s in seen])
    slope, intercept = _curve(evidence, np.array([s["label"] for s in seen], float))
    return Model(chosen, other, lam, k, max(slope, 0.0), intercept)


def scored(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every row; passages are (first token, token after, evidence)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            found = [model.passages(t) for t in texts]
            evidence = np.array([sum(e for _, _, e in f) for f in found])
            score = 1 / (1 + np.exp(-np.clip(model.slope * evidence + model.intercept, -60, 60)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                pa.array([[{"first": a, "after": b, "evidence": e} for a, b, e in f] for f in found], pa.list_(pa.struct(
                    [("first", pa.int32()), ("after", pa.int32()), ("evidence", pa.float64())]))),
            ], names=["doc_id", "held_out", "score", "predicted", "passages"])

    kind = documents.select("doc_id").schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double, predicted int, "
             "passages array<struct<first:int,after:int,evidence:double>>")
