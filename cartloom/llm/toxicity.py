"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values.

Tokens are words and their first letters (4 to 6), so that an inflected word has the evidence of its
stem. The log-odds of a token's presence in labelled toxic and clean documents, under an informative
Dirichlet prior, are its score where they are significant, for either label; all other tokens share
one small negative score. A linear scan gives all maximal segments of a document (Ruzzo and Tompa). A
segment's score S among n tokens has an expected number of equal or better chance segments
E = K n exp(-lambda S), with lambda the root of the clean scores' moment equation (Karlin and
Altschul) and K from the number of high segments in clean documents. The evidence of a document is
the sum of -ln E over its significant segments; a logistic curve of its logarithm makes it a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartloom.llm.common import written

WORD = re.compile(r"[^\W_]+")
STEMS = (4, 5, 6)
#: The prior's weight in documents, and what a token needs: z score, log-odds.
PRIOR, LEAST_Z, LEAST_ODDS = 50.0, 3.0, 1.5
#: Labelled documents for the calibration.
FIT_DOCS = 30_000
#: Up to so many rows of labels (two numbers each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
LEAST_E = 0.05


@dataclass
class Model:
    tokens: dict[str, float] = field(default_factory=dict)
    other: float = -0.01
    decay: float = 1.0  # lambda
    factor: float = 0.1  # K
    weights: tuple[float, float] = (-3.0, 0.0)


def stems(word: str) -> set[str]:
    return {word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)}


class WordScores(dict):
    """A word's score: its tokens' largest one above 0, else their least; 0 for others. Remembers words."""

    def __init__(self, tokens: dict[str, float]):
        self.tokens = tokens

    def __missing__(self, word: str) -> float:
        got = [self.tokens[x] for x in stems(word) if x in self.tokens]
        if len(self) > 1_000_000:
            self.clear()
        best = max(got, default=0.0)
        self[word] = x = best if best > 0 else min(got, default=0.0)
        return x


def hits(text: str, scores: WordScores) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, and the places and scores of those that have one."""
    words = WORD.findall(text.lower())
    each = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    at = np.flatnonzero(each)
    return len(words), at, each[at]


def maximal_segments(places: np.ndarray, scores: np.ndarray, other: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first place, last place) in linear time.

    They start and end at scores above 0. Between two places with scores all tokens score other (below 0), so only the places are walked.
    """
    found: list[list] = []  # [sum before, sum after, first, last]
    total, last = 0.0, None
    for place, score in zip(places.tolist(), scores.tolist(), strict=True):
        total += other * (place - last - 1 if last is not None else place)
        last = place
        new = [total, total + score, place, place]
        total += score
        if score <= 0:
            continue
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j -= 1
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(b - a, i, j) for a, b, i, j in found]


def root_decay(scores: np.ndarray, rates: np.ndarray, other: float) -> float:
    """lambda > 0 with sum(rate * exp(lambda * score)) = 1, the rest of the rate at other."""
    rest = 1 - rates.sum()

    def f(x: float) -> float:
        return float((rates * np.exp(np.minimum(x * scores, 700))).sum() + rest * math.exp(x * other) - 1)

    low, high = 0.0, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(low, 1e-3)


def significant(n: int, segments: list[tuple[float, int, int]], model: Model) -> list[tuple[int, int, float, float]]:
    """The significant segments: first word, last word, score and -ln E."""
    each = [(i, j, s, model.decay * s - math.log(model.factor * max(n, 1))) for s, i, j in segments]
    return [x for x in each if x[3] >= -math.log(LEAST_E)]


def tail_factor(scores: np.ndarray, counts: np.ndarray, words: int, decay: float) -> float:
    """K, such that K words exp(-decay S) segments of clean words have a score of S or more; S is that of their highest tenth."""
    if not counts.sum():
        return 0.1
    order = np.argsort(-scores)
    above = np.cumsum(counts[order])
    at = int(np.searchsorted(above, counts.sum() / 10))
    return float(np.clip(above[at] / max(words, 1) * np.exp(min(decay * scores[order][at], 50.0)), 1e-3, 10.0))


def evidence(good: list[tuple[int, int, float, float]]) -> float:
    """The sum of -ln E of the significant segments."""
    return sum(x for *_, x in good)


def weight(evidence: float) -> float:
    """What the logistic curve takes of an evidence: it grows without end, so stronger evidence never ties, but long texts don't pull the fit."""
    return math.log1p(evidence)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weights of sigmoid(a + b x), by Newton steps with a little ridge."""
    w = np.array([-2.0, 0.1])
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - 1e-2 * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows (doc_id, toxic 0 or 1) of documents (doc_id, text).

    Counts cover all labelled rows, a text that is found more than once counting once. All tokens that
    are significant for a label are in the model; it is calibrated on FIT_DOCS labelled documents, those
    with the least hash, of which the driver gets sums and a row of four numbers each. Without toxic or
    without clean rows nothing is toxic.
    """
    rows = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    small = rows.count() <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda x: x)
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    first = texts.select("doc_id", F.xxhash64("text").alias("h")).join(near(rows), "doc_id").groupBy("h").agg(F.min(F.struct("doc_id", "toxic")).alias("r"))
    chosen = written(first.select("r.doc_id", "r.toxic"), "toxicity-rows")
    sizes = {r.toxic: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(weights=(-3.0, 0.0))
    # a row for each labelled document, so as small as labels; repeated rows of a doc_id count again
    labelled = texts.join(near(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            got = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["token", "n1", "n0"])
            toxic.clear()
            clean.clear()
            return got

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (toxic if label == 1 else clean).update(set().union(*map(stems, set(WORD.findall(text.lower())))))
            if len(toxic) + len(clean) > 400_000:
                yield out()
        yield out()

    counts = labelled.mapInArrow(count, "token string, n1 long, n0 long").groupBy("token").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    a = F.lit(PRIOR / (n1 + n0)) * (F.col("n1") + F.col("n0"))
    odds = F.log((F.col("n1") + a) / (n1 + PRIOR - F.col("n1") - a)) - F.log((F.col("n0") + a) / (n0 + PRIOR - F.col("n0") - a))
    z = odds / F.sqrt(1 / (F.col("n1") + a) + 1 / (F.col("n0") + a))
    rated = counts.select("token", odds.alias("odds"), z.alias("z"))
    toxic_sign = (F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)
    clean_sign = F.col("z") <= -LEAST_Z
    model = Model({r.token: r.odds for r in rated.filter(toxic_sign | clean_sign).select("token", "odds").toLocalIterator()})

    tokens = model.tokens

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(tokens)
        for batch in batches:
            got = [hits(t, scores) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int32()), pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.list_(pa.int64())), pa.array([x[2] for x in got], pa.list_(pa.float64()))],
                ["toxic", "n", "at", "score"],
            )

    sample = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_DOCS)
    one_each = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    found = written(one_each.mapInArrow(find, "toxic int, n long, at array<long>, score array<double>"), "toxicity-hits")
    sums = {r.toxic: r for r in found.groupBy("toxic").agg(F.sum("n").alias("words"), F.sum(F.size("at")).alias("hits")).collect()}
    words = {y: sums[y].words or 0 if y in sums else 0 for y in (0, 1)}
    rate = {y: ((sums[y].hits or 0 if y in sums else 0) + 0.5) / (words[y] + 1) for y in (0, 1)}
    model.other = min(-1e-3, math.log((1 - min(rate[1], 0.5)) / (1 - min(rate[0], 0.5))))
    clean = found.filter("toxic = 0")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen.update(dict(zip(*(x.tolist() for x in np.unique(batch.column("score").flatten().to_numpy(), return_counts=True)), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.float64()), pa.array(list(seen.values()), pa.int64())], ["s", "n"])

    # a task passes on how often it has each score, of which there are no more than tokens
    chance = {r.s: r.n for r in clean.select("score").mapInArrow(tally, "s double, n long").groupBy(F.round("s", 2).alias("s")).agg(F.sum("n").alias("n")).collect()}
    typical = sorted(set(round(s, 2) for s in tokens.values()))
    rates = np.array([(chance.get(s, 0) + 0.5 / max(len(typical), 1)) / (words[0] + 1) for s in typical])
    if typical:
        model.decay = root_decay(np.array(typical), rates, model.other)

    def segments_of(batch: pa.RecordBatch) -> Iterator[list[tuple[float, int, int]]]:
        for at, own in zip(batch.column("at"), batch.column("score"), strict=True):
            yield maximal_segments(at.values.to_numpy(), own.values.to_numpy(), model.other) if len(at) else []

    def high(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([round(s, 1) for x in segments_of(batch) for s, _, _ in x], pa.float64())], ["s"])

    tail = clean.mapInArrow(high, "s double").groupBy("s").count().collect()
    model.factor = tail_factor(np.array([r.s for r in tail]), np.array([r["count"] for r in tail]), words[0], model.decay)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [weight(evidence(significant(n, segments, model))) for n, segments in zip(batch.column("n").to_pylist(), segments_of(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.float64())], ["toxic", "x"])

    rows = found.mapInArrow(weigh, "toxic int, x double").collect()
    y = np.array([float(r.toxic == 1) for r in rows])
    if len(rows) and 0 < y.sum() < len(y):
        model.weights = logistic(np.array([r.x for r in rows]), y)
    return model


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document of docs (doc_id, text): its score, evidence and significant segments.

    score is a probability; segments are in the order of the text, with the numbers of their first and
    last word, their score and E, an empty array if there are none; null and empty texts have no words and the score of no evidence. Null and repeated doc_ids are kept as
    they are; no documents give no rows; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = WordScores(model.tokens)
        a, b = model.weights
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                n, at, own = hits(text or "", scores)
                segments = maximal_segments(at, own, model.other) if len(at) else []
                good = significant(n, segments, model)
                x = evidence(good)
                spans = [{"first": i, "last": j, "score": s, "e": math.exp(-y)} for i, j, s, y in good]
                rows.append((1 / (1 + math.exp(-min(max(a + b * weight(x), -700.0), 700.0))), x, spans))
            kinds = (pa.float64(), pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("e", pa.float64())])))
            own = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *own], ["doc_id", "score", "evidence", "segments"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence double, segments array<struct<first: long, last: long, score: double, e: double>>")


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
