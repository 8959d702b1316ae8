"""Toxic passages by maximum-scoring segments.

Tokens (words and their leading characters) get smoothed log-odds between toxic
and clean documents under a Dirichlet prior. A text is then a sequence of
scores: what clearly speaks for toxicity adds, any other word costs, and more if it
clearly speaks against. One linear
scan finds every maximal-scoring segment. Scores of best segments of clean texts
follow an extreme-value law whose two parameters come from clean training texts,
so each segment has an expected number of chance finds; a text's evidence is the
sum over its significant segments, mapped to a probability by a logistic fit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.llm.common import durable, ship, table

_PARTS = re.compile(r"\w+")
#: Entries of a memo or counter that a worker holds before it empties it.
MEMO = 500_000
Segment = tuple[int, int, float]


def tokens(word: str) -> set[str]:
    """A word's tokens: its alphanumeric parts and their first 4, 5 and 6 characters."""
    return {t for part in _PARTS.findall(word) for t in (part, *(part[:k] for k in (4, 5, 6) if len(part) > k))}


def maximal_segments(scores: list[float]) -> list[Segment]:
    """All maximal-scoring segments of a sequence, as (first place, last place, score), in linear time.

    A candidate is joined with the nearest one before it whose sum starts lower,
    unless that one already ends as high. Each candidate knows its own nearest
    lower one, so those in between are skipped for good.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest that starts lower
    total = 0.0
    for place, score in enumerate(scores):
        if score <= 0:
            total += score
            continue
        first, before = place, total
        total += score
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            first, before = found[j][0], found[j][2]
            nearest = found[j][4]
            del found[j:]
            j = nearest
        found.append((first, place, before, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class Model:
    """A fitted scorer; small, so it travels with the tasks."""

    lexicon: dict[str, float] = field(default_factory=dict)
    cost: float = 1.0
    decay: float = 1.0
    scale: float = 1.0
    significant: float = 0.05
    intercept: float = -5.0
    slope: float = 0.0

    def __post_init__(self):
        self.memo: dict[str, float] = {}

    def scores(self, text: str) -> list[float]:
        """The scores of a text's words: the best of their tokens, less the cost of a word where none is positive."""
        words = text.lower().split()
        memo = self.memo
        missing = {*words}.difference(memo)
        if missing:
            if len(memo) + len(missing) > MEMO:
                memo.clear()
                missing = {*words}
            for w in missing:
                known = [self.lexicon[t] for t in tokens(w) if t in self.lexicon]
                best = max(known, default=0.0)
                memo[w] = best if best > 0 else min(known, default=0.0) - self.cost
        return list(map(memo.__getitem__, words))

    def segments(self, text: str) -> tuple[list[Segment], int]:
        """All segments of a text and its number of words."""
        scores = self.scores(text)
        return maximal_segments(scores), len(scores)

    def surprise(self, score: float, n_words: int) -> float:
        """Minus the logarithm of how many such segments a clean text of that length is expected to hold."""
        return self.decay * score - math.log(self.scale * max(1, n_words))

    def read(self, text: str) -> tuple[list[tuple[int, int, float, float]], float]:
        """Significant segments with their surprise, and the evidence they sum to."""
        found, n = self.segments(text)
        least = -math.log(self.significant)
        kept = [(a, b, s, e) for a, b, s in found if (e := self.surprise(s, n)) >= least]
        return kept, sum(e for *_, e in kept)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence))))


def calibrate(model: Model, best: list[tuple[float, int]], by_score: dict[float, int]) -> None:
    """Extreme-value parameters from clean texts.

    ``best`` holds (best segment's score, words) of each, ``by_score`` the number
    of their words by score. The decay solves sum(p(s) * exp(decay * s)) = 1 over
    the words' scores; given it, the scale has a closed maximum-likelihood form.
    """
    if not best:
        return
    s, n = (np.array(x, dtype=float) for x in zip(*by_score.items(), strict=True)) if by_score else (np.zeros(1), np.ones(1))
    p = n / n.sum()
    if (s > 0).any() and (p * s).sum() < 0:
        low, high = 0.0, 1.0
        while (p * np.exp(high * s)).sum() < 1 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
        model.decay = max(low, 1e-3)
    model.scale = len(best) / max(1e-9, sum(max(1, w) * math.exp(-model.decay * b) for b, w in best))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Intercept and slope by Newton's method with a small ridge."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p)
        grad = np.array([(y - p).sum() - ridge * a, ((y - p) * x).sum() - ridge * b])
        h = np.array([[w.sum() + ridge, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, grad)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    sample: int = 20_000,
    prior: float = 1.0,
    least_z: float = 3.5,
    margin: float = 2.5,
    cost: float = 1.0,
) -> Model:
    """Learns from at most ``sample`` labelled documents (doc_id, toxic).

    The sample is the first by a hash of doc_id; its ids are thus few enough to
    broadcast, and only its texts are kept for the two passes of the fit.
    Documents with the same text count once. ``prior`` is the Dirichlet
    pseudo-count of every token; a token enters the lexicon if its log-odds are
    ``least_z`` standard deviations above zero and exceed ``margin``, which its
    score leaves out, or as far below zero. The model follows the sample, not the
    corpus. Rows with a null doc_id,
    label or text teach nothing; contradicting labels count as toxic. Without
    both classes the model finds nothing and gives every text the base rate.
    """
    ship(docs.sparkSession)
    ids = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id").agg((F.max("toxic") > 0).alias("is_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    known = durable(
        docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        .groupBy(F.xxhash64("text").alias("h"), F.length("text").alias("l"))
        .agg(F.first("text").alias("text"), F.max("is_toxic").alias("is_toxic"))
        .select("text", "is_toxic")
    )
    n = {r.is_toxic: r.n for r in known.groupBy("is_toxic").agg(F.count("*").alias("n")).collect()}
    model = Model(cost=cost)
    rate = n.get(True, 0) / max(1, sum(n.values()))
    model.intercept = math.log((rate + 1e-4) / (1 - rate + 1e-4))
    if not (n.get(True) and n.get(False)):
        return model

    def count(batches):
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def rows():
            both = list(counts[0].keys() | counts[1].keys())
            cols = [pa.array([c[t] for t in both], pa.int64()) for c in counts]
            return pa.RecordBatch.from_arrays([pa.array(both, pa.string()), *cols], ["token", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "is_toxic")), strict=True):
                counts[toxic].update(set().union(*map(tokens, {*text.lower().split()})))
                if len(counts[0]) + len(counts[1]) > MEMO:
                    yield rows()
                    counts = Counter(), Counter()
        yield rows()

    odds = lambda c, total: F.log((F.col(c) + prior) / F.lit(total + 2 * prior))
    entries = (
        known.mapInArrow(count, "token string, clean long, toxic long")
        .groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .withColumn("odds", odds("toxic", n[True]) - odds("clean", n[False]))
        .withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)))
        .where(((F.col("z") >= least_z) & (F.col("odds") > margin)) | (F.col("z") <= -least_z))
        .select("token", F.when(F.col("odds") > 0, F.col("odds") - margin).otherwise(F.col("odds")).alias("score")).collect()
    )
    model.lexicon = {r.token: r.score for r in entries}

    def best(batches):
        """The best segment and the length of each clean text."""
        for batch in batches:
            read = [model.segments(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([max((s for *_, s in found), default=0.0) for found, _ in read], pa.float64()), pa.array([n for _, n in read], pa.int64())],
                ["best", "words"],
            )

    def tally(batches):
        """How many words of clean texts have which score."""
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(model.scores(text))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.float64()), pa.array(counts.values(), pa.int64())], ["score", "n"])

    clean = known.where("NOT is_toxic").select("text")
    by_score = clean.mapInArrow(tally, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    calibrate(model, [tuple(r) for r in clean.mapInArrow(best, "best double, words long").collect()], {r.score: r.n for r in by_score})

    def weigh(batches):
        for batch in batches:
            evidence = [model.read(text)[1] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("is_toxic"), pa.array(evidence, pa.float64())], ["is_toxic", "evidence"])

    rows = known.mapInArrow(weigh, "is_toxic boolean, evidence double").collect()
    model.intercept, model.slope = logistic(np.array([r.evidence for r in rows]), np.array([r.is_toxic for r in rows], dtype=float))
    return model


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, n_words, passages (first_word, last_word, score, surprise).

    A null text counts as empty and gets the score of a text without findings.
    Words are counted from 0 between white space. Texts are read whole; repeated
    rows and null ids stay; other columns are ignored; no shuffle.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ("first_word", "last_word", "score", "surprise")
    spans = pa.list_(pa.struct(list(zip(names, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))))

    def run(batches):
        for batch in batches:
            read = [model.read(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([model.probability(e) for _, e in read], pa.float64()),
                    pa.array([[dict(zip(names, s, strict=True)) for s in found] for found, _ in read], spans),
                ],
                ["id", "score", "passages"],
            )

    schema = f"id {kind}, score double, passages array<struct<first_word:long,last_word:long,score:double,surprise:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold(F.col("doc_id")) != 0))
    return toxicity(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"),
    )
