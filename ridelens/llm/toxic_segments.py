"""Toxic passages by maximum-scoring segments over token log-odds, with an extreme-value calibration.

A word's weight is the log-odds of its document frequency in toxic against clean training rows under a
Dirichlet prior that follows the word's frequency in both, shrunk by its standard error. Every other token
costs `drift`. One linear scan finds all maximal scoring segments of a text. In clean text the best segment of
n tokens follows an extreme-value law, P(S >= x) = 1 - exp(-K n e^(-rate x)): `rate` solves
sum p_w e^(rate s_w) = 1 over clean token frequencies, K comes from the segments of clean rows kept for
calibration. Passages whose expected number in clean text of that length is below one are significant; a text's
evidence is what their scores exceed that level by, and a logistic curve turns evidence into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.base import fold, pack, register, schema_of, table

SAMPLE_ROWS = 12_000  # training rows of each label at most
MODEL_WORDS = 50_000  # words with a weight of their own at most, the surest ones
_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


@dataclass
class ToxicModel:
    """A fitted model; at most `MODEL_WORDS` weights, so it can be broadcast."""

    weights: dict[str, float]
    drift: float = 0.25
    rate: float = 1.0
    log_k: float = 0.0
    bias: float = -30.0
    slope: float = 1.0

    def scores(self, words: Sequence[str]) -> np.ndarray:
        get, other = self.weights.get, -self.drift
        return np.array([get(w, other) for w in words])

    def segments(self, words: Sequence[str]) -> list[tuple[int, int, float]]:
        """All maximal segments (begin, end, score) of a token list."""
        if self.weights.keys().isdisjoint(words):
            return []
        return maximal_segments(self.scores(words))

    def excess(self, score: float, n: int) -> float:
        """Log of one over the number of such segments that clean text of `n` tokens would hold."""
        return self.rate * score - self.log_k - math.log(n)

    def probability(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-min(max(self.bias + self.slope * math.log1p(evidence), -700.0), 700.0)))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [begin, end) from left to right, in time linear in the tokens.

    A segment is maximal if all its proper parts score less and no longer segment with that property holds it.
    Candidates are kept with the running total before and after them; a new positive token joins the
    nearest earlier candidate that begins lower, as long as it also ends higher than that candidate. Each
    candidate remembers the nearest earlier one that begins lower, so none is looked at twice.
    """
    total = np.r_[0.0, np.cumsum(scores)]
    found: list[tuple[int, int, float, float, int]] = []  # begin, end, total before, total after, nearest that begins lower
    for i in np.flatnonzero(scores > 0).tolist():
        begin, low, high = i, float(total[i]), float(total[i + 1])
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][2] >= low:
                at = found[at][4]
            if at < 0 or found[at][3] >= high:
                break
            begin, low = found[at][0], found[at][2]
            del found[at:]
        found.append((begin, i + 1, low, high, at))
    return [(b, e, high - low) for b, e, low, high, _ in found]


def _word_counts(rows: DataFrame) -> DataFrame:
    """word, and per label the number of rows with it (d0, d1) and of its occurrences in clean rows (n0)."""
    struct, arrow = schema_of("word string, d0 long, d1 long, n0 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, occur = (Counter(), Counter()), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text)
                seen[toxic].update(set(words))
                if not toxic:
                    occur.update(words)
            every = list(seen[0].keys() | seen[1].keys())
            yield pack(arrow, [every, *([c[w] for w in every] for c in (*seen, occur))])

    return rows.select("text", "toxic").mapInArrow(run, struct).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("d0", "d1", "n0")])


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", drift: float = 0.25,
                 prior: float = 1.0, sample_rows: int = SAMPLE_ROWS, model_words: int = MODEL_WORDS) -> ToxicModel:
    """Fit on the rows of `docs` where `train` holds and `labels` has a 0/1 label for the id.

    The fit sees at most `sample_rows` rows of each label, those of lowest hashed id; two thirds of them give the
    word weights, one third the calibration. A null label is none; of several labels of an id the largest counts.
    `prior` weighs the Dirichlet prior in documents per observed document. Only the weights (at most `model_words`)
    and two numbers per sampled row reach the driver. Without labels of both kinds every score is 0.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    body = docs.where(train) if train is not None else docs
    body = body.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text"))
    ids = body.select("__id").join(known, "__id").select("__id", "toxic", F.xxhash64("__id").alias("h")).distinct().checkpoint()
    least = [ids.where(F.col("toxic") == y).orderBy("h", "__id").limit(sample_rows) for y in (0, 1)]
    rows = body.join(F.broadcast(least[0].unionByName(least[1])), "__id").select("text", "toxic", (F.pmod("h", F.lit(3)) == 0).alias("later")).repartition("text").checkpoint()
    size = {(r["later"], r["toxic"]): r["n"] for r in rows.groupBy("later", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = size.get((False, 0), 0), size.get((False, 1), 0)
    if not n0 or not n1:
        return ToxicModel({}, drift)
    counts = _word_counts(rows.where(~F.col("later"))).checkpoint()
    clean_tokens = counts.agg(F.sum("n0")).first()[0] or 1

    both = F.col("d0") + F.col("d1")
    a0, a1 = (prior * both * n / F.lit(float(n0 + n1)) for n in (n0, n1))
    odds = F.log((F.col("d1") + a1) / F.lit(n1 * (1 + prior))) - F.log((F.col("d0") + a0) / F.lit(n0 * (1 + prior)))
    error = F.sqrt(1 / (F.col("d1") + a1) + 1 / (F.col("d0") + a0))
    sure = F.when(odds > 0, F.greatest(odds - 2 * error, F.lit(0.0))).otherwise(F.least(odds + 2 * error, F.lit(0.0)))
    kept = counts.select("word", "n0", sure.alias("s"), (F.abs(odds) / error).alias("z")).where((F.col("s") != 0) & (F.col("z") > 3)).orderBy(F.desc("z"), "word").limit(model_words).collect()
    model = ToxicModel({r["word"]: r["s"] - drift for r in kept if r["s"] - drift > 0 or r["s"] < 0}, drift)
    model.rate = _rate(np.array([[model.weights[r["word"]], r["n0"] + 0.5] for r in kept if r["word"] in model.weights]).reshape(-1, 2), drift, float(clean_tokens))

    shared = rows.sparkSession.sparkContext.broadcast(model)
    struct, arrow = schema_of("toxic int, n long, segments array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text)
                out.append((toxic, len(words), [s for _, _, s in shared.value.segments(words)]))
            yield pack(arrow, list(zip(*out)) if out else [[]] * 3)

    later = rows.where("later").select("text", "toxic").mapInArrow(run, struct).collect()
    _calibrate(model, [(r["toxic"], r["n"], r["segments"]) for r in later])
    return model


def _rate(weighted: np.ndarray, drift: float, total: float) -> float:
    """The positive root of sum p e^(rate s) = 1; `weighted` has a row (score, count) per word."""
    positive = weighted[:, 0] > 0
    if not positive.any():
        return 1.0
    share = weighted[:, 1] / total
    rest = max(1.0 - share.sum(), 0.0)

    def over(x: float) -> float:
        return float((share * np.exp(np.minimum(x * weighted[:, 0], 700.0))).sum() + rest * math.exp(-x * drift)) - 1.0

    low, high = 1e-6, 1.0
    while over(high) < 0:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return high


def _calibrate(model: ToxicModel, later: list[tuple[int, int, list[float]]]) -> None:
    """Set K from the segments of clean rows, then bias and slope by Newton steps on the logistic likelihood."""
    floor = min((w for w in model.weights.values() if w > 0), default=1.0)
    clean = [(n, s) for y, n, s in later if not y]
    passed = sum(x >= floor for _, s in clean for x in s)
    model.log_k = math.log(passed + 0.5) - math.log(max(sum(n for n, _ in clean), 1)) + model.rate * floor
    x = np.array([math.log1p(sum(max(model.excess(v, n), 0.0) for v in s)) for _, n, s in later])
    y = np.array([t for t, _, _ in later], float)
    if not len(y):
        return
    # one made-up row of each label at both ends of the evidence keeps the likelihood's maximum finite
    top = max(float(x.max()), 1.0)
    x, y, weight = np.r_[x, 0.0, top], np.r_[y, 1.0, 0.0], np.r_[np.ones(len(y)), 0.5, 0.5]
    beta = np.zeros(2)
    design = np.c_[np.ones(len(x)), x]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        curve = weight * p * (1 - p)
        step = np.linalg.solve((design * curve[:, None]).T @ design + 1e-6 * np.eye(2), design.T @ (weight * (y - p)) - 1e-6 * beta)
        beta += step * min(1.0, 4.0 / max(float(np.abs(step).max()), 1e-12))
        if float(np.abs(step).max()) < 1e-10:
            break
    model.bias, model.slope = float(beta[0]), max(float(beta[1]), 0.0)


def toxic_passages(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", most_expected: float = 1.0) -> DataFrame:
    """`id_col`, score, evidence and passages of every row; no shuffle.

    `passages` are the significant segments in text order: begin and end (code points), score, expected (the number
    of such segments in clean text of that length, at most `most_expected`) and text. Null and empty texts and texts
    without letters have none and the lowest score. Repeated rows stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    struct, arrow = schema_of("__id long, score double, evidence double, passages array<struct<begin: int, `end`: int, score: double, expected: double, text: string>>")

    def passages(text: str, found: list[tuple[int, int, float]], n: int) -> list[dict]:
        # lower() may change the number of characters, so tokens are found again in the text as it is
        spans = [m.span() for m in _TOKEN.finditer(text)]
        same = len(spans) == n
        out = []
        for a, b, s in found:
            expected = math.exp(min(-shared.value.excess(s, n), 700.0))
            if expected <= most_expected:
                begin, end = (spans[a][0], spans[b - 1][1]) if same else (0, len(text))
                out.append({"begin": begin, "end": end, "score": s, "expected": expected, "text": text[begin:end]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text)
                found = m.segments(words)
                evidence = sum(max(m.excess(s, len(words)), 0.0) for _, _, s in found)
                out.append((key, m.probability(evidence), evidence, passages(text, found, len(words)) if found else []))
            yield pack(arrow, list(zip(*out)) if out else [[]] * 4)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, struct).withColumnRenamed("__id", id_col)


@register("op13_toxic_segments")
def op13_toxic_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id") != 0)
    found = toxic_passages(docs, model)
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("passages"))
