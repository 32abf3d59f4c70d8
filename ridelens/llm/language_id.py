"""Language identification: averaged hashed subword embeddings under a linear softmax.

Trained on the driver by stochastic gradient descent in numpy on a bounded sample of labelled rows;
applied to whole texts in Spark tasks. As embeddings are averaged and then mapped linearly, embedding
table and output layer collapse into one small table of bucket scores for prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridelens.llm.base import fold, pack, register, schema_of, table, utf8

BUCKETS, WIDTH = 1 << 15, 16
ROWS_PER_LANGUAGE, LANGUAGES, LONGEST = 600, 64, 20_000  # bounds of the training sample: rows, labels, characters of a row
UNKNOWN = "und"
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def subwords(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Place and bucket of every run of 2 to 4 bytes within a word and its bounding spaces."""
    b = np.frombuffer(b" " + data.lower().translate(_SPACES) + b" ", np.uint8).astype(np.uint32)
    word = b != 32
    place, bucket = [], []
    h = b.copy()
    inner = np.ones(len(b), bool)  # no space strictly inside the run that begins here
    for n in (2, 3, 4):
        if len(b) < n:
            break
        m = len(b) - n + 1
        h = h[:m] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        if n > 2:
            inner = inner[:m] & word[n - 2 : n - 2 + m]
            ok = inner
        else:
            inner = inner[:m]
            ok = word[:m] | word[1:]
        at = np.flatnonzero(ok)
        mixed = h[at] * np.uint32(0x9E3779B1)
        place.append(at)
        bucket.append((mixed >> np.uint32(17)).astype(np.int64))
    return (np.concatenate(place), np.concatenate(bucket)) if place else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # BUCKETS x labels: embedding times output layer
    bias: np.ndarray
    heat: float  # logits are divided by it
    least: float  # calibrated rejection: lower probabilities are not accepted

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Calibrated probabilities; texts are joined by two spaces, over which no run of bytes counts."""
        size = np.array([len(t) + 2 for t in texts])
        place, bucket = subwords(b"  ".join(texts) + b" ")
        owner = np.searchsorted(np.cumsum(size), place, "right").clip(0, len(texts) - 1)
        logits = np.stack([np.bincount(owner, column[bucket], len(texts)) for column in self.scores.T], 1)
        logits /= np.maximum(np.bincount(owner, minlength=len(texts)), 1)[:, None]
        return softmax((logits + self.bias) / self.heat)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(texts: list[bytes], labels: list[str], epochs: int = 4, rate: float = 4.0, seed: int = 7, most_error: float = 0.05) -> Model | None:
    """Fit on four fifths of the rows; heat and rejection bound on the last fifth. None without rows.

    Each row counts whole and once more as a random excerpt of up to 20 words, so that short texts are known
    too. The bound is the smallest probability above which at most `most_error` of the kept rows are wrong; where no
    bound reaches that it is one, and only certain rows are accepted.
    """
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    target = np.array([names.index(x) for x in labels])
    rows: list[tuple[np.ndarray, np.ndarray, int, bool]] = []
    for i, text in enumerate(texts):
        words = text.split()
        start = int(rng.integers(0, max(1, len(words) - 5)))
        for part in (text, b" ".join(words[start : start + int(rng.integers(1, 21))])):
            ids, n = np.unique(subwords(part)[1], return_counts=True)
            if len(ids):
                rows.append((ids, n / n.sum(), int(target[i]), i % 5 == 4))
    table_ = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    out, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    learn, check = [r for r in rows if not r[3]] or rows, [r for r in rows if r[3]] or rows
    total, step = epochs * len(learn), 0
    for _ in range(epochs):
        for j in rng.permutation(len(learn)):
            ids, share, y, _ = learn[j]
            mean = share @ table_[ids]
            grad = softmax(mean @ out + bias)
            grad[y] -= 1
            now = rate * (1 - step / total)
            back = out @ grad
            out -= now * 0.25 * np.outer(mean, grad)
            bias -= now * 0.01 * grad
            table_[ids] -= now * np.outer(share, back) * 4
            step += 1
    scores = table_ @ out
    logits = np.array([share @ scores[ids] + bias for ids, share, _, _ in check])
    y = np.array([r[2] for r in check])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()
    heat = float(min(np.geomspace(0.05, 20, 120), key=loss))
    p = softmax(logits / heat)
    sure, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-sure)
    error = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(error <= most_error)
    least = float(sure[order[good[-1]]]) if len(good) else 1.0
    return Model(names, scores, bias, heat, least)


def sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str, rows: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES) -> tuple[list[bytes], list[str]]:
    """At most `rows` usable rows of each of the `languages` commonest labels, by the hash of their id."""
    held = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.length(text_col) <= LONGEST))
    named = held.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"))
    common = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    # only rows of low hashes, about four times as many as are wanted, reach the window
    low = F.pmod("h", F.lit(1 << 30)) < F.lit(4.0 * rows) / F.col("count") * (1 << 30)
    order = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "id")
    few = named.join(F.broadcast(common), "lang").where(low).withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    few = few.groupBy("id").agg(F.min("lang").alias("lang"))
    got = held.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).join(F.broadcast(few), "id").dropDuplicates(["id"]).orderBy("id").collect()
    return [bytes(r["text"]) for r in got], [r["lang"] for r in got]


def fit_language_id(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE, languages: int = LANGUAGES) -> Model | None:
    """A model learned from rows where `usable` holds and the label is not null.

    Of each of the `languages` commonest labels at most `rows` rows of at most `LONGEST` characters are used, one per
    id; a rarer label is never predicted.
    """
    return train(*sample(docs, usable, id_col, text_col, lang_col, rows, languages))


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `carry`, lang_pred, score, accepted of every row.

    A text that is null or has no letter is `und` with score 0 and not accepted; so is every text when there
    was nothing to learn from. Nothing but the text enters the prediction, and all of it does. To carry columns
    whose names may be those of the result, put them into a struct.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    found, _ = schema_of("lang_pred string, score double, accepted boolean")
    struct, arrow = schema_of(StructType([*(docs.schema[c] for c in carry), *found]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_columns
            texts, letter = batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()
            label, sure, kept = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            todo = [i for i, ok in enumerate(letter) if ok and m is not None]
            for part in _runs(todo, texts):
                p = m.predict([texts[i] for i in part])
                for i, k, v in zip(part, p.argmax(1).tolist(), p.max(1).tolist()):
                    label[i], sure[i], kept[i] = m.labels[k], v, v >= m.least
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(label, pa.string()), pa.array(sure, pa.float64()), pa.array(kept, pa.bool_())], names=arrow.names)

    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*carry, utf8(text_col).alias("__text"), has_letter.alias("__letter")).mapInArrow(run, struct)


def _runs(todo: list[int], texts: list[bytes], most: int = 1_000_000) -> Iterator[list[int]]:
    part, size = [], 0
    for i in todo:
        if part and size + len(texts[i]) > most:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(texts[i])
    if part:
        yield part


@register("op3_language_id")
def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_language_id(docs, fold("doc_id") != 0)
    return identify(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "accepted")
