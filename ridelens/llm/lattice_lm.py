"""Subword lattice likelihood: every segmentation of a text into pieces counts.

The pieces and their first scores come from a public vocabulary (a piece of rank r starts with weight
1 / (r + 3)); expectation maximisation over the training words fits the scores. A word begins with a
space and no piece reaches into the next word, every single byte is a piece, and a word seen in
training is one more piece that spans it. The probability of a word is the sum over all segmentations,
taken by a log-space forward recursion; that of a text is the product over its words and its end,
summed over the groups (say, languages) it may belong to, each with scores of its own.

Whole-word pieces keep their training counts less a discount, which goes to the segmentations into
vocabulary pieces. Those are fitted to word types rather than tokens, as they stand for new words.
The scores of all words together sum to one.

The corpus appears only as word types with counts. Types that make up at least `HEAVY` of all tokens,
at most 1 / HEAVY of them, are broadcast and looked up where a document is read; all other words go
through a join, whose keys are rare by construction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.base import fold, pack, register, schema_of, table, utf8

HEAVY = 1 / 1_000_000
ROUNDS, GROUPS, DISCOUNT = 3, 8, 0.6
_MUL = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces as byte strings, found by the hash of their bytes; bounded by the vocabulary file."""

    pieces: list[bytes]
    prior: np.ndarray  # weight of each piece before training

    def __post_init__(self) -> None:
        ids = {p: i for i, p in enumerate(self.pieces)}
        starts = sorted({p[:n] for p in self.pieces for n in range(1, len(p) + 1)}, key=lambda b: (len(b), b))
        hashes = np.array([self._hash(b) for b in starts], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two piece beginnings share a hash")
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.id = np.array([ids.get(starts[i], -1) for i in order], np.int64)
        self.longest = max(map(len, self.pieces))

    @staticmethod
    def _hash(b: bytes) -> int:
        h = 0
        for x in b:
            h = (h * int(_MUL) + x + 1) & 0xFFFFFFFFFFFFFFFF
        return h * int(_MIX) & 0xFFFFFFFFFFFFFFFF

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Pieces of a sentencepiece model without upper case and inner space marks, plus all single bytes."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        for i in range(len(model)):
            text = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or "▁" in text[1:] or any("A" <= c <= "Z" for c in text):
                continue
            found.setdefault(text.replace("▁", " ").encode(), 1.0 / (3 + max(0.0, -model.get_score(i))))
        for b in range(256):
            found.setdefault(bytes([b]), 1e-6)
        weight = np.array(list(found.values()))
        return Vocabulary(list(found), weight / weight.sum())

    def edges(self, words: list[bytes]) -> Lattice:
        """The lattice of a batch of words, each with a space put in front."""
        data = np.frombuffer(b" " + b" ".join(words), np.uint8).astype(np.uint64)
        size = np.array([len(w) + 1 for w in words])
        begin = np.r_[0, np.cumsum(size)]
        word = np.repeat(np.arange(len(words)), size)
        left = begin[1:][word] - np.arange(len(data))  # bytes from here to the word's end
        at, h = np.arange(len(data)), np.zeros(len(data), np.uint64)
        found = []
        for n in range(1, self.longest + 1):
            ok = left[at] >= n
            at, h = at[ok], h[ok]
            if not len(at):
                break
            h = h * _MUL + data[at + n - 1] + np.uint64(1)
            mixed = h * _MIX
            slot = np.minimum(np.searchsorted(self.hashes, mixed), len(self.hashes) - 1)
            known = self.hashes[slot] == mixed
            at, h, piece = at[known], h[known], self.id[slot[known]]
            full = piece >= 0
            found.append((at[full], np.full(int(full.sum()), n), piece[full]))
        start, length, piece = (np.concatenate(x) for x in zip(*found))
        return Lattice(start + word[start], start + word[start] + length, piece, word[start], begin + np.arange(len(begin)), size)


@dataclass
class Lattice:
    """Edges between nodes; a word of n bytes has n + 1 nodes, numbered on from `first[word]`."""

    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    word: np.ndarray
    first: np.ndarray
    size: np.ndarray

    def _sweep(self, come: np.ndarray, go: np.ndarray, depth: np.ndarray, logp: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log of the summed path weights into each node, in the order of `depth`."""
        total = np.full(int(self.first[-1]), -np.inf)
        total[begin] = 0.0
        order = np.lexsort((go, depth))
        come, go, depth, logp = come[order], go[order], depth[order], logp[order]
        cuts = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:]):
            value, to = total[come[a:b]] + logp[a:b], go[a:b]
            group = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            top = np.maximum.reduceat(value, group)
            share = np.exp(value - np.repeat(top, np.diff(np.r_[group, b - a])))
            total[to[group]] = top + np.log(np.add.reduceat(share, group))
        return total

    def forward(self, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each word's probability, and of what leads to each node."""
        total = self._sweep(self.start, self.end, self.end - self.first[self.word], logp[self.piece], self.first[:-1])
        return total[self.first[:-1] + self.size], total

    def expected(self, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece where word i occurs `weight[i, g]` times, a row per column g."""
        each, ahead = self.forward(logp)
        last = (self.first[:-1] + self.size)[self.word]
        back = self._sweep(self.end, self.start, last - self.start, logp[self.piece], self.first[:-1] + self.size)
        use = np.exp(ahead[self.start] + logp[self.piece] + back[self.end] - each[self.word])
        return np.stack([np.bincount(self.piece, use * w[self.word], len(logp)) for w in weight.T])


def _batches(words: list[bytes], most: int = 1_000_000) -> Iterator[slice]:
    begin = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(w) + 1
    if words:
        yield slice(begin, len(words))


def count_words(docs: DataFrame, train: Column, group: Column, groups: int, text_col: str) -> DataFrame:
    """(word, c0, c1, ...) of every word of all texts: its number in the training texts of each group."""
    struct, arrow = schema_of("word binary, " + ", ".join(f"c{g} long" for g in range(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter() for _ in range(groups)]
            words: dict[bytes, None] = {}
            for g, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = text.lower().split()
                if g is None:
                    words.update(dict.fromkeys(found))
                else:
                    counts[g].update(found)
            for c in counts:
                words.update(dict.fromkeys(c))
            yield pack(arrow, [list(words), *[[c[w] for w in words] for c in counts]])

    rows = docs.select(F.when(train, group).alias("g"), utf8(text_col).alias("text")).mapInArrow(run, struct)
    return rows.groupBy("word").agg(*[F.sum(f"c{g}").alias(f"c{g}") for g in range(groups)])


def _counts(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    return batch.column(0).to_pylist(), np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)], 1).astype(float)


def fit(types: DataFrame, groups: int, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Natural log probability of every piece in each group, from the word types that occur in training.

    All groups share the segmentations of a round; the last one counts them per group, smoothed by their sum.
    """
    spark = types.sparkSession
    struct, arrow = schema_of("piece int, " + ", ".join(f"n{g} double" for g in range(groups)))
    seen = types.where(sum((F.col(f"c{g}") for g in range(groups)), F.lit(0)) > 0)
    logp = np.log(vocabulary.prior)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, logp))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, lp = shared.value
            total = np.zeros((groups, len(lp)))
            for batch in batches:
                words, c = _counts(batch)
                for part in _batches(words):
                    total += v.edges(words[part]).expected(lp, (c[part] > 0).astype(float))
            used = np.flatnonzero(total.sum(0))
            yield pack(arrow, [used.astype(np.int32), *total[:, used]])

        rows = seen.mapInArrow(run, struct).groupBy("piece").agg(*[F.sum(f"n{g}") for g in range(groups)]).collect()  # at most one row per piece
        count = np.zeros((groups, len(vocabulary.pieces)))
        for piece, *n in rows:
            count[:, piece] += n
        logp = np.log((count.sum(0) + 0.1) / (count.sum() + 0.1 * len(vocabulary.pieces)))
    each = count + 100.0 * np.exp(logp)
    return np.log(each / each.sum(1, keepdims=True))


def score_texts(docs: DataFrame, vocabulary: Vocabulary, train: Column, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """`id_col`, n_tokens, n_known, train_tokens, base_score, score of every row.

    Words are lower-cased (A-Z) and cut at white space; the end is one more token. `base_score` is the log10
    probability under smoothed word counts, `score` that of the lattice model; both are learned from the rows
    where `train` holds. The `GROUPS` commonest values of `group_col` there have scores of their own, other and
    null values count with the commonest; the column is not looked at when a text is scored. Null and empty
    texts have the end alone. Repeated rows are scored alike and counted each; other columns are not read.
    Without training rows the counts are zero and the pieces keep their first scores.
    """
    spark = docs.sparkSession
    learned = docs.where(train)
    found = learned.groupBy(F.col(group_col).alias("g") if group_col else F.lit(None).alias("g")).count().orderBy(F.desc("count"), "g").limit(GROUPS + 1).collect()
    names = [r["g"] for r in found if r["g"] is not None][:GROUPS] or [None]
    k = len(names)
    group = F.lit(0)
    for g, name in enumerate(names[1:], 1):
        group = F.when(F.col(group_col) == name, g).otherwise(group)
    types = count_words(docs, train, group, k, text_col).checkpoint()
    every = sum((F.col(f"c{g}") for g in range(k)), F.lit(0))
    sums = types.agg(F.sum((every > 0).cast("long")), *[F.sum(f"c{g}") for g in range(k)], *[F.sum((F.col(f"c{g}") > 0).cast("long")) for g in range(k)]).first()
    sums = np.array([float(x or 0) for x in sums])
    ends = np.zeros(k)
    for g, n in learned.groupBy(group.alias("g")).count().collect():
        ends[g] += n
    distinct, n_all = int(sums[0]) + int(ends.sum() > 0), int(sums[1 : k + 1].sum() + ends.sum())
    below = n_all + 0.5 * (distinct + 1)
    size = np.maximum(sums[1 : k + 1] + ends, 1.0)  # tokens of a group
    left = np.where(sums[1 : k + 1] > 0, DISCOUNT * sums[k + 1 :], size) / size  # share of its words that is spelled
    logp = fit(types, k, vocabulary, rounds)
    model = spark.sparkContext.broadcast((vocabulary, logp))
    columns = [f"s{g}" for g in range(k)]
    scored, scored_arrow = schema_of("word binary, known int, base double, " + ", ".join(f"{c} float" for c in columns))

    def score_types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, lp = model.value
        for batch in batches:
            words, c = _counts(batch)
            spelled = np.zeros(c.shape)
            for part in _batches(words):
                lattice = v.edges(words[part])
                for g in range(k):
                    spelled[part, g] = lattice.forward(lp[g])[0]
            with np.errstate(divide="ignore"):
                score = np.logaddexp(np.log(np.maximum(c - DISCOUNT, 0) / size), np.log(left) + spelled) / np.log(10.0)
            total = c.sum(1)
            yield pack(scored_arrow, [words, (total > 0).astype(np.int32), np.log10((total + 0.5) / below), *score.T])

    least = max(1, int(np.ceil(n_all * HEAVY)))
    heavy_rows = types.where(every >= least).mapInArrow(score_types, scored).collect()  # at most 1 / HEAVY rows
    heavy = spark.sparkContext.broadcast(({r[0]: i for i, r in enumerate(heavy_rows)}, np.array([tuple(r)[1:] for r in heavy_rows], np.float64).reshape(-1, 2 + k)))
    del heavy_rows
    last = [float(ends.sum() > 0), float(np.log10((ends.sum() + 0.5) / below)), *np.log10((ends + 0.5) / (size + 0.5)).tolist()]
    out, arrow = schema_of("uid long, key long, word binary, n int, n_tokens long, known double, base double, " + ", ".join(f"{c} double" for c in columns))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values = heavy.value
        for batch in batches:
            uids, words, ns = [], [], []
            whole = []
            for uid, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = Counter(text.lower().split())
                at, times = [], []
                for word, n in found.items():
                    place = places.get(word)
                    if place is None:
                        uids.append(uid)
                        words.append(word)
                        ns.append(n)
                    else:
                        at.append(place)
                        times.append(n)
                mine = values[at].T @ np.array(times, float) + last if at else np.array(last)
                # a word never holds a space, so this row of the document itself meets no word
                whole.append((uid, key, b" %d" % uid, None, found.total() + 1, *mine.tolist()))
            for i in range(0, len(words), 100_000):
                part = slice(i, i + 100_000)
                none = [None] * len(uids[part])
                yield pack(arrow, [uids[part], none, words[part], ns[part], *[none] * (3 + k)])
            yield pack(arrow, list(zip(*whole)) if whole else [[]] * len(arrow))

    parts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("key"), utf8(text_col).alias("text")).mapInArrow(read, out)
    rest = types.where(every < least).mapInArrow(score_types, scored).select("word", *[F.col(c).alias(f"t_{c}") for c in ("known", "base", *columns)])
    joined = parts.join(rest.hint("shuffle_hash"), "word", "left")
    total = {c: F.sum(F.coalesce(F.col(c), F.col("n") * F.col(f"t_{c}"))).alias(c) for c in ("known", "base", *columns)}
    sums_ = joined.groupBy("uid").agg(F.max("key").alias(id_col), F.max("n_tokens").alias("n_tokens"), *total.values())
    prior = np.log10((ends + 1e-3) / (ends + 1e-3).sum())
    likely = [F.col(c) + float(p) for c, p in zip(columns, prior)]
    top = F.greatest(*likely) if k > 1 else likely[0]
    score = top + F.log10(sum((F.pow(F.lit(10.0), x - top) for x in likely), F.lit(0.0)))
    return sums_.select(id_col, "n_tokens", F.round("known").cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"))


@register("op1_lattice_lm")
def op1_lattice_lm(spark, sf_dir):
    import public_tokenizers

    vocabulary = Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    out = score_texts(table(spark, sf_dir, "documents"), vocabulary, fold("doc_id") != 1, group_col="lang")
    return out.withColumn("held_out", fold("doc_id") == 1).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
