"""Phrase collocations from sorted count streams.

Only the longest windows are counted: a phrase's count is the sum over windows that begin with it, so one
pass over windows in prefix order gives the counts of all lengths. The frequent phrases then lie in two orders. In
prefix order a phrase follows its own first parts, so the last row of each shorter length is the count of
that part (left counts); in suffix order the same gives the counts of last parts (right counts); and in both an
extension by one word meets the phrase it extends. Nothing is looked up by key: neighbours in a sorted
stream answer for each other, and the streams meet in merge joins.

A word is the hash of its language and itself, from a seed under which no two words of the corpus collide. Two passes
before keep windows short: a window goes on only while its words, and its neighbouring pairs, can be
frequent. What can be is a bit set of fixed size over hashes; a false bit costs time, never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridelens.llm.base import pack, register, schema_of, table, utf8, written

CUTS = b".,;:!?\n\x0b\x0c\r"  # fixed: the characters between pieces
BITS = 1 << 27  # of a bit set; its 16 MB are the most that is broadcast
HELD_WORDS = 300_000  # distinct words a task keeps before it passes their counts on, or forgets their hashes
HELD_PAIRS = 4_000_000  # occurrences a task gathers before it combines and passes them on
HELD_WINDOWS = 2_000_000  # windows a task gathers before it combines and passes them on
PACKED = 4096  # windows of a row
SLICES = 4096  # at least; more where there are many partitions
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + CUTS, b"abcdefghijklmnopqrstuvwxyz " + b"." * len(CUTS))


def words_of(text: bytes) -> list[bytes]:
    """Words in order, with `.` wherever a piece ends (no word holds one)."""
    return text.translate(_PLAIN).replace(b".", b" . ").split()


class Coder(dict):
    """The code of each word of one language: 63 bits of a hash, or 0 if the bit set says that it is not frequent."""

    def __init__(self, lang: str, seed: int, bits: np.ndarray | None) -> None:
        super().__init__()
        self.start, self.seed, self.bits = lang.encode() + b"\0", seed, bits
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(self.start + word, self.seed) >> 1 or 1
        if self.bits is not None and not self.bits[(code >> 6) % len(self.bits)] >> np.uint64(code & 63) & np.uint64(1):
            code = 0
        self[word] = code
        return code


def _have(bits: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (bits[(codes >> 6) % len(bits)] >> (codes & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 63-bit number for each pair of codes."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ x >> np.uint64(32)) >> np.uint64(1)).astype(np.int64)


def _bit_set(frequent: DataFrame, column: str):
    """Broadcast bits of all values of `column` (longs of 63 bits): at most `BITS / 64` rows reach the driver."""
    at = F.col(column).bitwiseAND(F.lit(BITS - 1))
    words = frequent.select(F.shiftright(at, 6).alias("at"), F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    bits = np.zeros(BITS // 64, np.uint64)
    bits[words["at"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64).view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(bits)


def _codes(batches: Iterator[pa.RecordBatch], seed: int, bits: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of all texts of each batch, with at least one 0 between pieces and between texts."""
    coders: dict[str, Coder] = {}
    for batch in batches:
        got = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            coder = coders.get(lang)
            if coder is None:
                coder = coders[lang] = Coder(lang, seed, bits)
            words = words_of(text)
            got += [np.fromiter(map(coder.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        if sum(map(len, coders.values())) > HELD_WORDS:
            coders.clear()
        if got:
            yield np.concatenate(got)


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """code, lang, word, n of every word; `texts` has lang and text (bytes)."""
    struct, arrow = schema_of("code long, lang string, word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [[], [], [], []]
            for lang, found in counts.items():
                found.pop(b".", None)
                coder = Coder(lang, seed, None)
                for x, y in zip(rows, (map(coder.__getitem__, found), [lang] * len(found), found, found.values())):
                    x.extend(y)
            return pack(arrow, rows)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > HELD_WORDS:
                yield out()
                counts = {}
        yield out()

    # words with one code share a task, so collisions show up without a further shuffle
    return texts.mapInArrow(run, struct).repartition("code").groupBy("code", "lang", "word").agg(F.sum("n").alias("n"))


def pair_counts(texts: DataFrame, seed: int, frequent_words) -> DataFrame:
    """code, n of every pair of neighbouring words that may both be frequent."""
    struct, arrow = schema_of("code long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for codes in _codes(batches, seed, frequent_words.value):
            first = np.flatnonzero((codes[:-1] != 0) & (codes[1:] != 0))
            held.append(_mix(codes[first], codes[first + 1]))
            size += len(first)
            if size > HELD_PAIRS:
                yield pack(arrow, np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if held:
            yield pack(arrow, np.unique(np.concatenate(held), return_counts=True))

    return texts.mapInArrow(run, struct).repartition("code").groupBy("code").agg(F.sum("n").alias("n"))


def window_counts(texts: DataFrame, seed: int, frequent_words, frequent_pairs, most: int) -> DataFrame:
    """slice, first, packed: the windows that begin with a pair that may be frequent and go on like this.

    A window ends (with zeros) before a pair that cannot be frequent, at the piece's end, or full. A pair belongs
    to one slice. A task combines equal windows and packs those of a slice, in order, into rows of at most `PACKED`
    windows: w1 .. w`most` and the count of each; `first` is w3 of the first. Counts are not summed over tasks.
    """
    struct, arrow = schema_of("slice long, first long, packed binary")
    slices = max(SLICES, 256 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = np.c_[_mix(rows[:, 0], rows[:, 1]) % slices, rows]
            rows = rows[np.lexsort(rows.T[::-1])]
            starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
            rows, n = rows[starts], np.diff(np.r_[starts, len(rows)])
            at = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
            place = np.arange(len(rows)) - np.repeat(at, np.diff(np.r_[at, len(rows)]))
            at = np.flatnonzero(place % PACKED == 0)
            body = np.ascontiguousarray(np.c_[rows[:, 1:], n])
            offsets = (np.r_[at, len(rows)] * body.itemsize * body.shape[1]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
            return pa.RecordBatch.from_arrays([pa.array(rows[at, 0]), pa.array(rows[at, 3]), packed], schema=arrow)

        for codes in _codes(batches, seed, frequent_words.value):
            pair = (codes[:-1] != 0) & (codes[1:] != 0)
            at = np.flatnonzero(pair)
            pair[at] = _have(frequent_pairs.value, _mix(codes[at], codes[at + 1]))
            first = np.flatnonzero(pair)
            if not len(first):
                continue
            pair, codes = np.r_[pair, np.zeros(most, bool)], np.r_[codes, np.zeros(most, np.int64)]
            rows, goes = np.zeros((len(first), most), np.int64), np.ones(len(first), bool)
            rows[:, 0] = codes[first]
            for k in range(1, most):
                goes = goes & pair[first + k - 1]
                rows[:, k] = np.where(goes, codes[first + k], 0)
            held.append(rows)
            size += len(rows)
            if size > HELD_WINDOWS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, struct)


def _by_slice(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, bool]]:
    """Blocks of sorted windows (rows of w1 .. w`most`, n) and for each whether its pairs may also be in other blocks or tasks.

    A block is a slice. Only the first and the last slice of a task can have windows in other tasks; only a slice
    of more than `HELD_WINDOWS` windows is given out in several blocks.
    """
    held: list[np.ndarray] = []
    now, size, shared = None, 0, True  # slice, its windows, and whether it is the first one or was cut

    def out() -> np.ndarray:
        block = np.concatenate(held)
        return block[np.lexsort(block.T[-2::-1])]

    for batch in batches:
        for slice_, packed in zip(batch.column(0).to_pylist(), batch.column(2)):
            if now is not None and slice_ != now:
                if held:
                    yield out(), shared
                held, size, shared = [], 0, False
            now = slice_
            held.append(np.frombuffer(packed.as_buffer(), np.int64).reshape(-1, most + 1))
            size += len(held[-1])
            if size > HELD_WINDOWS:
                yield out(), True
                held, size, shared = [], 0, True
    if held:
        yield out(), True


def prefix_counts(windows: DataFrame, most: int, least: int) -> DataFrame:
    """w1 .. w`most`, n of every phrase of two words or more that occurs `least` times, from one pass in prefix order.

    Ranges of slices are dealt over tasks; a slice with very many windows may fill several. Phrases of a slice that
    is not whole in one block are passed on whatever their count, and summed afterwards.
    """
    names = [f"w{i + 1}" for i in range(most)]
    struct, arrow = schema_of(", ".join(f"{n} long" for n in names) + ", n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, shared in _by_slice(batches, most):
            new, keys, sums = np.arange(len(rows)) == 0, [], []
            new[1:] = rows[1:, 0] != rows[:-1, 0]
            for size in range(2, most + 1):
                new[1:] |= rows[1:, size - 1] != rows[:-1, size - 1]
                starts = np.flatnonzero(new)
                count = np.add.reduceat(rows[:, most], starts)
                keep = ((count >= least) | shared) & (rows[starts, size - 1] != 0)
                key = rows[starts[keep], :most]
                key[:, size:] = 0
                keys.append(key)
                sums.append(count[keep])
            yield pack(arrow, [*np.concatenate(keys).T, np.concatenate(sums)])

    ranges = windows.repartitionByRange("slice", "first").sortWithinPartitions("slice", "first")
    return ranges.mapInArrow(run, struct).groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _walk(phrases: DataFrame, most: int, side: str) -> DataFrame:
    """Two kinds of rows from one pass in the order of c1, c2, ...: each phrase with the counts of its beginnings, and
    for each phrase that an extension by one word equals in count, that phrase with `inside` 1.

    A beginning of a frequent phrase is frequent, so it is there, and before it: the last row of each length
    above a row is its beginning of that length. All phrases with the same two first words share a task, as a stream.
    """
    names = [f"c{i + 1}" for i in range(most)]
    parts = [f"{side}{k}" for k in range(2, most)]
    struct, arrow = schema_of(", ".join(f"{c} long" for c in [*names, *parts]) + ", inside int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = np.zeros(most + 1, np.int64)  # count of the last row of each length
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = np.stack([batch.column(i).to_numpy() for i in range(most)])
            n = np.r_[above, batch.column(most).to_numpy()]
            size = np.r_[np.arange(most + 1), (cols != 0).sum(0)]
            at = np.arange(len(n))
            count = np.zeros((most + 1, len(n)), np.int64)
            for k in range(2, most):
                count[k] = n[np.maximum.accumulate(np.where(size == k, at, k))]
            above = np.array([n[np.flatnonzero(size == k)[-1]] for k in range(most + 1)])
            size, n, count = size[most + 1 :], n[most + 1 :], count[:, most + 1 :]
            known = [np.where(size > k, count[k], 0) for k in range(2, most)]
            same = np.flatnonzero((size > 2) & (count[np.maximum(size - 1, 0), np.arange(len(n))] == n))
            held = cols[:, same].copy()
            held[size[same] - 1, np.arange(len(same))] = 0
            none = np.zeros(len(same), np.int64)
            yield pack(arrow, [*np.concatenate([cols, held], axis=1), *(np.r_[k, none] for k in known), np.r_[np.zeros(len(n), np.int32), np.ones(len(same), np.int32)]])

    return phrases.select(*names, "n").repartition("c1", "c2").sortWithinPartitions(*names).mapInArrow(run, struct)


def _reversed(most: int, old: str, new: str) -> list[Column]:
    """Columns new1.. that hold old1.. backwards; zeros stay at the end."""
    words = F.reverse(F.filter(F.array(*[F.col(f"{old}{i + 1}") for i in range(most)]), lambda x: x != 0))
    return [F.coalesce(F.get(words, F.lit(i)), F.lit(0)).alias(f"{new}{i + 1}") for i in range(most)]


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `top` best phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and tabs; a null
    language is `und`, a null text empty, repeated rows count again, other columns are not read. A candidate has 2
    to `most` words (3 at least to set) and occurs a >= `least` times; score = floor(1000 a n / (l r)) of its worst cut
    into a first part that occurs l times and a last that occurs r times (ties: shorter first part), n all word
    occurrences of the language. Candidates inside a longer one of the same count are left out; order is score, a,
    both falling, then phrase by UTF-8 bytes. Products are exact up to 38 digits. An empty table gives an empty result.
    """
    if most < 3:
        raise ValueError("most must be 3 or more")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), utf8(text_col).alias("text"))
    seed = 0
    while True:
        every = written(word_counts(texts, seed), "words")
        if every.groupBy("code").count().where("count > 1").isEmpty():
            break
        seed += 1
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    words = every.where(F.col("n") >= least).select("code", "lang", "word", "n")
    word_bits = _bit_set(words, "code")
    pair_bits = _bit_set(pair_counts(texts, seed, word_bits).where(F.col("n") >= least), "code")
    windows = written(window_counts(texts, seed, word_bits, pair_bits, most), "windows")
    phrases = written(prefix_counts(windows, most, least), "phrases")

    w, c = [f"w{i + 1}" for i in range(most)], [f"c{i + 1}" for i in range(most)]
    left = _walk(phrases.select(*[F.col(x).alias(y) for x, y in zip(w, c)], "n"), most, "l").withColumnsRenamed(dict(zip(c, w)))
    right = _walk(phrases.select(*_reversed(most, "w", "c"), "n"), most, "r")
    right = right.select(*_reversed(most, "c", "w"), *[f"r{k}" for k in range(2, most)], "inside")
    parts = [f"{s}{k}" for s in "lr" for k in range(2, most)]
    counts = phrases.withColumn("inside", F.lit(0)).unionByName(left, allowMissingColumns=True).unionByName(right, allowMissingColumns=True)
    counts = counts.groupBy(*w).agg(F.max("n").alias("a"), F.max("inside").alias("inside"), *[F.max(p).alias(p) for p in parts]).where("inside = 0")

    length = sum((F.col(x) != 0).cast("int") for x in w)
    counts = counts.withColumn("size", length).withColumn("end", F.element_at(F.array(*w), F.col("size")))
    ends = words.select(F.col("code").alias("end"), F.col("n").alias("r1"))
    starts = words.select(F.col("code").alias("w1"), "lang", F.col("n").alias("l1"))
    rated = counts.join(ends.hint("merge"), "end").join(starts.hint("merge"), "w1").join(totals, "lang")

    def digits(x: Column) -> Column:
        return x.cast("decimal(19,0)")

    cuts = []
    for k in range(1, most):
        l_, r_ = F.col(f"l{k}"), F.element_at(F.array(*[F.col(f"r{j}") for j in range(1, most)]), F.greatest(F.col("size") - k, F.lit(1)))
        score = F.call_function("div", digits(1000 * F.col("a")) * digits(F.col("n")), digits(l_) * digits(r_))
        cuts.append(F.when(F.col("size") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), l_.alias("l"), r_.alias("r"))))
    rated = rated.select("lang", *w, "a", "n", F.array_min(F.array(*cuts)).alias("cut")).select("lang", *w, "a", "n", "cut.l", "cut.r", "cut.score")
    best = [F.desc("score"), F.desc("a")]
    near = rated.withColumn("rank", F.rank().over(W.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top).drop("rank")
    for i, x in enumerate(w):
        near = near.join(words.select(F.col("code").alias(x), F.col("word").alias(f"t{i + 1}")).hint("merge"), x, "left")
    named = near.withColumn("phrase", F.concat_ws(" ", *[f"t{i + 1}" for i in range(most)]))
    ranked = named.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
with t as (select coalesce(lang, 'und') as lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
p as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from t),
g as (select lang, k, array_to_string(w[s : s + k - 1], ' ') as phrase, count(*)::hugeint as f
      from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as s from p, (values (1), (2), (3), (4), (5)) v(k) where len(w) >= k) x group by 1, 2, 3),
n as (select lang, sum(f)::hugeint as n from g where k = 1 group by 1),
c as (select lang, k as size, phrase, f as a, string_split(phrase, ' ') as w from g where k > 1 and f >= 100),
kept as (select * from c where not exists (select 1 from c d where d.lang = c.lang and d.size > c.size and d.a >= c.a and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts as (select kept.lang, kept.phrase, kept.a, n.n, v.k, l.f as l, r.f as r, (1000 * kept.a * n.n) // (l.f * r.f) as score
         from kept join n on n.lang = kept.lang, (values (1), (2), (3), (4)) v(k), g l, g r
         where v.k < kept.size and l.lang = kept.lang and l.phrase = array_to_string(kept.w[1 : v.k], ' ')
           and r.lang = kept.lang and r.phrase = array_to_string(kept.w[v.k + 1 : kept.size], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from o where rank <= 2000
"""


@register("op11_collocations", SQL)
def op11_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
