"""Document fingerprints that keep edit distance: a shared random walk over characters, then sampled digits.

All texts are read by the same walk: at step s the walk shows the character it stands on and moves on
or stays by a random bit of (s, character class). After an edit two walks fall into step again, so a
small edit distance becomes a small Hamming distance of what they show. A fingerprint samples that
sequence at shared random steps, one hexadecimal digit each: for texts of like length the steps are
the same, because slot k always takes the step of lowest random priority below the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.base import pack, register, schema_of, table, written
from ridelens.llm.graph import components

SLOTS = 256
BLOCK = 8192  # most classes of a band bucket on one side of a comparison
_CLASSES, _PERIOD = 64, 4096  # the walk's bits repeat after so many steps
_EMPTY = "-"


class Walk:
    """The shared randomness, a function of `seed` and `slots` alone."""

    def __init__(self, slots: int = SLOTS, seed: int = 20_240_117) -> None:
        rng = np.random.default_rng(seed)
        bits = rng.integers(0, 2, (_CLASSES, _PERIOD), dtype=np.uint8)
        stay = np.full((_CLASSES, _PERIOD), 60, np.int64)  # steps spent on a character that is entered at a step
        for back in range(59, -1, -1):
            stay[np.roll(bits, -back, axis=1) == 1] = back + 1
        self.stay = [row.astype(np.uint8).tobytes() for row in stay]
        # Lengths at which a slot's sampled step changes: the records of an endless sequence of priorities.
        records = np.ones((slots, 1))
        while records[:, -1].min() < 2.0**45:
            records = np.c_[records, np.floor(records[:, -1] / rng.random(slots)) + 1]
        self.records = np.minimum(records, 2.0**60).astype(np.int64)
        self.slots = slots
        self.salt = rng.integers(1, 1 << 62, slots, dtype=np.uint64)

    @staticmethod
    def codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def steps(self, codes: np.ndarray, start: int = 0) -> np.ndarray:
        """The step at which each character is entered, and last the step after the text."""
        classes = ((codes.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(12)) % np.uint64(_CLASSES)).astype(np.uint8).tobytes()
        stay, turn = self.stay, _PERIOD - 1
        return np.fromiter(accumulate(classes, lambda s, c: s + stay[c][s & turn], initial=start), np.int64, len(codes) + 1)

    def fingerprint(self, codes: np.ndarray, steps: np.ndarray) -> str:
        """A digit per slot: a salted hash of the three characters at the sampled step."""
        if not len(codes):
            return _EMPTY * self.slots
        length = steps[-1]
        at = np.where(self.records <= length, self.records, 0).max(axis=1) - 1
        i = np.searchsorted(steps, at, "right") - 1
        padded = np.r_[codes, np.zeros(2, np.uint32)].astype(np.uint64)
        gram = padded[i] << np.uint64(42) ^ padded[i + 1] << np.uint64(21) ^ padded[i + 2]
        mixed = (gram ^ self.salt) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return "".join(map("0123456789abcdef".__getitem__, (mixed >> np.uint64(60)).tolist()))


def _like(a: str, b: str) -> float:
    return sum(map(str.__eq__, a, b)) / len(a)


def likeness(a: Column, b: Column, slots: int = SLOTS) -> Column:
    """Share of equal digits of two fingerprint columns, 0 to 1."""
    same = F.filter(F.sequence(F.lit(1), F.lit(slots)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return F.size(same) / F.lit(float(slots))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", walk: Walk | None = None) -> DataFrame:
    """`id_col`, n_chars, fingerprint of every row; no shuffle.

    Null counts as empty, and an empty text has a fingerprint of its own that is unlike any other. Equal
    texts have equal fingerprints, repeated rows stay, other columns are not read.
    """
    walk = walk or Walk()
    struct, arrow = schema_of("__id long, n_chars long, fingerprint string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = walk.codes(text or "")
                out.append((key, len(codes), walk.fingerprint(codes, walk.steps(codes))))
            yield pack(arrow, list(zip(*out)) if out else [[]] * 3)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, struct).withColumnRenamed("__id", id_col)


def _linked(left: np.ndarray, right: np.ndarray | None, least: float, width: int, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two blocks of fingerprints (rows of bytes), or of one, that are alike and agree in no band before `band`."""
    slots = left.shape[1]
    need = int(np.ceil(least * slots - 1e-9))
    other = left if right is None else right
    for i in range(0, len(left), 64):
        for j in range(0 if right is not None else i, len(other), 512):
            same = left[i : i + 64, None] == other[None, j : j + 512]
            if slots % 8:
                count = same.sum(2)
            else:
                count = np.bitwise_count(same.view(np.uint64)).sum(2, dtype=np.int32)
            x, y = np.nonzero(count >= need)
            if right is None:
                once = x + i < y + j
                x, y = x[once], y[once]
            for k in range(0, len(x), 16384):
                u, v = x[k : k + 16384], y[k : k + 16384]
                first = same[u, v, : band * width].reshape(len(u), band, width).all(2).any(1)
                yield u[~first] + i, v[~first] + j


def _alike(prints: DataFrame, id_col: str, least: float, width: int, slots: int) -> DataFrame:
    """(fingerprint, component, links) of every fingerprint that a row with an id has."""
    groups = prints.where(F.col(id_col).isNotNull()).groupBy("fingerprint").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n"))
    groups = written(groups, "prints")
    # the low byte of a key is the band
    keys = F.transform(F.sequence(F.lit(0), F.lit(slots // width - 1)), lambda b: F.shiftleft(F.xxhash64(b, F.substring("fingerprint", b * width + 1, F.lit(width))), 8).bitwiseOR(b.cast("long")))
    rows = groups.where(~F.startswith("fingerprint", F.lit(_EMPTY))).select(F.explode(keys).alias("key"), "rep")
    met, met_arrow = schema_of("key long, rep long, block long")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a key follow each other; a key with one row goes, and a batch's last row, if first of its key, waits for the next batch
        last, seen, waits = None, 0, False  # key and id of the last row, its place in its bucket, and whether it is still held back
        for batch in batches:
            key, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(key):
                continue
            if waits:
                key, rep, seen = np.r_[last[0], key], np.r_[last[1], rep], 0
            new = np.r_[waits or last is None or key[0] != last[0], key[1:] != key[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            place = np.where(start < 0, np.arange(len(key)) + seen + 1, np.arange(len(key)) - start)
            keep = ~new | np.r_[~new[1:], False]
            last, seen, waits = (key[-1], rep[-1]), int(place[-1]), bool(new[-1])
            yield pack(met_arrow, [key[keep], rep[keep], place[keep] // BLOCK])

    bucket = rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(meet, met).checkpoint()
    blocks = bucket.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    dealt = bucket.join(groups, "rep").join(blocks, "key").select("key", "rep", "n", "fingerprint", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with"))
    dealt = dealt.select("key", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), (F.col("block") > F.col("with")).alias("second"), "rep", "n", "fingerprint")
    out, out_arrow = schema_of("a long, b long, links long")

    def compare(now: tuple, second: list, rep: list, n: list, digits: list) -> tuple[list, list, list]:
        cut = sum(not x for x in second)
        table = np.frombuffer("".join(digits).encode(), np.uint8).reshape(len(digits), -1)
        sizes, links = np.array(n, np.int64), np.zeros(len(n), np.int64)
        root = np.arange(len(n))
        right, shift = (None, 0) if now[1] == now[2] else (table[cut:], cut)
        for x, y in _linked(table[:cut], right, least, width, now[0] & 255):
            y = y + shift
            np.add.at(links, x, sizes[y])
            np.add.at(links, y, sizes[x])
            u, v = root[x], root[y]
            for p, q in np.unique(np.c_[u, v][u != v], axis=0).tolist():
                while root[p] != p:
                    p = root[p]
                while root[q] != q:
                    q = root[q]
                root[max(p, q)] = min(p, q)
            while (root[root] != root).any():
                root = root[root]
        ids, some = np.array(rep, np.int64), np.flatnonzero(links)
        return ids[some].tolist(), ids[root[some]].tolist(), links[some].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, [[], [], [], []]
        for batch in batches:
            cols, got = [batch.column(i).to_pylist() for i in range(7)], [[], [], []]
            for key, a, b, *row in zip(*cols):
                if (key, a, b) != now:
                    if len(held[0]) > 1:
                        for x, y in zip(got, compare(now, *held)):
                            x += y
                    now, held = (key, a, b), [[], [], [], []]
                for x, y in zip(held, row):
                    x.append(y)
            if got[0]:
                yield pack(out_arrow, got)
        if len(held[0]) > 1:
            yield pack(out_arrow, compare(now, *held))

    links = dealt.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "second", "rep").mapInArrow(run, out).checkpoint()
    ends = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    named = groups.join(components(links.select("a", "b")).withColumnRenamed("id", "rep"), "rep", "left").join(ends, "rep", "left")
    return named.select("fingerprint", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))


def similar_documents(prints: DataFrame, id_col: str = "doc_id", least: float = 0.8, width: int = 8, slots: int = SLOTS) -> DataFrame:
    """Every row of `prints` with component and links appended: banding over sampled digits, then verification.

    Equal fingerprints are one class from the start. A band is `width` digits (at most 256 bands). All classes with
    the same band value are compared with each other, and pairs of likeness `least` or more are links; a pair that
    agrees in several bands counts in the first. `component` is the smallest id that links reach, `links` the
    number of other rows with an id that a row is linked with. Pairs that agree in no band are not found: of two
    fingerprints of likeness s that is a share of about (1 - s^width)^(slots / width), 0.3 % at 0.8.

    No bucket is capped. Its classes are cut into blocks of `BLOCK`, and pairs of blocks are dealt over the tasks:
    a task holds two blocks, and comparisons, but not rows, grow with the square of a bucket. Empty texts are
    alike. Rows without an id get no component and no links.
    """
    out = prints.join(_alike(prints, id_col, least, width, slots), "fingerprint", "left")
    known = F.col(id_col).isNotNull()
    return out.select(*prints.columns, F.when(known, F.col("component")).alias("component"), F.when(known, F.col("links")).alias("links"))


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", walk: Walk | None = None) -> DataFrame:
    """`id_col`, n_chars, edited_text_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last quarter (rounded down) replaced by as much of the start of the next document,
    ids ascending, the first after the last; rows of one id follow each other by their first 16 characters and then
    by a hash of the text, a null id comes first. The ids are cut into ranges at quantiles of all ids; each range is
    one sorted run of a task, which gets a copy of the next range's first row. Texts travel compressed. A task
    holds two texts and the current batch. The driver sees one id per range. A single row is its own next; an
    empty table gives an empty result; other columns are not read.
    """
    walk = walk or Walk()
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 20_000)).first()[0] or []
    bounds = sorted(set(found))

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("k") < bounds[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    own = rows.select(place(0, len(bounds)).alias("range"), F.lit(False).alias("guest"), "k", "id", "text")
    heads = sorted((r["range"], r["k"]) for r in own.groupBy("range").agg(F.min("k").alias("k")).collect())
    before = {heads[(i + 1) % len(heads)][1]: heads[i][0] for i in range(len(heads))}
    if before:
        lookup = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        guests = rows.where(F.col("k").isin(*before)).select(lookup[F.col("k")].alias("range"), F.lit(True).alias("guest"), "k", "id", "text")
        own = own.unionByName(guests)
    body = own.select("range", "guest", "k", "id", F.substring("text", 1, 16).alias("begin"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    packed, packed_arrow = schema_of("range int, guest boolean, k long, id long, begin string, h long, text binary")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            small = pa.array([squeeze(t) for t in batch.column(6).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], small], schema=packed_arrow)

    runs = body.mapInArrow(shrink, packed).repartition(parts, "range").sortWithinPartitions("range", "guest", "k", "begin", "h").drop("begin", "h")
    struct, arrow = schema_of("__id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = zstandard.ZstdDecompressor().decompress
        last = None  # range, id, text, codes, steps, fingerprint
        for batch in batches:
            out = []
            for where, guest, _, key, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if guest and (last is None or last[0] != where):
                    continue  # a further row with the first id of the next range
                text = whole(text).decode()
                codes = walk.codes(text)
                steps = walk.steps(codes)
                now = (where, key, text, codes, steps, walk.fingerprint(codes, steps))
                if last is not None and last[0] == where:
                    _, old_key, old, old_codes, old_steps, old_print = last
                    keep = len(old_codes) - len(old_codes) // 4
                    taken = codes[: len(old_codes) - keep]
                    edited = np.r_[old_codes[:keep], taken]
                    edited_steps = np.r_[old_steps[:keep], walk.steps(taken, int(old_steps[keep]))]
                    other = walk.fingerprint(edited, edited_steps)
                    digest = hashlib.sha256((old[:keep] + text[: len(taken)]).encode("utf-8")).hexdigest()
                    out.append((old_key, len(old_codes), digest, old_print, other, _like(old_print, other), _like(old_print, now[5])))
                last = None if guest else now
            if out:
                yield pack(arrow, list(zip(*out)))

    return runs.mapInArrow(run, struct).withColumnRenamed("__id", id_col)


@register("op9_edit_fingerprint")
def op9_edit_fingerprint(spark, sf_dir):
    return similar_documents(written(fingerprints_with_next(table(spark, sf_dir, "documents")), "fingerprints"))
