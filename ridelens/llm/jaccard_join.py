"""Exact Jaccard self-join of word-shingle sets that uses relations between sets twice.

Index level: a set is indexed only under the first elements (prefix) of a global order, rare elements
first, and lists are cut into blocks of like size; size, position and a 256-bit parity map of the set
skip whole stretches of a list before anything is fetched.

Answer level: of every block one set, the lead, is compared with all others. For the rest of a list
answers are derived from the lead's: members of one component so far need no comparison, and for the others the lead's overlaps bound theirs, |a & b| <= min(oa, ob) + min(|a| - oa, |b| - ob).
Only pairs that survive all bounds are compared element by element, so no list yields all its pairs
for a group of near copies, and no link between different components is lost.

Equal sets are one node from the start. Elements are 64-bit hashes of shingles. The order of elements
comes from Misra-Gries counts; any order gives the same result, a bad one only more comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.base import pack, register, schema_of, table, utf8
from ridelens.llm.graph import components

COUNTERS = 1 << 17  # of a task's summary; also the most elements whose order is broadcast
BROADCAST_ROWS = 400_000  # requests for texts are broadcast up to this number of rows, joined beyond
PARTNERS = 64
COUNT_BUCKETS = 32  # a task hands on its counts as so many packed rows at most
SPREAD = 256  # larger sets have counts of their elements by stretch of the hashes
BLOCK = 8192  # about the rows of a list on one side of a comparison
_MUL = np.uint64(0x9E3779B97F4A7C15)
_COUNT = np.dtype([("id", "<u8"), ("n", "<i8")])


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `n` words; a shorter text is one run; no words, no runs."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    out = h[: len(h) - n + 1] + np.uint64(n)
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * _MUL + h[i : len(h) - n + 1 + i]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def parity(s: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the elements that fall on it: two sets differ in at least as many elements as bits."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def spread(s: np.ndarray) -> bytes | None:
    """How many elements fall on each stretch of the hashes, one stretch for eight elements or so: two sets differ in at least
    as many elements as these counts do. Small sets, which `parity` tells apart, have none."""
    if len(s) <= SPREAD:
        return None
    bits = (len(s) // 8 - 1).bit_length()
    n = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def surely_differ(x: bytes, y: bytes) -> int:
    """The least number of elements in which two sets with these `spread` counts differ."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    n = min(len(a), len(b))
    return int(np.abs(a.reshape(n, -1).sum(1) - b.reshape(n, -1).sum(1)).sum())


class Summary:
    """Misra-Gries counters over arrays of elements."""

    def __init__(self, k: int) -> None:
        self.k, self.buffer, self.held = k, [], 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, s: np.ndarray) -> None:
        self.buffer.append(s)
        self.held += len(s)
        if self.held > 1_500_000:
            self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        new, n = np.unique(np.concatenate(self.buffer), return_counts=True)
        self.buffer, self.held = [], 0
        keys, where = np.unique(np.r_[self.keys, new], return_inverse=True)
        counts = np.bincount(where, np.r_[self.counts, n]).astype(np.int64)
        if len(counts) > self.k:
            counts -= np.partition(counts, len(counts) - self.k - 1)[len(counts) - self.k - 1]
        keep = counts > 0
        self.keys, self.counts = keys[keep], counts[keep]


def profile(docs: DataFrame, n: int, id_col: str, text_col: str, k: int = COUNTERS) -> DataFrame:
    """One pass over all texts. Rows with `sig`: id, size, sig, m (parity map), counts (`spread`). Rows without: a task's element counts of one
    `bucket`, packed in `data`, so that their number does not grow with the elements that the tasks hold each for itself."""
    struct, arrow = schema_of("id long, size long, sig binary, m0 long, m1 long, m2 long, m3 long, counts binary, bucket int, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(k)
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, n)
                out.append((key, len(s), blake2b(s.tobytes(), digest_size=16).digest(), *parity(s).tolist(), spread(s), None, None))
                summary.add(s)
            if out:
                yield pack(arrow, list(zip(*out)))
        summary.settle()
        data = np.empty(len(summary.keys), _COUNT)
        data["id"], data["n"] = summary.keys, summary.counts  # the keys are sorted, so a bucket is a stretch of them
        cuts = np.searchsorted(summary.keys >> np.uint64(32), np.arange(COUNT_BUCKETS + 1, dtype=np.uint64) * np.uint64((1 << 32) // COUNT_BUCKETS))
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        none = [None] * len(full)
        yield pack(arrow, [*[none] * 8, full.astype(np.int32), [data[cuts[i] : cuts[i + 1]].tobytes() for i in full]])

    return docs.select(F.col(id_col).cast("long"), utf8(text_col)).mapInArrow(run, struct)


def element_order(counts: DataFrame, most: int = COUNTERS) -> tuple[np.ndarray, np.ndarray]:
    """The commonest elements (at most `most`) and their place in the order, which they close by rising count."""
    struct, arrow = schema_of("id long, n long")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every, where = np.unique(np.concatenate([keys, *(h["id"] for h in held)]), return_inverse=True)
            return every, np.bincount(where, np.concatenate([n, *(h["n"] for h in held)]), len(every)).astype(np.int64)

        for batch in batches:
            for blob in batch.column(0).to_pylist():
                held.append(np.frombuffer(blob, _COUNT))
                if sum(map(len, held)) > 1_500_000:
                    (keys, n), held = merged(), []
        keys, n = merged()
        keys, n = keys[n > 1], n[n > 1]
        for i in range(0, len(keys), 200_000):
            yield pack(arrow, [keys[i : i + 200_000].view(np.int64), n[i : i + 200_000]])

    # an element is of one bucket, so its counts meet in one task
    sums = counts.repartition("bucket").select("data").mapInArrow(total, struct).withColumn("level", F.floor(F.log2("n") * 4).cast("int"))
    cut, held = None, 0
    for level, n in sums.groupBy("level").count().orderBy(F.desc("level")).collect():  # a few hundred rows
        if held + n > most:
            break
        cut, held = level, held + n
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = sums.where(F.col("level") >= cut).select("id", "n").collect()
    keys, n = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows])
    place = np.empty(len(n), np.int64)
    place[np.lexsort((keys, n))] = np.arange(len(n))
    by = np.argsort(keys)
    return keys[by], place[by]


def postings(docs: DataFrame, n: int, percent: int, order: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """(token, id, pos) of every prefix element that two rows share at least.

    Elements of the broadcast order come as rows. All others travel packed and compressed to the task of
    their bucket, which drops those without a partner that size and position allow: nearly all of them.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(order)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = 4 * parts
    struct, arrow = schema_of("bucket int, data binary, token long, id long, pos int")
    packed = np.dtype([("token", "<u4"), ("id", "<i8"), ("pos", "<u4"), ("size", "<u4")])

    def press(data: np.ndarray) -> bytes:
        # column by column, ids as steps: what lies in one blob comes from one batch, so all but the tokens shrinks to little
        columns = [data["token"], np.diff(data["id"], prepend=np.int64(0)), data["pos"], data["size"]]
        return len(data).to_bytes(4, "little") + pa.compress(b"".join(c.tobytes() for c in columns), "zstd", asbytes=True)

    def unpress(blob: bytes) -> np.ndarray:
        n = int.from_bytes(blob[:4], "little")
        raw, at = pa.decompress(pa.py_buffer(blob).slice(4), packed.itemsize * n, "zstd", asbytes=True), 0
        data = np.empty(n, packed)
        for name in packed.names:
            data[name] = np.frombuffer(raw, packed[name], n, at)
            at += packed[name].itemsize * n
        data["id"] = np.cumsum(data["id"])
        return data

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place = shared.value
        for batch in batches:
            tokens, ids, pos, sizes, listed = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, n)
                if not len(s):
                    continue
                length = len(s) - -(-percent * len(s) // 100) + 1
                at = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
                late = common[at] == s if len(common) else np.zeros(len(s), bool)
                first = s[~late]
                if len(first) < length:
                    first = np.r_[first, s[late][np.argsort(place[at[late]])]]
                first = first[:length]
                tokens.append(first)
                ids.append(np.full(len(first), key, np.int64))
                pos.append(np.arange(len(first)))
                sizes.append(np.full(len(first), len(s)))
                listed.append(np.arange(len(first)) >= int((~late).sum()))
            if not tokens:
                continue
            token, key, where, size, row = (np.concatenate(x) for x in (tokens, ids, pos, sizes, listed))
            if row.any():
                k = int(row.sum())
                yield pack(arrow, [[None] * k, [None] * k, token[row].view(np.int64), key[row], where[row].astype(np.int32)])
            token, key, where, size = token[~row], key[~row], where[~row], size[~row]
            bucket = ((token >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            data = np.empty(len(by), packed)
            data["token"], data["id"], data["pos"] = (token[by] & np.uint64(0xFFFFFFFF)), key[by], where[by]
            data["size"] = size[by]
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            blobs = [press(data[cuts[b] : cuts[b + 1]]) for b in full]
            yield pack(arrow, [full.astype(np.int32), blobs, *[[None] * len(full)] * 3])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        where: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(unpress(blob))
                where.append(np.full(len(held[-1]), bucket, np.int64))
                rows += len(held[-1])
        if not rows:
            return
        data = np.concatenate(held)
        token = (np.concatenate(where) << 32) | data["token"].astype(np.int64)
        by = np.lexsort((data["size"], token))
        token, data = token[by], data[by]
        keep = np.flatnonzero(_has_partner(token, data["size"].astype(np.int64), data["pos"].astype(np.int64), percent))
        for i in range(0, len(keep), 200_000):
            at = keep[i : i + 200_000]
            # bucket elements are told from broadcast ones, whose hashes are any number, by the pair (kind, token)
            yield pack(small_arrow, [np.ones(len(at), np.int32), token[at], data["id"][at], data["pos"][at].astype(np.int32)])

    small, small_arrow = schema_of("kind int, token long, id long, pos int")
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), utf8(text_col)).mapInArrow(emit, struct).checkpoint()
    rare = rows.where("bucket is not null").select("bucket", "data").repartition(parts, "bucket").mapInArrow(settle, small)
    return rare.unionByName(rows.where("bucket is null").select(F.lit(0).alias("kind"), "token", "id", "pos"))


def _has_partner(token: np.ndarray, size: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of lists, ordered by token and size, have a partner in their list that the bounds let pass.

    Round k compares every row with the k-th after it. A row leaves once the next size is too large, or once
    it and all rows behind it in its list are known to have a partner.
    """
    n = len(token)
    alive = np.zeros(n, bool)
    ends = np.searchsorted(token, token, "right")
    at, k = np.arange(n), 1
    while len(at):
        at = at[at + k < ends[at]]
        at = at[100 * size[at] >= percent * size[at + k]]
        need = -(-percent * (size[at] + size[at + k]) // (100 + percent))
        good = at[np.minimum(size[at] - pos[at], size[at + k] - pos[at + k]) >= need]
        alive[good] = alive[good + k] = True
        k += 1
        dead = np.append(np.flatnonzero(~alive), n)
        at = at[~alive[at] | (dead[np.searchsorted(dead, at + k)] < ends[at])] if len(at) else at
    return alive


def thin(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), each once, without those of large sets whose `spread` counts (id, size, counts) differ too much for a link."""
    struct, arrow = schema_of("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sa, sb, ca, cb = (batch.column(i).to_pylist() for i in range(6))
            need = [-(-percent * (m + n) // (100 + percent)) if m and n else 0 for m, n in zip(sa, sb)]
            ok = [i for i in range(len(a)) if ca[i] is None or cb[i] is None or surely_differ(ca[i], cb[i]) <= sa[i] + sb[i] - 2 * need[i]]
            yield pack(arrow, [[a[i] for i in ok], [b[i] for i in ok]])

    side = lambda x: counts.select(F.col("id").alias(x), F.col("size").alias(f"s{x}"), F.col("counts").alias(f"c{x}"))
    both = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.select("a", "b", "sa", "sb", "ca", "cb").mapInArrow(run, struct).distinct()


def overlaps(docs: DataFrame, pairs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, o): |a & b| of every pair, from the whole texts.

    The texts of a lead's partners are dealt over salts, one for each `PARTNERS` of them, with a copy of the
    lead's, so a lead of very many partners is no hot group, and a task holds one set and the current batch (several
    sets only where rows share the lead's id). A pair comes out once, however many salts of its lead a task gets.
    """
    pairs = pairs.checkpoint()
    number = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PARTNERS)).alias("salts"))
    pairs = pairs.join(number, "a")
    salt = F.pmod(F.xxhash64("b"), F.col("salts"))
    member = pairs.select(F.col("b").alias("id"), F.col("a").alias("lead"), salt.alias("salt"), F.lit(1).alias("side"))
    lead = pairs.select(F.col("a").alias("id"), F.col("a").alias("lead"), salt.alias("salt"), F.lit(0).alias("side")).distinct()
    asks = member.unionByName(lead).checkpoint()
    few = asks.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    got = texts.join(F.broadcast(asks) if few else asks, "id").select("lead", "salt", "side", "id", "text")
    struct, arrow = schema_of("a long, b long, o long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            out = []
            for a, salt, side, key, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                s = shingle_set(text, n)
                if side == 0:
                    sets = [*sets, s] if now == (a, salt) else [s]
                    now = (a, salt)
                elif now == (a, salt):
                    out += [(a, key, int(np.isin(s, x, assume_unique=True).sum())) for x in sets]
            if out:
                yield pack(arrow, list(zip(*out)))

    return got.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "side").mapInArrow(run, struct)


def remaining_pairs(lists: DataFrame, percent: int, maps: DataFrame | None = None) -> DataFrame:
    """(a, b) of one list and two labels that pass every bound.

    Rows of a list come in two parts: loose ones, that do not carry its commonest label, and the rest. Both are
    cut by a hash of the id into blocks of about `BLOCK` rows. Every pair of loose blocks, and of a loose block with one
    of the rest, is a group of its own, so a task holds one loose block while another streams by, and a hot list is
    dealt over many tasks. Lists with a single label are settled and not looked at. Parity maps are columns of `lists` or
    come, for the rows that are left, from `maps` (id, size, m0 to m3).
    """
    struct, arrow = schema_of("a long, b long")
    names = ["id", "pos", "size", "m0", "m1", "m2", "m3", "lead", "o", "label"]

    def compare(held: dict[str, np.ndarray], new: dict[str, np.ndarray], same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # both sides by size: a block of one side meets only the stretch of the other that is neither too short nor too long
        left, right = ({k: v[np.argsort(side["size"], kind="stable")] for k, v in side.items()} for side in (held, new))
        for i in range(0, len(left["id"]), 256):
            some = {k: v[i : i + 256] for k, v in left.items()}
            lo = np.searchsorted(right["size"], -(-percent * some["size"][0] // 100))
            hi = np.searchsorted(right["size"], 100 * some["size"][-1] // percent, "right")
            for j in range(lo, hi, 8192):
                part = {k: v[j : min(j + 8192, hi)] for k, v in right.items()}
                sa, sb = some["size"].astype(np.int32)[:, None], part["size"].astype(np.int32)[None, :]
                most = np.minimum(sa - some["pos"].astype(np.int32)[:, None], sb - part["pos"].astype(np.int32)[None, :])
                ok = most.astype(np.float32) * (100 + percent) >= (sa + sb).astype(np.float32) * np.float32(percent * 0.9999)
                ok &= some["label"][:, None] != part["label"][None, :]
                x, y = np.nonzero(ok)
                if same:
                    once = some["id"][x] < part["id"][y]
                    x, y = x[once], y[once]
                sa, sb = some["size"][x], part["size"][y]
                need = -(-percent * (sa + sb) // (100 + percent))
                left_over = sa + sb - 2 * need
                far = np.zeros(len(x), np.int64)
                for m in names[3:7]:
                    far += np.bitwise_count((some[m][x] ^ part[m][y]).view(np.uint64))
                    near = far <= left_over
                    if not near.all():
                        x, y, sa, sb, need, left_over, far = (v[near] for v in (x, y, sa, sb, need, left_over, far))
                if not len(x):
                    continue
                oa, ob = some["o"][x], part["o"][y]
                derived = np.where((some["lead"][x] == part["lead"][y]) & (oa >= 0) & (ob >= 0), np.minimum(oa, ob) + np.minimum(sa - oa, sb - ob), need)
                keep = (derived >= need) & (np.minimum(sa - some["pos"][x], sb - part["pos"][y]) >= need) & (need <= np.minimum(sa, sb))
                if keep.any():
                    a, b = some["id"][x[keep]], part["id"][y[keep]]
                    yield np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            *key, own, second = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            cols = {k: batch.column(6 + i).to_numpy(zero_copy_only=False).astype(np.int64) for i, k in enumerate(names)}
            cuts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in key], axis=0), True]) if len(own) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if tuple(k[a] for k in key) != now:
                    now, held = tuple(k[a] for k in key), {k: v[:0] for k, v in cols.items()}
                loose, rest = ({k: v[a:b][m] for k, v in cols.items()} for m in (~second[a:b].astype(bool), second[a:b].astype(bool)))
                found = [*compare(held, loose, False), *compare(loose, loose, True)] if own[a] else []
                held = {k: np.r_[held[k], v] for k, v in loose.items()}
                for pair in (*found, *compare(held, rest, False)):
                    yield pack(arrow, pair)

    labels = lists.groupBy("kind", "token", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = labels.groupBy("kind", "token").agg(F.max_by("label", "n").alias("most"), F.max("n").alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    mixed = mixed.select("kind", "token", "most", blocks(F.col("all") - F.col("top")).alias("few"), blocks(F.col("top")).alias("many"))
    rows = lists.join(mixed, ["kind", "token"])
    rows = (rows if maps is None else rows.join(maps, ["id", "size"])).withColumn("main", F.col("label") == F.col("most"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("many")).otherwise(F.col("few"))).cast("int"))
    # loose blocks are numbered from 0, the others from `few`; a loose block meets itself where it meets the first of the others
    met = F.when(F.col("main"), F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1), F.col("block")))
    rows = rows.withColumn("block", F.when(F.col("main"), F.col("few") + F.col("block")).otherwise(F.col("block"))).withColumn("with", F.explode(met))
    left, right = F.least("block", "with"), F.greatest("block", "with")
    rows = rows.select("token", "kind", left.alias("left"), right.alias("right"), (right == F.col("few")).alias("own"), (F.col("block") > F.col("with")).alias("second"), *names)
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much to compare: not to be coalesced
    return rows.repartition(parts, "token", "kind", "left", "right").sortWithinPartitions("token", "kind", "left", "right", "second").mapInArrow(run, struct).distinct()


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_shingles, component_id of every row: rows link when their sets of `n`-word shingles have a Jaccard
    similarity of `percent` / 100 or more, and a component is named by its smallest id.

    Words are lower-cased (A-Z) and cut at white space. Null and empty texts, and texts without words, have no
    shingle and link with nothing. Rows that share an id should be one document; each is
    placed by its own text. A row without an id gets no component and
    links with nothing. An empty table gives an empty result; other columns are not read.
    """
    seen = profile(docs, n, id_col, text_col).checkpoint()
    sets = seen.where("sig is not null").drop("bucket", "data")
    order = element_order(seen.where("sig is null"))
    nodes = sets.where("size > 0 and id is not null")
    reps = nodes.groupBy("sig").agg(F.min("id").alias("rep"))
    lone = nodes.join(reps, "sig").where("id = rep").dropDuplicates(["id", "sig"]).drop("rep", "sig").checkpoint()

    bands = F.floor(F.log(F.col("size").cast("double")) / F.lit(-log(percent / 100)))
    lists = postings(docs, n, percent, order, id_col, text_col).join(lone.select("id", "size"), "id").withColumn("band", bands).checkpoint()
    leads = lists.groupBy("kind", "token", "band").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    asked = lists.join(leads, ["kind", "token", "band"]).where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    one = lone.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("size", "m0", "m1", "m2", "m3")])
    two = lone.select(F.col("id").alias("b"), "size", "m0", "m1", "m2", "m3")
    need = F.ceil(F.lit(percent) * (F.col("a_size") + F.col("size")) / F.lit(100 + percent))
    far = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(m))) for m in ("m0", "m1", "m2", "m3")), F.lit(0))
    near = asked.join(one, "a").join(two, "b").where((need <= F.least("a_size", "size")) & (far <= F.col("a_size") + F.col("size") - 2 * need)).select("a", "b")
    sizes = lone.groupBy("id").agg(F.max("size").alias("size"))
    # an id with several texts has no counts, as those of one text say nothing of the others
    several = lone.groupBy("id").count().where("count > 1")
    counts = lone.where("counts is not null").select("id", "size", "counts").join(several, "id", "left_anti").checkpoint()

    def linked(found: DataFrame) -> DataFrame:
        both = found.join(sizes.select(F.col("id").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("id").alias("b"), F.col("size").alias("sb")), "b")
        return both.withColumn("ok", F.lit(100) * F.col("o") >= F.lit(percent) * (F.col("sa") + F.col("sb") - F.col("o"))).select("a", "b", "o", "ok")

    first = linked(overlaps(docs, thin(near, counts, percent), n, id_col, text_col)).checkpoint()
    before = components(first.where("ok").select("a", "b"))
    known = lists.join(leads, ["kind", "token", "band"], "left").join(first.select(F.col("a").alias("lead"), F.col("b").alias("id"), "o"), ["lead", "id"], "left").join(before, "id", "left")
    own = F.when(F.col("id").eqNullSafe(F.col("lead")), F.col("size")).otherwise(F.coalesce("o", F.lit(-1)))
    known = known.select("kind", "token", "id", "pos", "size", F.coalesce("lead", F.lit(-1)).alias("lead"), own.cast("long").alias("o"), F.coalesce("component", "id").alias("label")).checkpoint()
    rest = remaining_pairs(known, percent, lone.select("id", "size", "m0", "m1", "m2", "m3"))
    second = linked(overlaps(docs, thin(rest, counts, percent), n, id_col, text_col)).checkpoint()
    found = components(second.where("ok").select("a", "b").unionByName(before.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    named = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("c"))
    out = sets.join(named, "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.when(F.col("size") > 0, F.coalesce("c", "id")).otherwise(F.col("id"))).alias("component_id"))


SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) end) as g from w),
n as (select doc_id, count(*) as n_shingles from s group by 1),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n_shingles + y.n_shingles - o)),
l as (select a, b from e union all select b, a from e),
r(doc_id, c) as (select doc_id, doc_id from documents union select l.b, r.c from r join l on l.a = r.doc_id)
select r.doc_id, coalesce(max(n.n_shingles), 0)::bigint as n_shingles, min(c) as component_id from r left join n using (doc_id) group by r.doc_id
"""


@register("op6_jaccard_join", SQL)
def op6_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)
