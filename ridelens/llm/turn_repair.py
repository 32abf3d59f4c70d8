"""Repair of conversation structure: the cheapest edits that give legal role turns, and the least audit among them.

A conversation is legal when its role initials read `(s?(ua)+)?`. A cost DP runs from the last row to the first
over (rows consumed, state); the arcs on cheapest ways form an acyclic graph whose nodes are ranked by prefix
doubling: round k ranks each arc by the least audit of 2^k initials that begins with it, from its own rank and
that of the best arc where those initials end. The final ranks select each node's arc, and doubled pointers unroll the
chosen path. A node has at most one arc per initial, so a prefix of an audit leads to one node.

Texts are never held: a first pass over sorted rows keeps a few bytes a row and gives reports with audits, a
second streams the sorted texts behind their conversation's report and applies it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.base import pack, register, schema_of, table

BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, OPEN_END = 0, 2, 3, 2, 1  # costs; OPEN_END is added to undeleted truncated rows
BATCH_ROWS = 50_000  # conversations are solved together until they hold so many rows
START, S, U, A = range(4)
_EMITS = np.array([U, U, A, U])  # the state after a user or assistant turn that fits
_NEVER = 1 << 40
_SEEN = ["conv_id", "turn", "role", "text"]
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def least_paths(tail: np.ndarray, head: np.ndarray, label: np.ndarray, vertices: int, starts: np.ndarray, longest: int) -> list[bytes]:
    """The least label string from each start to a vertex without arcs; `tail` ascends, labels differ within a tail.

    A string that ends is less than one that goes on. `longest` bounds the length of every path.
    """
    n = len(tail)
    if not n:
        return [b""] * len(starts)
    first = np.flatnonzero(np.r_[True, tail[1:] != tail[:-1]])
    owner, number = tail[first], np.arange(n)

    def best(rank: np.ndarray) -> np.ndarray:
        out = np.full(vertices + 1, n)  # arc n and vertex `vertices` stand for the end
        out[owner] = np.minimum.reduceat(rank[:-1] * n + number, first) % n
        return out

    rank = np.r_[np.unique(label, return_inverse=True)[1] + 1, 0]
    last, length = np.r_[head, vertices], 1
    while length < longest:
        then = best(rank)[last]
        found, rank = np.unique(rank * (n + 2) + rank[then], return_inverse=True)
        last, length = last[then], 2 * length
        if len(found) == n + 1:
            break
    chosen = best(rank)
    jump = np.r_[chosen[head], n]
    arc, path, at = chosen[starts], np.arange(len(starts)), np.zeros(len(starts), np.int64)
    live = arc < n
    arc, path, at, step = arc[live], path[live], at[live], 1
    while True:
        then = jump[arc]
        live = then < n
        if not live.any():
            break
        arc, path, at = np.r_[arc, then[live]], np.r_[path, path[live]], np.r_[at, at[live] + step]
        jump, step = jump[jump], 2 * step
    text = label[arc[np.lexsort((at, path))]].astype(np.uint8).tobytes()
    ends = np.cumsum(np.bincount(path, minlength=len(starts)))
    return [text[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]


def solve(sizes: np.ndarray, initial: np.ndarray, doomed: np.ndarray, open_end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cost and audit of conversations whose rows lie one after another; `initial` 1, 2, 3 for s, u, a, else 0."""
    shift = np.r_[0, np.cumsum(sizes)]
    base = shift[:-1] + np.arange(len(sizes))  # a conversation of n rows has n + 1 nodes in each state
    go = np.full((int(shift[-1]) + len(sizes), 4), _NEVER, np.int64)
    order = np.argsort(-sizes, kind="stable")
    ascending = sizes[order][::-1]

    def with_inserts(h: np.ndarray) -> np.ndarray:
        once = h[:, _EMITS]
        return np.minimum(np.minimum(h, once + INSERT), once[:, _EMITS] + 2 * INSERT)

    def ways(row: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Costs by state of deleting, keeping and reroling `row` when `after` is the cost from the next node; keep's states."""
        stays = np.where(doomed[row], _NEVER, np.where(open_end[row], OPEN_END, 0))[:, None]
        i = initial[row][:, None]
        state = np.arange(4)[None, :]
        fits = np.where(i == S, state == START, np.where(i == U, state != U, np.where(i == A, state == U, False)))
        target = np.broadcast_to(i, fits.shape)
        keep = np.where(fits, np.take_along_axis(after, target, 1) + stays + KEEP, _NEVER)
        return after + DELETE, np.minimum(keep, _NEVER), np.minimum(after[:, _EMITS] + stays + REROLE, _NEVER), target

    go[base + sizes] = with_inserts(np.array([[0, _NEVER, _NEVER, 0]]))
    for back in range(1, int(sizes.max(initial=0)) + 1):
        live = order[: len(order) - int(np.searchsorted(ascending, back))]
        at = sizes[live] - back
        delete, keep, rerole, _ = ways(shift[live] + at, go[base[live] + at + 1])
        go[base[live] + at] = with_inserts(np.minimum(np.minimum(delete, keep), rerole))
    go = np.minimum(go, _NEVER)

    row_node = np.arange(int(shift[-1])) + np.repeat(np.arange(len(sizes)), sizes)
    delete, keep, rerole, target = ways(np.arange(int(shift[-1])), go[row_node + 1])
    here, states = go[row_node], np.arange(4)
    arcs = []
    for letter, cost, to in ((b"D", delete, states), (b"K", keep, target), (b"R", rerole, _EMITS)):
        r, s = np.nonzero((cost == here) & (here < _NEVER))
        arcs.append((row_node[r] * 4 + s, (row_node[r] + 1) * 4 + np.broadcast_to(to, cost.shape)[r, s], np.full(len(r), letter[0])))
    r, s = np.nonzero((go[:, _EMITS] + INSERT == go) & (go < _NEVER))
    arcs.append((r * 4 + s, r * 4 + _EMITS[s], np.full(len(r), b"I"[0])))
    tail, head, label = (np.concatenate(x) for x in zip(*arcs))
    by = np.argsort(tail, kind="stable")
    longest = 3 * (int(sizes.max(initial=0)) + 1)
    return go[base, START], least_paths(tail[by], head[by], label[by], 4 * len(go), base * 4 + START, longest)


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def _plain(rows: DataFrame, gone: Column | None) -> DataFrame:
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))).alias("gone"),
    )


def audit_turns(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation in `rows`.

    Needs conv_id, turn, role, text; other columns are not read. Null role and text count as one space, a null id is a
    conversation of its own. Rows follow by turn (null first), then role and text. Where `gone` holds, a row only
    names its conversation; one without other rows has zeros and an empty audit. Equal rows are duplicates whatever
    their digests' 128 bits say about others. Rows are sorted by Spark and streamed; a task holds some 150 bytes a
    row of the conversations it solves together, at least one.
    """
    plain = _plain(rows, gone)
    bare, first = F.rtrim("text", F.lit(BLANKS)), F.substring("role", 1, 1)
    coded = _ordered(plain).select(
        "conv_id", "turn", "gone", F.when(first == "s", S).when(first == "u", U).when(first == "a", A).otherwise(0).alias("initial"), (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
        F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "role").alias("d2"),
    )
    struct, arrow = schema_of(f"conv_id long, {REPORT}")

    def flush(ids: list, parts: list[np.ndarray], turns: list[int]) -> pa.RecordBatch:
        rows_, conv = np.concatenate(parts), np.repeat(np.arange(len(ids)), [len(p) for p in parts])
        sizes = np.bincount(conv, minlength=len(ids))
        initial, blank, open_, d1, d2 = (rows_[:, i] for i in range(5))
        order = np.lexsort((np.arange(len(conv)), d2, d1, conv))
        c, x, y = conv[order], d1[order], d2[order]
        again = np.zeros(len(conv), bool)
        again[order[1:]] = (c[1:] == c[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        blank = blank == 1
        again &= ~blank
        open_ = (open_ == 1) & ~blank & ~again
        pair = initial[:-1] * 4 + initial[1:]
        wrong = (conv[1:] == conv[:-1]) & ~np.isin(pair, (S * 4 + U, U * 4 + A, A * 4 + U))
        cost, audits = solve(sizes, initial, blank | again, open_)
        count = [np.bincount(conv[m], minlength=len(ids)) for m in (blank, again, open_)]
        return pack(arrow, [ids, turns, *count, np.bincount(conv[1:][wrong], minlength=len(ids)), cost, [a.decode() for a in audits]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, gaps, held = [], [], [], 0
        now, open_, low, high, seen, previous = None, [], None, None, 0, None

        def close() -> None:
            ids.append(now[0])
            parts.append(np.concatenate(open_) if open_ else np.zeros((0, 5), np.int64))
            gaps.append(high - low + 1 - seen if seen else 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            table_ = np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(3, 8)], 1)
            key, turn, gone_ = (batch.column(i).to_pylist() for i in range(3))
            edges = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for a, b in zip(edges[:-1], edges[1:]):
                if now is None or now[0] != key[a]:
                    if now is not None:
                        close()
                        if held >= BATCH_ROWS:
                            yield flush(ids, parts, gaps)
                            ids, parts, gaps, held = [], [], [], 0
                    now, open_, low, high, seen, previous = (key[a],), [], None, None, 0, None
                stays = [i for i in range(a, b) if not gone_[i]]
                open_.append(table_[stays])
                held += len(stays) + 1
                for i in stays:
                    if turn[i] is not None and turn[i] != previous:
                        low, high, previous, seen = turn[i] if low is None else low, turn[i], turn[i], seen + 1
        if now is not None:
            close()
            yield flush(ids, parts, gaps)

    return coded.mapInArrow(run, struct)


def repaired_turns(rows: DataFrame, reports: DataFrame, gone: Column | None = None) -> DataFrame:
    """The repaired conversations: a row of place 0 with each report, then rows of place 1, 2, ... with edit, role, text.

    `rows` and `gone` are those given to `audit_turns`, whose result `reports` is. Inserted turns have empty text and
    reroled ones the role that their place asks for; deleted rows are left out. Rows of one conversation
    follow each other in a task, in order. A task holds one report and a batch.
    """
    body = _plain(rows, gone).where(~F.col("gone")).select(F.lit(1).alias("kind"), *_SEEN, F.lit(None).cast(f"struct<{REPORT.replace(' ', ':').replace(',:', ',')}>").alias("report"))
    heads = reports.select(F.lit(0).alias("kind"), "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct(*[c for c in reports.columns if c != "conv_id"]).alias("report"))
    run_ = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text")
    struct, arrow = schema_of(f"conv_id long, place long, edit string, role string, text string, {REPORT}")
    names = [f.name for f in arrow][5:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, state = "", 0, 0, START
        for batch in batches:
            out = []

            def emit(key, edit: str, role: str, text: str) -> None:
                nonlocal state, place
                place += 1
                state = {"s": S, "u": U, "a": A}[role[0]]
                out.append((key, place, edit, role, text, *[None] * len(names)))

            def fitting() -> str:
                return "assistant" if state == U else "user"

            def inserts(key) -> None:
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    emit(key, "I", fitting(), "")
                    at += 1

            for kind, key, _, role, text, report in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if kind == 0:
                    audit, at, place, state = report["audit"], 0, 0, START
                    out.append((key, 0, None, None, None, *[report[n] for n in names]))
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        emit(key, edit, role if edit == "K" else fitting(), text)
                inserts(key)
            if out:
                yield pack(arrow, list(zip(*out)))

    return run_.mapInArrow(run, struct)


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation: its report and repaired_sha256 over `role:text` lines; reads `repaired_turns` in place."""
    struct, arrow = schema_of(f"conv_id long, {REPORT}, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                key, place, _, role, text, *report = row
                if place == 0:
                    if head is not None:
                        out.append((*head, digest.hexdigest()))
                    head, digest = (key, *report), hashlib.sha256()
                else:
                    digest.update((f"{role}:{text}" if place == 1 else f"\n{role}:{text}").encode("utf-8"))
            if out:
                yield pack(arrow, list(zip(*out)))
        if head is not None:
            yield pack(arrow, [[x] for x in (*head, digest.hexdigest())])

    return repaired.mapInArrow(run, struct)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with a column `gone` and one fault each in five of twenty, by crc32 of `conv_id:turn` (nulls: one space)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


@register("op12_turn_repair")
def op12_turn_repair(spark, sf_dir):
    rows = damage(table(spark, sf_dir, "conversations"))
    return repaired_digests(repaired_turns(rows, audit_turns(rows, F.col("gone")), F.col("gone")))
