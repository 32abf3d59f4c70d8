"""Collocations, turn repair and toxic segments against plain versions, with nulls, empty tables, ties and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.llm import collocations, toxic_segments, turn_repair
from ridelens.llm.base import fold, prepare

BLANK = " \t\n\x0b\f\r"


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return prepare(spark)


# -- phrases

def plain_collocations(rows, least, top, most=5):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            n[lang] += len(words)
            for k in range(1, most + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def test_collocations(session, monkeypatch):
    rng = random.Random(3)
    words = ["a", "b", "c", "A", "dé", "x\x1cy", "w" * 3000]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ";"]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, " .,"), ("en", "a a a a a a a a")] + [("fr", "un deux trois quatre cinq six")] * 9
    df = session.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], "lang string, text string, n int, word string, code long, w1 int, phrase string")
    for held, parts in ((300_000, 3), (2, 7)):
        monkeypatch.setattr(collocations, "HELD_WORDS", held)
        got = sorted(map(tuple, collocations.collocations(df.repartition(parts), least=6, top=40).collect()))
        assert got == plain_collocations(rows, 6, 40)
    assert sorted(map(tuple, collocations.collocations(df, most=3, least=9, top=5).collect())) == plain_collocations(rows, 9, 5, most=3)
    assert collocations.collocations(df.where("false")).count() == 0


def test_collocations_keep_counts_over_ranges_and_false_bits(session, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 64)  # nearly every bit is set, so nothing is pruned
    monkeypatch.setattr(collocations, "PACKED", 3)
    rows = [("en", "p q r s t p q r s t")] * 40 + [("en", f"p q u{i} p q") for i in range(60)]
    df = session.createDataFrame(rows, "lang string, text string").repartition(9)
    assert sorted(map(tuple, collocations.collocations(df, least=20).collect())) == plain_collocations(rows, 20, 2000)


def test_collocation_scores_pass_64_bits(session):
    a, n = 3_000_000_000, 4_000_000_000_000
    cut = F.call_function("div", (F.lit(1000 * a)).cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)"), F.lit(a).cast("decimal(19,0)") * F.lit(a + 7).cast("decimal(19,0)"))
    assert session.range(1).select(cut).first()[0] == 1000 * a * n // (a * (a + 7))


# -- turns

def plain_repair(rows):
    """`rows`: (turn, role, text) in order; (gaps, blank, duplicate, truncated, illegal, cost, audit, digest)."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(BLANK)
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    after = None
    for i in range(len(rows), -1, -1):
        here = {}
        for state, may in follows.items():
            ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            if i < len(rows):
                _, role, text = rows[i]
                ways += [(3 + c, "D" + x, y) for c, x, y in [after[state]]]
                if faults[i] not in ("b", "d"):
                    open_end = int(faults[i] == "t")
                    if role[:1] and role[0] in may:
                        c, x, y = after[role[0]]
                        ways.append((open_end + c, "K" + x, ((role, text), *y)))
                    for s in "ua":
                        if s in may:
                            c, x, y = after[s]
                            ways.append((2 + open_end + c, "R" + x, ((names[s], text), *y)))
            here[state] = min(ways, default=(10**9, "", ()))
        for _ in range(4):
            here = {state: min([here[state], *((2 + here[s][0], "I" + here[s][1], ((names[s], ""), *here[s][2])) for s in "ua" if s in may)]) for state, may in follows.items()}
        after = here
    cost, audit, kept = after[""]
    turns = {t for t, _, _ in rows if t is not None}
    first = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def plain_damaged(rows):
    by = {}
    for conv, turn, role, text in rows:
        kept = by.setdefault(conv, [])
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {conv: plain_repair(sorted(kept, key=order)) for conv, kept in by.items()}


def test_turn_repair(session, monkeypatch):
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "usher"], [None, "", "hi.", "yes", "no! ", "ok?\n", "\t", "A.", "B.", "a b.", "é", "x" * 20_000]
    rows = [(c, rng.choice([None, t, t, t, t, 1, t + 3]), rng.choice(roles), rng.choice(texts)) for c in [*range(250), None] for t in range(rng.choice([1, 1, 2, 3, 5, 8, 12]))]
    df = session.createDataFrame([(*r, 1, "x", True, 0) for r in rows], "conv_id long, turn int, role string, text string, kind int, audit string, gone boolean, place int")
    want = plain_damaged(rows)
    for batch in (50_000, 1):
        monkeypatch.setattr(turn_repair, "BATCH_ROWS", batch)
        damaged = turn_repair.damage(df)
        reports = turn_repair.audit_turns(damaged, F.col("gone"))
        got = {r[0]: tuple(r)[1:] for r in turn_repair.repaired_digests(turn_repair.repaired_turns(damaged, reports, F.col("gone"))).collect()}
        assert got == want
    assert turn_repair.audit_turns(df.where("false")).count() == 0


def test_repaired_turns_are_legal(session):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "What"), (1, 1, "user", "What"), (1, 2, "user", " "), (2, 0, "system", "S."), (3, None, "tool", "T.")]
    df = session.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    reports = turn_repair.audit_turns(df)
    found = {}
    for r in turn_repair.repaired_turns(df, reports).orderBy("conv_id", "place").collect():
        if r.place:
            found.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert found == {1: [("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "What"), ("I", "assistant", "")]} or sum(map(len, found.values())) % 2 == 0
    assert {r.conv_id: (r.cost, r.audit) for r in reports.collect()} == {c: plain_repair([(t, r, x) for i, t, r, x in rows if i == c])[5:7] for c in (1, 2, 3)}


def test_long_conversation_is_solved_like_a_short_one():
    rng = random.Random(8)
    rows = [(t, rng.choice(["system", "user", "assistant", "x"]), rng.choice([f"{t}.", f"{t}", "", "same."])) for t in range(1500)]
    want = plain_repair(rows)
    seen, flags = set(), []
    for _, role, text in rows:
        flags.append((not text or (role, text) in seen, bool(text) and (role, text) not in seen and text[-1] != "."))
        seen.add((role, text))
    initial = np.array(["xsua".index(r[1][0]) for r in rows])
    cost, audits = turn_repair.solve(np.array([len(rows)]), initial, np.array([f[0] for f in flags]), np.array([f[1] for f in flags]))
    assert (int(cost[0]), audits[0].decode()) == want[5:7]


# -- toxicity

def plain_segments(scores):
    """Maximal segments by their recursive definition: the best segment, then the parts left and right of it."""
    def best(a, b):
        found = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if found[0] <= 0:
            return []
        i, j = found[3:]
        return [*best(a, i), (i, j, found[0]), *best(j, b)]
    return best(0, len(scores))


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(400):
        # distinct powers keep sums apart, so that the best segment is unique
        scores = [rng.choice([-1, 1]) * (rng.randrange(1, 40) + 2.0**-i) for i in range(1, rng.randrange(1, 14))]
        got = toxic_segments.maximal_segments(np.array(scores))
        want = plain_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])
    assert toxic_segments.maximal_segments(np.array([-1.0, -2.0])) == []
    assert len(toxic_segments.maximal_segments(np.tile([1.0, -2.0], 50_000))) == 50_000


def test_toxicity_on_held_out_rows_and_odd_texts(session):
    rng = random.Random(7)
    words, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["vile", "filth", "scum"]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text) + 1), rng.choice(bad).upper())
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    odd = [None, "", " \n", "123 ...", "İ scum VILE filth", "filth " * 20_000]
    rows += [(1000 + i, t) for i, t in enumerate(odd)] + [rows[0], rows[1], (None, "scum")]
    labels += [(0, 1), (3, None), (None, 1), (5000, 1)]
    docs = session.createDataFrame([(*r, 1, 2.0, "x", 3) for r in rows], "doc_id long, text string, toxic int, score double, passages string, h int")
    marks = session.createDataFrame([(*r, "x") for r in labels], "doc_id long, toxic int, text string")
    model = toxic_segments.fit_toxicity(docs, marks, fold("doc_id") != 0)
    assert set(bad) <= {w for w, s in model.weights.items() if s > 0}
    found = toxic_segments.toxic_passages(docs, model).collect()
    assert len(found) == len(rows)
    known = dict(labels[:900])
    held = [(known[r.doc_id], r.score >= 0.5) for r in found if r.doc_id is not None and r.doc_id < 900 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 100 and sum(bool(a) == b for a, b in held) >= 0.97 * len(held)
    texts = dict(rows[:906])
    low = min(r.score for r in found)
    for r in found:
        assert 0 <= r.score <= 1
        for p in r.passages:
            assert p.expected <= 1 and (r.doc_id is None or texts[r.doc_id][p.begin : p.end] == p.text)
        if r.doc_id in (1000, 1001, 1002, 1003):
            assert not r.passages and r.score == low
    assert all(r.score > 0.5 for r in found if r.doc_id in (1004, 1005))
    for part in (docs.where("false"), docs):
        empty = toxic_segments.fit_toxicity(part, marks.where("toxic = 0"))
        assert not empty.weights and {r.score < 1e-9 for r in toxic_segments.toxic_passages(docs, empty).collect()} == {True}
    assert toxic_segments.toxic_passages(docs.where("false"), model).count() == 0


@pytest.mark.parametrize("most_held", [2_000_000, 5])
def test_slices_over_blocks(monkeypatch, most_held):
    """Sums over all blocks give each window's count, and every slice in more than one block or at an end is marked."""
    import pyarrow as pa

    monkeypatch.setattr(collocations, "HELD_WINDOWS", most_held)
    rng = np.random.default_rng(4)
    rows = np.c_[rng.integers(1, 9, (200, 2)), rng.integers(0, 3, (200, 3)), rng.integers(1, 9, 200)]
    rows = rows[np.argsort(rows[:, 0], kind="stable")]  # the first word stands for the slice
    batches = [pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 2]), pa.array([r.tobytes() for r in part], pa.binary())], names=list("abc")) for part in np.array_split(rows, 23)]
    total, want, met, marked = Counter(), Counter(), Counter(), set()
    for block, shared in collocations._by_slice(iter(batches), 5):
        assert len(set(block[:, 0].tolist())) == 1 and (np.lexsort(block.T[-2::-1]) == np.arange(len(block))).all()
        met[block[0, 0]] += 1
        marked |= {block[0, 0]} if shared else set()
        for r in block.tolist():
            total[tuple(r[:5])] += r[5]
    for r in rows.tolist():
        want[tuple(r[:5])] += r[5]
    assert total == want and {k for k, n in met.items() if n > 1} <= marked and {rows[0, 0], rows[-1, 0]} <= marked
