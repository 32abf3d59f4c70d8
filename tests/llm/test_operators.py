"""Small cases of the text operators: brute-force versions, nulls, empty and repeated rows, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelens.llm import block_labeller, chat, edit_fingerprint, exact_dedup, graph, jaccard_join, language_id, lattice_lm, mixing, piece_codec, url_filter
from ridelens.llm.base import fold, prepare

WORDS = "alpha beta gamma delta omega house river stone cloud paper green seven north light".split()


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return prepare(spark)


def model_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


CLASH = "keep_id string, kept int, n long, size int, sig string, component string, score int, lang string, t int, k int, uid string"


def documents(spark, texts, ids=None):
    """Rows with columns whose names operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    junk = ("x", 1, 2, 3, "y", "z", 5, None, 4, 5, "u")
    return spark.createDataFrame([(i, t, *junk) for i, t in zip(ids, texts)], f"doc_id long, text string, {CLASH}")


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


ODD = [None, "", " ", "\n\t", "a", "A b", "a  b", "a\nb", "x" * 30_000, "one two three four five", "One two three FOUR five", "one two three four five", None, ""]


def test_exact_dedup(session):
    texts = ODD + ["hot text"] * 60 + ["hot  text"]
    for k in (2, 1024):
        rows = exact_dedup.exact_dedup(documents(session, texts), k=k).collect()
        norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
        assert len(rows) == len(texts)
        for r in rows:
            same = [i for i, t in enumerate(norm) if t == norm[r.doc_id]]
            assert (r.keep_id, r.group_size, r.kept) == (same[0], len(same), same[0] == r.doc_id)
            assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_exact_dedup_ids(session):
    df = documents(session, ["a", "a", "a", "b", "b", "c"], [None, 5, 5, None, None, None])
    got = sorted((r.text_sha256[:3], str(r.doc_id), str(r.keep_id), r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert sum(r[3] for r in got) == 3 and {r[2] for r in got} == {"5", "None"}
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and kept.count() == 3
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_misra_gries_keeps_every_heavy_key(session):
    keys = ["h"] * 400 + ["g"] * 300 + [f"k{i}" for i in range(500)]
    df = session.createDataFrame([(k,) for k in keys], "key string").repartition(7)
    assert {"h", "g"} <= {r.key for r in exact_dedup.misra_gries(df, "key", 8).collect()}


def test_url_filter(session):
    urls = {
        None: ("", "", None, "allow"), "no mark": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "HTTP://Sub.Example.ORG/es/a?x#y": ("sub.example.org", "/es/a", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "http://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"), "http://a.com?x=/de/": ("a.com", "", None, "allow"),
        "http://free-porn.net/": ("free-porn.net", "/", None, "block"), "http://sussex.net/adult": ("sussex.net", "/adult", None, "allow"),
        "http://adult.net/poker": ("adult.net", "/poker", None, "block"), "http://adult.net/adult": ("adult.net", "/adult", None, "allow"),
    }
    df = session.createDataFrame([(i, u, "a", "b") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules=url_filter.RULES).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_chat_round_trip(session):
    t = chat.Template()
    texts = [None, "", "[INST]", "<s></s>", "[\\INST] <\\/s> <\\\\s> [[INST]]", "[ROLE]x[/ROLE]\n", "plain\\", "é[/TURN]"]
    roles = ["system", "user", "assistant", "user", "tool [INST]", None, "assistant", "user"]
    rows = [(7, i, r, x, "n", 1) for i, (r, x) in enumerate(zip(roles, texts))] + [(8, 1, "assistant", "b", "n", 1), (8, 0, "user", "a", "n", 1), (None, None, "user", "[SYS]", "n", 1)]
    df = session.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, valid int")
    out = chat.format_chats(df, t)
    read = {r.conv_id: r for r in out.select("conv_id", chat.read_turns(F.col("formatted"), t).alias("turns"), chat.learned_text(F.col("segments"), t).alias("learned"), "valid", "n_turns", "formatted").collect()}
    assert [(x.role, x.text) for x in read[7].turns] == [(r or "", x or "") for r, x in zip(roles, texts)]
    assert read[7].learned == texts[2] + texts[6]
    assert (read[8].formatted, read[8].valid, read[7].valid) == ("[INST]a[/INST]<s>b</s>", True, False)
    assert read[None].turns[0].text == "[SYS]" and chat.format_chats(df.limit(0)).count() == 0


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat.Template(other=("[ROLE]", "[/ROLE]", "[a[b]"))


def test_codec_equals_library(session):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    rng = random.Random(4)
    wild = ["".join(rng.choice("ab ▁\n\té𝔘語\x00<>0x41  th eing'") for _ in range(rng.randrange(60))) for _ in range(250)]
    texts = ODD + wild + ["<s> </s><0x41>", " " * 70, "▁" * 9 + "x", "aaaa" * 300, "語" * 500, "the " * 3000, "0000000000" * 40]
    got = {r.doc_id: r for r in piece_codec.encode(documents(session, texts), model_path()).collect()}
    for i, text in enumerate(texts):
        want = sp.encode(text or "", add_eos=True)
        assert (got[i].ids, got[i].n_tokens, got[i].decoded) == (want, len(want), sp.decode(want)), repr(text)
    assert piece_codec.encode(documents(session, []), model_path()).count() == 0


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    low = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                o = len(a & sets[j])
                if a and 100 * o >= percent * (len(a) + len(sets[j]) - o):
                    low[i] = low[j] = min(low[i], low[j])
    return [(len(s), low[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(session, n, percent):
    rng = random.Random(9)
    texts = list(ODD)
    shared = sentence(rng, 30)
    for _ in range(6):
        base = sentence(rng, rng.randrange(20, 90)).split()
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS) + str(rng.randrange(9))
            texts.append(" ".join(copy))
        texts.append(shared + " " + sentence(rng, 8))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(session, texts), n, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, n, percent)


def test_hot_list_is_dealt_in_blocks(session, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    rows = [(0, 7, i, 0, 10, 0, 0, 0, 0, -1, -1, i if i < 30 else 100) for i in range(60)]  # 30 labels of one row, one of 30 rows
    rows += [(1, 7, i, 0, 10, 0, 0, 0, 0, -1, -1, i) for i in (1, 70)] + [(1, 8, i, 0, 10, 0, 0, 0, 0, -1, -1, 3) for i in (80, 81)]
    lists = session.createDataFrame(rows, "kind int, token long, id long, pos int, size long, m0 long, m1 long, m2 long, m3 long, lead long, o long, label long")
    pairs = jaccard_join.remaining_pairs(lists, 80)
    assert sorted(map(tuple, pairs.collect())) == sorted([(a, b) for a in range(30) for b in range(a + 1, 60)] + [(1, 70)])
    held = []
    monkeypatch.setattr(type(lists), "mapInArrow", lambda df, *_: held.append(df) or df.select(F.col("id").alias("a"), F.col("id").alias("b")))
    jaccard_join.remaining_pairs(lists, 80)
    most = held[0].groupBy("token", "kind", "left", "right").agg(F.sum((~F.col("second")).cast("int")).alias("n"), F.count("*").alias("all"))
    assert most.agg(F.max("n"), F.max("all")).first()[0] <= 15 and most.agg(F.max("all")).first()[0] <= 30


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard_in_small_blocks_equals_brute_force(session, monkeypatch, n, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    test_jaccard_equals_brute_force(session, n, percent)


def test_overlaps_come_out_once(session, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PARTNERS", 2)
    docs = documents(session, [sentence(random.Random(i), 12) for i in range(40)])
    pairs = session.createDataFrame([(0, i) for i in range(1, 40)], "a long, b long")
    got = sorted((r.a, r.b) for r in jaccard_join.overlaps(docs, pairs, 3, "doc_id", "text").collect())  # 20 salts in 4 partitions
    assert got == [(0, i) for i in range(1, 40)]


def test_jaccard_nulls_and_empty(session):
    rows = [(r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(documents(session, ["a b c d e", "a b c d e", "a b c d e"], [3, None, 2])).collect()]
    assert sorted(rows, key=str) == [(2, 2), (3, 2), (None, None)]
    assert jaccard_join.jaccard_components(documents(session, [])).count() == 0


def test_components(session):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7)]
    got = {r.id: r.component for r in graph.components(session.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 150))


def test_fingerprints(session):
    rng = random.Random(2)
    texts = ODD + [sentence(rng, n) for n in (3, 50, 400, 2000)] + ["語" * 99]
    rows = {r.doc_id: r for r in edit_fingerprint.fingerprints_with_next(documents(session, texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        walk = edit_fingerprint.Walk()
        direct = walk.fingerprint(walk.codes(edited), walk.steps(walk.codes(edited)))
        assert direct == rows[i].edited_fingerprint
    assert len({rows[i].fingerprint for i, t in enumerate(texts) if not t}) == 1
    plain = {r.doc_id: r.fingerprint for r in edit_fingerprint.fingerprints(documents(session, texts)).collect()}
    assert plain == {i: r.fingerprint for i, r in rows.items()}
    last = len(ODD) + 2
    assert 0.6 < rows[last].near_edited and rows[last].near_next < 0.3
    assert edit_fingerprint.fingerprints_with_next(documents(session, [])).count() == 0
    alone = edit_fingerprint.fingerprints_with_next(documents(session, ["abcdefgh", "abcd"], [None, None])).collect()
    assert len(alone) == 2 and alone[0].doc_id is None


def test_similar_fingerprints(session):
    rng = random.Random(5)
    base = sentence(rng, 500)
    near = base.replace("river", "rivers", 2)
    other = sentence(rng, 500)
    prints = edit_fingerprint.fingerprints(documents(session, [base, near, other, base, "", None]))
    got = {r.doc_id: r.component for r in edit_fingerprint.similar_documents(prints, least=0.7).collect()}
    assert (got[0], got[1], got[3], got[2], got[4], got[5]) == (0, 0, 0, 2, 4, 4)


@pytest.mark.parametrize("block", [8192, 3])
def test_similar_fingerprints_equal_brute_force(session, monkeypatch, block):
    monkeypatch.setattr(edit_fingerprint, "BLOCK", block)
    rng = random.Random(8)
    prints = []
    for _ in range(6):  # groups that share bands with a smaller row that is unlike them
        hot = "".join(rng.choice("0123456789abcdef") for _ in range(64))
        prints.append(hot + "".join(rng.choice("0123456789abcdef") for _ in range(192)))
        base = hot + "".join(rng.choice("0123456789abcdef") for _ in range(192))
        for _ in range(8):
            at = set(rng.sample(range(256), 26))
            prints.append("".join(rng.choice("0123456789abcdef") if i in at else c for i, c in enumerate(base)))
        prints.append(prints[-1])
    df = session.createDataFrame([(i, p) for i, p in enumerate(prints)] + [(None, prints[0])], "doc_id long, fingerprint string")
    alike = [[i != j and sum(map(str.__eq__, a, b)) >= 0.8 * 256 for j, b in enumerate(prints)] for i, a in enumerate(prints)]
    bands = [[any(a[k : k + 8] == b[k : k + 8] for k in range(0, 256, 8)) for b in prints] for a in prints]
    assert all(bands[i][j] for i in range(len(prints)) for j in range(len(prints)) if alike[i][j])  # full recall on these rows
    low = list(range(len(prints)))
    for _ in prints:
        low = [min([low[i]] + [low[j] for j in range(len(prints)) if alike[i][j]]) for i in range(len(prints))]
    got = {r.doc_id: (r.component, r.links) for r in edit_fingerprint.similar_documents(df).collect()}
    assert got == {i: (low[i], sum(alike[i])) for i in range(len(prints))} | {None: (None, None)}


def test_fingerprint_query_groups(session, tmp_path):
    rng = random.Random(5)
    base = sentence(rng, 500)
    texts = [base, base.replace("river", "rivers", 2), sentence(rng, 500), base, "", None]
    documents(session, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in edit_fingerprint.op9_edit_fingerprint(session, str(tmp_path)).collect()}
    assert [rows[i].component for i in range(6)] == [0, 0, 2, 0, 4, 4] and [rows[i].links for i in range(6)] == [2, 2, 0, 2, 1, 1]


def brute_word(piece_p, word):
    """Probability of a word by plain recursion over its pieces."""
    data = b" " + word
    total = [0.0] * (len(data) + 1)
    total[0] = 1.0
    for e in range(1, len(data) + 1):
        for s in range(max(0, e - 40), e):
            if data[s:e] in piece_p:
                total[e] += total[s] * piece_p[data[s:e]]
    return total[-1]


def test_lattice_equals_recursion():
    v = lattice_lm.Vocabulary.load(model_path())
    rng = np.random.default_rng(1)
    p = rng.random(len(v.pieces))
    p /= p.sum()
    words = ["the", "thing", "é", "x", "queen" * 4, "語"]
    got = v.edges([w.encode() for w in words]).forward(np.log(p))[0]
    table = dict(zip(v.pieces, p))
    assert np.allclose(got, [np.log(brute_word(table, w.encode())) for w in words])
    use = v.edges([b"the"]).expected(np.log(p), np.ones((1, 1)))[0]
    assert np.isclose(sum(len(v.pieces[i]) * use[i] for i in np.flatnonzero(use)), 4)


def test_lattice_scores(session):
    rng = random.Random(3)
    texts = ODD + [sentence(rng, 40) + f" new{i}" for i in range(60)]
    df = documents(session, texts)
    v = lattice_lm.Vocabulary.load(model_path())
    rows = {r.doc_id: r for r in lattice_lm.score_texts(df, v, fold("doc_id") != 1).collect()}
    words = [(t or "").encode().lower().split() for t in texts]
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in [*words[i], None])
    n, distinct = sum(c.values()), len(c)
    for i, w in enumerate(words):
        w = [*w, None]
        base = sum(np.log10((c[x] + 0.5) / (n + 0.5 * (distinct + 1))) for x in w)
        assert rows[i].n_tokens == len(w) and rows[i].n_known == sum(c[x] > 0 for x in w) and rows[i].train_tokens == n
        assert np.isclose(rows[i].base_score, base) and np.isfinite(rows[i].score) and rows[i].score <= 0
    assert lattice_lm.score_texts(documents(session, []), v, fold("doc_id") != 1).count() == 0
    assert lattice_lm.score_texts(df, v, F.lit(False)).where("score < 0").count() == len(texts)


def test_language_id(session):
    rng = random.Random(8)
    kinds = {"aa": "the house and river".split(), "bb": "das haus und fluss über".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(12)), k) for i, k in enumerate(["aa", "bb"] * 40)]
    rows += [(100, None, "aa"), (101, "123 ### 4", "aa"), (102, "", None), (103, "das haus " * 3000, None)]
    df = session.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, score int, accepted int")
    model = language_id.fit_language_id(df, fold("doc_id") != 0)
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang and got[i].accepted for i, _, lang in rows[:80])
    assert [(got[i].lang_pred, got[i].score, got[i].accepted) for i in (100, 101, 102)] == [("und", 0.0, False)] * 3
    assert got[103].lang_pred == "bb" and language_id.identify(df.limit(0), model).count() == 0
    nothing = language_id.fit_language_id(df, F.lit(False))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def test_mixing(session):
    rng = random.Random(6)
    kinds = {"good": WORDS[:7], "junk": ["###", "$$$", "%%%"], "toxic": ["vile", "awful", "nasty"]}
    rows = []
    for i in range(240):
        kind = ("good", "good", "junk", "toxic")[i % 4]
        rows.append((i, " ".join(rng.choice(kinds[kind] + WORDS[7:]) for _ in range(30)), kind if i % 3 else None, "x", 1))
    rows += [(900, None, None, "x", 1), (901, "", None, "x", 1), (None, "alpha", None, "x", 1)]
    df = session.createDataFrame(rows, "doc_id long, text string, domain string, rate string, n int")
    labels = df.select("doc_id", "domain")
    out = mixing.mix(df, labels, {"good": 0.6, "junk": 0.3, "toxic": 0.1}).collect()
    total = sum(r.n_tokens for r in out)
    for k, share in (("good", 0.6), ("junk", 0.3), ("toxic", 0.1)):
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{k}"] for r in out) / total - share) < 0.01
    assert len(out) == len(rows) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in out)
    kept = mixing.mix(df, labels, {"good": 0.9, "junk": 0.08, "toxic": 0.02}, most=1.0).collect()
    assert all(r.rate <= 1 for r in kept) and all(r.copies == 1 for r in kept if r.p_good > 0.9 and r.n_tokens)
    assert mixing.mix(df.limit(0), labels, {"good": 0.9, "junk": 0.1}).count() == 0
    assert mixing.mix(df, labels.limit(0), {"good": 0.9, "junk": 0.1}).count() == len(rows)


def test_mixing_keeps_all_good_of_a_clean_corpus(session):
    rng = random.Random(7)
    kinds = {"good": WORDS[:7], "junk": ["###", "$$$", "%%%"], "toxic": ["vile", "awful", "nasty"]}
    for junk, toxic in ((6, 3), (60, 3), (6, 60), (60, 60)):  # of 300: both short, one short, none short
        kind = lambda i: "junk" if i < junk else "toxic" if i < junk + toxic else "good"  # noqa: B023, E731
        rows = [(i, " ".join(rng.choice(kinds[kind(i)]) for _ in range(30)), kind(i)) for i in range(300)]
        df = session.createDataFrame(rows, "doc_id long, text string, domain string")
        out = mixing.mix(df, df.where("doc_id % 2 = 0").select("doc_id", "domain"), mixing.WEIGHTS, most=1.0).collect()
        assert all(r.copies == 1 and r.rate == 1 for r in out if kind(r.doc_id) == "good")
        kept = {k: sum(r.rate for r in out if kind(r.doc_id) == k) for k in kinds}
        for k, n in (("junk", junk), ("toxic", toxic)):
            assert kept[k] <= max(mixing.WEIGHTS[k] * sum(kept.values()) * 1.05, 0.5)
            assert kept[k] > 0.99 * n or kept[k] > 0.9 * mixing.WEIGHTS[k] * sum(kept.values())


def test_caps():
    share = np.array([0.9, 0.08, 0.02])
    for there in ([97, 2, 1], [80, 10, 10], [95, 0.5, 4.5], [90, 10, 0], [0, 5, 5]):
        there = np.array(there, float)
        most = np.minimum(there, mixing.caps(there, there, share))
        assert most[0] == there[0] and (most[1:] <= share[1:] * most.sum() + 1e-9).all()
        assert all(m == t or abs(m - s * most.sum()) < 1e-9 for m, t, s in zip(most[1:], there[1:], share[1:]))


def test_blocks():
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Menu</a><li>Two</ul></nav><!-- c --><div class="post x1"><p>One &amp;\n two<br>three<p><b>Four</div>tail &lt;b'
    got = block_labeller.blocks(page)
    assert [b.text for b in got] == ["Menu", "Two", "One & two three", "Four", "tail <b"]
    assert got[0].link == 1.0 and ".post" in got[2].path and got[4].path == ["html", "body"]
    assert block_labeller.blocks("") == [] and block_labeller.blocks("<" * 3000)[0].text == "<" * 3000


def test_gradients():
    rng = np.random.default_rng(0)
    m = block_labeller.Labeller()
    n = block_labeller.PATH_DIMS + block_labeller.WORD_DIMS + block_labeller.NUMBERS
    x, mask, y = block_labeller._pad([rng.normal(size=(3, n)), rng.normal(size=(5, n))], [np.array([1, 0, 1.0]), np.array([0, 1, 1, 0, 1.0])])
    _, grad = m.gradients(x, mask, y)
    for k, at in (("xf", (3, 5)), ("hb", (2, 40)), ("cf", (30,)), ("out", (7, 0)), ("hf", (1, 80))):
        keep = m.w[k].copy()
        m.w[k][at] += 1e-5
        up, _ = m.gradients(x, mask, y)
        m.w[k][at] -= 2e-5
        down, _ = m.gradients(x, mask, y)
        m.w[k] = keep
        assert np.isclose((up - down) / 2e-5, grad[k][at], rtol=1e-3, atol=1e-7)


def test_labeller_on_made_up_layouts(session):
    """Trained on pages of one layout, it finds the article of pages laid out in ways it has not been given."""
    rng = np.random.default_rng(21)
    r = random.Random(1)
    stories = [[sentence(r, 6)] + [sentence(r, r.randrange(20, 60)) + "." for _ in range(r.randrange(2, 7))] for _ in range(60)]
    pages = [f"<html><body><nav><ul><li><a>{sentence(r, 1)}</a></li></ul></nav><div class=ad>{sentence(r, 5)}</div><article><h1>{s[0]}</h1>{''.join(f'<p>{x}</p>' for x in s[1:])}</article><footer>&copy; {sentence(r, 4)}</footer></body></html>" for s in stories]
    df = session.createDataFrame([(i, "u", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    model = block_labeller.fit_labeller(df)
    got = {x.page_id: x.text for x in block_labeller.extract(df, model).collect()}
    assert sum(got[i] == "\n".join(s) for i, s in enumerate(stories)) >= 58
    right = 0
    for s in stories:
        pieces = block_labeller.layout(rng, s, stories, [sentence(r, 4) for _ in range(9)])
        html = "".join(h for h, _ in pieces)
        out = block_labeller.blocks(html)
        x, mask, _ = block_labeller._pad([block_labeller.Hasher().vectors(out)])
        ends = np.cumsum([len(h) for h, _ in pieces])
        want = np.array([pieces[i][1] for i in np.searchsorted(ends, [b.offset for b in out], "right")])
        right += ((model.predict(x, mask)[0] > 0.5) == want).mean()
    assert right / len(stories) > 0.9
    odd = session.createDataFrame([(None, None, None), (2, "u", ""), (3, "u", "<p>")], "page_id long, url string, html string")
    assert {x.text for x in block_labeller.extract(odd, model).collect()} == {""}
    assert block_labeller.fit_labeller(odd) is None and block_labeller.extract(odd.limit(0), None).count() == 0


def test_rows_without_a_partner_are_dropped():
    rng = np.random.default_rng(4)
    token = np.sort(rng.integers(0, 12, 300))
    size, pos = rng.integers(20, 60, 300), rng.integers(0, 8, 300)
    by = np.lexsort((size, token))
    token, size, pos = token[by], size[by], pos[by]
    want = np.zeros(300, bool)
    for i in range(300):
        for j in range(300):
            if i != j and token[i] == token[j]:
                need = -(-85 * (size[i] + size[j]) // 185)
                want[i] |= min(size[i], size[j]) >= need and min(size[i] - pos[i], size[j] - pos[j]) >= need
    assert (jaccard_join._has_partner(token, size, pos, 85) == want).all() and 0 < want.sum() < 300
