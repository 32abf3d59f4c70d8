"""The pipeline against plain versions of its stages, each on the rows that its predecessor kept."""

import random

import pytest

import corpus_pipeline
from ridelens.llm.base import prepare
from tests.llm.test_operators import brute_components, model_path

KINDS = {"en": "the house and river with this that from when".split(), "de": "das haus und fluss mit dies wenn nicht über".split()}

TOXIC = "awful nasty scum rotten lousy filthy horrid wicked".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    prepare(spark)
    rng = random.Random(12)
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        words = [rng.choice(KINDS[lang]) + rng.choice(["", "", "s", "e"]) for _ in range(60)]
        if i % 5 == 4:
            words += ["vile", *rng.sample(TOXIC, 7)]
        rows.append((i, " ".join(words), lang, "s", 1))
    for i in range(30):  # exact and near copies of clean rows
        text = rows[i][1]
        rows.append((200 + i, text if i % 2 else text + " tail", rows[i][2], "s", 1))
    rows += [(300, None, "en", "s", 1), (301, "", None, "s", 1), (302, "### 12 $$$", "en", "s", 1), (None, rows[3][1] + " more words", "de", "s", 1)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 7 > 0), int(i % 5 == 4)) for i in range(0, 120) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).checkpoint()
        kept = {r.doc_id for r in out.collect()}
        assert kept <= set(rows) and out.count() == len(kept)
        if name == "language":
            assert set(rows) - kept == {300, 301, 302}
        elif name == "exact_copies":
            first = {}
            for i in sorted(rows, key=lambda x: (x is None, x)):
                first.setdefault(rows[i], i)
            assert kept == set(first.values())
        elif name == "near_copies":
            ids = sorted(i for i in rows if i is not None)
            parts = brute_components([rows[i] for i in ids], 5, 80)
            assert kept == {i for i, (_, low) in zip(ids, parts) if ids[low] == i} | {None}
        elif name == "mixture":
            toxic = {i for i in rows if "vile" in rows[i]}
            assert len(kept & toxic) < 0.75 * len(toxic) and len(kept - toxic) > 0.9 * len(set(rows) - toxic)
        if name != "token_ids":
            assert out.columns == columns
        docs, rows = out, {i: t for i, t in rows.items() if i in kept}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path())
    assert {r.doc_id: r.ids for r in docs.collect()} == {i: sp.encode(t or "", add_eos=True) for i, t in rows.items()}


def test_run_and_empty_table(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 50 and "n_tokens" in got.columns
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
