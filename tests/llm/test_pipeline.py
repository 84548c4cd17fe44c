"""The pipeline against a plain Python version of each stage, and on empty tables, nulls and clashing names."""

import os
import random
import re

import pytest
from test_training_data import brute_groups, least_edits, normal_text, prose, replaced, vocabulary
from tokenizers import Tokenizer

import corpus_pipeline
from vellumry.llm import decontamination, packing, pii
from vellumry.llm.chat_format import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    words = {"aa": vocabulary(1), "bb": ["".join(random.Random(f"b{i}").choice("áéíóúñçôûèkzw") for _ in range(5)) for i in range(300)]}
    texts = [(prose(i, 80, words[v]), v) for i in range(60) for v in ("aa", "bb")]
    bench = [prose(5000 + i, 30, words["aa"]) for i in range(4)]
    texts += [(replaced(texts[i][0], i, 25), texts[i][1]) for i in range(0, 20, 2)] + [texts[3], texts[3]]
    texts += [(f"{prose(7000 + i, 40, words['aa'])} {bench[i]} {prose(7100 + i, 40, words['aa'])}", "aa") for i in range(3)]
    texts += [(f"{prose(7200 + i, 40, words['bb'])} joe{i}@example.com {prose(7300 + i, 20, words['bb'])}", "bb") for i in range(3)]
    texts += [(prose(8000, 5000, words["aa"]), "aa"), (None, "aa"), ("", "bb"), ("12 34", "aa"), (None, None)]
    rows = [(i, t, v, "s", None if t is None else len(t)) for i, (t, v) in enumerate(texts)]
    return [*rows, (None, prose(8100, 60, words["bb"]), None, None, None)], list(enumerate(bench))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, bench = corpus()
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_against_plain_python(spark, folder):
    rows, bench = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "pii", "packing"]

    def after(name, docs):
        got = stages[name](spark, docs, folder)
        assert name == "packing" or got.columns == docs.columns
        return corpus_pipeline.written(got, f"test-{name}")

    def held(df):
        return {r.doc_id: r.text for r in df.collect()}

    # texts with letters have a clear language here; those without any are rejected
    docs = after("language_id", docs)
    expected = {r[0]: r[1] for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])}
    assert held(docs) == expected
    # one of each group stays, the one of least doc_id
    docs = after("near_dedup", docs)
    ids = sorted(expected, key=lambda i: (i is None, i))
    gone = {ids[j] for j in brute_groups([expected[i] for i in ids])}
    assert len(gone) >= 10
    expected = {i: t for i, t in expected.items() if i not in gone}
    assert held(docs) == expected
    # documents that hold a benchmark item go
    docs = after("decontamination", docs)

    def holds(text):
        return any(least_edits(normal_text(b), normal_text(text)) <= decontamination.budget(len(normal_text(b)))[0] for _, b in bench) if len(text) < 2000 else False

    expected = {i: t for i, t in expected.items() if not holds(t)}
    assert held(docs) == expected
    docs = after("pii", docs)
    expected = {i: re.sub(r"joe\d@example\.com", "[EMAIL]", t) for i, t in expected.items()}
    assert held(docs) == expected and all(pii.find(t) == [] for t in expected.values())
    assert all(r.n_chars == len(r.text) for r in docs.filter("n_chars is not null").collect())
    packed = after("packing", docs).collect()
    tok = Tokenizer.from_file(TOKENIZER)
    for i, t in expected.items():
        assert sum(r.size for r in packed if r.doc_id == i) == len(tok.encode(t, add_special_tokens=False).ids) + 1
    fill = {}
    for r in packed:
        fill[r.round, r.part, r.bin] = fill.get((r.round, r.part, r.bin), 0) + r.size
    assert max(fill.values()) <= packing.CAPACITY and all(fill[r.round, r.part, r.bin] == r.fill for r in packed)
    assert sorted((r.doc_id or -1, r.piece, r.size) for r in corpus_pipeline.run(spark, folder).collect()) == sorted((r.doc_id or -1, r.piece, r.size) for r in packed)


@pytest.mark.parametrize("case", ["empty", "nulls", "clash"])
def test_odd_tables(spark, folder, tmp_path, case):
    rows, _ = corpus()
    docs = {
        "empty": lambda: spark.createDataFrame([], SCHEMA),
        "nulls": lambda: spark.createDataFrame([(None,) * 5] * 7, SCHEMA),
        "clash": lambda: spark.createDataFrame([(*r, 1, 2, "x") for r in rows], f"{SCHEMA}, node int, label int, hash string"),
    }[case]()
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    os.symlink(f"{folder}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == (0 if case != "clash" else corpus_pipeline.run(spark, folder).count())
