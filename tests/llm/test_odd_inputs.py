"""Queries and the pipeline over tables with odd rows: nulls, repeated ids and rows, clashing columns, no rows at all."""

import importlib.util

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from veritab.llm import bpe, conversation_repair, quality_classifier, quality_rules, sentence_pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, lang_pred string, score double, kept boolean, stats array<double>, doc string, found string, _key string, _row int, _class long, ids array<int>, segment long, audit string"
GOOD = "The committee met in the town hall and talked about the new bridge, its cost and the time that it would take. "


def odd_rows():
    rows = [(i, t) for i, t in ODD] + [(k, GOOD * (1 + k % 3) + f"Item {k}.") for k in range(20, 60)] + [(20, GOOD), (20, GOOD), (None, None), (None, "no id")]
    return [(i, t, "en" if (i or 0) % 3 else None, "s", 1, "x", 0.1, True, [1.0], "d", "f", "k", 1, 2, [1], 3, "K") for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables whose documents are odd, with doubled and null labels."""
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(k, k % 2, 0, "x") for k in range(20, 60)] + [(21, 1, 0, "x"), (22, None, None, None), (None, 1, 0, "x"), (7, 1, 0, "y"), (7, 0, 0, "y")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{at}/labels.parquet")
    talk = [(1, 0, "user", "Hi.", "a"), (1, 0, "user", "Hi.", "a"), (None, None, None, None, None), (2, 5, "assistant", "Word " * 50_000 + ".", "b")]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string, audit string").write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("none"))
    for name in ("documents", "labels", "conversations"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{at}/{name}.parquet")
    return at


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


ROW_QUERIES = [quality_rules.op9_repetition_rules, quality_classifier.op5_quality_classifier, bpe.op10_bpe_segment_tree, sentence_pieces.op12_piece_chunks]


@pytest.mark.parametrize("run", ROW_QUERIES, ids=lambda f: f.__name__)
def test_every_row_has_its_row(spark, folder, empty, run):
    found = run(spark, folder)
    assert ids(found) == ids(spark.read.parquet(f"{folder}/documents.parquet"))
    assert run(spark, empty).count() == 0
    assert run(spark, empty).columns == found.columns


def test_rules_of_a_long_text_by_plain_counting(spark, tmp_path):
    """A text of 30,000 words with repeats, counted word by word."""
    import random

    r = random.Random(1)
    lines = [" ".join(r.choice(["oak", "elm", "ash", "fir", "yew", "bay", "#1", "fig|"]) for _ in range(r.randint(0, 9))) for _ in range(6_000)]
    text = "\n".join(lines)
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    seen, repeated = set(), 0
    for line in lines:
        if line.split():
            repeated += line in seen
            seen.add(line)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    row = quality_rules.op9_repetition_rules(spark, str(tmp_path)).first()
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(words), sum(map(len, words)), text.count("#") + text.count("|"), repeated, len(inside))
    assert row.base_failed == (100 * len(inside) > 50 * len(words)) and not (row.base_failed and row.kept)


def test_scores_are_probabilities_and_equal_texts_score_alike(spark, folder):
    rows = quality_classifier.op5_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").distinct(), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in rows if r.doc_id in (6, 7)} and len({r.score for r in rows if r.doc_id in (6, 7)}) == 1


def test_repair_query_over_odd_and_empty_tables(spark, folder, empty):
    rows = {r.conv_id: r for r in conversation_repair.op11_repair_automata(spark, folder).collect()}
    assert set(rows) == {None, 1, 2} and all(len(r.repaired_sha256) == 64 for r in rows.values())
    assert conversation_repair.op11_repair_automata(spark, empty).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")
def test_pipeline_over_odd_and_empty_tables(spark, folder, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() <= docs.count(), k
    assert corpus_pipeline.run(spark, folder).where(F.col("length") <= 0).count() == 0
    assert corpus_pipeline.run(spark, empty).count() == 0
