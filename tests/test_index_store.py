"""The index that follows its files against one that is built at once."""

import math

import pytest
from pyspark.sql import functions as F

from veritab.operators import index_store, retrieval
from veritab.operators.index_store import IndexStore

SCHEMA = "file string, version string, text string"
FIRST = [("a.md", "1", "alpha notes on zebras and migration " * 40), ("b.md", "1", "beta notes on sourdough baking"), ("c.md", "1", "gamma: budget, budget and zebras"), ("empty.md", "1", " "), ("none.md", None, None)]
LATER = [("a.md", "2", "alpha notes now on quasars and telescopes"), FIRST[1], FIRST[3], FIRST[4], ("d.md", "7", "delta budget of the sourdough quasars")]


def scores(index, words):
    return {(r.file, r.ordinal): round(r.score, 9) for r in index.search(words).collect()}


def plain(spark, rows, words, folder):
    """The same scores from an index that is built at once over the chunks."""
    cut = retrieval.chunks(spark.createDataFrame(rows, SCHEMA), "file")
    return scores(retrieval.build_index(cut, ["file", "ordinal"], "chunk", folder), words)


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"))


def counted(monkeypatch):
    """Counts the files that are cut and tokenised."""
    seen = []
    real = index_store.chunks
    monkeypatch.setattr(index_store, "chunks", lambda docs, key: seen.append(docs.count()) or real(docs, key))
    return seen


def test_only_what_changed_is_tokenised_and_scores_equal_a_new_build(spark, store, tmp_path, monkeypatch):
    seen = counted(monkeypatch)
    assert store.refresh(spark.createDataFrame(FIRST, SCHEMA)) == index_store.Refresh(5, 0, 0, 1)
    assert store.refresh(spark.createDataFrame(FIRST, SCHEMA)) == index_store.Refresh(0, 0, 5, 1)
    old = store.snapshot()
    change = store.refresh(spark.createDataFrame(LATER, SCHEMA))
    assert (change.added, change.removed, change.kept) == (2, 2, 3) and seen == [5, 2]
    for k, words in enumerate((["zebras", "budget"], ["quasars"], ["sourdough", "alpha", "sourdough", "nothing"], ["nothing"], [])):
        assert scores(store.snapshot(), words) == (plain(spark, LATER, words, f"{tmp_path}/later-{k}") if words else {})
        assert scores(old, words) == (plain(spark, FIRST, words, f"{tmp_path}/first-{k}") if words else {})
    assert not any(f == "a.md" for f, _ in scores(store.snapshot(), ["zebras", "migration"]))


def test_segments_merge_and_old_ones_go(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(index_store, "SEGMENTS", 2)
    rows = {f[0]: f for f in FIRST}
    for k in range(4):
        rows[f"new{k}.md"] = (f"new{k}.md", "1", f"budget number {k} zebras")
        rows["a.md"] = ("a.md", str(k + 5), f"alpha zebras version {k}")
        store.refresh(spark.createDataFrame(list(rows.values()), SCHEMA))
    assert len(store._told(store.latest())[0]) <= 2
    for k, words in enumerate((["zebras", "budget"], ["version", "alpha"])):
        assert scores(store.snapshot(), words) == plain(spark, list(rows.values()), words, f"{tmp_path}/merged-{k}")
    before = scores(store.snapshot(), ["zebras"])
    gone = store.vacuum()
    assert any(g.startswith("segments/") for g in gone) and store.commits() == [store.latest()]
    assert scores(store.snapshot(), ["zebras"]) == before and store.vacuum() == []


def test_a_commit_that_died_is_not_seen(spark, store, monkeypatch):
    store.refresh(spark.createDataFrame(FIRST, SCHEMA))
    real = index_store.written

    def dies(df, path):
        if path.endswith("/weights"):
            raise RuntimeError("lost")
        return real(df, path)

    monkeypatch.setattr(index_store, "written", dies)
    with pytest.raises(RuntimeError):
        store.refresh(spark.createDataFrame(LATER, SCHEMA))
    monkeypatch.undo()
    assert store.commits() == [1] and ("a.md", 0) in scores(store.snapshot(), ["zebras"])
    store.refresh(spark.createDataFrame(LATER, SCHEMA))
    assert ("a.md", 0) in scores(store.snapshot(), ["quasars"])


def test_all_files_may_go_and_retrieval_reads_a_snapshot(spark, store):
    store.refresh(spark.createDataFrame(FIRST, SCHEMA))
    names = spark.createDataFrame([(f, f) for f, _, _ in FIRST], "file string, name string")
    snap = store.snapshot()
    found = retrieval.retrieve(snap, snap.chunks, names, "file", ["sourdough", "baking"], 3).collect()
    assert found[0].file == "b.md" and found[0].snippet.startswith("beta notes")
    store.refresh(spark.createDataFrame([], SCHEMA))
    assert store.snapshot().search(["zebras"]).count() == 0 and store.snapshot().rows == 0
    assert store.files(store.latest()).where(F.col("file").isNotNull()).count() == 0


def test_postings_travel_as_lists_and_texts_do_not(spark, store, tmp_path):
    store.refresh(spark.createDataFrame([(str(k), "1", "zebras and sourdough") for k in range(40)], SCHEMA).coalesce(1))
    snap = store.snapshot()
    lists = snap.postings.select("term", F.size("file").alias("n")).collect()
    assert sum(r.n for r in lists) == 80 and len(lists) <= 2 * retrieval.SALT
    assert len(scores(snap, ["zebras"])) == 40
    own = retrieval.bags(snap.chunks, ["file", "ordinal"], "chunk")
    plan = retrieval.posting_lists(own, ["file", "ordinal"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("common", [0, 1, 200_000])
def test_norms_with_and_without_rare_terms(spark, common):
    rows = spark.createDataFrame([(k, "zebras zebras " + ("budget" if k % 3 else "") + f" own{k}") for k in range(9)], "k int, text string")
    own = retrieval.bags(rows, ["k"], "text")
    terms = retrieval.document_frequency(rows, "text")
    norms = {r.k: r.norm for r in retrieval.row_norms(own, ["k"], terms, 9, common).collect()}
    weight = lambda df: math.log(10 / (df + 1)) + 1
    for k in range(9):
        assert math.isclose(norms[k] ** 2, (2 * weight(9)) ** 2 + weight(1) ** 2 + (weight(6) ** 2 if k % 3 else 0))


def test_rows_without_key_and_repeated_keys_are_found(spark, tmp_path):
    rows = spark.createDataFrame([(None, "zebras budget"), (1, "zebras"), (1, "zebras sourdough"), (2, "budget")], "k int, text string")
    once = spark.createDataFrame([(None, "zebras budget"), (1, "zebras zebras sourdough"), (2, "budget")], "k int, text string")
    found = [retrieval.build_index(x, ["k"], "text", f"{tmp_path}/{i}") for i, x in enumerate((rows, once))]
    assert sorted(map(tuple, found[0].terms.select("term", "df", "tf").collect())) == sorted(map(tuple, found[1].terms.select("term", "df", "tf").collect()))
    assert {r.k for r in found[0].search(["zebras"]).collect()} == {None, 1}


def test_an_index_shuffles_lists_and_keeps_no_bags(spark, tmp_path):
    rows = spark.createDataFrame([(k, "zebras budget") for k in range(30)], "k int, text string").coalesce(1)
    index = retrieval.build_index(rows, ["k"], "text", str(tmp_path / "i"))
    lists = index.postings.select("term", F.size("k").alias("n")).collect()
    assert sum(r.n for r in lists) == 60 and len(lists) <= 2 * retrieval.SALT
    assert {x.name for x in (tmp_path / "i").iterdir() if not x.name.startswith(".")} == {"terms", "norms", "postings"}
    assert index.search(["zebras"]).count() == 30
