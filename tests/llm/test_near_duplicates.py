"""SimHash classes against brute force, and the pipeline's stages."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veritab.llm import simhash_dedup as m
from veritab.llm import stages, word_tokens

SF = "/root/testdata/sf0.001"


def brute(prints: list[int]) -> list[int]:
    """The least member of each fingerprint's component."""
    label = list(range(len(prints)))
    near = [[j for j, y in enumerate(prints) if ((x ^ y) & (2**64 - 1)).bit_count() <= 2] for x in prints]
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(prints))]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("cell_pairs", [24, 2])
def test_links_and_components_against_brute_force(spark, cell_pairs):
    """Dense balls around a few centres, by pairs and by neighbourhoods."""
    draw = random.Random(4)
    prints = {0}
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(draw.randint(0, 4)):
                x ^= 1 << draw.randrange(64)
            prints.add(x)
    prints = sorted(m.signed(x) for x in prints)
    found = {r.vertex: r.root for r in m.components(m.links(spark.createDataFrame([(x,) for x in prints], "fp long"), cell_pairs)).collect()}
    label = brute(prints)
    assert [found.get(x, x) for x in prints] == [prints[k] for k in label]


def test_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    found = m.op7_simhash_pivots(spark, SF).toPandas().sort_values("doc_id")
    import xxhash

    for i, text, hexed in zip(docs.doc_id, docs.text, found.fingerprint, strict=True):
        words = text.encode().translate(m.LOWER).split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))] if words else []
        assert int(hexed, 16) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), i
    label = brute([int(x, 16) for x in found.fingerprint])
    assert found.component_id.tolist() == [found.doc_id.iloc[k] for k in label]


def test_odd_texts(spark, odd, no_docs):
    found = m.near_duplicates(odd, 3).collect()
    assert len(found) == 10
    by = {r.doc_id: r.component_id for r in found}
    assert by[1] == by[2] == by[3] == 1 and by[6] == by[7] == 6 and by[None] is None
    assert m.near_duplicates(no_docs, 3).isEmpty()


def test_stage_keeps_one_of_each(spark, odd, no_docs):
    kept = stages.keep_one_of_each(spark, odd, SF)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 8]
    assert stages.keep_one_of_each(spark, no_docs, SF).isEmpty()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:2]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert len((before & good) - kept) <= 0.03 * len(good), name
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert packed.groupby("sequence_id").length.sum().map(lambda n: n & (n - 1) == 0).all()
    assert np.isin(packed.doc_id, list(before)).all()


def test_stage_keeps_each_group_whatever_its_ids(spark):
    """Unrelated texts without doc_id, copies without doc_id of a kept text, and two texts under one doc_id."""
    texts = [" ".join(f"{name}{k}" for k in range(40)) for name in ("red", "green", "blue", "black", "white")]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1] + " end"), (1, texts[2]), (None, texts[2]), (2, texts[3]), (2, texts[4]), (3, texts[4] + " end")]
    kept = stages.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    groups = sorted((r.doc_id or 0, next(k for k, t in enumerate(texts) if r.text.startswith(t))) for r in kept)
    assert groups == [(0, 0), (0, 1), (1, 2), (2, 3), (2, 4)]


def test_pipeline_packs_one_of_each_group(spark):
    """run() packs every document that the two classifiers keep, but for copies: by brute force over their whole shingle sets."""
    from test_similar_copies import groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF)
    clean = docs.select("doc_id", "text").toPandas().sort_values("doc_id")
    kept = set(groups(clean.doc_id.tolist(), clean.text.tolist()))
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == kept
    library = word_tokens.tokenizer(word_tokens.vocabulary())
    lengths = packed.groupby("doc_id").length.sum()
    expected = {i: len(library.encode(x, add_special_tokens=False).ids) + 1 for i, x in zip(clean.doc_id, clean.text, strict=True) if i in kept}
    assert lengths.to_dict() == expected


def test_stages_of_odd_tables(spark):
    """Null and repeated ids, repeated rows, clashing and odd column names, no tags, no labels, an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _veritab_language string, `a.b` int, found int, doc string"
    story = lambda k: " ".join(f"word{k}x{j}" for j in range(40))
    rows = [(i, t, g, "s", 1, "own", 5, 6, "d") for i, t, g in [(1, story(1), "en"), (1, story(2), "en"), (1, story(1), "en"), (None, story(3), "en"), (None, story(4), None), (None, story(5), None), (2, None, "en"), (3, "", None), (4, " \n", "en"), (5, "12 34", "en"), (6, "word " * 30_000, "en")]]
    docs = spark.createDataFrame(rows, schema)
    for stage, sizes in ((stages.keep_identified, 7), (stages.keep_good, None), (stages.keep_one_of_each, 8)):
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema and {r._veritab_language for r in out.select("_veritab_language").collect()} <= {"own"}
        assert sizes is None or out.count() == sizes, stage
        assert stage(spark, docs.limit(0), SF).isEmpty()
    untagged = stages.keep_identified(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF)
    assert untagged.count() == 7
    assert stages.pack(spark, docs, SF).selectExpr("sum(length) > 0").first()[0] and stages.pack(spark, docs.limit(0), SF).isEmpty()


def test_stage_does_not_depend_on_the_order_of_rows(spark):
    """Copies under one id differ in other columns: whichever way the rows are dealt, the same one stays."""
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text, f"s{k}") for k in range(20)] + [(None, text + " end", "t")] * 3
    kept = {tuple(map(tuple, stages.keep_one_of_each(spark, spark.createDataFrame(rows[::step], "doc_id long, text string, source string").repartition(n), SF).collect())) for step, n in ((1, 3), (-1, 5))}
    assert len(kept) == 1 and len(next(iter(kept))) == 1
