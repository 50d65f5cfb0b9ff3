"""Groups of similar texts against brute force over whole shingle sets."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritab.llm import similar_copies as m
from veritab.llm.simhash_dedup import components, settled

SF = "/root/testdata/sf0.001"


def shingles(text: str | None) -> set:
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def groups(ids: list, texts: list) -> list:
    """The least id of each text's component of pairs that share 0.8 of their shingles."""
    sets = [shingles(x) for x in texts]
    near = [[j for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)] for x in sets]
    label = list(ids)
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(sets))]
        if new == label:
            return label
        label = new


def edited(draw: random.Random, words: list[str], times: int) -> list[str]:
    out = list(words)
    for _ in range(times):
        out[draw.randrange(len(out))] = f"new{draw.getrandbits(30)}"
    return out


@pytest.mark.parametrize("rounds", [((2, False, 4), (2, True, 1), (4, False, 1)), ((1, False, 1),)])
def test_large_groups_against_brute_force(spark, monkeypatch, rounds):
    """Copies of a few texts with one to eight edits, so groups hold chains and members that only some others are near to."""
    monkeypatch.setattr(m, "ROUNDS", rounds)
    monkeypatch.setattr(m, "GROWTH", 3)
    draw = random.Random(11)
    texts = []
    for _ in range(4):
        base = [f"w{draw.randrange(500)}" for _ in range(160)]
        texts += [" ".join(edited(draw, base, draw.randint(0, 8))) for _ in range(60)]
    texts += ["", None, "one two", "ONE two", "one two three"]
    draw.shuffle(texts)
    ids = list(range(len(texts)))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in m.similar_documents(docs).collect()}
    assert [found[i] for i in ids] == groups(ids, texts)


def test_table_against_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    found = m.similar_documents(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().sort_values("doc_id")
    assert found.component_id.tolist() == groups(docs.doc_id.tolist(), docs.text.tolist())


def test_pivot_cells_bring_pairs_without_a_common_band(spark, monkeypatch):
    """Texts with one word changed in five hundred, and no bucket of bands with two classes: only pivot cells link."""
    real = m.sketch

    def lonely(text, n):
        s = real(text, n)
        return F.struct(s["fp"].alias("fp"), F.array(*[F.xxhash64(text, F.lit(k)) for k in range(m.BANDS)]).alias("keys"), s["bits"].alias("bits"))

    monkeypatch.setattr(m, "sketch", lonely)
    draw = random.Random(5)
    texts = []
    for _ in range(3):
        base = [f"w{draw.randrange(5000)}" for _ in range(500)]
        texts += [" ".join(base), *[" ".join(edited(draw, base, 1)) for _ in range(12)]]
    prints = [m.majority(m.shingle_set(x.encode(), m.WORDS)) for x in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    label = list(range(len(texts)))
    for _ in label:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    assert any(i != x for i, x in enumerate(label))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in m.similar_documents(docs).collect()}
    assert [found[i] for i in range(len(texts))] == label


def test_what_pivot_cells_bring_is_verified(spark, monkeypatch):
    """Every SimHash the same: all texts meet there, and only alike ones stay linked."""
    real = m.sketch
    monkeypatch.setattr(m, "sketch", lambda text, n: F.struct(F.lit(7).cast("long").alias("fp"), real(text, n)["keys"].alias("keys"), real(text, n)["bits"].alias("bits")))
    test_table_against_brute_force(spark)


def test_band_keys_do_not_depend_on_chunks(monkeypatch):
    h = np.random.default_rng(3).integers(0, 2**63, 3000, dtype=np.uint64)
    whole = m.band_keys(h)
    monkeypatch.setattr(m, "CHUNK", 7)
    assert (m.band_keys(h) == whole).all() and len(set(whole.tolist())) == m.BANDS


def test_odd_texts(spark, odd, no_docs):
    found = m.similar_documents(odd).collect()
    assert len(found) == 10
    by = {r.doc_id: r.component_id for r in found}
    assert by[1] == by[2] == by[3] == 1 and by[6] == by[7] == 6 and by[None] is None
    assert m.similar_documents(no_docs).isEmpty()


def test_few_pairs_take_few_jobs(spark):
    """What the driver holds grows with the number of jobs; the driver's memory failed the check with 71 of them here."""
    from veritab.llm.stages import keep_one_of_each

    run = spark._jsparkSession.sharedState().statusStore().executionsCount
    before = run()
    kept = keep_one_of_each(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).select("doc_id").collect()
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert {r.doc_id for r in kept} == set(groups(docs.doc_id.tolist(), docs.text.tolist())) and run() - before <= 45


def test_rounds_and_pairs_beyond_those_verified_at_once(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_PAIRS", 1)
    monkeypatch.setattr(m, "AT_ONCE", 0)
    test_table_against_brute_force(spark)


def test_settled_edges(spark):
    edges = lambda *some: spark.createDataFrame(list(some), "a long, b long")
    assert settled(edges((2, 1), (3, 1), (9, 4))) and not settled(edges((3, 2), (2, 1))) and not settled(edges((3, 2), (3, 1)))
    chain = {r.vertex: r.root for r in components(edges(*[(x + 1, x) for x in range(40)]), stored=True).collect()}
    assert chain == dict.fromkeys(range(1, 41), 0)


def test_rounds_read_each_open_row_once(spark, monkeypatch):
    """Over a large group of near copies, joins with the components made twenty times as many rows as classes stand in buckets."""
    monkeypatch.setattr(m, "BUCKET_PAIRS", 1)
    told = []
    real = m.link_classes
    monkeypatch.setattr(m, "link_classes", lambda shared, *rest: told.append(shared.count()) or real(shared, *rest))
    draw = random.Random(3)
    base = [f"w{draw.randrange(500)}" for _ in range(160)]
    texts = [" ".join(edited(draw, base, draw.randint(0, 8))) for _ in range(120)]
    store = spark._jsparkSession.sharedState().statusStore()
    before = {x.executionId() for x in listed(store.executionsList())}
    found = {r.doc_id: r.component_id for r in m.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i] for i in range(len(texts))] == groups(list(range(len(texts))), texts)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = 0
    for x in [x.executionId() for x in listed(store.executionsList()) if x.executionId() not in before]:
        values = store.executionMetrics(x)
        for node in listed(store.planGraph(x).allNodes()):
            if "Join [cls" in node.desc() or "Join [label" in node.desc():
                rows = [values.get(p.accumulatorId()) for p in listed(node.metrics()) if p.name() == "number of output rows" and "LeftOuter" in node.desc()]
                made += sum(int(r.get().replace(",", "")) for r in rows if r.isDefined())
    assert 0 < made <= 8 * told[0]


def listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]
