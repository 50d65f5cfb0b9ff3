"""Operator 13 against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import ODD
from veritab.llm import collocations as mining

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def counted(rows, least, cover, top):
    """The contract's result for (lang, text) rows, by counting all phrases."""
    out = []
    counts, total = {}, Counter()
    for lang, text in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_TO_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for size in (1, 2, 3):
                f.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= cover * a for q, b in candidates.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(x[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for x in df.collect())


def corpus(seed):
    r = random.Random(seed)
    words = ["The", "new", "York", "city", "É", "né", "a", "b", "x y", "​", "it's", "中文"]
    return [(r.choice(["en", "en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", ";"]) for _ in range(r.randint(0, 60)))) for _ in range(150)]


@pytest.mark.parametrize("size", [1 << 24, 2000, 1])
def test_phrases_equal_plain_counts(spark, monkeypatch, size):
    monkeypatch.setattr(mining, "SEGMENT_BYTES", size)
    monkeypatch.setattr(mining, "WAITING_BYTES", 3 * size)
    rows = [*corpus(size), (None, None), ("en", ""), ("de", "  \n\t"), ("en", "a a a a a " * 30)]
    docs = spark.createDataFrame([(a, b, 1, 2, "w") for a, b in rows], "lang string, text string, n int, id int, word string")
    for least, cover, top in ((10, 50, 2000), (3, 80, 7), (2, 101, 30)):
        assert rows_of(mining.collocations(docs, least, cover, top)) == counted(rows, least, cover, top)


def test_ties_of_cuts_and_of_ranks(spark):
    rows = [("en", "p q r. " * 12), ("en", "s t. " * 12), ("en", "u v, " * 12), ("en", "b c. " * 9)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = rows_of(mining.collocations(docs))
    assert got == counted(rows, 10, 50, 2000)
    assert [x[2] for x in got] == ["p q r", "s t", "u v"]


def test_odd_documents_and_empty_tables(spark, odd, no_docs):
    assert rows_of(mining.collocations(odd.withColumnRenamed("lang_pred", "lang"))) == counted([("x", t) for _, t in ODD], 10, 50, 2000)
    assert mining.collocations(no_docs.withColumnRenamed("lang_pred", "lang")).count() == 0


def test_products_beyond_64_bits(spark):
    big = spark.createDataFrame([(3_000_000_007, 3_000_000_011, 3_000_000_019)], "a long, l long, r long").select(mining.exact_score("a", "l", "r").alias("s"))
    assert big.first().s == 1_000_000 * 3_000_000_007**2 // (3_000_000_011 * 3_000_000_019)


def test_lists_come_back_as_packed():
    sizes = np.array([3, 1, 4])
    lists = np.array([0, 5, 70_000, 2, 1, 3, 4, 4_000_000_000])
    a, b = mining.unpacked(mining.packed(sizes, lists))
    assert a.tolist() == sizes.tolist() and b.tolist() == lists.tolist()
