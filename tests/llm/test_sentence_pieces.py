"""Operator 12 against the sentencepiece library."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from veritab.llm import sentence_pieces as pieces

LETTERS = "aeiou tnrs  \n.,;▁é中😀0€\t\x00“"


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.vocabulary())


@pytest.fixture(scope="module")
def own():
    return pieces.Encoder(pieces.vocabulary(), most=20_000)


def texts():
    r = random.Random(12)
    fixed = ["", " ", "  ", "\n", " \n ", "a  b ", "x▁y", "▁", "▁▁ a", "中文😀🏳️‍🌈 ﷽", "<s> </s> <unk> <0x41>", " " * 37 + "x" + " " * 5, "a" * 5000, "ab" * 300 + "é" * 100, "word, " * 3000, "e.g. U.S.A, x.y;z", "⁇"]
    return fixed + ["".join(r.choice(LETTERS) for _ in range(r.randint(1, 60))) for _ in range(1500)]


def test_ids_and_texts_equal_the_library(library, own):
    every = texts()
    for text in every:
        ids = library.encode(text)
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids)
    for part in (every[:700], every[700:], every[:20]):  # over a table that is full meanwhile
        for text, (n, ids, decoded) in zip(part, own.summaries(part), strict=True):
            assert (n, ids, decoded) == (len(library.encode(text)), ",".join(map(str, library.encode(text))), library.decode(library.encode(text)))


def test_any_ids_decode_as_in_the_library(library, own):
    r = random.Random(13)
    for _ in range(1500):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000), r.randrange(259, 300), 0, 1, 2]) for _ in range(r.randint(1, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_columns_of_odd_rows(spark, odd, no_docs, library):
    found = odd.select("doc_id", "lang_pred", pieces.piece_summary(F.col("text")).alias("r"), pieces.piece_ids(F.col("text")).alias("ids")).withColumn("back", pieces.piece_text(F.col("ids"))).collect()
    assert len(found) == len(ODD)
    for x, (_, text) in zip(sorted(found, key=lambda x: (x.doc_id is None, x.doc_id)), sorted(ODD, key=lambda x: (x[0] is None, x[0])), strict=True):
        ids = library.encode(text or "")
        assert list(x.ids) == ids and x.r.n_tokens == len(ids) and x.back == library.decode(ids)
        assert x.r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert no_docs.select(pieces.piece_summary(F.col("text"))).count() == 0


def test_query_on_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    text = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in pieces.op12_piece_chunks(spark, sf).collect():
        ids = library.encode(text[x.doc_id])
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_a_vocabulary_whose_pieces_cross_is_refused(monkeypatch):
    monkeypatch.setattr(pieces, "CROSSING", pieces.re.compile("[a-z][a-z]"))
    with pytest.raises(ValueError, match="cross"):
        pieces.Pieces(pieces.vocabulary())
