"""Language identification by prediction by partial matching (operator 8).

Each language has a byte context tree of order 3: counts of every byte after every context of at most three bytes. A byte
costs -log2 of its share in the longest context that has seen it, plus the escapes (method C) of the longer contexts that
have not; order -1 is uniform over 256 bytes. The statistics are frozen after training, so a text's code length under
each language is exact, and the shortest one names the language.

Training takes whole texts of at most `DOCS_PER_LANGUAGE` documents per language and `TRAINING_DOCS` in all (with many
languages each has fewer, but one at least), those with the smallest hashes of doc_id and text; everything else covers all
rows. Texts are lower-cased first.

Defined results: a null text or one without a letter is `und` with score 0; with no training rows every text is `und`.
A row without text, doc_id or lang is never learned from, and a document given several times is learned once. Repeated rows
give repeated results, and columns other than the ones named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.llm._common import materialise, passes, slices, table

DOCS_PER_LANGUAGE = 600
TRAINING_DOCS = 38_400
ORDER = 3
PAD = b"\0" * ORDER
#: Bytes of evidence at most that the posterior counts, so that it stays informative on long texts.
EVIDENCE = 64
UNDETERMINED = "und"
GRAMS = "lang string, n int, code long, times long"


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the four bytes that end at each byte of each text, and the texts' first positions among them."""
    raw = [x.lower().encode("utf-8", "replace") for x in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    b = np.frombuffer(b"".join(PAD + x for x in raw), np.uint8).astype(np.uint32)
    ends = np.cumsum(sizes + ORDER)
    real = np.ones(len(b), bool)
    for k in range(ORDER):
        real[ends - sizes - ORDER + k] = False
    if len(b) <= ORDER:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    codes = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
    return codes[real[3:]], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, code, times) of the n-grams, n from 1 to 4, of each batch's texts."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            codes, _ = grams([t for x, t in zip(langs, texts, strict=True) if x == lang])
            for n in range(1, ORDER + 2):
                found, times = np.unique(codes & np.uint32((1 << (8 * n)) - 1), return_counts=True)
                yield pa.record_batch({"lang": pa.array([lang] * len(found), pa.string()), "n": pa.array(np.full(len(found), n, np.int32)), "code": pa.array(found.astype(np.int64)), "times": pa.array(times.astype(np.int64))})


class ContextTree:
    """Frozen costs, in bits, of one language."""

    def __init__(self, counted: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.keys, self.cost, self.contexts, self.escape = {}, {}, {}, {}
        for n in range(1, ORDER + 2):
            codes, times = counted.get(n, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            order = np.argsort(codes)
            codes, times = codes[order], times[order].astype(np.float64)
            contexts, at = np.unique(codes >> 8, return_inverse=True)
            total, distinct = np.bincount(at, times, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(np.float64)
            self.keys[n], self.cost[n] = codes.astype(np.uint32), (-np.log2(times / (total + distinct)[at])).astype(np.float32)
            self.contexts[n], self.escape[n] = contexts.astype(np.uint32), (-np.log2(distinct / (total + distinct))).astype(np.float32)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The cost of the last byte of each four-byte code."""
        out = np.full(len(codes), 8.0, np.float32)
        for n in range(1, ORDER + 2):
            code = codes & np.uint32((1 << (8 * n)) - 1)
            out += self._look(self.contexts[n], self.escape[n], code >> np.uint32(8), 0.0)
            out = self._look(self.keys[n], self.cost[n], code, out)
        return out

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
        if not len(keys):
            return np.broadcast_to(np.float32(default), wanted.shape) if np.isscalar(default) else default
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default).astype(np.float32)


def sample(known: DataFrame, docs_per_language: int, training_docs: int) -> DataFrame:
    """(lang, text) of the documents with the smallest hashes of each language, from (lang, doc_id, text).

    A language's share of the hashes' range follows from its number of different documents, so that the window which ranks
    them sees little more than the sample, however many rows a language has."""
    hashed = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    most = F.greatest(F.lit(1), F.least(F.lit(docs_per_language), F.floor(training_docs / F.greatest(F.lit(1), F.count("*").over(Window.partitionBy())))))
    share = materialise(counts.withColumn("most", most).select("lang", "most", ((F.col("most") + 6 * F.sqrt("most") + 30) * 1.2 / F.col("n")).alias("share")))
    low = F.shiftrightunsigned("h", 1) / float(1 << 63)
    drawn = hashed.join(share, "lang").where(low < F.col("share")).groupBy("lang", "h").agg(F.first("most").alias("most"), F.first("text").alias("text"))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h")))
    return ranked.where("rank <= most").select("lang", "text")


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", training_docs: int = TRAINING_DOCS) -> dict[str, ContextTree]:
    """Context trees from a bounded sample of whole documents of each language; what reaches the driver are the counts of
    that sample."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).dropna()
    counted = sample(known, docs_per_language, training_docs).mapInArrow(count_grams, GRAMS).groupBy("lang", "n", "code").agg(F.sum("times").alias("times")).toArrow()
    if not counted.num_rows:
        return {}
    counted = counted.sort_by([("lang", "ascending"), ("n", "ascending"), ("code", "ascending")])
    names = counted["lang"].combine_chunks().dictionary_encode()
    lang_at, n, code, times = names.indices.to_numpy(), *(counted[k].to_numpy() for k in ("n", "code", "times"))
    out = {}
    for k, name in enumerate(names.dictionary.to_pylist()):
        lo, hi = np.searchsorted(lang_at, [k, k + 1])
        cut = lo + np.searchsorted(n[lo:hi], np.arange(1, ORDER + 3))
        out[name] = ContextTree({m: (code[a:b], times[a:b]) for m, a, b in zip(range(1, ORDER + 2), cut[:-1], cut[1:], strict=True)})
    return out


def identify(texts: list[str | None], trees: dict[str, ContextTree]) -> tuple[list[str], list[float]]:
    """The language and score of each text."""
    names = list(trees)
    out: list[str] = [UNDETERMINED] * len(texts)
    scores = [0.0] * len(texts)
    able = [i for i, x in enumerate(texts) if names and x and any(map(str.isalpha, x))]
    for a, b in passes([texts[i] for i in able]):
        rows = able[a:b]
        codes, starts = grams([texts[i] for i in rows])
        found, at = np.unique(codes, return_inverse=True)
        bits = np.stack([np.add.reduceat(trees[x].bits(found)[at].astype(np.float64), starts) for x in names])
        sizes = np.diff(np.append(starts, len(codes)))
        worse = (bits - bits.min(axis=0)) * np.minimum(1.0, EVIDENCE / np.maximum(sizes, 1))
        share = 1 / np.exp2(-np.minimum(worse, 1000)).sum(axis=0)
        for i, k, s in zip(rows, bits.argmin(axis=0), share, strict=True):
            out[i], scores[i] = names[k], float(s)
    return out, scores


def language_of(text: Column, trees: dict[str, ContextTree]) -> Column:
    """struct(lang_pred, score) of each text."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(trees)

    @F.arrow_udf("lang_pred string, score double")
    def language(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for _, some in slices(texts):
            found = identify(some, shared.value)
            names += found[0]
            scores += found[1]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return language(text)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = train(docs.where(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language_of(F.col("text"), trees).alias("r")).select("doc_id", "held_out", "r.*")
