"""Quality rules by repetition coverage (operator 9).

A text's words are numbered by first appearance, rolling hashes of several n-gram lengths are taken over the numbers in
numpy, and the characters inside n-grams that occur twice or more, and inside repeated lines, are measured.

Defined results: a null or empty text has no words, so it fails the base rule; texts are never cut; repeated rows give
repeated results; other columns of the input stay untouched, as the rules read one column only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm._common import bytes_of, mix, table

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = re.compile(rb"[#*$%&|<>]")
#: n-gram lengths whose duplicates are measured, with the largest share of a text's word characters they may cover.
LIMITS = ((5, 0.40), (7, 0.35), (10, 0.30))
MAX_LINE_SHARE = 0.30
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """The verdict's parameters: shares of word characters."""

    ngrams: tuple[tuple[int, float], ...] = LIMITS
    lines: float = MAX_LINE_SHARE
    min_words: int = 50
    max_repeat_percent: int = 50


SCHEMA = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(x, T.BooleanType()) for x in ("base_failed", "kept")]
    + [T.StructField("dup_line_share", T.DoubleType()), T.StructField("dup_ngram_shares", T.ArrayType(T.DoubleType()))]
)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    if len(keys) < 2:
        return np.zeros(len(keys), bool)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """True for each word inside a window of n words that starts where `starts` is true."""
    edge = np.zeros(words + 1, np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def windows3(ids: np.ndarray, distinct: int) -> np.ndarray:
    """Exact keys of the three-word windows: the numbers side by side, or renumbered pairs where they don't fit."""
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if distinct < 1 << 21:
        return (a << np.uint64(42)) | (b << np.uint64(21)) | c
    pairs = np.unique((a << np.uint64(32)) | b, return_inverse=True)[1].astype(np.uint64)
    return (pairs << np.uint64(32)) | c


def rolling(ids: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of all windows of each length: prefix sums of a polynomial, brought to one power."""
    powers = np.multiply.accumulate(np.full(len(ids) + 1, BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
    return {n: (sums[n:] - sums[:-n]) * powers[::-1][n : len(powers)] for n in lengths if n <= len(ids)}


def measure(raw: bytes, limits: Limits) -> tuple:
    """One row of SCHEMA for one text."""
    words = raw.split()
    n = len(words)
    symbols = len(SYMBOLS.findall(raw))
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        elif not line.isspace() and line:
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    by_word = np.fromiter((len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in number), np.int64, len(number))
    chars = by_word[ids.astype(np.int64)] if n else np.zeros(0, np.int64)
    total = int(chars.sum())
    repeat = int(covered(repeated(windows3(ids, len(number))), 3, n).sum()) if n >= 3 else 0
    base_failed = n < limits.min_words or 100 * repeat > limits.max_repeat_percent * n
    hashes = rolling(ids, [k for k, _ in limits.ngrams]) if n else {}
    shares = [float(chars[covered(repeated(hashes[k]), k, n)].sum()) / max(1, total) if k in hashes else 0.0 for k, _ in limits.ngrams]
    line_share = dup_line_chars / max(1, total)
    kept = not base_failed and line_share <= limits.lines and all(s <= most for s, (_, most) in zip(shares, limits.ngrams, strict=True))
    return n, total, symbols, dup_lines, repeat, base_failed, kept, line_share, shares


def repetition_rules(text: Column, limits: Limits = Limits()) -> Column:
    """A struct of SCHEMA for each text."""

    @F.arrow_udf(SCHEMA)
    def rules(texts: pa.Array) -> pa.Array:
        rows = [measure(x, limits) for x in bytes_of(texts)]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.list_(pa.float64())]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=SCHEMA.names)

    return rules(text)


def op9_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repetition_rules(F.col("text")).alias("r"))
    return docs.select("doc_id", "r.*")
