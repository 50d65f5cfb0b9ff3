"""BPE encoding and decoding with a segment tree (operator 10).

A pre-token's bytes are leaves of a segment tree over the ranks of adjacent pairs. The root holds the least (rank,
position), so it names the leftmost lowest-rank merge; a merge updates at most three leaves and their paths, until the
root holds no mergeable pair. Words are kept with their ids as in word_tokens, within the same bound.

Defined results: a null or empty text has no ids and decodes to the empty text; special tokens inside a text are single
ids; texts are never cut. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm._common import slices, table
from veritab.llm.word_tokens import Kept, byte_letters, definition, plain_words, specials, tokenizer, vocabulary

NO_PAIR = 1 << 62
#: Of a tree node's value; a pre-token may have so many bytes as these bits can count.
POSITION_BITS = 40
#: Symbols that one pass takes at most, if it has more than one word.
PASS_SYMBOLS = 1 << 18
SUMMARY = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Merges:
    """Ranks of adjacent pairs and the symbols that merges make."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        """pairs: (left, right, merged) by rank."""
        table = np.array(pairs, np.int64).reshape(-1, 3)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), table[:, 2]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NO_PAIR where it can't merge."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_PAIR)

    def apply(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Merges every row of symbols, whose first sizes[i] count, until no row has a mergeable pair; -1: no symbol.

        tree[i] is row i's segment tree: leaf p holds rank and position of the pair that starts at p, an inner node the
        lesser of its two children, so tree[i, 1] is the leftmost lowest-rank pair."""
        rows, width = symbols.shape
        leaves = 1 << max(0, width - 1).bit_length()
        sym = np.full((rows, width + 1), -1, np.int64)
        sym[:, :-1] = np.where(np.arange(width) < sizes[:, None], symbols, -1)
        tree = np.full((rows, 2 * leaves), NO_PAIR, np.int64)
        pairs = sym[:, 1:-1] >= 0
        found = self.rank(sym[:, :-2][pairs], sym[:, 1:-1][pairs])
        held = np.full(pairs.shape, NO_PAIR, np.int64)
        held[pairs] = np.where(found < NO_PAIR, found << POSITION_BITS | np.nonzero(pairs)[1], NO_PAIR)
        tree[:, leaves : leaves + width - 1] = held
        for i in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        after = np.minimum(after, np.append(sizes[:, None], sizes[:, None], axis=1)[:, :1])
        before = np.tile(np.arange(-1, width), (rows, 1))

        def put(r: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            at = at + leaves
            tree[r, at] = value
            while at[0] > 1:
                at = at >> 1
                tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

        r = np.flatnonzero(tree[:, 1] != NO_PAIR)
        while len(r):
            top = tree[r, 1]
            i = top & ((1 << POSITION_BITS) - 1)
            j = after[r, i]
            new = self.merged[top >> POSITION_BITS]
            sym[r, i] = new
            sym[r, j] = -1
            k, p = after[r, j], before[r, i]
            after[r, i] = k
            before[r, k] = i
            put(r, j, np.full(len(r), NO_PAIR))
            right = np.where(k < sizes[r], self.rank(new, sym[r, k]), NO_PAIR)
            put(r, i, np.where(right < NO_PAIR, right << POSITION_BITS | i, NO_PAIR))
            left = np.where(p >= 0, self.rank(sym[r, np.maximum(p, 0)], new), NO_PAIR)
            q = p >= 0
            if q.any():
                put(r[q], p[q], np.where(left < NO_PAIR, left << POSITION_BITS | p, NO_PAIR)[q])
            r = r[tree[r, 1] != NO_PAIR]
        return sym[:, :-1]


class Encoder:
    """Ids and token texts of whole texts under one vocabulary file."""

    def __init__(self, path: str):
        model = definition(path)["model"]
        self.path, vocab, suffix = path, model["vocab"], model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        self.bytes = {x: b for b, x in enumerate(self.letters)}
        self.inner = np.array([vocab[x] for x in self.letters])
        self.last = np.array([vocab[x + suffix] for x in self.letters])
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.names = {i: x for x, i in vocab.items()} | {x["id"]: x["content"] for x in definition(path)["added_tokens"]}
        self.special_ids = {x["content"]: x["id"] for x in definition(path)["added_tokens"]}
        self.kept = Kept(self._words)

    def ids_of(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token's bytes; words of like length share a pass."""
        out: list[list[int]] = [[]] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                classes.setdefault(max(3, (len(w) - 1).bit_length()), []).append(i)
        for bits, members in classes.items():
            step = max(1, PASS_SYMBOLS >> bits)
            for a in range(0, len(members), step):
                some = members[a : a + step]
                sizes = np.array([len(words[i]) for i in some])
                width = int(sizes.max())
                raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in some), np.uint8).reshape(-1, width)
                symbols = self.inner[raw]
                symbols[np.arange(len(some)), sizes - 1] = self.last[raw[np.arange(len(some)), sizes - 1]]
                merged = self.merges.apply(symbols, sizes)
                kept = merged >= 0
                flat, ends = merged[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
                for i, start, end in zip(some, [0, *ends[:-1]], ends, strict=True):
                    out[i] = flat[start:end]
        return out

    def _words(self, words: list[str]) -> list[tuple[str, str, int]]:
        """Decimal ids and token texts of plain pre-tokens, joined by spaces, and their number."""
        return [(" ".join(map(str, ids)), self.decode(ids), len(ids)) for ids in self.ids_of([x.encode() for x in words])]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, one pre-token after another."""
        out: list[int] = []
        steps, at = tokenizer(self.path), 0
        for m in [*specials(self.path).finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                split = steps.pre_tokenizer.pre_tokenize_str(steps.normalizer.normalize_str(part))
                for ids in self.ids_of([bytes(map(self.bytes.__getitem__, letters)) for letters, _ in split]):
                    out += ids
            if m:
                out.append(self.special_ids[m[0]])
                at = m.end()
        return out

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder: token texts, special ones too, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))

    def summaries(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """The number of ids, the decimal ids and the decoded text of each text."""
        split = [plain_words(x, self.path) for x in texts]
        plain = iter(self.kept.values([x for x in split if x is not None]))
        for text, words in zip(texts, split, strict=True):
            if words is None:
                ids = self.encode(text)
                yield len(ids), " ".join(map(str, ids)), self.decode(ids)
            else:
                a, b, n = zip(*found, strict=True) if (found := next(plain)) else ((), (), ())
                yield sum(n), " ".join(a), " ".join(b)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


def bpe_ids(text: Column, path: str | None = None) -> Column:
    """The ids of each text as array<int>."""
    path = path or vocabulary()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([encoder(path).encode(x or "") for x in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def bpe_text(ids: Column, path: str | None = None) -> Column:
    """The decoded text of each id list."""
    path = path or vocabulary()

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return pa.array([None if x is None else encoder(path).decode(x) for x in lists.to_pylist()], pa.string())

    return text(ids)


def bpe_summary(text: Column, path: str | None = None) -> Column:
    """Number and digest of each text's ids, and the digest of the text they decode to."""
    path = path or vocabulary()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()

    @F.arrow_udf(SUMMARY)
    def summary(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for texts in batches:
            parts = [[], [], []]
            for _, whole in slices(texts):
                for n, ids, decoded in own.summaries([x or "" for x in whole]):
                    for part, value in zip(parts, (n, digest(ids), digest(decoded)), strict=True):
                        part.append(value)
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(parts, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["n_tokens", "ids_sha256", "decoded_sha256"])
        own.kept.clear()

    return summary(text)


def op10_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", bpe_summary(F.col("text")).alias("r"))
    return docs.select("doc_id", "r.*")
