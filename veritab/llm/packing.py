"""Hierarchical multi-length packing (operator 3).

Documents are encoded and cut into full windows of the largest tier; what remains is routed to the smallest context size
that holds it. From the largest tier down, each window is filled from shorter tiers, best fit first, and closed by
cutting one document, the shortest that fits a shorter tier or else the longest of all, so windows are full at a power of
two and nothing is padded. Only one window of a block can stay open, and its pieces are carried to the next block; the last
open window of a task is closed by the binary digits of its length. The windows of a block
are dealt to step groups of `STEP_TOKENS` tokens, by turns in order of attention cost, so groups of a tier cost alike.

Each task packs what it reads, in blocks of bounded size: no shuffle, and a lost task is read and packed again to the same
rows. Defined results: a null or empty text is its end id alone; repeated rows are packed each; columns other than doc_id
and text are never read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from veritab.llm._common import slices, table
from veritab.llm.word_tokens import library_ids, vocabulary

TIERS = (4096, 2048, 1024, 512, 256)
END_ID = 2
STEP_TOKENS = 65_536
BLOCK_TOKENS = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
COLUMNS = [x.split()[0] for x in PIECES.split(", ")]


class Pool:
    """Remainders by length; the longest that fits is found by bisection."""

    def __init__(self):
        self.lengths: list[int] = []
        self.items: dict[int, list] = {}

    def add(self, item: tuple) -> None:
        n = item[2]
        if n not in self.items:
            insort(self.lengths, n)
            self.items[n] = []
        self.items[n].append(item)

    def take(self, at: int) -> tuple:
        n = self.lengths[at]
        item = self.items[n].pop()
        if not self.items[n]:
            del self.items[n], self.lengths[at]
        return item

    def fitting(self, most: int) -> tuple | None:
        """The longest item of at most `most`."""
        at = bisect_right(self.lengths, most) - 1
        return self.take(at) if at >= 0 else None

    def shortest(self, below: int) -> tuple | None:
        """The shortest item, if it is no longer than `below`."""
        return self.take(0) if self.lengths and self.lengths[0] <= below else None

    def longest(self) -> tuple | None:
        return self.take(-1) if self.lengths else None

    def longest_between(self, low: int, high: int) -> tuple | None:
        """The longest item of more than low and at most high."""
        at = bisect_right(self.lengths, high) - 1
        return self.take(at) if at >= 0 and at >= bisect_left(self.lengths, low + 1) else None


def pack_block(pool: Pool, tiers: tuple[int, ...]) -> tuple[list[tuple[int, list]], list]:
    """Full windows (tier, pieces), and the pieces of the one window that could not be filled, as the pool was empty.

    A piece: (document, start, length)."""
    full, rest = [], []
    for k, tier in enumerate(tiers):
        low = tiers[k + 1] if k + 1 < len(tiers) else 0
        inner = low or tier
        while first := pool.longest_between(low, tier):
            window, gap = [first], tier - first[2]
            while gap and (item := pool.fitting(min(gap, inner))):
                window.append(item)
                gap -= item[2]
            if gap and (item := pool.shortest(inner) or pool.longest()):
                doc, start, n = item
                window.append((doc, start, gap))
                pool.add((doc, start + gap, n - gap))
                gap = 0
            if gap:
                rest += window
            else:
                full.append((tier, window))
    return full, rest


def close(rest: list, largest: int) -> list[tuple[int, list]]:
    """The last pieces side by side, cut at full windows and then at the binary digits of what is left."""
    left = sum(n for _, _, n in rest)
    out, queue = [], rest[::-1]
    while left:
        size = largest if left >= largest else 1 << (left.bit_length() - 1)
        window, gap = [], size
        while gap:
            doc, start, n = queue.pop()
            use = min(n, gap)
            window.append((doc, start, use))
            if use < n:
                queue.append((doc, start + use, n - use))
            gap -= use
        out.append((size, window))
        left -= size
    return out


def step_groups(windows: list[tuple[int, list]]) -> list[tuple[int, int, list]]:
    """(group, tier, pieces): windows of a tier by falling attention cost, dealt there and back over the tier's groups."""
    out, base = [], 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        some = sorted((w for t, w in windows if t == tier), key=lambda w: -sum(n * n for _, _, n in w))
        groups = max(1, round(len(some) * tier / STEP_TOKENS))
        for i, w in enumerate(some):
            turn, k = divmod(i, groups)
            out.append((base + (k if turn % 2 == 0 else groups - 1 - k), tier, w))
        base += groups
    return out


def packer(path: str, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS):
    """A mapInArrow function: (doc_id, text) to rows of PIECES."""
    end = END_ID.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, words, largest = TaskContext.get(), library_ids(path), tiers[0]
        base = (context.partitionId() if context else 0) << 32
        sequences = groups = 0
        windows: list[tuple[int, list]] = []
        pool, held = Pool(), 0

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal sequences, groups, windows, pool, held
            full, rest = pack_block(pool, tiers)
            dealt = step_groups(windows + full + (close(rest, largest) if last else []))
            pool, windows, held = Pool(), [], 0
            if not last:
                for item in rest:
                    pool.add(item)
            rows = []
            for group, tier, pieces in dealt:
                offset = 0
                for (doc, ids), start, n in pieces:
                    rows.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, base + sequences, offset, tier, base + groups + group))
                    offset += n
                sequences += 1
            groups += 1 + max((g for g, _, _ in dealt), default=0)
            return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(COLUMNS))], names=COLUMNS)

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, texts in slices(batch.column(1)):
                for doc_id, ids in zip(doc_ids[a : a + len(texts)], words.encode([x or "" for x in texts]), strict=True):
                    ids += end
                    doc, n = (doc_id, ids), len(ids) // 4
                    whole = n - n % largest
                    windows += [(largest, [(doc, s, largest)]) for s in range(0, whole, largest)]
                    if whole < n:
                        pool.add((doc, whole, n - whole))
                    held += n
                    if held >= block_tokens:
                        yield emit(False)
        yield emit(True)
        words.kept.clear()

    return pack


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row per piece of each document; sequence_id, offset and step_group tell where it goes."""
    return docs.select("doc_id", "text").mapInArrow(packer(path or vocabulary(), tiers), PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
