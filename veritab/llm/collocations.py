"""Phrase collocation mining over vertical positional inverted lists (operator 13).

The documents' words stand in segments: of one language, about `SEGMENT_BYTES` of whole texts. A segment holds, for each of
its words, the list of the word's positions; positions leave a gap where a piece ends, so two words stand side by side if and
only if their positions differ by one. A phrase's list is made by merging the end positions of a phrase that is one word
shorter with the next word's list shifted by one, and its length is the phrase's exact count in the segment. Counts of
segments are summed over the corpus; a phrase is extended only where it and the phrase that the new word ends are frequent
everywhere, as no other extension can be.

A segment's lists are written once and only they and the keys of frequent phrases move, dealt by segment. A very common word
or phrase has one row a segment, never one an occurrence, so no key gathers more rows than there are segments.

Defined results: null and empty texts have no words, a null language is `und`, repeated rows count each, an empty table has
no phrases. Texts are never cut. Columns other than text and lang are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from veritab.llm._common import discard, materialise, slices, table

#: Bytes of texts that a segment has at least, unless a task has fewer of its language.
SEGMENT_BYTES = 24 << 20
#: Bytes of texts of all languages that wait in a task at most, before all of them become segments.
WAITING_BYTES = 64 << 20
LEAST = 10
COVER_PERCENT = 50
TOP = 2000
UNKNOWN = "und"
#: Parts of a language that are ranked on their own before the first rows of each are ranked together.
PARTS = 64
SEGMENTS = "segment long, lang string, local int, word string, n long, lists binary"
#: Class of each byte: 0 part of a word, 1 between words, 2 between pieces.
CLASS = np.zeros(256, np.uint8)
CLASS[[0x20, 0x09]] = 1
CLASS[[*map(ord, ".,;:!?"), 0x0A, 0x0B, 0x0C, 0x0D]] = 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def packed(sizes: np.ndarray, lists: np.ndarray) -> bytes:
    """Ascending lists, one behind another: their lengths, then the differences within each, bytes by place, compressed."""
    steps = np.diff(lists, prepend=0)
    starts = np.cumsum(sizes) - sizes
    steps[starts] = lists[starts]
    head, body = (pa.compress(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True) for x in (sizes, steps))
    return np.array([len(sizes), len(lists), len(head)], np.int64).tobytes() + head + body


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, lists) of packed ones."""
    n, total, cut = np.frombuffer(raw, np.int64, 3).tolist()

    def numbers(part: bytes, many: int) -> np.ndarray:
        planes = np.frombuffer(pa.decompress(part, decompressed_size=4 * many, codec="zstd", asbytes=True), np.uint8)
        return np.ascontiguousarray(planes.reshape(4, many).T).view(np.uint32).ravel().astype(np.int64)

    sizes, steps = numbers(raw[24 : 24 + cut], n), numbers(raw[24 + cut :], total)
    sums, starts = np.cumsum(steps), np.cumsum(sizes) - sizes
    return sizes, sums - np.repeat(sums[starts] - steps[starts], sizes)


def inverted(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, list lengths, position lists by word) of texts."""
    blob = np.frombuffer(b"\n".join(texts).translate(LOWER), np.uint8)
    kind = CLASS[blob]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(blob[inside].tobytes())])
    breaks = np.cumsum(kind == 2, dtype=np.int32)[starts]
    position = np.arange(len(starts)) + np.cumsum(np.diff(breaks, prepend=breaks[0]) > 0)
    coded = words.dictionary_encode()
    word = coded.indices.to_numpy()
    order = np.argsort(word, kind="stable")
    return coded.dictionary.cast(pa.large_string()).cast(pa.string()), np.bincount(word, minlength=len(coded.dictionary)), position[order]


def segments(docs: DataFrame) -> DataFrame:
    """One row for each word of each segment with its number of positions, and one with local = -1 for all lists.

    docs: (lang, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        waiting: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal number
            held.pop(lang)
            words, sizes, lists = inverted(waiting.pop(lang))
            if len(words):
                n = len(words) + 1
                columns = [
                    pa.array(np.full(n, number)),
                    pa.DictionaryArray.from_arrays(np.zeros(n, np.int8), [lang]).cast(pa.string()),
                    pa.array(np.arange(-1, n - 1, dtype=np.int32)),
                    pa.concat_arrays([pa.array([None], pa.string()), words]),
                    pa.array(np.concatenate([[len(lists)], sizes])),
                    pa.array([packed(sizes, lists), *[None] * (n - 1)], pa.binary()),
                ]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "lang", "local", "word", "n", "lists"])

        for batch in batches:
            langs = batch.column(0)
            for start, texts in slices(batch.column(1)):
                for lang, text in zip(langs.slice(start, len(texts)).to_pylist(), texts, strict=True):
                    if text:
                        raw = text.encode()
                        waiting.setdefault(lang, []).append(raw)
                        held[lang] = held.get(lang, 0) + len(raw)
                        if held[lang] >= SEGMENT_BYTES:
                            yield from flush(lang)
                if sum(held.values()) >= WAITING_BYTES:
                    for lang in list(waiting):
                        yield from flush(lang)
        for lang in list(waiting):
            yield from flush(lang)

    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").mapInArrow(build, SEGMENTS)


class Segment:
    """The lists of a segment's frequent words, which stand here by their index among those.

    at[p] is the word at position p, -1 where none of them stands."""

    def __init__(self, raw: bytes, local: np.ndarray, ids: np.ndarray):
        """local, ids: the frequent words' numbers in the segment and in the corpus."""
        sizes, lists = unpacked(raw)
        order = np.argsort(ids)
        self.ids = ids[order]
        index = np.full(len(sizes), -1, np.int64)
        index[local[order]] = np.arange(len(order))
        word = np.repeat(index, sizes)
        kept = word >= 0
        self.ends, self.words = lists[kept], word[kept]
        self.at = np.full(int(lists.max()) + 2, -1, np.int64)
        self.at[self.ends] = self.words

    def extended(self, ends: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges the end positions of phrases with the lists of the words behind them: (new ends, phrases, words)."""
        words = self.at[ends + 1]
        met = words >= 0
        return ends[met] + 1, phrases[met], words[met]


def pair_counts(segment: Segment, *_: np.ndarray) -> list[np.ndarray]:
    """(first word, second word, number) of a segment's pairs of frequent words."""
    _, first, second = segment.extended(segment.ends, segment.words)
    code, n = np.unique(first * len(segment.ids) + second, return_counts=True)
    return [segment.ids[code // len(segment.ids)], segment.ids[code % len(segment.ids)], n]


def triple_counts(segment: Segment, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """(three words, number) of a segment's triples whose two pairs are both among the frequent pairs (x, y)."""
    many = len(segment.ids)
    frequent = np.sort(np.searchsorted(segment.ids, x) * many + np.searchsorted(segment.ids, y))
    if not len(frequent):
        return [x[:0], x[:0], x[:0], x[:0]]

    def place(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(frequent, code), len(frequent) - 1)
        return at, frequent[at] == code

    ends, first, second = segment.extended(segment.ends, segment.words)
    pair, known = place(first * many + second)
    _, pair, third = segment.extended(ends[known], pair[known])
    held = place(frequent[pair] % many * many + third)[1]
    code, n = np.unique(pair[held] * many + third[held], return_counts=True)
    pairs = frequent[code // many]
    return [segment.ids[pairs // many], segment.ids[pairs % many], segment.ids[code % many], n]


def in_segments(lists: DataFrame, rows: DataFrame, counts, names: tuple[str, ...]) -> DataFrame:
    """(segment, names..., n): what counts(segment, x, y) finds in each segment.

    lists: (segment, lists). rows: (segment, kind, x, y): the segment's frequent words (kind 1: number there, id) and
    phrases (kind 2: ids of both words). Both are dealt by segment, and a task holds one segment at a time."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, now = None, None
        parts: list[tuple[np.ndarray, ...]] = []

        def done() -> Iterator[pa.RecordBatch]:
            kind, x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
            word, pair = kind == 1, kind == 2
            if word.any():
                found = counts(Segment(raw, x[word], y[word]), x[pair], y[pair])
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found[0]), now)), *map(pa.array, found)], names=["segment", *names, "n"])

        for batch in batches:
            segment, kind, x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(segment)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if segment[a] != now:
                    if parts:
                        yield from done()
                    now, parts = segment[a], []
                if kind[a] == 0:
                    raw = batch.column(4)[a].as_py()
                parts.append((kind[a:b], x[a:b], y[a:b]))
        if parts:
            yield from done()

    none = F.lit(0).cast("long")
    both = lists.select("segment", F.lit(0).alias("kind"), none.alias("x"), none.alias("y"), "lists").unionAll(rows.select("segment", "kind", "x", "y", F.lit(None).cast("binary")))
    dealt = both.repartition("segment").sortWithinPartitions("segment", "kind")
    return dealt.mapInArrow(build, ", ".join(f"{c} long" for c in ("segment", *names, "n")))


def exact_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) without rounding; products have up to 38 digits."""
    d = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    return F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * {d(a)} * {d(a)}) div ({d(left)} * {d(right)})")


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER_PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two or three words.

    docs: (lang, text). least: a candidate's least count. cover: a phrase goes if a longer candidate with so many percent of
    its count holds it."""
    written = materialise(segments(docs.select("lang", "text")))
    words, lists = written.where("local >= 0"), written.where("local = -1").select("segment", "lists")
    totals = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")))
    one = materialise(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()))
    here = materialise(words.join(one, ["lang", "word"]).select("segment", F.lit(1).alias("kind"), F.col("local").cast("long").alias("x"), F.col("id").alias("y")))
    pairs = in_segments(lists, here, pair_counts, ("a", "b"))
    whole = pairs.withColumn("f", F.sum("n").over(Window.partitionBy("a", "b"))).where(F.col("f") >= least)
    common = materialise(whole.select("segment", F.lit(2).alias("kind"), F.col("a").alias("x"), F.col("b").alias("y"), "f"))
    two = materialise(common.groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.max("f").alias("f")))
    triples = in_segments(lists, here.unionAll(common.drop("f")), triple_counts, ("a", "b", "c"))
    three = materialise(triples.groupBy("a", "b", "c").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    discard(written, here, common)

    def word(name: str) -> DataFrame:
        """(name, name_word, name_f), and the language by that of a."""
        return one.select(F.col("id").alias(name), F.col("word").alias(f"{name}_word"), F.col("f").alias(f"{name}_f"), *(["lang"] if name == "a" else []))

    covered = three.select("a", "b", "f").unionAll(three.select("b", "c", "f")).groupBy("a", "b").agg(F.max("f").alias("longer"))
    left = two.join(covered, ["a", "b"], "left").where(f"longer IS NULL OR 100 * longer < {cover} * f")
    short = left.join(word("a"), "a").join(word("b"), "b").select("lang", F.concat_ws(" ", "a_word", "b_word").alias("phrase"), "f", F.col("a_f").alias("l"), F.col("b_f").alias("r"))
    short = short.withColumn("score", exact_score("f", "l", "r"))
    long = three.join(two.withColumnRenamed("f", "ab_f"), ["a", "b"]).join(two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("bc_f")), ["b", "c"])
    long = long.join(word("a"), "a").join(word("b"), "b").join(word("c"), "c")
    cut = lambda k, l, r: F.struct(exact_score("f", l, r).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
    long = long.select("lang", F.concat_ws(" ", "a_word", "b_word", "c_word").alias("phrase"), "f", F.least(cut(1, "a_f", "bc_f"), cut(2, "ab_f", "c_f")).alias("cut"))
    long = long.select("lang", "phrase", "f", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part")
    first = short.unionByName(long).select("*", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def op13_positional_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


#: The same rows from DuckDB: all phrases of one to three words by plain grouping.
OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM t),
g AS (SELECT lang, 1 AS size, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM w
  UNION ALL SELECT lang, 3, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) FROM w),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.phrase, c.size, c.ws, c.f, k, array_to_string(c.ws[:k], ' ') AS head, array_to_string(c.ws[k + 1:], ' ') AS tail FROM c, (VALUES (1), (2)) AS v(k) WHERE k < c.size),
scored AS (SELECT x.*, h.f AS l, r.f AS r, (1000000::HUGEINT * x.f * x.f) // (h.f::HUGEINT * r.f) AS score
  FROM cuts x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.tail),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (SELECT lang, f, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase FROM c WHERE size = 3),
longest AS (SELECT lang, phrase, max(f) AS longer FROM inner_phrases GROUP BY ALL),
kept AS (SELECT s.* FROM least s LEFT JOIN longest o ON s.size = 2 AND o.lang = s.lang AND o.phrase = s.phrase WHERE o.longer IS NULL OR 100 * o.longer < 50 * s.f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, f AS a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
