"""Document fingerprints by locally consistent parsing (operator 1).

A text's code points are names of level 0. At each level runs of one name become one name; deterministic coin tossing
(the lowest bit in which a name differs from the one before, and that bit, repeated until labels are below six) marks
local maxima, and each stretch from one maximum to the next is a phrase, named by a hash of its names. Names depend on a
few neighbours only, so equal substrings get equal names away from their ends, whatever their offset, and one name at the
top stands for the whole text. A fingerprint holds that name and, for levels 1 to 3, the least hashes of the level's
phrases, each with its number of occurrence, so it is a multiset sketch. Likeness is the share of common phrases (Dice)
estimated at the highest level at which both texts have enough phrases. Every text keeps the same levels.

Documents are dealt by ranges of (doc_id, hash of the text), so rows that share a doc_id, or have none, are split as well;
only rows equal in both stay together, one after another in one task.

Defined results: a null text is empty; empty texts share one fingerprint and are alike. The next document of the last one
is the first; of a table of one row, the row itself. Rows with one doc_id are ordered by the hash of their text. Rows
without doc_id come first. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm._common import mix, slices, table

#: (level, hashes kept, phrases that both texts need there)
LEVELS = ((1, 16, 0), (2, 24, 12), (3, 48, 24))
PASS_CHARS = 400_000
#: After the first toss has made labels below 128; three more make them below 14, 8 and 6.
ROUNDS = 3
GOLD = np.uint64(0x9E3779B97F4A7C15)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def low_bit(x: np.ndarray) -> np.ndarray:
    """The place of the lowest set bit of each non-zero word."""
    return ((x & (~x + np.uint64(1))).astype(np.float64).view(np.int64) >> 52) - 1023


def _toss_table() -> np.ndarray:
    """The toss of each pair of unequal labels below 128, by label * 128 + the one before."""
    a, b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    place = low_bit((a ^ b).astype(np.uint64) | np.uint64(128))
    return (place << 1 | (a >> place & 1)).astype(np.uint8).ravel()


TOSS = _toss_table()
#: Odd multipliers by a name's place in its phrase; a phrase has fewer than 32 names, as labels are below six.
PLACES = mix(np.arange(64, dtype=np.uint64) * GOLD + np.uint64(1)) | np.uint64(1)


def coin_toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below six for names of which no two neighbours in a text are equal; first: places where a text begins."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first] = names[first] ^ np.uint64(1)
    place = low_bit(names ^ before)
    label = (place << 1 | (names >> place.astype(np.uint64) & np.uint64(1)).astype(np.int64)).astype(np.uint8)
    for _ in range(ROUNDS):
        at = label.astype(np.uint16) << np.uint16(7)
        at[1:] |= label[:-1]
        at[first] = label[first].astype(np.uint16) << np.uint16(7) | (label[first] ^ np.uint8(1))
        label = TOSS[at]
    return label


def collapse(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one name within a text become one name of it and their length; new names and text starts."""
    head = np.ones(len(names), bool)
    head[1:] = names[1:] != names[:-1]
    head[starts] = True
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, len(names)))
    out = names[at]
    long = runs > 1
    out[long] = mix(out[long] * GOLD + runs[long].astype(np.uint64))
    return out, np.searchsorted(at, starts)


def phrases(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level's names and text starts."""
    first = np.zeros(len(names), bool)
    first[starts] = True
    label = coin_toss(names, starts)
    peak = np.zeros(len(names), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = np.zeros(len(names), bool)
    last[starts[1:] - 1] = True
    peak &= ~last
    peak[np.minimum(starts + 1, len(names) - 1)] &= first[np.minimum(starts + 1, len(names) - 1)]
    cut = np.flatnonzero(peak | first)
    within = np.arange(len(names)) - np.repeat(cut, np.diff(np.append(cut, len(names))))
    named = mix(np.add.reduceat(mix(names) * PLACES[within & 63], cut))
    return named, np.searchsorted(cut, starts)


def least(names: np.ndarray, starts: np.ndarray, keep: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the `keep` least hashes of (name, which of its occurrences in the text), and the number of names."""
    sizes = np.diff(np.append(starts, len(names)))
    text = np.repeat(np.arange(len(starts)), sizes).astype(np.uint64)
    order = np.argsort(mix(names + text * GOLD), kind="stable")
    key, own = names[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    place = np.arange(len(key))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    h = mix(key + mix(nth.astype(np.uint64) + GOLD)) >> np.uint64(32)
    both = np.sort(own << np.uint64(32) | h)
    ends = np.cumsum(sizes)
    return [both[e - n : min(e, e - n + keep)].astype(np.uint32) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)], sizes


def parse(texts: list[str]) -> list[tuple]:
    """For each text (top name, {level: (least hashes, number of phrases)}); empty texts have no levels."""
    out: list[tuple] = [(0, {}) for _ in texts]
    rows = np.array([i for i, x in enumerate(texts) if x], np.int64)
    if not len(rows):
        return out
    sizes = np.array([len(texts[i]) for i in rows], np.int64)
    names = np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    kept = {level: keep for level, keep, _ in LEVELS}
    level = 0
    while len(rows):
        names, starts = collapse(names, starts)
        ends = np.append(starts[1:], len(names))
        single = ends - starts == 1
        if level > 3 and single.any():
            for i, name in zip(rows[single].tolist(), names[starts[single]].tolist(), strict=True):
                out[i] = (name ^ level, out[i][1])
            keep_names = np.repeat(~single, ends - starts)
            names, rows = names[keep_names], rows[~single]
            if not len(rows):
                break
            starts = np.concatenate([[0], np.cumsum((ends - starts)[~single])[:-1]])
        names, starts = phrases(names, starts)
        level += 1
        if level in kept:
            found, counts = least(names, starts, kept[level])
            for i, hashes, count in zip(rows.tolist(), found, counts.tolist(), strict=True):
                out[i][1][level] = (hashes, count)
    return out


def to_string(found: tuple) -> str:
    """Hex: the top name, then for each kept level its number, its phrases and their least hashes."""
    top, levels = found
    return ".".join([f"{top & 0xFFFFFFFFFFFFFFFF:016x}", *(f"{k}-{n:x}-{h.astype('>u4').tobytes().hex()}" for k, (h, n) in sorted(levels.items()))])


def from_string(text: str) -> tuple:
    top, *rest = text.split(".")
    parts = (x.split("-") for x in rest)
    return int(top, 16), {int(k): (np.frombuffer(bytes.fromhex(h), ">u4").astype(np.uint32), int(n, 16)) for k, n, h in parts}


def likeness(a: tuple, b: tuple) -> float:
    """The estimated share of common phrases of two fingerprints, 0 to 1; equal fingerprints give 1."""
    if a[0] == b[0] and a[1].keys() == b[1].keys() and all(np.array_equal(a[1][k][0], b[1][k][0]) for k in a[1]):
        return 1.0
    shared = [x for x in LEVELS if x[0] in a[1] and x[0] in b[1]]
    if not shared:
        return 0.0
    enough = [x for x in shared if min(a[1][x[0]][1], b[1][x[0]][1]) >= x[2]]
    level, keep, _ = (enough or shared)[-1 if enough else 0]
    x, y = a[1][level][0], b[1][level][0]
    union = np.union1d(x, y)[:keep]
    common = np.intersect1d(np.intersect1d(x, y), union)
    j = len(common) / len(union)
    return 2 * j / (1 + j)


def edited(text: str, following: str) -> str:
    """The last quarter of the text's code points replaced by as many of the following text's first."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter] if quarter else text


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, own, doc_id, text), sorted; a row with own false only follows its bucket's last row."""
    waiting: list[tuple] = []  # own rows in order, each with its bucket
    size = 0

    def emit(rows: list[tuple], following: str) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        nexts = [*texts[1:], following]
        edits = [edited(t, f) for t, f in zip(texts, nexts, strict=True)]
        own = parse([*texts, following])
        new = parse(edits)
        data = [
            [d for d, _ in rows], [len(t) for t in texts], [hashlib.sha256(e.encode("utf-8", "replace")).hexdigest() for e in edits],
            list(map(to_string, own[:-1])), list(map(to_string, new)), [likeness(a, b) for a, b in zip(own, new, strict=False)], [likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
        ]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array(x, k) for x, k in zip(data, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    bucket, followed = None, True
    for batch in batches:
        buckets, owns, ids = (batch.column(k).to_pylist() for k in range(3))
        for start, texts in slices(batch.column(3)):
            for k, text in enumerate(texts, start):
                b, text = buckets[k], text or ""
                if owns[k]:
                    if waiting and b == bucket and size >= PASS_CHARS:
                        yield emit(waiting, text)
                        waiting, size = [], 0
                    waiting.append((ids[k], text))
                    size += len(text)
                    bucket, followed = b, False
                elif not followed:
                    yield emit(waiting, text)
                    waiting, size, followed = [], 0, True


def bounds_of(keyed: DataFrame, buckets: int) -> list[tuple[int, int]]:
    """At most `buckets` - 1 places (_id, _h) that cut the rows into even ranges; where one _id spans several of them, it is
    cut at its hashes' own quantiles. Only these places reach the driver."""
    at = [k / buckets for k in range(1, buckets)] or [0.5]
    found = keyed.agg(F.percentile_approx("_id", at, 100 * buckets)).first()[0] or []
    times = {x: found.count(x) for x in found}
    hot = {x: n for x, n in times.items() if n > 1}
    out = [(x, -(1 << 63)) for x in times]
    if hot:
        parts = max(hot.values()) + 1
        cuts = keyed.where(F.col("_id").isin(list(hot))).groupBy("_id").agg(F.percentile_approx("_h", [k / parts for k in range(1, parts)], 100 * parts).alias("cuts")).collect()
        out += [(r["_id"], h) for r in cuts for h in r["cuts"]]
    return sorted(set(out))


def with_following(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, own, doc_id, text) sorted within partitions: ranges of (doc_id, hash of text), each with the next range's
    first row after its own. Only the ranges' first places, one for each of `buckets` at most, reach the driver."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"), "doc_id", "text")
    bounds = bounds_of(keyed.select("_id", "_h"), buckets)
    edges = np.array(bounds, np.dtype([("i", "<i8"), ("h", "<i8")]))

    @F.arrow_udf("int")
    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        own = np.empty(len(ids), edges.dtype)
        own["i"], own["h"] = ids.to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, own, side="right").astype(np.int32)) if len(edges) else pa.array(np.zeros(len(ids), np.int32))

    dealt = keyed.withColumn("bucket", place("_id", "_h"))
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct("_id", "_h")).alias("first")).orderBy("bucket").collect()
    before = {(r["first"]["_id"], r["first"]["_h"]): firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    order = sorted(before)
    heads = np.array(order, edges.dtype)
    follows = np.array([before[x] for x in order], np.int32)

    @F.arrow_udf("int")
    def ghost(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        own = np.empty(len(ids), edges.dtype)
        own["i"], own["h"] = ids.to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
        if not len(heads):
            return pa.nulls(len(ids), pa.int32())
        at = np.minimum(np.searchsorted(heads, own), len(heads) - 1)
        return pa.array(follows[at], mask=heads[at] != own)

    to = F.when(F.col("ghost").isNull(), F.array(F.struct(F.col("bucket"), F.lit(True).alias("own"))))
    to = to.otherwise(F.array(F.struct(F.col("bucket"), F.lit(True).alias("own")), F.struct(F.col("ghost").alias("bucket"), F.lit(False).alias("own"))))
    sent = dealt.withColumn("ghost", ghost("_id", "_h")).select(F.explode(to).alias("to"), "_id", "_h", "doc_id", "text")
    spread = sent.select("to.bucket", "to.own", "_id", "_h", "doc_id", "text").repartitionById(max(1, len(bounds) + 1), F.col("bucket"))
    return spread.sortWithinPartitions("bucket", F.desc("own"), "_id", "_h", F.asc_nulls_first("text")).select("bucket", "own", "doc_id", "text")


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The fingerprint of each document and of its edited text, and how near the edited text and the next one are."""
    buckets = buckets or max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return with_following(docs, buckets).mapInArrow(compare, RESULT)


def op1_lcp_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
