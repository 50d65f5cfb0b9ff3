"""SimHash near-duplicates by pivot distance tables (operator 7).

Every fingerprint gets a table of its Hamming distances to fixed reference fingerprints: the zero fingerprint and one
pivot for each block of two bits. Two fingerprints at distance 2 or less differ in at most two coordinates (relative to
the first), so of five groups of pivots at least three have equal coordinates: each choice of three groups makes a cell
key, and all links lie within cells. A pair in a cell is discarded if any coordinate, towards the pivots or a further set
of spread references, differs by more than 2, and the survivors are verified bit by bit.

Cells with more than `cell_pairs` different fingerprints never emit their pairs. There two fingerprints link exactly if
some fingerprint is at most one bit from both, so each is sent to its 65 neighbours and linked with the least one met;
at most 65 different ones can meet. Copies are one fingerprint, and components are found among different ones only.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id never names a
component unless nothing else is in it; repeated rows stay repeated. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm._common import bytes_of, discard, materialise, table

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
RADIUS = 2
GROUPS = 5
BLOCK_PIVOTS = [3 << (2 * k) for k in range(32)]
SPREAD_PIVOTS = [xxhash.xxh64_intdigest(str(k), SEED) for k in range(8)]
CELL_PAIRS = 24


def shingle_hashes(raw: bytes, n: int) -> np.ndarray:
    """The XXH64 of each n-word shingle of a text; of the whole sequence if it is shorter, none if it has no word."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    buf = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = min(n, len(words))
    digest = xxhash.xxh64_intdigest
    pairs = zip((ends - sizes)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.array([digest(buf[a:b], SEED) for a, b in pairs], "<u8")


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed long; zero for no hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprint(raw: bytes, n: int) -> int:
    """The 64-bit SimHash of the n-word shingles of a text."""
    return majority(shingle_hashes(raw, n))


def simhash(text: Column, n: int = 3) -> Column:
    """The SimHash of each text as a signed long."""

    @F.arrow_udf("long")
    def hashes(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x, n) for x in bytes_of(texts)], pa.int64())

    return hashes(text)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(signed(pivot)).cast("long")))


def cell_keys(fp: Column) -> Column:
    """The keys of a fingerprint's cells, from its distances to the block pivots."""
    zero = distance(fp, 0)
    groups = [F.concat(*[(distance(fp, p) - zero + 2).cast("string") for p in BLOCK_PIVOTS[g::GROUPS]]) for g in range(GROUPS)]
    chosen = combinations(range(GROUPS), GROUPS - RADIUS)
    return F.array(*[F.xxhash64(F.lit(k), *[groups[g] for g in some]) for k, some in enumerate(chosen)])


def coordinates(fp: Column) -> Column:
    """A fingerprint's distances to the spread references."""
    return F.array(*[distance(fp, p).cast("tinyint") for p in SPREAD_PIVOTS])


def near(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """No stored coordinate (xs, ys) differs by more than the radius, and then the bits themselves don't."""
    apart = [F.abs(xs[k] - ys[k]) for k in range(len(SPREAD_PIVOTS))]
    return (F.greatest(*apart) <= RADIUS) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS)


def links(fps: DataFrame, cell_pairs: int = CELL_PAIRS, made: list[DataFrame] | None = None) -> DataFrame:
    """(a, b), a > b: enough of the links between the different fingerprints of column fp to join all that are near. made takes
    the frames that were written for it, for a caller that discards them."""
    cells = materialise(fps.select(F.explode(cell_keys(F.col("fp"))).alias("key"), "fp"))
    sizes = cells.groupBy("key").count().where("count > 1")
    shared = materialise(cells.join(sizes, "key"))
    if made is not None:
        made += cells, shared
    few = shared.where(F.col("count") <= cell_pairs).select("key", "fp", coordinates(F.col("fp")).alias("at"))
    met = few.toDF("key", "a", "at_a").join(few.toDF("key", "b", "at_b"), "key")
    pairs = met.where((F.col("a") > F.col("b")) & near(F.col("a"), F.col("b"), F.col("at_a"), F.col("at_b"))).select("a", "b")
    many = shared.where(F.col("count") > cell_pairs).select("fp").distinct()
    balls = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << k)).cast("long")) for k in range(64)])
    met = many.select("fp", F.explode(balls).alias("centre")).groupBy("centre").agg(F.collect_list("fp").alias("met")).where(F.size("met") > 1)
    stars = met.select(F.explode("met").alias("a"), F.array_min("met").alias("b")).where("a > b")
    return pairs.union(stars).distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every edge (a, b), a > b, leads to the least vertex of its component: no vertex below another has two edges."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("below")).unionAll(edges.select("b", F.lit(0)))
    return ends.groupBy("v").agg(F.max("below").alias("below"), F.count("*").alias("n")).where("below = 1 AND n > 1").count() == 0


def components(edges: DataFrame, stored: bool = False) -> DataFrame:
    """(vertex, root) of every vertex of edges (a, b), a > b; root is its component's least vertex. stored: the edges lie in
    files, so that reading them twice is cheap.

    Alternating large-star and small-star rounds; each round is written to the shared folder, and the rounds end when
    every edge leads to its root."""
    if not stored:
        edges = materialise(edges)
    while True:
        both = edges.unionAll(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        last, edges = edges, materialise(small)
        discard(last)
        if settled(edges):
            out = edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
            out._veritab_path = edges._veritab_path
            return out


def near_duplicates(docs: DataFrame, n: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    prints = materialise(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text), n).alias("fp")))
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    rooted = components(links(classes.select("fp")))
    placed = classes.join(rooted, classes.fp == rooted.vertex, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(placed.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
