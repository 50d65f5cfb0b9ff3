"""SimHash near-duplicates by pivot distance tables, widened to the likeness of shingle sets (operator 7's wide form).

First operator 7's search finds the texts whose SimHashes are at most two bits apart: they meet in cells of equal pivot
coordinates, their whole shingle sets are compared, and what is alike is linked. Texts that share just 0.8 of their five-word
shingles have SimHashes some ten bits apart, where such cells no longer tell pairs apart. For these, documents then meet that
share a band of minima: of `BANDS` bands with `BAND_ROWS` minima each, a pair of likeness 0.8 shares at least one with
probability 0.99997. A pair met there is discarded if a pivot coordinate (each class carries its table of distances) or the
SimHashes themselves are more than `WIDE_RADIUS` bits apart, or if the
`SKETCH_BITS` one-bit minima differ in more than `MOST_APART` places; the bounds lie four deviations and more beyond
a pair at 0.8. The survivors are verified by the exact likeness (intersection over union) of their whole shingle sets.

Groups of any size are joined without emitting their pairs. Buckets of at most `BUCKET_PAIRS` classes are compared pair by
pair, each pair in the first bucket that both share. Larger ones take rounds: in each every open bucket names a few centres, which are
compared with the members of other components in all their buckets, each pair in the first bucket that both share; the first round's are named by an eighth of the buckets. What
passes the filter is verified at once if it is at most `AT_ONCE` pairs, which spares jobs. Of more, each class first verifies its
nearest centre alone, or later each two components their nearest pair; links merge components, and only pairs that still lie in
two of them are all verified after that. The second round's centres are members of each bucket's largest component, which
most of the others join there; later ones are those that have not. A class that has been a centre leaves all its buckets, and
a bucket leaves when what is left in it is one component, so every link between components that share a bucket is found, and
each round reads only what is still open. The number of centres grows sixteenfold each round.

Defined results: null and empty texts, and texts without words, are one group; texts of fewer words than a shingle are their
whole sequence; equal texts are one class throughout; a null doc_id names a component only if nothing else is in it;
repeated rows stay repeated. Columns other than doc_id and text are never read.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm._common import bytes_of, discard, materialise, mix
from veritab.llm.simhash_dedup import SPREAD_PIVOTS, components, coordinates, links, majority, shingle_hashes

WORDS = 5
LEAST = 0.8
BANDS = 20
BAND_ROWS = 4
WIDE_RADIUS = 28
SKETCH_WORDS = 16
SKETCH_BITS = 64 * SKETCH_WORDS
#: A pair at 0.8 differs in 102 of 1024 places on average, with a deviation of 9.6.
MOST_APART = 141
#: Of the first rounds: centres of a bucket, whether they are of its largest component, and which share of the buckets names
#: any (one in so many); later rounds grow from the last.
ROUNDS = ((1, False, 8), (4, True, 1), (16, False, 1))
GROWTH = 16
#: Odd multipliers: each orders the shingle hashes in its own way. The bands' are whole words, the sketch's half words.
ORDERS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
SKETCH_ORDERS = (mix(np.arange(1001, 1001 + SKETCH_BITS, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
CHUNK = 256
#: A list of classes with at most so many rows (16 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Buckets of at most so many classes are compared pair by pair before the first round; larger ones take rounds.
BUCKET_PAIRS = 24
#: At most so many pairs of a round are verified at once; of more the nearest come first.
AT_ONCE = 200_000
#: Shingle sets of at most so many bytes are broadcast to be verified against; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
PLACED = [f"b{k}" for k in range(SKETCH_WORDS)]


def shingle_set(raw: bytes, n: int) -> np.ndarray:
    """The sorted different shingle hashes; one zero for a text without words."""
    h = np.unique(shingle_hashes(raw, n))
    return h if len(h) else np.zeros(1, "<u8")


def band_keys(h: np.ndarray) -> np.ndarray:
    """A signed key for each band of minima."""
    least = np.full(len(ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), CHUNK):
        np.minimum(least, (h[i : i + CHUNK, None] * ORDERS).min(axis=0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        key = mix(key ^ row)
    return key.view(np.int64)


def one_bit_minima(h: np.ndarray) -> np.ndarray:
    """One bit of each of `SKETCH_BITS` minima, as signed longs; like sets agree in (1 + likeness) / 2 of them."""
    low = mix(h).astype(np.uint32)
    least = np.full(SKETCH_BITS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(low), CHUNK):
        np.minimum(least, (low[i : i + CHUNK, None] * SKETCH_ORDERS).min(axis=0), out=least)
    bits = mix(least.astype(np.uint64) ^ (np.arange(SKETCH_BITS, dtype=np.uint64) << np.uint64(32))) >> np.uint64(63)
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def sketch(text: Column, n: int) -> Column:
    """fp, the SimHash of the different shingles, the band keys and the one-bit minima."""

    @F.arrow_udf("fp long, keys array<long>, bits array<long>")
    def sketches(texts: pa.Array) -> pa.Array:
        prints, keys, bits = [], [], []
        for x in bytes_of(texts):
            h = shingle_set(x, n)
            prints.append(majority(h))
            keys.append(band_keys(h))
            bits.append(one_bit_minima(h))

        def lists(rows: list[np.ndarray], size: int) -> pa.Array:
            flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.array(flat))

        return pa.StructArray.from_arrays([pa.array(prints, pa.int64()), lists(keys, BANDS), lists(bits, SKETCH_WORDS)], ["fp", "keys", "bits"])

    return sketches(text)


def packed_set(text: Column, n: int) -> Column:
    """The shingle set as little-endian bytes."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(x, n).tobytes() for x in bytes_of(texts)], pa.binary())

    return packed(text)


def alike(x: Column, y: Column, least: float) -> Column:
    """Whether two packed sets share at least `least` of their union."""

    @F.arrow_udf("boolean")
    def compared(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(bytes_of(xs), bytes_of(ys), strict=True):
            if min(len(a), len(b)) < least * max(len(a), len(b)):
                out.append(False)
                continue
            both = np.concatenate([np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")])
            union = len(np.unique(both))
            out.append(len(both) - union >= least * union - 1e-9)
        return pa.array(out, pa.bool_())

    return compared(x, y)


def apart(left: str, right: str) -> Column:
    """The number of one-bit minima in which two rows differ."""
    return reduce(add, [F.bit_count(F.col(f"{left}.{b}").bitwiseXOR(F.col(f"{right}.{b}"))) for b in PLACED])


def within(left: str, right: str) -> Column:
    """No pivot coordinate differs by more than the wide radius, then not the bits themselves, and then not the minima."""
    table = [F.abs(F.col(f"{left}.coords")[k] - F.col(f"{right}.coords")[k]) for k in range(len(SPREAD_PIVOTS))]
    near = (F.greatest(*table) <= WIDE_RADIUS) & (F.bit_count(F.col(f"{left}.fp").bitwiseXOR(F.col(f"{right}.fp"))) <= WIDE_RADIUS)
    return near & (apart(left, right) <= MOST_APART)


def class_of(text: Column) -> Column:
    """Tells equal texts; a null is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def among(rows: DataFrame, few: DataFrame, on: Column, how: str = "left_semi") -> DataFrame:
    """rows joined with few, whose number of rows is checked before it is broadcast; a longer list is shuffled."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, on, how)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, linked) of pairs (a, b) of a member and a centre. Centres are few: where their sets are small they travel to
    the members' sets, and no set is shuffled."""
    wanted = sets.join(pairs.select(F.col("b").alias("cls")).distinct(), "cls", "left_semi").toDF("b", "y")
    size = wanted.agg(F.sum(F.length("y"))).first()[0] or 0
    told = sets.toDF("a", "x").join(F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs, "a")
    told = told.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "b")
    return materialise(told.select("a", "b", alike(F.col("x"), F.col("y"), least).alias("linked")))


def merged(rooted: DataFrame | None, told: DataFrame) -> DataFrame | None:
    """(vertex, root) after the links of told, which lie in files."""
    found = told.where("linked").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if found.isEmpty():
        return rooted
    out = components(found if rooted is None else found.unionAll(rooted.toDF("a", "b")), stored=True)
    discard(rooted)
    return out


def label_of(rows: DataFrame, vertex: str, rooted: DataFrame | None, name: str) -> DataFrame:
    """rows with the column `name`, the root of the class in column vertex."""
    if rooted is None:
        return rows.withColumn(name, F.col(vertex))
    return rows.join(rooted.toDF("_v", "_r"), F.col(vertex) == F.col("_v"), "left").withColumn(name, F.coalesce("_r", vertex)).drop("_v", "_r")


def with_component(rows: DataFrame, rooted: DataFrame | None) -> DataFrame:
    """rows with label, the root of the class in column cls, and size, how many classes its component has. Sizes are put beside
    the classes first, so the rows, which are one for each class and bucket, take one join."""
    if rooted is None:
        return rows.withColumn("label", F.col("cls")).withColumn("size", F.lit(1).cast("long"))
    sizes = rooted.groupBy("root").agg((F.count("*") + 1).alias("size"))
    told = rooted.join(sizes, "root").select("vertex", "root", "size").unionAll(sizes.select("root", "root", "size")).toDF("_v", "_r", "_n")
    return rows.join(told, F.col("cls") == F.col("_v"), "left").withColumn("label", F.coalesce("_r", "cls")).withColumn("size", F.coalesce("_n", F.lit(1))).drop("_v", "_r", "_n")


def met_by_pivots(classes: DataFrame) -> DataFrame:
    """(a, b), a > b, of classes (cls, fp) whose SimHashes are equal or were linked by operator 7's pivot cells. Each class meets
    the least one of its own SimHash, and these meet for the SimHashes, so copies of one SimHash are not paired with each other."""
    own = classes.groupBy("fp").agg(F.min("cls").alias("rep"))
    made: list[DataFrame] = []
    left = links(own.select("fp"), made=made).join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select("x", "y")
    same = classes.join(own, "fp").where("cls > rep").select(F.col("cls").alias("x"), F.col("rep").alias("y"))
    pairs = materialise(left.unionAll(same).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))
    discard(*made)
    return pairs


def link_pairs(rest: DataFrame, sets: DataFrame, least: float, rooted: DataFrame | None, known: DataFrame | None = None) -> DataFrame | None:
    """(vertex, root) after the links of known and of the pairs (a, b, apart, la, lb) of rest that are alike, la and lb being
    their components; discards rest."""
    n = rest.count()
    # Before anything is linked each class is a component, and only the nearest centre of each tells something.
    for step in range(3 if not n and known is None else 2 if n <= AT_ONCE else 0 if rooted is None else 1, 3):
        if step == 0:
            some = rest.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("n")).select("a", "n.b")
        elif step == 1:
            some = rest.groupBy(F.least("la", "lb").alias("lo"), F.greatest("la", "lb").alias("hi")).agg(F.min(F.struct("apart", "a", "b")).alias("n")).select("n.a", "n.b")
        some = materialise(some) if step < 2 else rest.select("a", "b")
        told = verified(some, sets, least)
        rooted = merged(rooted, told if known is None else told.unionAll(known))
        known = None
        if step < 2:
            left = rest.select("a", "b", "apart").join(some, ["a", "b"], "left_anti")
            left = materialise(label_of(label_of(left, "a", rooted, "la"), "b", rooted, "lb").where("la != lb"))
            discard(rest)
            rest = left
        discard(some, told)
        if step < 2 and rest.isEmpty():
            break
    discard(rest)
    return rooted


def link_classes(shared: DataFrame, sets: DataFrame, least: float, known: DataFrame | None = None) -> DataFrame | None:
    """(vertex, root) of every linked class but the roots; shared has (key, n, cls, keys, fp, coords, b0 ...) of buckets with
    n > 1 classes, keys being all of the class's; known has pairs (a, b, linked) that were verified before, which are
    joined with those of the small buckets. Nothing that is bounded by the number of pairs is shuffled before the filter."""
    once = F.array_min(F.array_intersect("m.keys", "c.keys")) == F.col("m.key")
    small = shared.where(F.col("n") <= BUCKET_PAIRS)
    met = small.alias("m").join(small.alias("c"), F.col("m.key") == F.col("c.key")).where((F.col("m.cls") > F.col("c.cls")) & within("m", "c") & once)
    a, b = F.col("m.cls"), F.col("c.cls")
    rest = materialise(met.select(a.alias("a"), b.alias("b"), apart("m", "c").alias("apart"), a.alias("la"), b.alias("lb")))
    rooted, known = link_pairs(rest, sets, least, None, known), None
    large = shared.where(F.col("n") > BUCKET_PAIRS).drop("n")
    if large.isEmpty():
        return rooted
    placed = materialise(with_component(large, rooted))
    for turn in count():
        centres_of_bucket, of_lead, one_in = ROUNDS[turn] if turn < len(ROUNDS) else (ROUNDS[-1][0] * GROWTH ** (turn + 1 - len(ROUNDS)), False, 1)
        narrow = placed.select("key", "cls", "label", "size")
        lead = narrow.groupBy("key").agg(F.max(F.struct("size", "label")).alias("lead"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
        lead = materialise(lead.select("key", F.col("lead.label").alias("lead")))
        if lead.isEmpty():  # no bucket has two components
            discard(lead, placed)
            return rooted
        waiting = narrow.join(lead, "key").where("label = lead" if of_lead else "label != lead")
        if one_in > 1:
            waiting = waiting.where(F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(one_in)) == 0)
        salt = F.pmod(F.xxhash64("cls", F.lit(centres_of_bucket)), F.lit(centres_of_bucket))
        first = F.min(F.struct("size", F.xxhash64("cls").alias("order"), "cls"))
        centres = materialise(waiting.groupBy("key", salt.alias("salt")).agg(first.alias("c")).select("c.cls").distinct())
        if centres.isEmpty():  # this round's share of the buckets has no open one
            discard(lead, centres)
            continue
        opened = placed.drop("size").join(lead.select("key"), "key", "left_semi")
        opened = materialise(opened.join(centres.select(F.col("cls").alias("_c")), F.col("cls") == F.col("_c"), "left").withColumn("central", F.col("_c").isNotNull()).drop("_c"))
        discard(lead, centres, placed)
        apiece = (F.col("m.label") != F.col("c.label")) & (~F.col("m.central") | (F.col("m.cls") > F.col("c.cls")))
        met = opened.alias("m").join(opened.where("central").alias("c"), F.col("m.key") == F.col("c.key")).where(apiece & within("m", "c") & once)
        rest = materialise(met.select(F.col("m.cls").alias("a"), F.col("c.cls").alias("b"), apart("m", "c").alias("apart"), F.col("m.label").alias("la"), F.col("c.label").alias("lb")))
        rooted = link_pairs(rest, sets, least, rooted)
        # Centres were compared with all that they meet, and a bucket that was not opened has one component for good.
        placed = materialise(with_component(opened.where("NOT central").drop("label", "central"), rooted))
        discard(opened)


def similar_classes(docs: DataFrame, n: int = WORDS, least: float = LEAST, text: str = "text", doc_id: str = "doc_id", pivots: bool = True, ids: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """(doc_id, cls) of every row of docs, and (cls, first, root) of every class of equal texts; first is the class's least
    doc_id, root tells its group of similar texts. pivots: whether pairs come from pivot cells before they come from bands; ids:
    whether the first frame is wanted, else it is None, which spares its files."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), class_of(F.col(text)).alias("cls"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    drawn = rows.select("doc_id", "cls", sketch(F.col("text"), n).alias("s")).select("doc_id", "cls", "s.*")
    if ids:
        drawn = materialise(drawn)
    sketched = materialise(drawn.groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("bits").alias("bits")))
    placed, classes = materialise(drawn.select("doc_id", "cls")) if ids else None, sketched.select("cls", "first")
    discard(drawn)
    near = met_by_pivots(sketched.select("cls", "fp")) if pivots else None
    cells = sketched.select(F.explode("keys").alias("key"), "cls")
    often = cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialise(cells.join(often, "key"))
    some = met.select("cls") if near is None else met.select("cls").unionAll(near.select("a")).unionAll(near.select("b"))
    wanted = materialise(some.distinct().join(sketched, "cls"))
    traits = wanted.select(F.col("cls").alias("_c"), "keys", "fp", coordinates(F.col("fp")).alias("coords"), *[F.col("bits")[k].alias(b) for k, b in enumerate(PLACED)])
    shared = materialise(met.join(traits, met.cls == traits["_c"]).drop("_c"))
    named = wanted.select(F.col("first").alias("_first"), F.col("cls").alias("_cls"))
    held = among(rows, named, F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("cls") == F.col("_cls")))
    sets = materialise(held.select("cls", "text").dropDuplicates(["cls"]).select("cls", packed_set(F.col("text"), n).alias("hashes")))
    discard(met)
    told = None if near is None else verified(near, sets, least)
    rooted = link_classes(shared, sets, least, told)
    discard(shared, sets, wanted, near, told)
    if rooted is None:
        return placed, classes.select("cls", "first", F.col("cls").alias("root"))
    return placed, classes.join(rooted, classes.cls == rooted.vertex, "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))


def similar_documents(docs: DataFrame, n: int = WORDS, least: float = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, component_id) of every row of docs; component_id is the least doc_id of its group of similar texts."""
    rows, placed = similar_classes(docs, n, least, text, doc_id)
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(placed.join(ids, "root").select("cls", "component_id"), "cls").select("doc_id", "component_id")
