"""Quality classifier by random Fourier features (operator 5).

Statistics of the whole text are standardised and mapped by cosines of random projections, which approximate a Gaussian
kernel. Each partition sums its share of the normal equations; their sum gives a ridge regression, and the pool-adjacent-
violators rule over score bins of a further part of the labelled rows makes calibrated scores between 0 and 1.

Defined results: null and empty texts have all statistics zero and get the score of such a text; without labelled rows
every score is 0.5. A label that is null is left out, and one given twice counts twice. Columns other than text, and the
key that joins the labels, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm._common import bytes_of, materialise, table

N_STATS = 16
N_FOURIER = 256
RIDGE = 0.3
#: Score bins that calibration counts.
BINS = 512
THRESHOLD = 0.3
SEED = 7


def _classes() -> np.ndarray:
    """One row of 0 and 1 for each byte class: lower, upper, digits, white space, symbols, other punctuation, high bytes."""
    out = np.zeros((7, 256))
    for b in range(256):
        c = chr(b)
        k = 6 if b > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if c in "#*$%&|<>{}[]\\^~_=@+" else 5
        out[k, b] = 1
    return out


CLASSES = _classes()


def statistics(raw: bytes) -> np.ndarray:
    """Shares of byte classes, word and line shapes and repetition of one text; all zero for an empty one."""
    out = np.zeros(N_STATS)
    words = raw.split()
    if not words:
        return out
    n, size = len(words), len(raw)
    times: dict[bytes, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:7] = CLASSES @ counts / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = counts[counts > 0] / size
    out[7] = np.log1p(n)
    out[8] = np.log(size / n)
    out[9] = len(times) / n
    out[10] = max(times.values()) / n
    out[11] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    out[12] = 1 - len(set(lines)) / len(lines)
    out[13] = np.log1p(n / len(lines))
    out[14] = -(shares * np.log2(shares)).sum()
    out[15] = sum(not w[-1:].isalpha() and w[-1] < 128 for w in words) / n
    return out


def text_statistics(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def stats(texts: pa.Array) -> pa.Array:
        rows = [statistics(x) for x in bytes_of(texts)]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * N_STATS, pa.int32()), pa.array(flat))

    return stats(text)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None
    levels: np.ndarray | None = None

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Cosine features of a Gaussian kernel of width sqrt(N_STATS), and a constant."""
        draw = np.random.default_rng(SEED)
        w = draw.normal(size=(N_STATS, N_FOURIER)) / np.sqrt(N_STATS)
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ w + draw.uniform(0, 2 * np.pi, N_FOURIER)
        return np.hstack([np.sqrt(2 / N_FOURIER) * np.cos(z), np.ones((len(x), 1))])

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score; a thousandth of the ridge score keeps the order within a level."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = np.clip(self.ridge(x), 0, 1)
        level = raw if self.levels is None else np.interp(raw, self.edges, self.levels)
        return 0.999 * level + 0.001 * raw


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the nearest rising sequence of weighted means."""
    pools: list[list[float]] = []
    for value, w in zip(y, weight, strict=True):
        pools.append([value * w, w, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w2, n = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + w2, pools[-1][2] + n]
    return np.concatenate([np.full(int(n), s / w) for s, w, n in pools]) if pools else np.zeros(0)


def fit(labelled: DataFrame) -> Model:
    """From (stats array<double>, label double, fold int): folds 1 to 3 fit the ridge, fold 4 and above calibrates it."""
    part = F.col("fold") <= 3
    first = labelled.where(part).agg(F.count("*"), *[f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(N_STATS)]).first()
    if not first or not first[0]:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    mean, deviation = np.array(first[1 : N_STATS + 1], float), np.array(first[N_STATS + 1 :], float)
    model = Model(mean, np.where(deviation > 1e-9, deviation, 1.0))
    size = N_FOURIER + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.fourier(matrix(batch.column(0)))
            total += z.T @ np.hstack([z, batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
        yield pa.record_batch({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = np.zeros((size, size + 1)), None
        for batch in batches:
            for part, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += np.frombuffer(m.as_py()).reshape(size, size + 1)
                least = part if least is None else min(least, part)
        if least is not None:
            yield pa.record_batch({"part": pa.array([least], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

    # Sums of doubles depend on their order: they meet by partition number, in order.
    shape = "part long, m binary"
    dealt = labelled.where(part).select("stats", "label").mapInArrow(normal, shape).repartition(8, F.pmod("part", F.lit(8))).sortWithinPartitions("part")
    sums = sorted(dealt.mapInArrow(together, shape).collect(), key=lambda r: r.part)
    total = sum(np.frombuffer(r.m).reshape(size, size + 1) for r in sums)
    penalty = RIDGE * np.eye(size)
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])

    @F.arrow_udf("int")
    def bin_of(stats: pa.Array) -> pa.Array:
        return pa.array((np.clip(model.ridge(matrix(stats)), 0, 1) * (BINS - 1)).round().astype(np.int32))

    bins = labelled.where(~part).groupBy(bin_of("stats").alias("bin")).agg(F.avg("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if len(bins) > 1:
        model.edges = np.array([r.bin for r in bins]) / (BINS - 1)
        model.levels = isotonic(np.array([r.y for r in bins]), np.array([float(r.n) for r in bins]))
    return model


def scorer(model: Model):
    """A Column function: stats array<double> to score double."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(stats: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(matrix(stats)))

    return score


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """From (doc_id, stats) and (doc_id, quality); rows with crc32(doc_id as text) mod 5 equal to 0 are never used."""
    fold = (F.crc32(F.col("doc_id").cast("string")) % 5).cast("int")
    known = labels.where(F.col("quality").isNotNull() & (fold != 0)).select("doc_id", F.col("quality").cast("double").alias("label"), fold.alias("fold"))
    return fit(materialise(stats.select("doc_id", "stats").join(known, "doc_id").select("stats", "label", "fold")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = materialise(docs.select("doc_id", text_statistics(F.col("text")).alias("stats")))
    model = train(stats, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = stats.select("doc_id", held.alias("held_out"), scorer(model)("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
