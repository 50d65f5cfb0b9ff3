"""Vectors kept in bytes beside their table: one signed byte a component and a scale, keyed by id and version.

A search scores all packed vectors by dot products of bytes. Each packed vector tells how far it lies from its vector, so its
score has bounds that hold for sure: all whose upper bound reaches the k-th best lower bound are scored anew by exact cosine,
and none of the k nearest is lost. Of equal vectors the k with the least keys are enough. Queries travel to every task, so there
is a stated bound of them in a run; more are taken in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.operators.retrieval import cosine
from veritab.sources.store import new_folder, written

PACKED = "scale float, codes binary, error float, same long"
#: Queries of one pass, and what rounding to six digits and single precision add to a bound.
BLOCK, SLACK = 512, 2e-5


def pack(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scales, codes, errors) of rows: unit vectors in signed bytes, scaled by their largest component, and the distance of each
    from what its bytes say; a zero vector is zeros."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    scale = (np.abs(unit).max(axis=1) / 127 if vectors.shape[1] else np.zeros(len(vectors))).astype(np.float32)
    wide = scale[:, None].astype(np.float64)
    codes = np.rint(np.divide(unit, wide, out=np.zeros_like(unit), where=wide > 0)).astype(np.int8)
    return scale, codes, np.linalg.norm(unit - codes * wide, axis=1).astype(np.float32)


def packed(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, version, scale, codes, error, same) of (key, version, vector); equal vectors have equal `same`. Null vectors are left
    out; all others have one length."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            n = len(lists)
            if not n:
                continue
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            scale, codes, error = pack(flat.reshape(n, -1))
            columns = [batch.column(0), batch.column(1), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "version", "scale", "codes", "error", "same"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.where(F.col(vector).isNotNull()).select(key, F.col("version").cast("string").alias("version"), vector, F.xxhash64(vector).alias("same")).mapInArrow(build, f"{key} {kind}, version string, {PACKED}")


class VectorSidecar:
    """Packed vectors under a folder: one part for each refresh, and the list of what is live."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "vec_id"):
        self.spark, self.folder, self.key, self.parts = spark, folder.rstrip("/"), key, 0
        self.live: DataFrame | None = None

    def refresh(self, vectors: DataFrame, vector: str = "embedding") -> int:
        """Packs what is new or of a new version, forgets what is gone; how many vectors were packed."""
        keys = [self.key, "version"]
        given = vectors.withColumn("version", F.col("version").cast("string"))
        fresh = given if self.live is None else given.join(self.live.select(*keys), keys, "left_anti")
        self.parts += 1
        new = written(packed(fresh, self.key, vector), f"{self.folder}/part-{self.parts}")
        n = new.count()
        kept = new if self.live is None else self.live.join(given.select(*keys), keys, "left_semi").unionByName(new)
        self.live = written(kept, f"{self.folder}/live-{self.parts}")
        return n

    def candidates(self, queries: list[tuple[object, list[float]]], k: int) -> DataFrame:
        """(number, key): for each query, by its place, all vectors that can be among its k nearest."""
        scale, codes, error = pack(np.array([v for _, v in queries], np.float64))
        wanted = codes.astype(np.float32) * scale[:, None]
        length, self_key = np.linalg.norm(wanted, axis=1), self.key

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    batch = firsts(batch)
                if not batch.num_rows:
                    continue
                own, off = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 3))
                rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(batch.num_rows, -1)
                dots = (rows.astype(np.float32) @ wanted.T) * own[:, None]
                # |q.v - q'.v'| <= |q - q'| + |q'| |v - v'| for unit vectors; a vector without direction may score anything.
                apart = error[None, :] + off[:, None] * length[None, :] + np.float32(SLACK)
                none = (own == 0)[:, None] | (scale == 0)[None, :]
                low, high = np.where(none, np.float32(-2), dots - apart), np.where(none, np.float32(2), dots + apart)
                least = np.partition(low, len(low) - k, axis=0)[len(low) - k] if len(low) > k else np.full(len(scale), -3, np.float32)
                at, query = np.nonzero(high >= least)
                told = [pa.array(query.astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(4).take(pa.array(at)), pa.array(low[at, query]), pa.array(high[at, query])]
                yield pa.RecordBatch.from_arrays(told, names=["number", self_key, "same", "low", "high"])

        def firsts(batch: pa.RecordBatch) -> pa.RecordBatch:
            """Of equal vectors the k with the least keys."""
            ordered = batch.take(pc.sort_indices(batch, sort_keys=[("same", "ascending"), (self_key, "ascending")]))
            same = ordered.column(4).to_numpy()
            start = np.maximum.accumulate(np.where(np.r_[True, same[1:] != same[:-1]], np.arange(len(same)), 0))
            return ordered.filter(pa.array(np.arange(len(same)) - start < k))

        kind = self.live.schema[self.key].dataType.simpleString()
        scored = self.live.select(self.key, "scale", "codes", "error", "same").mapInArrow(score, f"number int, {self.key} {kind}, same long, low float, high float")
        copies = Window.partitionBy("number", "same").orderBy(self.key)
        few = scored.withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k)
        placed = few.withColumn("_n", F.row_number().over(Window.partitionBy("number").orderBy(F.desc("low"))))
        bound = F.max(F.when(F.col("_n") == k, F.col("low"))).over(Window.partitionBy("number"))
        return placed.withColumn("_least", bound).where(F.col("_least").isNull() | (F.col("high") >= F.col("_least"))).select("number", self.key)

    def nearest(self, vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding") -> DataFrame:
        """(query, key, rank, score): the k nearest of each query (query, vector) by exact cosine, ties by key.

        Queries are read in blocks of `BLOCK` in the order of their ids, each block one pass over the packed vectors."""
        ordered = queries.select("query", vector).orderBy("query").toLocalIterator(prefetchPartitions=True)
        parts, block = [], []

        def run() -> None:
            found = self.candidates(block, k)
            told = self.spark.createDataFrame(list(enumerate(q for q, _ in block)), f"number int, query {queries.schema['query'].dataType.simpleString()}")
            parts.append(written(found.join(F.broadcast(told), "number").select("query", self.key), new_folder(self.spark, "nearest")))

        for row in ordered:
            block.append((row[0], list(map(float, row[1]))))
            if len(block) == BLOCK:
                run()
                block = []
        if block:
            run()
        if not parts:
            return queries.select("query").limit(0).crossJoin(vectors.select(self.key).limit(0)).select("query", self.key, F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
        pairs = parts[0]
        for more in parts[1:]:
            pairs = pairs.unionAll(more)
        exact = pairs.join(vectors.select(self.key, vector), self.key).join(queries.select("query", F.col(vector).alias("_q")), "query")
        scored = exact.select("query", self.key, F.round(cosine(F.col(vector), F.col("_q")), 6).alias("score"))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), self.key)))
        return ranked.where(F.col("rank") <= k).select("query", self.key, "rank", "score")
