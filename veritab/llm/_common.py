"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: About how many characters one numpy pass takes; longer texts form a pass of their own.
PASS_CHARS = 400_000
#: Rows whose texts are made Python strings at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is not set, a temporary one if all runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veritab-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veritab_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame | None) -> None:
    """Deletes the files of materialised frames that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_veritab_path", None):
            remove(df.sparkSession, path)


def passes(texts: list[str | None], most: int = PASS_CHARS):
    """(start, end) of slices of texts with about `most` characters each; no text is cut."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def slices(column: pa.Array, most: int = PASS_CHARS) -> Iterator[tuple[int, list]]:
    """(first row, texts) of stretches of a text column with about `most` bytes each, so that only one stretch at a time
    is held as Python strings."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        end = max(start + 1, min(int(np.searchsorted(ends, before + most)), start + (1 << 16), len(column)))
        yield start, column.slice(start, end - start).to_pylist()
        start = end


def bytes_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text; a null is empty."""
    for start in range(0, len(column), SLICE_ROWS):
        for x in column.slice(start, SLICE_ROWS).cast(pa.large_binary()).to_pylist():
            yield x or b""


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
