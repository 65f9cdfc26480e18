"""Helpers shared by the operators: shared folder, stored tables, word splitting in Arrow batches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the control characters tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text that one step of a task works on; a longer text is a step of its own.
STEP_BYTES = 8 << 20
#: Shuffle files go at the end of a job whose rows are stored, rather than when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors all see: in spark.checkpoint.dir, or in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, and later plans know its size."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
        if hadoop is not None:
            hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def about(df: DataFrame, key: str, n: int) -> DataFrame:
    """Some n rows or a few more, those of the smallest hashes of the key, or all if there are not twice as many.

    For fitting on a bounded sample: a sort for exactly n rows then has this many to look at, not n from every task."""
    total = df.count()
    if total <= 2 * n:
        return df
    return df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * (1.1 * n + 100) / total))


def slices(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of ``column``, one row at least."""
    sizes = pc.fill_null(pc.cast(pc.binary_length(batch[column]), pa.int64()), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_array(values) -> pa.Array:
    """One array of 64-bit offsets, whatever the column's chunks and string type."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values


def strings(column) -> pa.Array:
    """Texts with null as the empty text, offsets from 0: some compute functions misread arrays that begin further on."""
    texts = pc.fill_null(pc.cast(as_array(column), pa.large_string()), "")
    offsets, data = raw(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a large_string or large_binary array without nulls, offsets from 0."""
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """All words of all texts in order, with the number of the text of each."""
    lists = pc.split_pattern_regex(texts, SPACES)
    flat, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    return pc.filter(rows, full).to_numpy(zero_copy_only=False), as_array(pc.filter(flat, full))


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each value, distinct values)."""
    if len(values) == 0:
        return np.zeros(0, np.int64), values
    found = values.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix, so that all bits depend on all bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def hashed(values: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v) for v in pc.cast(values, pa.large_binary()).to_pylist()), np.uint64, len(values))


def byte_level_pieces(path: str) -> Iterator[tuple[bytes, int]]:
    """Pieces of a byte-level vocabulary file (JSON) as bytes with their ids, special tokens left out.

    Such files write printable bytes as themselves and the others, in order, as the characters from 256 on.
    """
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    special = {t["content"] for t in content.get("added_tokens", []) if t.get("special")}
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    for piece, number in content["model"]["vocab"].items():
        if piece not in special:
            yield bytes(of[c] for c in piece), number
