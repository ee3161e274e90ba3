"""Helpers shared by the operators of this package: tables, Arrow steps, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from partsight.session import run_dir

#: Bytes of text that an Arrow step works on at a time (a longer text is a step of its own).
STEP_BYTES = 4 << 20

#: Bytes of an Arrow batch on its way to Python, and the setting of the session that bounds it with Spark's default.
BATCH_BYTES = 8 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to ``BATCH_BYTES`` where nobody has set another bound.

    Executors hold a batch once in the JVM and once in Python for each step of each task.
    """
    if spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns, of whatever name, are not read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends, a lost executor loses nothing."""
    path = run_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Returns what this process has freed to the system (where the C library can: glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(step: Callable) -> Callable:
    """An Arrow step that gives its memory back when it begins and ends.

    Python workers serve one task after another and wait in between; without this each keeps the
    most that any of its tasks needed.
    """

    def run(batches):
        give_back()
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def stepped(
    batches: Iterable[pa.RecordBatch], column: str, limit: int = STEP_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total + size > limit and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, and where each group starts (with the end as last value).

    The batches must be sorted by ``key``, an integer column without nulls.
    """
    held: list[pa.RecordBatch] = []

    def flush() -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = rows.column(key).to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        return rows, np.concatenate(([0], cuts, [len(keys)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[-1])
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield flush()
            held = []
        if last:
            held.append(batch.slice(0, last))
            yield flush()
            held = []
        held.append(batch.slice(last))
    if held:
        yield flush()


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value of each 64-bit value (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def compressed(df: DataFrame, raw: str, into: str) -> DataFrame:
    """``df`` with the binary column ``raw`` replaced by ``into``, zstandard frames: less to shuffle."""
    kept = [f for f in df.schema.fields if f.name != raw]

    def step(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in stepped(batches, raw):
            packed = [None if x is None else press.compress(x) for x in batch.column(raw).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), binaries(packed)], [*(f.name for f in kept), into]
            )

    return df.mapInArrow(lean(step), T.StructType([*kept, T.StructField(into, T.BinaryType())]))


def decompressed(column: pa.Array) -> list[bytes | None]:
    press = zstandard.ZstdDecompressor()
    return [None if x is None else press.decompress(x) for x in column.to_pylist()]
