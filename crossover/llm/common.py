"""What the operators of this package share: document keys, Arrow batches in bounded slices, groups out of sorted rows, shared tables.

A document row is addressed by its key ``(id, v)``: ``id`` is doc_id with NULL as the smallest 64-bit integer, ``v`` a hash of the
text. Rows that repeat a doc_id with the same text have one key and get the same result; with another text they are documents of
their own that share an id.
"""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossover.session import run_folder

NULL_ID = -(1 << 63)
SLICE_BYTES = 1 << 20
CHUNK_BYTES = 8 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def key_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(name: str = "id") -> Column:
    """doc_id of a key."""
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name))


def keyed(docs: DataFrame) -> DataFrame:
    """Key and text; other columns, whatever their names, are left behind."""
    return docs.select(key_id().alias("id"), F.xxhash64("text").alias("v"), F.col("text").cast("string").alias("text"))


def free_name(columns: Iterable[str], name: str = "__key") -> str:
    """``name``, or as much more of it as no column is called (whatever the case of its letters)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """``df`` under the names c0, c1, ..., as Arrow functions over whole rows cannot take a name with a dot; ``toDF`` gives names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def key_struct() -> Column:
    return F.struct(key_id().alias("id"), F.xxhash64("text").alias("v"))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def written(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """``df`` as a table in the folder that all executors share: it cuts lineage, is computed once, outlives executors and goes
    with the application. Of rows that take megabytes, a reader holds ``group_rows`` at once."""
    spark, path = df.sparkSession, run_folder(df.sparkSession, name)
    (df.write.option("parquet.block.row.count.limit", group_rows) if group_rows else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, limit: int) -> Iterator[None]:
    """Jobs that run meanwhile hand Python Arrow batches of about ``limit`` bytes; the default (10 000 rows, 64 MB) is held by the executor's
    JVM and by the worker, in each twice while the next one is read."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, limit)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def ints(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def texts_of(a: pa.Array) -> list[bytes]:
    """UTF-8 of each text, NULL as empty."""
    return [b"" if x is None else x for x in a.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches again, in pieces of about ``limit`` bytes of text; a longer text is a piece of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        lengths = np.nan_to_num(pc.binary_length(b.column(b.schema.get_field_index(column))).to_numpy(zero_copy_only=False)).astype(np.int64)
        part = (np.cumsum(lengths) - lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield b.slice(lo, hi - lo)


def release() -> None:
    """Give freed memory back to the system. Python workers serve one task after another, and what a task has freed would
    count against the executor for as long as they live."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What processes keep from task to task: encoders, models. Workers outlive stages, so the next stage's first task empties them.
CACHES: list[dict] = []
_STAGE: list[int | None] = [None]


def _new_stage() -> None:
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _STAGE[0]:
        for cache in CACHES:
            cache.clear()
        _STAGE[0] = stage
        release()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a process without another stage's caches, followed by :func:`release`."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _new_stage()
        try:
            yield from run(batches)
        finally:
            release()

    return both


def mapped(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``fn`` over every slice of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, column, limit):
            out = fn(s)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(tidy(run), schema)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Rows gathered over batches up to ``limit`` bytes of text, so that a task's repeats meet in one place of bounded size."""
    held, size = [], 0
    for b in slices(batches, column, min(limit, SLICE_BYTES)):
        held.append(b)
        size += pc.sum(pc.binary_length(b.column(b.schema.get_field_index(column)))).as_py() or 0
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` out of rows sorted by it; holds one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = ints(b.column(b.schema.get_field_index(key)))
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and k[lo] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = k[lo]
    if held:
        yield pa.Table.from_batches(held)


def batch(**columns) -> pa.RecordBatch:
    """A record batch of arrays, numpy arrays or lists."""
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()})


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, for clusters where it isn't installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    path = Path(tempfile.mkdtemp(prefix="crossover-")) / "crossover_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "crossover").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)
