"""CSV export in files of a bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossover.functions.constants import MAX_IMPORT_BYTES
from crossover.session import ship

CSV_OPTIONS = {"escape": '"', "quote": '"', "nullValue": "\\N", "emptyValue": '""', "lineSep": "\n", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}

READ_OPTIONS = {**CSV_OPTIONS, "emptyValue": ""}  # quoted nothing is the empty string, \N is NULL


def rows_per_file(df: DataFrame, max_bytes: int = MAX_IMPORT_BYTES) -> int:
    """How many rows of the longest kind fit a file; one aggregation over the rows as CSV."""
    size = F.octet_length(_line(df)) + 1
    longest = df.agg(F.coalesce(F.max(size), F.lit(1)).alias("n")).first()["n"]
    if longest > max_bytes:
        raise ValueError(f"a row takes {longest} bytes, too much for files of {max_bytes}")
    return max_bytes // longest


def _line(df: DataFrame):
    return F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), CSV_OPTIONS)


def file_numbers(sizes: np.ndarray, used: int, number: int, max_bytes: int) -> tuple[np.ndarray, int, int]:
    """File of each row of a task, after ``used`` bytes in file ``number``; and where this leaves off. A file ends before the row that
    would take it beyond ``max_bytes``."""
    if len(sizes) and sizes.max() > max_bytes:
        raise ValueError(f"a row takes {sizes.max()} bytes, too much for files of {max_bytes}")
    ends, out, at = np.cumsum(sizes), np.empty(len(sizes), dtype=np.int64), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = int(np.searchsorted(ends, before + max_bytes - used, side="right"))
        out[at:end] = number
        if end < len(sizes):
            number, used = number + 1, 0
        else:
            used += int(ends[-1] - before)
        at = end
    return out, used, number


def export_csv(df: DataFrame, path: str, max_bytes: int = MAX_IMPORT_BYTES, mode: str = "overwrite") -> None:
    """Write CSV files of at most ``max_bytes``, cut by the running size of the rows, below one folder for each file number of a task.

    Rows stay in their partitions and in their order: nothing is shuffled, and the rows are read once. All column names are the caller's. A
    row that no file can hold ends the export.
    """
    ship(df.sparkSession)
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = number = 0
        for b in batches:
            out, used, number = file_numbers(b.column(b.num_columns - 1).to_numpy().astype(np.int64), used, number, max_bytes)
            yield b.set_column(b.num_columns - 1, "file", pa.array(out))

    names = [f"c{i}" for i in range(len(df.columns))]  # files carry none
    sized = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)], (F.octet_length(_line(df)) + 1).alias("file"))
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, df.schema)), T.StructField("file", T.LongType())])
    sized.mapInArrow(cut, schema).write.mode(mode).options(**CSV_OPTIONS).partitionBy("file").csv(path)


def read_export(spark, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).options(**READ_OPTIONS).option("multiLine", "true").option("recursiveFileLookup", "true").csv(path)
