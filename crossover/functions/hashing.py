"""Row hashes, table checksums and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossover.functions.comparing import canonical, plain


def _plain(field: T.StructField, trim: bool) -> Column:
    """One value in the form both sides are compared in."""
    return plain(F.col(f"`{field.name}`"), field.dataType, canonical(field.dataType), trim)


def plain_columns(df: DataFrame, columns: list[str] | None = None, trim: bool = True) -> dict[str, Column]:
    """Comparison form of each column, in name order, so that column order never matters."""
    names = sorted(columns if columns is not None else df.columns)
    return {n: _plain(df.schema[n], trim) for n in names}


def row_hash(df: DataFrame, columns: list[str] | None = None, trim: bool = True, salt: int = 0) -> Column:
    """64-bit hash of a row.

    The hash function skips NULLs, so the NULLs of a row are hashed as well, one bit each; otherwise (NULL, 'a') and
    ('a', NULL) would be equal.
    """
    names = list(plain_columns(df, columns, trim=False))
    nulls = [reduce(Column.bitwiseOR, [F.shiftleft(F.col(f"`{n}`").isNull().cast("long"), i) for i, n in enumerate(names[k:k + 60])])
             for k in range(0, len(names), 60)]
    return F.xxhash64(F.lit(salt), *nulls, *plain_columns(df, columns, trim).values())


def row_digest(df: DataFrame, columns: list[str] | None = None, trim: bool = True) -> Column:
    """SHA-256 over the row as JSON with sorted keys and explicit NULLs."""
    cols = [c.alias(n) for n, c in plain_columns(df, columns, trim).items()]
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def checksum_aggregates(h: Column) -> list[Column]:
    """Order-free checksum of hashes. XOR alone would lose pairs of equal rows, so the sum goes with it."""
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(h).alias("hash_xor"),
        F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
    ]


def fingerprint(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 12)
