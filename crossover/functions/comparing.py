"""One form for both sides of a comparison.

Source and target seldom have the same types: integers and decimals are widened, texts padded, timestamps lose their zone. The form of
a column follows from both types, and everything that compares rows (hashes, keys, buckets, samples, checksums, cells) works on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossover.functions.text import trimmed

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.StructType, T.ArrayType, T.MapType)
_DIGITS = {T.BooleanType: 1, T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both; text where there is none, and for an integer or decimal beside a float."""
    pair = (a, b)
    if all(isinstance(x, T.StringType) for x in pair):
        return T.StringType()
    if all(isinstance(x, (*_INTEGERS, T.BooleanType)) for x in pair):
        return T.BooleanType() if all(isinstance(x, T.BooleanType) for x in pair) else T.LongType()
    if all(isinstance(x, (*_INTEGERS, *_FLOATS, T.DecimalType)) for x in pair) and any(isinstance(x, _FLOATS) for x in pair):
        # An integer or decimal meets a float as text, where a digit that a float lost shows.
        return T.DoubleType() if all(isinstance(x, _FLOATS) for x in pair) else T.StringType()
    if all(isinstance(x, (*_INTEGERS, T.BooleanType, T.DecimalType)) for x in pair):
        whole = max(x.precision - x.scale if isinstance(x, T.DecimalType) else _DIGITS[type(x)] for x in pair)
        scale = max(x.scale if isinstance(x, T.DecimalType) else 0 for x in pair)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if all(isinstance(x, _TIMES) for x in pair):
        return T.DateType() if all(isinstance(x, T.DateType) for x in pair) else T.TimestampNTZType()
    if any(isinstance(x, T.BinaryType) for x in pair) and all(isinstance(x, (T.BinaryType, T.StringType)) for x in pair):
        return T.BinaryType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and sorted(a.names) == sorted(b.names):
        return T.StructType([T.StructField(n, common_type(a[n].dataType, b[n].dataType)) for n in sorted(a.names)])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType))
    return a if a == b else T.StringType()


def _unpadded(text: Column) -> Column:
    return F.when(text.contains(".") & ~text.contains("E"), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def _float_text(c: Column) -> Column:
    """A float as the text of an equal decimal: whole numbers with all their digits, others with the fewest digits that name the float."""
    size, text = F.abs(c.cast("double")), c.cast("string")
    whole = (size < 9223372036854775808.0) & (F.floor(F.when(size < 9223372036854775808.0, c.cast("double"))) == c.cast("double"))
    small = F.when((size > 0) & (size < 1e-3), text.cast("decimal(38,37)"))
    large = F.when((size >= 1e7) & (size < 1e18), text.cast("decimal(38,20)"))
    huge = F.when((size >= 1e18) & (size < 9.9e37), text.cast("decimal(38,0)"))
    return (F.when(whole, c.cast("double").try_cast("bigint").cast("string")).when(size >= 1e18, F.coalesce(huge.cast("string"), text))
            .when(size >= 1e7, _unpadded(large.cast("string"))).when((size < 1e-3) & (small != 0), _unpadded(small.cast("string"))).otherwise(_unpadded(text)))


def form(c: Column, have: T.DataType, want: T.DataType, trim: bool = True) -> Column:
    """``c`` of type ``have`` as a value of ``want``: texts trimmed, maps as sorted entries, one zero, numbers as text without spare zeros."""
    if isinstance(want, T.StructType):
        made = F.struct(*[form(c[n], have[n].dataType, want[n].dataType, trim).alias(n) for n in want.names])
        return F.when(c.isNotNull(), made)
    if isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: form(x, have.elementType, want.elementType, trim))
    if isinstance(want, T.MapType):
        pair = lambda e: F.struct(form(e["key"], have.keyType, want.keyType, trim).alias("key"), form(e["value"], have.valueType, want.valueType, trim).alias("value"))
        return F.array_sort(F.transform(F.map_entries(c), pair))
    if isinstance(want, T.StringType):
        if isinstance(have, T.DecimalType):
            return F.when(c == 0, "0").otherwise(_unpadded(c.cast("string")))
        if isinstance(have, _FLOATS):
            return _float_text(c)
        if isinstance(have, T.VariantType):
            return F.to_json(c)
        text = c.cast("string")
        return trimmed(text) if trim else text
    if isinstance(want, T.DoubleType):
        return c.cast("double") + F.lit(0.0)
    if isinstance(want, T.FloatType):
        return c + F.lit(0.0).cast("float")
    if isinstance(have, T.BooleanType) and isinstance(want, T.DecimalType):
        return c.cast("int").cast(want)
    return c if have == want else c.cast(want)


def plain(c: Column, have: T.DataType, want: T.DataType, trim: bool = True) -> Column:
    """:func:`form` as a value that can be hashed and grouped; nested values as JSON with their NULLs."""
    made = form(c, have, want, trim)
    if isinstance(want, _NESTED):
        return F.when(c.isNotNull(), F.to_json(F.struct(made.alias("v")), {"ignoreNullFields": "false"}))
    return made


def canonical(t: T.DataType) -> T.DataType:
    """The form of a column when the other side isn't known: integers as the widest, the rest as it is."""
    return T.LongType() if isinstance(t, _INTEGERS) else T.StringType() if isinstance(t, T.VariantType) else t


def comparison_columns(source: DataFrame, target: DataFrame, columns: list[str], trim: bool = True) -> tuple[list[Column], list[Column]]:
    """Each column in one form on either side."""
    s, t = [], []
    for n in columns:
        a, b = source.schema[n].dataType, target.schema[n].dataType
        want = canonical(common_type(a, b))
        s.append(plain(F.col(f"`{n}`"), a, want, trim).alias(n))
        t.append(plain(F.col(f"`{n}`"), b, want, trim).alias(n))
    return s, t


def shared_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """Columns of both sides. One that a side lacks is an error: leaving it out unasked would pass a table that lost it."""
    alone = sorted(set(source.columns) ^ set(target.columns))
    if alone:
        raise ValueError(f"columns on one side only: {', '.join(alone)}; name the columns to compare")
    return source.columns


def comparable(source: DataFrame, target: DataFrame, keys: list[str] = (), columns: list[str] | None = None, trim: bool = True) -> tuple[DataFrame, DataFrame, list[str]]:
    """Keys and columns of both sides in one form, and the columns to compare."""
    cols = list(columns) if columns is not None else shared_columns(source, target)
    every = list(dict.fromkeys([*keys, *cols]))
    s, t = comparison_columns(source, target, every, trim)
    return source.select(*s), target.select(*t), cols
