"""Keyed diff by key ranges: checksums of ranges, refined where they differ.

The first level cuts the key at quantiles of the source and reads both sides once, moving a checksum per range. Each further level reads
only the ranges that differ, cut finer at quantiles of their own, until a range is small; then the rows of these ranges are compared. Range
conditions are plain comparisons of the key columns, so they reach Parquet statistics, partitions or a database.

Both sides' rows are dealt to ranges by their own key values. Where the sides order a key differently (padded text), a row may lie in two
ranges; both then differ, and the rows still meet in the end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossover.functions.comparing import comparison_columns, shared_columns
from crossover.functions.hashing import checksum_aggregates, row_hash
from crossover.functions.sketch import quantiles
from crossover.operators.validate import diff_rows
from crossover.session import ship

FAN, LEAF_ROWS, MOST_RANGES = 64, 100_000, 512
SKETCH_SIZE = 1024  # of a range's own quantiles, which need not be exact


@dataclass(frozen=True)
class Range:
    """Keys above ``low`` and not above ``high``; None is an open end. Rows with a NULL in the key belong to the first range."""

    low: tuple | None
    high: tuple | None


@dataclass
class RangeDiff:
    """Differing keys, the ranges they were looked for in, and how many rows of both sides each level read."""

    rows: DataFrame
    ranges: list[Range]
    read: list[int] = field(default_factory=list)


class Keys:
    """Key columns, and conditions against bounds of the types that the source has."""

    def __init__(self, names: list[str], schema: T.StructType):
        self.names, self.types = list(names), [schema[k].dataType for k in names]

    def _column(self, i: int) -> Column:
        return F.col(f"`{self.names[i]}`")

    def _bound(self, i: int, bound: tuple) -> Column:
        return F.lit(bound[i]).cast(self.types[i])

    def empty(self) -> Column:
        return reduce(lambda a, b: a | b, [self._column(i).isNull() for i in range(len(self.names))])

    def above(self, bound: tuple) -> Column:
        return self._compared(bound, lambda i, last: self._column(i) > self._bound(i, bound), self._column(0) >= self._bound(0, bound))

    def not_above(self, bound: tuple) -> Column:
        return self._compared(bound, lambda i, last: self._column(i) <= self._bound(i, bound) if last else self._column(i) < self._bound(i, bound), self._column(0) <= self._bound(0, bound))

    def _compared(self, bound: tuple, test: Callable[[int, bool], Column], first: Column) -> Column:
        """Key by key; of a composite key the first column's comparison also stands alone, where statistics see it."""
        n = len(self.names)
        tests = [reduce(lambda a, b: a & b, [*(self._column(j) == self._bound(j, bound) for j in range(i)), test(i, i == n - 1)]) for i in range(n)]
        return tests[0] if n == 1 else first & reduce(lambda a, b: a | b, tests)

    def within(self, r: Range) -> Column:
        """Condition for the rows of a range; every row meets that of exactly one of adjoining ranges."""
        # A part of a composite key may be NULL while another is beyond a bound; such rows belong to the first range alone.
        filled = [~self.empty()] if len(self.names) > 1 else []
        if r.low is None:
            return F.lit(True) if r.high is None else reduce(lambda a, b: a & b, [self.not_above(r.high), *filled]) | self.empty()
        return reduce(lambda a, b: a & b, [self.above(r.low), *([] if r.high is None else [self.not_above(r.high)]), *filled])

    def place(self, ranges: list[Range]) -> Column:
        """Number of a row's range, found in as many comparisons as the number has bits."""
        def descend(lo: int, hi: int) -> Column:
            if hi - lo == 1:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(self.above(ranges[mid].low), descend(mid, hi)).otherwise(descend(lo, mid))

        return F.when(self.empty(), F.lit(0)).otherwise(descend(0, len(ranges)))


def _any(conditions: list[Column]) -> Column:
    """A balanced OR, so that its depth stays small."""
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a | b, conditions[i : i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0] if conditions else F.lit(False)


def joined(ranges: list[Range]) -> list[Range]:
    """Adjoining ranges as one; they come in key order."""
    out: list[Range] = []
    for r in ranges:
        if out and out[-1].high is not None and out[-1].high == r.low:
            out[-1] = Range(out[-1].low, r.high)
        else:
            out.append(r)
    return out


def rows_within(df: DataFrame, keys: Keys, ranges: list[Range]) -> DataFrame:
    return df.where(_any([keys.within(r) for r in joined(ranges)]))


def _split(cuts: list[tuple], r: Range) -> list[Range]:
    inner = [c for c in cuts if (r.low is None or c > r.low) and (r.high is None or c < r.high)]
    ends = [r.low, *inner, r.high]
    return [Range(a, b) for a, b in zip(ends, ends[1:])]


def _sums(side: DataFrame, form: list[Column], columns: list[str], keys: Keys, ranges: list[Range], whole: bool) -> DataFrame:
    """Checksum of each range of one side; only these ranges are read unless they are the ``whole`` table."""
    place = "place"
    while place in columns:
        place += "_"
    rows = (side if whole else rows_within(side, keys, ranges)).select(keys.place(ranges).alias(place), *form)
    return rows.groupBy(F.col(place).alias("place")).agg(*checksum_aggregates(row_hash(rows, columns, trim=False)))


def diff_ranges(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None, trim: bool = True,
                fan: int = FAN, leaf_rows: int = LEAF_ROWS, most_ranges: int = MOST_RANGES) -> RangeDiff:
    """:func:`diff_rows` over the ranges of the key that differ.

    ``keys`` of both sides are of kinds that sort alike (numbers, times, or texts). When differing ranges hold more than half of the rows, or
    are more than ``most_ranges``, refining stops and their rows are compared. The driver gets a checksum per range of a level.
    """
    for k in keys:
        kinds = [_kind(df.schema[k].dataType) for df in (source, target)]
        if kinds[0] != kinds[1]:
            raise ValueError(f"key {k} is {kinds[0]} on one side and {kinds[1]} on the other; use diff_shards")
    ship(source.sparkSession)
    cols = list(columns) if columns is not None else shared_columns(source, target)
    every = list(dict.fromkeys([*keys, *cols]))
    forms, key = comparison_columns(source, target, every, trim), Keys(keys, source.schema)

    def cuts_of(df: DataFrame, group: Column | None, size: int) -> dict[int, list[tuple]]:
        out: dict[int, list[tuple]] = {}
        for r in quantiles(df, keys, fan, group, size).collect():  # at most ``fan`` for each of at most ``most_ranges`` ranges
            out.setdefault(r[0], []).append(tuple(r)[1:])
        return {g: sorted(c) for g, c in out.items()}

    ranges, small, read = _split(cuts_of(source, None, 4 * SKETCH_SIZE).get(0, []), Range(None, None)), [], []
    while ranges:
        sides = [{r["place"]: tuple(r)[1:] for r in _sums(df, form, every, key, ranges, not read).collect()} for df, form in zip((source, target), forms)]
        read.append(sum(x[0] for s in sides for x in s.values()))
        bad = [i for i in range(len(ranges)) if sides[0].get(i) != sides[1].get(i)]
        rows = [[s.get(i, (0,))[0] for i in bad] for s in sides]
        large = [ranges[i] for i, n in zip(bad, map(max, *rows)) if n > leaf_rows] if bad else []
        small += [ranges[i] for i in bad if ranges[i] not in large]
        if not large or len(bad) > most_ranges or 2 * (sum(rows[0]) + sum(rows[1])) > read[0]:
            small += large
            break
        # Cut at the quantiles of the side that has more rows there.
        fuller = source if sum(rows[0]) >= sum(rows[1]) else target
        number = F.coalesce(*[F.when(key.within(r), F.lit(i)) for i, r in enumerate(large)])
        cuts, ranges = cuts_of(rows_within(fuller, key, large), number, SKETCH_SIZE), []
        for i, r in enumerate(large):
            parts = _split(cuts.get(i, []), r)
            if len(parts) == 1:  # one key with many rows
                small.append(r)
            else:
                ranges += parts
    found = [r for r in small if r.low is None] + sorted((r for r in small if r.low is not None), key=lambda r: r.low)
    return RangeDiff(diff_rows(rows_within(source, key, found), rows_within(target, key, found), keys, cols, trim), found, read)


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "a number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "a time"
    return t.typeName()
