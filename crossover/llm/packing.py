"""Best-fit packing with exact complements, planned on counts of lengths.

Texts become token ids, ids become pieces of at most ``size``, and only their lengths (at most ``size`` different ones) decide how
they are packed. The plan takes the largest length, looks up single lengths, pairs and triples whose sum fills its gap exactly,
and uses such a combination as often as the counts allow; where none fits, the largest piece that does (best fit) shrinks the gap.
A plan row says: the pieces of one length with ranks lo and up go to sequences from ``seq`` on, at ``offset``. Ranks need no
global sort: each task numbers its pieces of a length, and tasks' counts are added up.

Defined cases: a NULL or empty text is one piece that holds the end id; a longer text is cut from its end, so its first piece may be
shorter; repeated rows are packed each; a NULL doc_id is kept; an empty table packs into nothing; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossover.llm.bpe import CALL_BYTES, encoder
from crossover.llm.common import batch, batches_of, id_back, ints, keyed, release, slices, tidy, written

SIZE = 1024
END = 2
TOKENIZER = "byte_bpe_50k.json"

PIECES = "id bigint, v bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """A row for each piece, with its task (part) and its rank among that task's pieces of its length."""
    def run(batches):
        file = path or public_tokenizers.path(TOKENIZER)
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for b in slices(batches, limit=CALL_BYTES):
            out = []
            for i, v, ids in zip(ints(b.column(0)).tolist(), ints(b.column(1)).tolist(), encoder(file).encode(b.column(2))):
                ids = np.append(ids, end).astype("<u4")
                first = len(ids) % size or size
                for n, hi in enumerate(range(first, len(ids) + 1, size)):
                    lo = max(0, hi - size)
                    out.append((i, v, n, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes()), part, int(seen[hi - lo])))
                    seen[hi - lo] += 1
            cols = zip(*out)
            names = ("id", "v", "piece", "start", "length", "ids_crc32", "part", "rank")
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield batch(**{n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)})
            release()

    return keyed(docs).mapInArrow(tidy(run), PIECES)


class Complements:
    """Which lengths, pairs and triples of available lengths sum to a gap."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self._pairs: np.ndarray | None = None

    def take(self, lengths: tuple[int, ...]) -> int:
        """Use a combination as often as the counts allow."""
        need = Counter(lengths)
        times = min(int(self.counts[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.counts[x] -= n * times
            if not self.counts[x]:
                self._pairs = None
        return times

    def _fits(self, lengths: tuple[int, ...], held: tuple[int, ...]) -> bool:
        need = Counter(lengths + held)
        return all(self.counts[x] >= n for x, n in need.items())

    def _pair_sums(self) -> np.ndarray:
        if self._pairs is None:
            have = (self.counts > 0).astype(np.int32)
            self._pairs = np.convolve(have, have)
        return self._pairs

    def _pair(self, gap: int, most: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        a = np.arange(min(most, gap - 1), (gap - 1) // 2, -1)
        for x in a[(self.counts[a] > 0) & (self.counts[gap - a] > 0)]:
            if self._fits((int(x), gap - int(x)), held):
                return int(x), gap - int(x)
        return None

    def exact(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths that fill ``gap`` beside the pieces ``held``; larger ones first."""
        if self._fits((gap,), held):
            return (gap,)
        sums = self._pair_sums()
        if sums[gap] and (found := self._pair(gap, gap - 1, held)):
            return found
        for a in np.flatnonzero(self.counts[: gap - 1])[::-1]:
            a = int(a)
            if 3 * a < gap:
                break
            if sums[gap - a] and self._fits((a,), held) and (found := self._pair(gap - a, min(a, gap - a - 1), (a, *held))):
                return (a, *found)
        return None

    def best(self, gap: int, held: tuple[int, ...]) -> int | None:
        for a in np.flatnonzero(self.counts[: gap + 1])[::-1]:
            if self._fits((int(a),), held):
                return int(a)
        return None


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths, and how many sequences each makes. ``counts[x]``: pieces of length x; the last index is the size."""
    c, size = Complements(counts.astype(np.int64).copy()), len(counts) - 1
    out = []
    for length in range(size, 0, -1):
        while c.counts[length]:
            held, gap = (length,), size - length
            while gap:
                if (found := c.exact(gap, held)) is not None:
                    held += found
                    break
                if (one := c.best(gap, held)) is None:
                    break
                held, gap = (*held, one), gap - one
            out.append((held, c.take(held)))
    return out


def places(combinations: list[tuple[tuple[int, ...], int]], size: int = SIZE) -> list[np.ndarray]:
    """For each length its rows (first rank, first sequence, offset), by rank."""
    used, rows, sequence = [0] * (size + 1), [[] for _ in range(size + 1)], 0
    for lengths, times in combinations:
        offset = 0
        for x in lengths:
            rows[x].append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return [np.array(r, dtype=np.int64).reshape(-1, 3) for r in rows]


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with batches_of(docs.sparkSession, CALL_BYTES):
        cut = written(pieces(docs, path, size, end), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    total = np.zeros(size + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        total[r.length] = r.n
    where = places(plan(total), size)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            col = {n: b.column(b.schema.get_field_index(n)) for n in b.schema.names}
            length, rank = ints(col["length"]), ints(col["rank"]) + ints(col["base"])
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for x in np.unique(length):
                mine, w = np.flatnonzero(length == x), where[x]
                row = w[np.searchsorted(w[:, 0], rank[mine], side="right") - 1]
                sequence[mine], offset[mine] = row[:, 1] + rank[mine] - row[:, 0], row[:, 2]
            yield batch(id=col["id"], piece=col["piece"], start=col["start"], length=col["length"], ids_crc32=col["ids_crc32"], sequence_id=sequence, offset=offset)

    out = cut.join(base, ["part", "length"]).mapInArrow(tidy(run), "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.select(id_back().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
