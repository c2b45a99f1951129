"""Benchmark decontamination with a positional inverted index that is split by document.

``build_index`` stores, for every segment of documents, the postings of the terms that test items hold (no other term can take part
in a match). ``search`` reads the lists of a window's rarest term in the whole corpus, shifts them by the term's place, and keeps
the starts that the next-rarest terms' shifted lists share, up to the last term. As a document lies in one segment, no list
travels, and a term or source with a third of all rows is spread over all segments.

The test set is read in blocks of at most ``BLOCK_BYTES``: one block's terms and windows are what a job sends to its tasks.

Defined cases: a NULL or wordless text has no words and no hits; a NULL or wordless item has no windows; an item with a NULL
item_id hits words but isn't listed; items that repeat an item_id count once; repeated document rows each get their row; an empty
table on either side gives no rows or no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossover.llm.common import batch, id_back, ints, keyed, mapped, texts_of, tidy, written
from crossover.llm.words import ALNUM, Words, covered, normal

WINDOW = 10
BLOCK_BYTES = 8 << 20
CANDIDATES = 1 << 20

INDEX = "ids array<bigint>, vs array<bigint>, first array<int>, terms array<int>, counts array<int>, postings binary"
MATCHES = "id bigint, v bigint, n_words bigint, hit_from array<int>, hit_to array<int>, items array<string>"


@dataclass
class TestSet:
    """One block of test items: its terms (sorted by hash), and its windows as term numbers, -1 behind the end of short ones."""

    hashes: np.ndarray
    terms: list[bytes]
    windows: np.ndarray
    length: np.ndarray
    item: list[str | None]

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], k: int) -> TestSet:
        w = Words.of([normal((t or "").encode(), ALNUM) for _, t in rows])
        hashes, at, term = np.unique(w.hashes(), return_index=True, return_inverse=True)
        lo, hi = w.windows(k, whole_if_short=True)
        place = lo[:, None] + np.arange(k)
        windows = np.where(place < hi[:, None], term[np.minimum(place, max(len(w) - 1, 0))] if len(w) else -1, -1)
        owner = w.text_of_word()[lo] if len(lo) else []
        return cls(hashes, [w.buf[s:e] for s, e in zip(w.starts[at], w.ends[at])], windows.astype(np.int64), hi - lo, [rows[d][0] for d in owner])


def test_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Different rows of the test set, block by block; only one block is held at a time. Repeats would all meet in one block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = 1 + size // block_bytes
    for b in range(n):
        yield [(r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def build_index(docs: DataFrame, tests: TestSet) -> DataFrame:
    """Postings of the test terms, a row for each segment of documents: terms with their counts, and their word places in order."""
    hashes, terms = tests.hashes, tests.terms
    sizes = np.array([len(t) for t in terms], dtype=np.int64)

    def segment(b: pa.RecordBatch) -> pa.RecordBatch:
        w = Words.of([normal(t, ALNUM) for t in texts_of(b.column(2))])
        h = w.hashes()
        place = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
        known = np.flatnonzero((hashes[place] == h) & (sizes[place] == w.ends - w.starts)) if len(hashes) else np.empty(0, dtype=np.int64)
        known = known[np.argsort(place[known], kind="stable")]
        found, at, counts = np.unique(place[known], return_index=True, return_counts=True)
        # The hash finds a term, its letters decide.
        wrong = [t for t, i in zip(found, at) if w.buf[w.starts[known[i]] : w.ends[known[i]]] != terms[t]]
        if wrong:
            known = known[~np.isin(place[known], wrong)]
            found, counts = np.unique(place[known], return_counts=True)
        posts = zstandard.ZstdCompressor(level=1).compress(known.astype("<u4").tobytes())
        return batch(ids=[ints(b.column(0))], vs=[ints(b.column(1))], first=[w.first.astype(np.int32)], terms=[found.astype(np.int32)],
                     counts=[counts.astype(np.int32)], postings=[posts])

    return mapped(keyed(docs), segment, INDEX)


def term_counts(index: DataFrame) -> DataFrame:
    """How often each term occurs in the corpus; reads two columns of the index."""
    return index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n"))


def search(index: DataFrame, tests: TestSet, slop: int = 0) -> DataFrame:
    """Per document the word ranges that test windows match, and the items they belong to.

    ``slop`` 0 asks for the exact phrase. Otherwise each word may stand up to ``slop`` places from where the phrase has it
    (proximity), measured from the window's rarest term.
    """
    total = np.zeros(max(len(tests.terms), 1), dtype=np.int64)
    for r in term_counts(index).collect():  # one row for each term of the block
        total[r.term] = r.n
    windows, length, items = tests.windows, tests.length, tests.item
    order = np.argsort(np.where(windows < 0, np.iinfo(np.int64).max, total[windows]), axis=1, kind="stable") if len(windows) else windows

    def starts(first: np.ndarray, terms: np.ndarray, counts: np.ndarray, posts: np.ndarray):
        """(window, start) of every match in a segment."""
        have = np.zeros(len(total), dtype=np.int64)
        have[terms] = counts
        begin = np.zeros(len(total), dtype=np.int64)
        begin[terms] = np.cumsum(counts) - counts
        keys = (np.repeat(terms.astype(np.int64), counts) << 32) | posts
        rarest = windows[np.arange(len(windows)), order[:, 0]]
        live = np.flatnonzero((have[rarest] > 0) & np.all((windows < 0) | (have[windows] > 0), axis=1))
        while len(live):
            some = live[: max(1, int(np.searchsorted(np.cumsum(have[rarest[live]]), CANDIDATES, side="right")))]
            live = live[len(some):]
            n = have[rarest[some]]
            w = np.repeat(some, n)
            s = posts[np.repeat(begin[rarest[some]] - (np.cumsum(n) - n), n) + np.arange(len(w))] - order[w, 0]
            d = np.searchsorted(first, np.maximum(s, 0), side="right") - 1
            ok = (s >= 0) & (s + length[w] <= first[np.minimum(d + 1, len(first) - 1)])
            w, s, d = w[ok], s[ok], d[ok]
            for r in range(1, windows.shape[1]):
                if not len(w):
                    break
                place, asked = order[w, r], r < length[w]
                t = windows[w, place]
                at = np.maximum(s + place - slop, first[d])
                i = np.searchsorted(keys, (t << 32) | at)
                near = np.where(i < len(keys), keys[np.minimum(i, len(keys) - 1)], -1)
                ok = ~asked | (near >= 0) & (near >> 32 == t) & ((near & 0xFFFFFFFF) <= np.minimum(s + place + slop, first[d + 1] - 1))
                w, s, d = w[ok], s[ok], d[ok]
            yield w, s, d

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = [[] for _ in range(6)]
        for ids, vs, first, terms, counts, posts in zip(*(b.column(i) for i in range(6))):
            first, terms, counts = (np.array(x.values, dtype=np.int64) for x in (first, terms, counts))
            p = np.frombuffer(zstandard.ZstdDecompressor().decompress(posts.as_py()), dtype="<u4").astype(np.int64)
            found = list(starts(first, terms, counts, p)) if len(windows) and len(p) else []
            w, s, d = (np.concatenate([f[i] for f in found]) if found else np.empty(0, dtype=np.int64) for i in range(3))
            n_docs = len(first) - 1
            lo, hi, named = ([[] for _ in range(n_docs)] for _ in range(3))
            for x in np.unique(d):
                mine = d == x
                lo[x], hi[x] = s[mine] - first[x], s[mine] - first[x] + length[w[mine]]
                named[x] = sorted({items[i] for i in np.unique(w[mine])} - {None})
            for c, v in zip(cols, (np.array(ids.values), np.array(vs.values), np.diff(first), lo, hi, named)):
                c.extend(v)
        return batch(id=pa.array(cols[0], pa.int64()), v=pa.array(cols[1], pa.int64()), n_words=pa.array(cols[2], pa.int64()),
                     hit_from=pa.array(cols[3], pa.list_(pa.int32())), hit_to=pa.array(cols[4], pa.list_(pa.int32())), items=pa.array(cols[5], pa.list_(pa.string())))

    return mapped(index, run, MATCHES, "postings")


def matches(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document row with its key, number of words, matched word ranges and items."""
    found = []
    for rows in test_blocks(benchmark, block_bytes):
        tests = TestSet.of(rows, k)
        found.append(search(written(build_index(docs, tests), "postings"), tests, slop))
    if len(found) == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("hit_from", "hit_to")]
    merged = every.groupBy("id", "v").agg(F.max("n_words").alias("n_words"), *lists, F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return keyed(docs).select("id", "v").join(merged, ["id", "v"])  # one row for each test block and document met above


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the key (id, v)."""

    def digest(b: pa.RecordBatch) -> pa.RecordBatch:
        n = ints(b.column(2))
        names = b.column(5).to_pylist()
        hit = [int(covered(int(m), np.array(lo.values), np.array(hi.values)).sum()) if len(lo) else 0 for m, lo, hi in zip(n, b.column(3), b.column(4))]
        return batch(id=b.column(0), v=b.column(1), n_words=b.column(2), n_hit=pa.array(hit, pa.int64()), n_items=pa.array([len(x) for x in names], pa.int64()),
                     items_sha256=pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()))

    found = matches(docs, benchmark, k, slop, block_bytes)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield digest(b)

    out = found.mapInArrow(tidy(run), "id bigint, v bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")
    return out.select(id_back().alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "id", "v")
