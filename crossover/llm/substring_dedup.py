"""Substring dedup by super-k-mer partitioning.

A window is ``k`` consecutive words. Its minimiser is the smallest hash among its runs of ``M`` words. Consecutive windows with one
minimiser travel together, as one packed string of words, to the minimiser's bucket, where sorting brings equal windows together:
all but the first by (doc_id, start) are repeats. Words under a repeat are removed.

Equal super-k-mers of one chunk of a task go as one: the first stands for the rest, which are repeats for certain. A passage that a
third of all documents hold thus sends one string for each chunk. Windows across its edges share its minimisers but not its text;
minimisers with more super-k-mers than a quarter of an average bucket (counted over the whole corpus first) therefore send their
windows one by one to buckets chosen by the whole window. Which ones do is a bit map of fixed size, and never changes the result.

Defined cases: a NULL or wordless text has no words; a text of fewer than ``k`` words keeps all; a NULL doc_id is the smallest id;
rows that share a doc_id with different texts are ordered by a hash of the text; repeated rows of one document count once and get
the same result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossover.llm.common import batch, chunks, groups, id_back, ints, keyed, mapped, texts_of, tidy
from crossover.llm.words import U, Words, covered, mix, normal, range_hashes, sliding_min

K = 20
M = 3
BUCKET_BYTES = 16 << 20
SEND_BYTES = 6 << 20
MIN_BUCKETS = 256
HOT_BITS = 1 << 22

SENT = "bucket bigint, payload binary"
REPEATS = "id bigint, v bigint, lo int, hi int"
HEAD = np.dtype([("id", "<i8"), ("v", "<i8"), ("start", "<i4"), ("size", "<i4")])
DECIDED = np.dtype([("id", "<i8"), ("v", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


class Kmers:
    """Super-k-mers of some texts: windows lo..hi (as words lo:hi + k - 1), their minimiser and text number."""

    def __init__(self, texts: list[bytes], k: int):
        self.k, self.words = k, Words.of(texts)
        self.hashes = self.words.hashes()
        w, _ = self.words.windows(k)
        if not len(w):
            self.lo = self.hi = self.text = np.empty(0, dtype=np.int64)
            self.minimiser = np.empty(0, dtype=np.uint64)
            return
        runs = np.arange(len(self.hashes) - M + 1)
        least = sliding_min(mix(range_hashes(self.hashes, runs, runs + M)), k - M + 1)[w]
        text = self.words.text_of_word()[w]
        cut = np.flatnonzero((least[1:] != least[:-1]) | (text[1:] != text[:-1])) + 1
        at = np.concatenate([[0], cut])
        self.lo, self.hi = w[at], w[np.concatenate([cut, [len(w)]]) - 1] + 1
        self.minimiser, self.text = least[at], text[at]

    def digest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the words of windows lo..hi."""
        end = hi + self.k - 1
        return range_hashes(self.hashes, lo, end), range_hashes(mix(self.hashes + U(1)), lo, end)

    def singly(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """lo, hi, text and bucket hash, with the marked super-k-mers taken apart into windows."""
        n = self.hi[hot] - self.lo[hot]
        lo = np.repeat(self.lo[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        own = mix(range_hashes(self.hashes, lo, lo + self.k))
        cold = ~hot
        return (np.concatenate([self.lo[cold], lo]), np.concatenate([self.hi[cold], lo + 1]), np.concatenate([self.text[cold], np.repeat(self.text[hot], n)]),
                np.concatenate([self.minimiser[cold], own]))


def _first_of_equals(kmers: Kmers, lo, hi, text, ids, vs) -> tuple[np.ndarray, np.ndarray]:
    """Which super-k-mers to send, and which of the others repeat them; a document's own repeated rows are neither."""
    a, b = kmers.digest(lo, hi)
    start = lo - kmers.words.first[text]
    order = np.lexsort((start, vs[text], ids[text], b, a))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    i, v, s = ids[text][order], vs[text][order], start[order]
    again = np.zeros(len(order), dtype=bool)
    again[1:] = same[1:] & (i[1:] == i[:-1]) & (v[1:] == v[:-1]) & (s[1:] == s[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    first_row = (i == i[head]) & (v == v[head]) & (s == s[head])
    return order[~same], order[same & ~again & ~first_row]


def minimiser_counts(docs: DataFrame, k: int = K) -> DataFrame:
    """How many super-k-mers would be sent for each minimiser, over the whole corpus: (m, n)."""

    def run(batches):
        for t in chunks(batches, limit=SEND_BYTES):
            ids, vs = ints(t.column(0)), ints(t.column(1))
            kmers = Kmers([normal(x) for x in texts_of(t.column(2))], k)
            if not len(kmers.lo):
                continue
            sent, _ = _first_of_equals(kmers, kmers.lo, kmers.hi, kmers.text, ids, vs)
            m, n = np.unique(kmers.minimiser[sent], return_counts=True)
            for lo in range(0, len(m), 50_000):
                yield batch(m=m[lo : lo + 50_000].view(np.int64), n=n[lo : lo + 50_000].astype(np.int64))

    return keyed(docs).mapInArrow(tidy(run), "m bigint, n bigint").groupBy("m").agg(F.sum("n").alias("n"))


def hot_map(docs: DataFrame, limit: int, k: int = K) -> np.ndarray:
    """Bit map of HOT_BITS bits, set where a minimiser has more than ``limit`` super-k-mers; at most HOT_BITS / 64 words come here."""
    bit = F.col("m").bitwiseAND(HOT_BITS - 1)
    marks = minimiser_counts(docs, k).where(F.col("n") > limit).select((bit / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(m & 63 as int))").alias("b"))
    out = np.zeros(HOT_BITS // 64, dtype=np.int64)
    for r in marks.groupBy("word").agg(F.bit_or("b").alias("b")).collect():
        out[r.word] = r.b
    return out.view(np.uint64)


def is_hot(minimiser: np.ndarray, marks: np.ndarray) -> np.ndarray:
    bit = minimiser & U(HOT_BITS - 1)
    return (marks[(bit >> U(6)).astype(np.int64)] >> (bit & U(63))) & U(1) == 1


def pack(head: np.ndarray, strings: list[bytes], decided: np.ndarray) -> bytes:
    """Sizes, columns of both tables (ids as differences), and the strings."""
    columns = [t[n] for t in (head, decided) for n in t.dtype.names]
    columns = [np.diff(c, prepend=c.dtype.type(0)) if c.dtype == np.int64 and i % 4 == 0 else c for i, c in enumerate(columns)]
    raw = b"".join([np.array([len(head), len(decided)], dtype="<i8").tobytes(), *(c.tobytes() for c in columns), b"\n".join(strings)])
    return zstandard.ZstdCompressor(level=6).compress(raw)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    sizes, at, tables = np.frombuffer(raw, "<i8", 2), 16, []
    for n, kind in zip(sizes.tolist(), (HEAD, DECIDED)):
        t = np.empty(n, kind)
        for name in kind.names:
            t[name] = np.frombuffer(raw, kind[name], n, at)
            at += n * kind[name].itemsize
        t["id"] = np.cumsum(t["id"])
        tables.append(t)
    return *tables, raw[at:].split(b"\n") if sizes[0] else []


def sent(docs: DataFrame, buckets: int, marks: np.ndarray, k: int = K) -> DataFrame:
    """Packed super-k-mers by bucket, and what a chunk has settled by itself."""

    def run(batches):
        for t in chunks(batches, limit=SEND_BYTES):
            ids, vs = ints(t.column(0)), ints(t.column(1))
            kmers = Kmers([normal(x) for x in texts_of(t.column(2))], k)
            if not len(kmers.lo):
                continue
            lo, hi, text, h = kmers.singly(is_hot(kmers.minimiser, marks))
            go, settled = _first_of_equals(kmers, lo, hi, text, ids, vs)
            w, start = kmers.words, lo - kmers.words.first[text]
            if len(settled):
                d = np.empty(len(settled), DECIDED)
                x = text[settled]
                d["id"], d["v"], d["lo"], d["hi"] = ids[x], vs[x], start[settled], (start + hi - lo)[settled] + k - 1
                yield batch(bucket=[int(mix(np.array([ids[0]]).view(np.uint64))[0] % U(buckets))], payload=[pack(np.empty(0, HEAD), [], d)])
            bucket = (h[go] % U(buckets)).astype(np.int64)
            order = np.lexsort((start[go], text[go], bucket))  # by document within a bucket: ids then differ by little
            go, bucket = go[order], bucket[order]
            head = np.empty(len(go), HEAD)
            head["id"], head["v"], head["start"], head["size"] = ids[text[go]], vs[text[go]], start[go], hi[go] - lo[go]
            a, b = w.starts[lo[go]].tolist(), w.ends[hi[go] + k - 2].tolist()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(go)]
            for p, q in zip(cuts, cuts[1:]):
                yield batch(bucket=bucket[p : p + 1], payload=[pack(head[p:q], [w.buf[x:y] for x, y in zip(a[p:q], b[p:q])], np.empty(0, DECIDED))])

    return keyed(docs).mapInArrow(tidy(run), SENT)


def repeats_of(head: np.ndarray, strings: list[bytes], k: int) -> np.ndarray:
    """Word ranges under windows of a bucket that start earlier elsewhere."""
    w = Words.of(strings)
    hashes = w.hashes()
    at, _ = w.windows(k)
    h = range_hashes(hashes, at, at + k)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    some = order[twice]  # windows whose hash occurs again
    if not len(some):
        return np.empty(0, DECIDED)
    text = w.text_of_word()[at]
    start = head["start"][text] + (at - w.first[text])
    other = range_hashes(mix(hashes + U(1)), at[some], at[some] + k)
    x = text[some]
    order = np.lexsort((start[some], head["v"][x], head["id"][x], other, h[some]))
    some, other = some[order], other[order]
    x = text[some]
    new = np.ones(len(some), dtype=bool)
    new[1:] = (h[some][1:] != h[some][:-1]) | (other[1:] != other[:-1])
    first = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    y = text[first]
    later = (head["id"][x] != head["id"][y]) | (head["v"][x] != head["v"][y]) | (start[some] != start[first])
    flagged = np.sort(some[later])
    if not len(flagged):
        return np.empty(0, DECIDED)
    cut = np.flatnonzero((np.diff(flagged) != 1) | (np.diff(text[flagged]) != 0)) + 1
    lo, hi = flagged[np.concatenate([[0], cut])], flagged[np.concatenate([cut, [len(flagged)]]) - 1]
    out = np.empty(len(lo), DECIDED)
    out["id"], out["v"] = head["id"][text[lo]], head["v"][text[lo]]
    out["lo"], out["hi"] = start[lo], start[hi] + k
    return out


def repeats(packed: DataFrame, k: int = K) -> DataFrame:
    """(id, v, lo, hi): word ranges to remove; a row of ``packed`` is sorted and counted with its bucket."""

    def run(batches):
        for t in groups(batches, "bucket"):
            heads, strings, found = [], [], []
            for p in t.column(1):
                h, d, s = unpack(p.as_py())
                heads.append(h)
                found.append(d)
                strings.extend(s)
            if strings:
                found.append(repeats_of(np.concatenate(heads), strings, k))
            d = np.concatenate(found)
            if len(d):
                yield batch(**{n: np.ascontiguousarray(d[n]) for n in DECIDED.names})

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(run), REPEATS)


def plan_buckets(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[int, int]:
    """How many buckets, and how many super-k-mers a minimiser may send to one. A text travels about three times over."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, 3 * size // bucket_bytes)
    return buckets, max(50, size // 54 // buckets // 4)


def removed(docs: DataFrame, k: int = K) -> DataFrame:
    """(id, v, ranges): for each document with repeats its word ranges, packed as lo * 2**32 + hi."""
    buckets, limit = plan_buckets(docs)
    found = repeats(sent(docs, buckets, hot_map(docs, limit, k), k), k)
    return found.groupBy("id", "v").agg(F.collect_list((F.col("lo").cast("long") * (1 << 32)) + F.col("hi")).alias("ranges"))


def dedup_substrings(docs: DataFrame, k: int = K) -> DataFrame:
    """Per document row: key, n_words, n_removed, kept_sha256 and the kept words joined by single spaces."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t, r in zip(texts_of(b.column(2)), b.column(3)):
            words = t.split()
            if r.is_valid and words:
                x = np.array(r.values)
                gone = covered(len(words), x >> 32, x & 0xFFFFFFFF)
                kept = [words[i] for i in np.flatnonzero(~gone)]
            else:
                kept = words
            text = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text))
        n, gone, sha, text = zip(*rows)
        return batch(id=b.column(0), v=b.column(1), n_words=pa.array(n, pa.int64()), n_removed=pa.array(gone, pa.int64()), kept_sha256=pa.array(sha, pa.string()),
                     text=pa.array(text, pa.binary()).cast(pa.string()))

    return mapped(keyed(docs).join(removed(docs, k), ["id", "v"], "left"), run, "id bigint, v bigint, n_words bigint, n_removed bigint, kept_sha256 string, text string")


def substring_report(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select(id_back().alias("doc_id"), "n_words", "n_removed", "kept_sha256")
