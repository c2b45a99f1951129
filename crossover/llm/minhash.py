"""Near-dedup with min-max hashing.

Each permutation of the shingle hashes yields two signature values, its minimum and its maximum, so ``PERMUTATIONS`` hash
evaluations give twice as many values for the bands. A band takes ``BAND`` values of different permutations, about half of each
kind. At the threshold of 0.8 a pair misses all bands with a probability of about one in a million.

1. Signatures of whole texts. Documents with equal shingle sets form a class (128-bit digest); its smallest key (id, v) stands for it,
   and it gets a number of its own, as many classes can share an id.
2. Bands that at least two classes share tie each of them to the band's smallest. These ties are not links; their components are
   groups outside of which no link is looked for, so that a set travels once and not once for each band.
3. A group is confirmed on full sets through an index of its shingles that counts intersections exactly. Groups of over ``BLOCK``
   members (or ``BLOCK_SHINGLES`` shingles) are cut into blocks, and each pair of blocks is a unit of its own, so that no task
   holds a group. A unit returns a spanning forest of its links, never all pairs.
4. Components of the links give the smallest key reachable: that document stays.

Defined cases: a NULL or wordless text has an empty set, is linked with nothing and stays; a text of fewer words than a shingle has
them all as one; a NULL doc_id is the smallest id and its component is NULL; rows that share a doc_id (NULL, too)
with other texts are documents of their own, linked only by what they say, and of near copies among them the smallest hash of text
stays; repeated rows share a class, and each is returned; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossover.llm.common import batch, groups, id_back, ints, keyed, mapped, slices, texts_of, tidy, written
from crossover.llm.components import components
from crossover.llm.words import LOWER, U, Words, mix, normal, range_hashes

SHINGLE = 5
THRESHOLD = 80  # in hundredths
PERMUTATIONS = 90
BAND = 5
BLOCK = 256
BLOCK_SHINGLES = 1 << 19

_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(1, 1 << 62, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
_B = _RNG.integers(0, 1 << 62, PERMUTATIONS, dtype=np.uint64)
#: Signature places: minima first, then maxima; a band takes neighbours in an order that alternates between both kinds.
_ORDER = np.concatenate([np.array([i, PERMUTATIONS + (i + PERMUTATIONS // 2) % PERMUTATIONS]) for i in range(PERMUTATIONS)])
BANDS = 2 * PERMUTATIONS // BAND

SIGNATURES = "id bigint, v bigint, n_shingles bigint, digest binary, bands array<bigint>"


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words.of([normal(t, LOWER) for t in texts])
    lo, hi = w.windows(k, whole_if_short=True)
    h = mix(range_hashes(w.hashes(), lo, hi) + (hi - lo).astype(np.uint64))
    at = np.searchsorted(lo, w.first)
    return [np.unique(h[a:b]) for a, b in zip(at, at[1:])]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of the shingles under each permutation."""
    least, most = np.full(PERMUTATIONS, ~U(0)), np.zeros(PERMUTATIONS, dtype=np.uint64)
    for lo in range(0, len(shingles), 2048):
        x = np.multiply.outer(_A, shingles[lo : lo + 2048]) + _B[:, None]
        np.minimum(least, x.min(axis=1), out=least)
        np.maximum(most, x.max(axis=1), out=most)
    return np.concatenate([least, most])


def bands(values: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands; bands never share keys."""
    rows = mix(values[_ORDER]).reshape(BANDS, BAND)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND):
        key = mix(key * U(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(texts_of(b.column(2)), k)
        keys = [bands(signature(s)) if len(s) else np.empty(0, dtype=np.int64) for s in sets]
        return batch(id=b.column(0), v=b.column(1), n_shingles=pa.array([len(s) for s in sets], pa.int64()), digest=pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     bands=pa.array(keys, pa.list_(pa.int64())))

    return mapped(keyed(docs), run, SIGNATURES)


def classes(signed: DataFrame) -> DataFrame:
    """One row for each shingle set: (digest, id, v, n_shingles, bands) of its smallest key, and its number c, which holds once it is written."""
    row = F.min(F.struct("id", "v", "n_shingles", "bands")).alias("r")
    return signed.where("n_shingles > 0").groupBy("digest").agg(row).select("digest", "r.*", F.monotonically_increasing_id().alias("c"))


def ties(reps: DataFrame) -> DataFrame:
    """(a, b): class b shares a band of which class a is the smallest."""
    rows = reps.select(F.explode("bands").alias("band"), "c")
    shared = rows.groupBy("band").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a < z").select("band", "a")
    return rows.join(shared, "band").where("c > a").select("a", F.col("c").alias("b")).distinct()


def units(grouped: DataFrame) -> DataFrame:
    """(unit, side, c) out of (c, n_shingles, component): blocks of a group, and a unit for each pair of its blocks.

    Members get their block by hash, in as many blocks as the group needs; unit ids are hashes of (group, block, block).
    """
    size = grouped.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    need = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    placed = grouped.join(size.select("component", need.alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("c", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), (F.col("block") > F.col("other")).alias("right"),
                        (F.col("block") == F.col("other")).alias("whole"))


def links_of(ids: np.ndarray, sets: list[np.ndarray], right: np.ndarray, whole: bool, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of a unit, confirmed on full sets.

    ``whole``: all members against each other; else left against right. An index of the unit's shingles counts, for one member at
    a time, what it shares with every other; members already connected need no further link.
    """
    n = len(ids)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(ids[0]), int(ids[1]))] if 100 * both >= threshold * (size.sum() - both) else []
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    _, term = np.unique(flat, return_inverse=True)
    begin = np.searchsorted(flat[order], flat[order])  # of each sorted entry's list
    count = np.bincount(term)
    start = np.zeros(len(count), dtype=np.int64)
    start[term[order]] = begin
    posts = owner[order]
    at = np.concatenate([[0], np.cumsum(size)])
    label = np.arange(n)
    out = []
    for x in range(n):
        if not whole and right[x]:
            continue
        t = term[at[x] : at[x + 1]]
        c = count[t]
        shared = np.bincount(posts[np.repeat(start[t] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))], minlength=n)
        fits = 100 * shared >= threshold * (size + size[x] - shared)
        fits[x] = False
        if not whole:
            fits &= right
        for y in np.flatnonzero(fits & (label != label[x])):
            if label[y] != label[x]:
                out.append((int(ids[x]), int(ids[y])))
                label[label == label[y]] = label[x]
    return out


def links(docs: DataFrame, reps: DataFrame, ways: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links between classes, as keys (id, v), that are enough to connect all that are linked."""
    chosen = ways.join(reps.select("c", "id", "v"), "c")
    dealt = keyed(docs).join(chosen, ["id", "v"]).select("id", "v", "text", "unit", "right", "whole").repartition("unit").sortWithinPartitions("unit", "id", "v")

    def shrink(batches):
        """Texts to shingle sets; a document's repeated rows are neighbours, and only the first goes on."""
        last = None
        for b in slices(batches):
            keys = list(zip(*(b.column(i).to_pylist() for i in (0, 1, 3))))
            fresh = [i for i, x in enumerate(keys) if x != (keys[i - 1] if i else last)]
            last = keys[-1]
            if fresh:
                b = b.take(pa.array(fresh))
                sets = shingle_sets(texts_of(b.column(2)), k)
                yield batch(id=b.column(0), v=b.column(1), unit=b.column(3), right=b.column(4), whole=b.column(5), shingles=pa.array([s.tobytes() for s in sets], pa.binary()))

    def run(batches):
        for t in groups(shrink(batches), "unit"):
            sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in t.column("shingles")]
            found = links_of(np.arange(len(sets)), sets, ints(t.column("right")).astype(bool), t.column("whole")[0].as_py(), threshold)
            if found:
                a, b = (np.array(x) for x in zip(*found))
                i, v = ints(t.column("id")), ints(t.column("v"))
                yield batch(a_id=i[a], a_v=v[a], b_id=i[b], b_v=v[b])

    found = dealt.mapInArrow(tidy(run), "a_id bigint, a_v bigint, b_id bigint, b_v bigint")
    return found.select(*(F.struct(F.col(f"{x}_id").alias("id"), F.col(f"{x}_v").alias("v")).alias(x) for x in "ab"))


def near_components(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Per document row: key (id, v), n_shingles, component (the smallest id reachable over links) and kept (its key is the smallest)."""
    signed = written(signatures(docs, k), "signatures")
    reps = written(classes(signed), "classes")
    tied = components(ties(reps), "ties")
    ways = units(reps.select("c", "n_shingles").join(tied.select(F.col("node").alias("c"), "component"), "c"))
    linked = components(links(docs, reps, ways, k, threshold), "links")
    key = F.struct("id", "v")
    named = reps.select("digest", key.alias("node")).join(linked, "node", "left").select("digest", F.coalesce("component", "node").alias("first"))
    # An empty set is a class of none: such a document keeps its own key.
    out = signed.select("id", "v", "n_shingles", "digest").join(named, "digest", "left").withColumn("first", F.coalesce("first", key))
    return out.select("id", "v", "n_shingles", F.col("first.id").alias("component"), (F.col("first") == key).alias("kept"))


def near_report(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    return near_components(docs, k).select(id_back().alias("doc_id"), "n_shingles", id_back("component").alias("component_id"), "kept")
