"""Frequent phrases of each language, scored by how much more often their words come together than their parts would by chance.

Rabin-Karp fingerprints, level by level: within a block of text the fingerprints of all n-grams of one length come from numpy prefix
polynomials over word hashes. A block sends each of its different n-grams once, as sorted runs of fingerprints and counts; block and place in
its order are the pointer to an occurrence. Tasks merge the runs of a range of fingerprints and let those through that reach the least
count over all blocks. Their pointers return to the blocks, which cut their text down to the stretches whose n-grams are all frequent; only
these hold longer ones. Of all blocks with a frequent n-gram the first one writes its words.

Collisions: within a block n-grams with one fingerprint are compared word by word. Between blocks every block adds up, over its frequent
n-grams, a second hash of their words times a hash of the fingerprint, and the block that writes the words takes off as much for all
of them. Unless this comes to nothing, some words differ, and the level is counted again by the words themselves, in every block.

Defined cases: a NULL or empty text has no words; a NULL lang is ``und``; repeated rows and NULL doc_ids count as documents of their own;
an empty table gives no rows. Other columns are not read. A text is never cut into blocks; a longer one is a block.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crossover.llm.common import batch, chunks, groups, texts_of, tidy, written
from crossover.llm.words import LOWER, U, mix, range_hashes

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
BLOCK_BYTES = 16 << 20
#: Blocks that a reader holds at once.
GROUP_ROWS = 4
#: Fingerprints that a task merges at once, and their bits.
SLOT_ROWS, BITS = 2_000_000, 56
#: ``ids`` (see :func:`packed`) are places in ``words``; ``size`` is their number.
BLOCK = "block bigint, lang string, n bigint, words array<binary>, size bigint, ids binary"
#: A run: the fingerprints of a block in one slot, from place ``first`` of its order on.
RUN = "slot int, block bigint, first int, prints binary, counts binary"
#: Frequent places of a block's order; of those that it writes, their counts over all blocks and the number of these.
FOUND = "block bigint, hits binary, spoken binary, totals binary, holders binary"
#: What a level leaves: the block cut down for the next one, the phrases of this one, and the block's part of the check for collisions.
LEVEL = BLOCK + ", phrases array<binary>, counts array<bigint>, residue bigint"
_PRINT, _CHECK = U(0xD1342543DE82EF95), U(0xA0761D6478BD642F)
_BREAK, _SPACE = (np.array([chr(c) in s for c in range(256)]) for s in (".,;:!?\n\x0b\x0c\r", " \t"))


# ---- text to word ids ---------------------------------------------------------------------------------------------

def word_ids(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The different words of texts, and all texts as places in them; -1 parts the pieces."""
    buf = b"\n".join(texts).translate(LOWER) + b"\n"
    a = np.frombuffer(buf, dtype=np.uint8)
    cut = _BREAK[a]
    inside = ~(cut | _SPACE[a])
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return pa.array([], pa.binary()), np.empty(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])]).dictionary_encode()
    breaks = np.cumsum(cut, dtype=np.int32)[starts]
    places = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(breaks[1:] != breaks[:-1])])
    ids = np.full(int(places[-1]) + 1, -1, dtype=np.int32)
    code = words.indices.to_numpy()
    common = np.argsort(-np.bincount(code), kind="stable")  # small numbers for common words take less room
    rank = np.empty(len(common), dtype=np.int32)
    rank[common] = np.arange(len(common), dtype=np.int32)
    ids[places] = rank[code]
    return words.dictionary.take(pa.array(common)), ids


def packed(ids: np.ndarray) -> bytes:
    """Ids (from -1 on) as planes of bytes, the lowest first."""
    return np.ascontiguousarray((ids + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int32) - 1


def blocks_of(docs: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """The corpus as blocks of one language each, in order of rows."""
    def run(batches):
        for number, t in enumerate(chunks(batches, limit=limit)):
            langs = t["lang"].combine_chunks().dictionary_encode()
            code = langs.indices.to_numpy()
            for c, lang in enumerate(langs.dictionary.to_pylist()):
                words, ids = word_ids(texts_of(t["text"].combine_chunks().take(pa.array(np.flatnonzero(code == c)))))
                if len(ids):
                    yield batch(block=pa.array([_number(number, c)], pa.int64()), lang=pa.array([lang]), n=pa.array([int((ids >= 0).sum())], pa.int64()),
                                words=_one(words, pa.binary()), size=pa.array([len(ids)], pa.int64()), ids=pa.array([packed(ids)], pa.binary()))

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(tidy(run), BLOCK), "phrases-1", GROUP_ROWS)


def _number(chunk: int, lang: int) -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40 | chunk << 20 | lang


def _one(values, kind: pa.DataType) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


# ---- one level ----------------------------------------------------------------------------------------------------

def word_hashes(words: pa.Array, base: np.uint64) -> np.ndarray:
    """64-bit hashes of words, the same in every block."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] else np.empty(0, np.uint8)
    lo, hi = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    out = np.empty(len(words), dtype=np.uint64)
    w, values = 0, mix(data[offsets[0] : offsets[-1]].astype(np.uint64) + base)
    while w < len(words):  # in parts, so that powers of the base need little room
        end = max(w + 1, int(np.searchsorted(hi, lo[w] + (1 << 20), side="right")))
        out[w:end] = range_hashes(values[lo[w] : hi[end - 1]], lo[w:end] - lo[w], hi[w:end] - lo[w], base)
        w = end
    return mix(out + (hi - lo).astype(np.uint64))


def ngrams(words: pa.Array, ids: np.ndarray, k: int, lang: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Start and fingerprint of every n-gram of ``k`` words that crosses no break."""
    broken = np.concatenate([[0], np.cumsum(ids < 0, dtype=np.int32)])
    at = np.flatnonzero(broken[k:] == broken[:-k]) if len(ids) >= k else np.empty(0, np.int64)
    seed = mix(np.array([int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little") + k], dtype=np.uint64))
    values = word_hashes(words, _PRINT)[ids] if len(ids) else np.empty(0, np.uint64)  # a break's value is never within an n-gram
    out, part = np.empty(len(at), dtype=np.uint64), 1 << 19
    for lo in range(0, len(ids), part):
        mine = slice(*np.searchsorted(at, [lo, lo + part]))
        out[mine] = range_hashes(values[lo : lo + part + k], at[mine] - lo, at[mine] - lo + k, _PRINT)
    return at, mix(out ^ seed) >> U(64 - bits)


def checks(words: pa.Array, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """A second hash of the words of n-grams, by another base and word by word."""
    values, out = word_hashes(words, _CHECK), np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        out = mix(out * _CHECK + values[ids[at + j]])
    return out


def distinct(ids: np.ndarray, at: np.ndarray, prints: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams at ``at`` by fingerprint: fingerprint, one place, count; and for each of ``at`` which of them it is. Those
    with one fingerprint are told apart by their words."""
    order = np.argsort(prints, kind="stable")
    p = prints[order]
    fresh = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.empty(0, bool)
    first = np.flatnonzero(fresh)
    places, n = at[order], np.diff(np.append(first, len(p)))
    group = np.cumsum(fresh) - 1
    which = np.empty(len(at), dtype=np.int64)
    which[order] = group
    like = np.repeat(places[first], n)
    same = np.ones(len(p), dtype=bool)
    for j in range(k):
        same &= ids[places + j] == ids[like + j]
    if same.all():
        return p[first], places[first], n, which
    found: dict[tuple, list] = {}
    for i in np.flatnonzero(~same).tolist():
        found.setdefault((int(group[i]), *ids[places[i] : places[i] + k].tolist()), []).append(i)
    more = list(found.values())
    for g, members in enumerate(more):
        which[order[members]] = len(first) + g
    prints, places = np.concatenate([p[first], p[[m[0] for m in more]]]), np.concatenate([places[first], places[[m[0] for m in more]]])
    n = np.bincount(which, minlength=len(prints))
    again = np.argsort(prints, kind="stable")
    rank = np.empty(len(again), dtype=np.int64)
    rank[again] = np.arange(len(again))
    return prints[again], places[again], n[again], rank[which]


def squeezed(values: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the largest needs, after that number."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    rows = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(-1, data[0])
    out = np.zeros((len(rows), 8), dtype=np.uint8)
    out[:, : data[0]] = rows
    return out.view("<u8").ravel()


def _state(b: pa.RecordBatch):
    """Block, language, words, n of language, ids of each row."""
    names = b.schema.names
    for block, lang, words, n, ids in zip(*(b.column(names.index(c)) for c in ("block", "lang", "words", "n", "ids"))):
        yield block.as_py(), lang.as_py(), words.values, n.as_py(), unpacked(ids.as_py())


def _sent(blocks: DataFrame, k: int, slots: int, bits: int) -> DataFrame:
    """Every different n-gram of every block, in runs."""
    edges = np.array([(i << bits) // slots for i in range(1, slots)], dtype=np.uint64)

    def run(batches):
        for b in batches:
            for block, lang, words, _, ids in _state(b):
                prints, _, n, _ = distinct(ids, *ngrams(words, ids, k, lang, bits), k)
                cuts = np.concatenate([[0], np.searchsorted(prints, edges), [len(prints)]])
                live = np.flatnonzero(np.diff(cuts))
                if len(live):
                    yield batch(slot=pa.array(live, pa.int32()), block=pa.array(np.full(len(live), block), pa.int64()), first=pa.array(cuts[live], pa.int32()),
                                prints=pa.array([_run(prints[cuts[i] : cuts[i + 1]]) for i in live], pa.binary()),
                                counts=pa.array([squeezed(n[cuts[i] : cuts[i + 1]]) for i in live], pa.binary()))

    return blocks.select("block", "lang", "n", "words", "ids").mapInArrow(tidy(run), RUN)


def _run(prints: np.ndarray) -> bytes:
    """Sorted fingerprints: the first, and steps."""
    return int(prints[0]).to_bytes(8, "little") + squeezed(np.diff(prints))


def _prints(data: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1), unsqueezed(data[8:])]), dtype=np.uint64)


def merged(runs: pa.Table, least: int) -> pa.RecordBatch | None:
    """Frequent fingerprints of one slot, told to the blocks of its runs; rows come by block."""
    parts = [_prints(x) for x in runs["prints"].to_pylist()]
    size = np.array([len(x) for x in parts], dtype=np.int64)
    prints, n = np.concatenate(parts), np.concatenate([unsqueezed(x) for x in runs["counts"].to_pylist()]).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), size)
    place = np.arange(len(prints)) - np.repeat(np.cumsum(size) - size - runs["first"].to_numpy(), size)
    order = np.argsort(prints, kind="stable")
    p = prints[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    holders, totals = np.diff(np.append(first, len(p))), np.add.reduceat(n[order], first)
    good = totals >= least
    if not good.any():
        return None
    hit = np.sort(order[np.repeat(good, holders)])
    speaker = order[first[good]]
    by = np.argsort(speaker)
    speaker, totals, holders = speaker[by], totals[good][by], holders[good][by]
    blocks = runs["block"].to_numpy()
    live = np.unique(owner[hit])
    cuts = [np.searchsorted(owner[x], live, side=s) for x in (hit, speaker) for s in ("left", "right")]
    return batch(block=blocks[live], hits=pa.array([place[hit[a:b]].astype("<i4").tobytes() for a, b in zip(*cuts[:2])], pa.binary()),
                 **{name: pa.array([v[a:b].astype(kind).tobytes() for a, b in zip(*cuts[2:])], pa.binary())
                    for name, v, kind in (("spoken", place[speaker], "<i4"), ("totals", totals, "<i8"), ("holders", holders, "<i8"))})


def _frequent(runs: DataFrame, least: int, slots: int) -> DataFrame:
    """Per block its frequent places; a block's lists are as long as its order at most."""
    def run(batches):
        for slot in groups(batches, "slot"):
            out = merged(slot, least)
            if out is not None:
                yield out

    # Sorted by block as well, so that a task that runs again names the same writers.
    kept = runs.repartition(slots, "slot").sortWithinPartitions("slot", "block").mapInArrow(tidy(run), FOUND)
    return kept.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("hits", "spoken", "totals", "holders"))).alias("found"))


def shrunk(ids: np.ndarray, at: np.ndarray, frequent: np.ndarray, k: int) -> np.ndarray:
    """The stretches in which every n-gram is frequent and a longer one has room, parted by -1; ``at`` are all n-grams' starts."""
    starts = at[frequent]
    opens = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1])) if len(starts) else np.empty(0, np.int64)
    lo, size = starts[opens], np.diff(np.append(opens, len(starts)))
    lo, size = lo[size > 1], size[size > 1] + k  # words of the stretch and a break
    ends = np.cumsum(size)
    places = np.repeat(lo - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    out = ids[np.minimum(places, len(ids) - 1)] if len(ids) else ids
    out[ends - 1] = -1
    return out[:-1]


def _advanced(blocks: DataFrame, found: DataFrame, k: int, last: bool, bits: int, by_words: bool = False) -> DataFrame:
    """The next level's blocks, and phrases: those that a block writes, with their counts over all blocks, or ``by_words`` all of its frequent
    ones with their counts in the block."""
    def run(batches):
        for b in batches:
            for (block, lang, words, n, ids), told in zip(_state(b), b.column(b.schema.get_field_index("found"))):
                hits, spoken, totals, holders = (np.concatenate([np.frombuffer(x, kind) for x in told.values.field(i).to_pylist()]) for i, kind in enumerate(("<i4", "<i4", "<i8", "<i8")))
                prints, places, counts, which = distinct(ids, *(at_prints := ngrams(words, ids, k, lang, bits)), k)
                weight = lambda x: (mix(prints[x]) | U(1)) * checks(words, ids, places[x], k)
                residue = weight(hits).sum(dtype=np.uint64, keepdims=True) - (weight(spoken) * holders.astype(np.uint64)).sum(dtype=np.uint64, keepdims=True)
                if by_words:
                    spoken, totals = hits, counts[hits]
                names = _names(words, ids[places[spoken][:, None] + np.arange(k)])
                frequent = np.zeros(len(prints), dtype=bool)
                frequent[hits] = True
                live, rest = (ids[:0], ids[:0]) if last else _fewer(shrunk(ids, at_prints[0], frequent[which], k))
                yield batch(block=pa.array([block], pa.int64()), lang=pa.array([lang]), n=pa.array([n], pa.int64()), words=_one(words.take(pa.array(live)), pa.binary()),
                            size=pa.array([len(rest)], pa.int64()), ids=pa.array([packed(rest)], pa.binary()), phrases=_one(names, pa.binary()),
                            counts=_one(totals, pa.int64()), residue=pa.array(residue.view(np.int64)))

    return blocks.join(found, "block").mapInArrow(tidy(run), LEVEL)


def _names(words: pa.Array, used: np.ndarray) -> list[bytes]:
    live = np.unique(used)
    table = dict(zip(live.tolist(), words.take(pa.array(live)).to_pylist()))
    return [b" ".join(map(table.__getitem__, r)) for r in used.tolist()]


def _fewer(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words still in use, and ``ids`` as places in them."""
    live, back = np.unique(ids, return_inverse=True)
    gap = int(len(live) > 0 and live[0] < 0)
    return live[gap:], (back - gap).astype(np.int32)


# ---- phrases ------------------------------------------------------------------------------------------------------

def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of every phrase of up to ``longest`` words that occurs ``least`` times, and (lang, n), each language's words."""
    blocks = blocks_of(docs, block_bytes)
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = []
    for k in range(1, longest + 1):
        size = blocks.agg(F.sum("size")).first()[0]
        if not size:
            break
        state, slots, last = blocks.where("size > 0").select(*(c.split()[0] for c in BLOCK.split(", "))), -(-size // SLOT_ROWS), k == longest
        found = _frequent(_sent(state, k, slots, bits), least, slots)
        blocks = written(_advanced(state, found, k, last, bits), f"phrases-{k + 1}", GROUP_ROWS)
        residue = blocks.agg(F.sum(F.col("residue").cast("decimal(38,0)"))).first()[0]
        if residue and residue % (1 << 64):
            blocks = written(_advanced(state, found, k, last, bits, by_words=True), f"phrases-{k + 1}", GROUP_ROWS)
        parts.append(blocks.select("lang", F.lit(k).alias("k"), F.explode(F.arrays_zip("phrases", "counts")).alias("p")))
    if not parts:
        return docs.sparkSession.createDataFrame([], "lang string, k int, phrase string, f bigint"), totals
    counted = reduce(DataFrame.unionByName, parts).groupBy("lang", "k", F.col("p.phrases").cast("string").alias("phrase")).agg(F.sum("p.counts").alias("f"))
    return written(counted.where(F.col("f") >= least), "phrases"), totals


def scored(phrases: DataFrame, totals: DataFrame, share: int = 100) -> DataFrame:
    """Candidates (phrases of two words or more) with their lowest-scoring cut, without those that a candidate one word longer holds in
    ``share`` percent of their places. A still longer one that does so has one in between that does."""
    word = F.split("phrase", " ")
    f = phrases.select("lang", "phrase", "f")
    candidates = phrases.where("k > 1")
    inner = candidates.where("k > 2").select("lang", F.col("f").alias("g"), F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("g").alias("g"))
    left = candidates.join(held, ["lang", "phrase"], "left").where(f"g is null or 100 * g < {share} * f").select("lang", "k", "phrase", F.col("f").alias("a"))
    cuts = left.select("*", F.explode(F.expr("sequence(1, k - 1)")).alias("cut")).select(
        "*", F.array_join(F.slice(word, F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice(word, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("tail"))
    both = (cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang"))
    # Decimals of 38 digits: 1000 * a * n and l * r stay exact beyond 64 bits.
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")


def phrase_report(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, block_bytes: int = BLOCK_BYTES, bits: int = BITS) -> DataFrame:
    found = scored(*frequent_phrases(docs, least, longest, block_bytes, bits))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
