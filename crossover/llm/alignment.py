"""Alignment of two tokenizers over the bytes of each document, and of their ids over the corpus.

The places where tokens of A and of B both end cut a text into groups. A stretch of tokens is a :class:`Fragment`: an open prefix, closed
groups and an open suffix. Fragments compose associatively, so a long document is cut at byte ranges wherever they fall, each range is
tokenised and turned into a fragment by a task of its own, and a tree of shuffles puts the fragments together. A short document is the
composition of the fragments of its pieces; each different piece is tokenised once by a process (``PIECES`` bounds what it keeps).

A is byte-level BPE with the usual splitting pattern, B a sentencepiece model with byte fallback. A token of
either never reaches over a single space or line feed between other characters, nor from a letter to a full stop or comma; for B this
is read off its vocabulary, and without it every text goes to the libraries whole.

Blocks of documents (about ``BLOCK_BYTES`` of text) meet the corpus-wide counts twice: a block sends each of its id pairs once, with the
number of its documents that link it, and gets back the counts of these pairs.

Defined cases: a NULL or empty text, and one whose joined token bytes differ from space + text (as U+2581 makes them), has no tokens: zeros
and ''. NULL doc_ids and repeated rows are documents of their own. An empty table gives no rows. Other columns are not read. A text
without any safe place to cut is one range, however long. A group of n and m tokens has n * m links by definition.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crossover.llm.bpe import IRREGULAR, MARK
from crossover.llm.common import CACHES, batch, chunks, groups, id_back, ints, keyed, tidy, written

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_BYTES = 2 << 20
LONG_BYTES, RANGE_BYTES, FAN = 1 << 16, 1 << 15, 8
#: Text of long documents in a task.
TASK_BYTES = 2 << 20
PIECES = 250_000
#: Pieces in a call of the libraries, whose time for a text grows faster than the text.
LEARN = 1000
#: Blocks that a reader holds at once.
GROUP_ROWS = 4
#: An id of B in a pair; A's id stands above it.
B_BITS = 20
SPACE = "▁"


# ---- fragments ----------------------------------------------------------------------------------------------------

@dataclass
class Fragment:
    """Tokens of a byte range: ids of A and of B, and how many of them each group has. The first group is open to the left, the last
    one to the right; with n common ends there are n + 1 groups."""

    a: np.ndarray
    a_sizes: np.ndarray
    b: np.ndarray
    b_sizes: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)

        def sizes(ends: np.ndarray) -> np.ndarray:
            return np.diff(np.searchsorted(ends, common, side="right"), prepend=0, append=len(ends))

        return cls(a, sizes(a_ends), b, sizes(b_ends))

    def __add__(self, other: Fragment) -> Fragment:
        def met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.concatenate([x[:-1], [x[-1] + y[0]], y[1:]])

        return Fragment(np.concatenate([self.a, other.a]), met(self.a_sizes, other.a_sizes),
                        np.concatenate([self.b, other.b]), met(self.b_sizes, other.b_sizes))


EMPTY = Fragment(np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64))


@dataclass
class Units:
    """Closed stretches of tokens: numbers of tokens and groups, the groups as text, and the linked id pairs (CSR)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    text: list[str]
    links: np.ndarray
    first: np.ndarray


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _joined(values: pa.Array, sizes: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values), by)


def units(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, count: np.ndarray) -> Units:
    """Stretches of closed groups, ``count`` groups each, of ``a_sizes`` and ``b_sizes`` tokens."""
    text = pc.binary_join_element_wise(_joined(pc.cast(pa.array(a), pa.string()), a_sizes, ","), _joined(pc.cast(pa.array(b), pa.string()), b_sizes, ","), "|")
    size = a_sizes * b_sizes
    ends = np.concatenate([[0], np.cumsum(size)])
    group = np.repeat(np.arange(len(size)), size)
    within = np.arange(int(ends[-1])) - ends[group]
    a_first, b_first = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    links = a[a_first[group] + within // b_sizes[group]].astype(np.int64) << B_BITS | b[b_first[group] + within % b_sizes[group]]
    cuts = np.concatenate([[0], np.cumsum(count)])

    def totals(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x)])[cuts])

    return Units(totals(a_sizes), totals(b_sizes), count, _joined(text, count, ";").to_numpy(zero_copy_only=False).tolist(), links, ends[cuts])


# ---- tokenizers ---------------------------------------------------------------------------------------------------

class Pair:
    """Both tokenizers, the byte length of every token, and a bounded table of the units of known pieces."""

    def __init__(self, path_a: str, path_b: str, kept: int = PIECES):
        self.b, self.kept = sentencepiece.SentencePieceProcessor(model_file=path_b), kept
        self.a_bytes, self.encode_a = byte_level(path_a)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode() for p in pieces]
        self.a_len, self.b_len = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.cuts = not any("\n" in p or re.search(r"[^\W\d_][.,]", p) and not re.search(r"[²³¹⁰-₟][.,]", p)
                            or SPACE in p[1:] and p.strip(SPACE) for p in pieces)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.numbers: list[np.ndarray] = []  # n_a, n_b, n_groups of each lot of pieces
        self.lots: list[np.ndarray] = []  # their links
        self.first: list[np.ndarray] = []
        self.total = 0

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B of space + text; None where the bytes of either are not those of the text."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for t, x, y in zip(texts, self.encode_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1)):
            want = (" " + t).encode()
            same = b"".join(map(self.a_bytes.__getitem__, x)) == want and b"".join(map(self.b_bytes.__getitem__, y)) == want
            out.append((np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)) if same and t else None)
        return out

    def fragment(self, a: np.ndarray, b: np.ndarray, lo: int = -1, hi: int | None = None) -> Fragment:
        """Of the tokens that end beyond byte ``lo`` and not beyond ``hi``."""
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        if hi is not None:
            (i, j), (k, m) = (np.searchsorted(e, [lo, hi], side="right") for e in (a_ends, b_ends))
            a, a_ends, b, b_ends = a[i:j], a_ends[i:j], b[k:m], b_ends[k:m]
        return Fragment.of(a, a_ends, b, b_ends)

    def _learn(self, pieces: list[str]) -> None:
        """Units of new pieces out of one call. Pieces open with a line feed, with MARK (then they follow a letter), or else with the
        space before them; ``x`` and the letter before a mark are left out again."""
        before = ["x" if p[0] == MARK else "" for p in pieces]
        bodies = [p[1:] if p[0] == MARK else p if p[0] == "\n" else " " + p for p in pieces]
        joined = "x" + "".join(f" {x}{p}" if x else p for x, p in zip(before, bodies))
        size = np.array([len(p.encode()) for p in bodies], dtype=np.int64)
        skipped = np.array([2 * len(x) for x in before], dtype=np.int64)
        hi = 2 + np.cumsum(size + skipped)
        lo = hi - size
        ids = self.encode([joined])[0]
        if ids is None:  # a piece that B can't give back; found one by one
            ok = np.array([SPACE not in p for p in pieces])
            if ok.all():
                raise ValueError("B does not give back what it was given")
            bad = [p for p, o in zip(pieces, ok) if not o]
            self._add(bad, Units(*(np.full(len(bad), -1, dtype=np.int64) for _ in range(3)), [""] * len(bad), np.empty(0, np.int64), np.zeros(len(bad) + 1, np.int64)))
            good = [p for p, o in zip(pieces, ok) if o]
            if good:
                self._learn(good)
            return
        a, b = ids
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])

        def kept(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            piece = np.searchsorted(hi, ends, side="left")
            mine = (ends > lo[np.minimum(piece, len(hi) - 1)]) & (ends > 2)
            return x[mine], ends[mine]

        a, a_ends = kept(a, a_ends)
        b, b_ends = kept(b, b_ends)
        f = Fragment.of(a, a_ends, b, b_ends)
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        count = np.diff(np.searchsorted(common, hi, side="right"), prepend=0)
        self._add(pieces, units(f.a, f.a_sizes[:-1], f.b, f.b_sizes[:-1], count))

    def _add(self, pieces: list[str], u: Units) -> None:
        n = len(self.known)
        self.known.update(zip(pieces, range(n, n + len(pieces))))
        self.text.extend(u.text)
        self.numbers.append(np.stack([u.n_a, u.n_b, u.n_groups]))
        self.lots.append(u.links)
        self.first.append(self.total + u.first[:-1])
        self.total += len(u.links)

    def places(self, pieces: list[str]) -> np.ndarray:
        """Where the units of ``pieces`` stand, after learning the new ones."""
        if len(self.known) > self.kept:
            again = [p for p in pieces if p in self.known]
            us = self.taken(np.array([self.known[p] for p in again], dtype=np.int64))
            self._clear()
            self._add(again, us)
        new = [p for p in pieces if p not in self.known]
        if new:
            for lo in range(0, len(new), LEARN):
                self._learn(new[lo : lo + LEARN])
        return np.array([self.known[p] for p in pieces], dtype=np.int64)

    def taken(self, place: np.ndarray) -> Units:
        if len(self.lots) > 1:
            self.numbers = [np.concatenate(self.numbers, axis=1)]
            self.lots, self.first = [np.concatenate(self.lots)], [np.concatenate(self.first)]
        numbers = self.numbers[0][:, place]
        first = np.append(self.first[0], self.total)
        size = first[place + 1] - first[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(first[place] - ends[:-1], size) + np.arange(int(ends[-1]))
        return Units(*numbers, [self.text[i] for i in place.tolist()], self.lots[0][at], ends)


def byte_level(path: str) -> tuple[list[bytes], Callable[[list[str]], list[list[int]]]]:
    """Bytes of every token of a byte-level vocabulary file, and an encoder of texts.

    Where ids number the merges in their order, as is usual, ranks say the same as merges, and the quicker library applies them.
    """
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True  # their strings in a text are ordinary text
    letters = {c: i for i, c in _byte_letters().items()}
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    names = [model.id_to_token(i) or "" for i in range(model.get_vocab_size())]
    tokens = [bytes(letters.get(c, 63) for c in n) for n in names]
    vocabulary = content["model"]["vocab"]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in content["model"]["merges"]]
    single = {n for n in names if len(n) == 1 and n in vocabulary}
    before = content.get("pre_tokenizer") or {}
    ranked = ([vocabulary.get(n) for n in made] == list(range(256, 256 + len(made))) and {vocabulary[n] for n in single} == set(range(256))
              and (before.get("type"), before.get("use_regex"), before.get("add_prefix_space"), content.get("normalizer")) == ("ByteLevel", True, False, None))
    if ranked:
        ranks = {tokens[i]: i for i in range(256 + len(made))}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return tokens, lambda texts: [quick.encode_ordinary(t) for t in texts]
    return tokens, lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters for themselves, the others, in
    order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in set(plain)]
    return {i: chr(i) for i in plain} | {i: chr(256 + n) for n, i in enumerate(rest)}


_PAIRS: dict[tuple[str, str], Pair] = {}
CACHES.append(_PAIRS)


def pair(path_a: str | None = None, path_b: str | None = None) -> Pair:
    key = (path_a or public_tokenizers.path(TOKENIZER_A), path_b or public_tokenizers.path(TOKENIZER_B))
    if key not in _PAIRS:
        _PAIRS[key] = Pair(*key)
    return _PAIRS[key]


# ---- blocks of documents ------------------------------------------------------------------------------------------

#: A block: its documents with their figures and units, its units with their pairs (places in ``pairs``), and in how many documents each pair is.
BLOCK = ("block bigint, id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, "
         "doc_units array<int>, doc_sizes array<int>, unit_links array<int>, unit_sizes array<int>, pairs array<bigint>, docs array<int>")


def _block(number: int, ids: np.ndarray, us: Units, doc_units: np.ndarray, doc_sizes: np.ndarray) -> pa.RecordBatch:
    """``doc_units`` are places in ``us``, document after document."""
    cuts = np.concatenate([[0], np.cumsum(doc_sizes)])

    def totals(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(x[doc_units])])[cuts])

    text = _joined(pa.array(us.text, pa.large_string()).take(pa.array(doc_units)).cast(pa.string()), doc_sizes, ";").to_pylist()
    sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in text]
    unit_sizes = np.diff(us.first)
    pairs, unit_links = np.unique(us.links, return_inverse=True)
    # Distinct (document, unit), then distinct (document, pair).
    owner = np.repeat(np.arange(len(doc_sizes)), doc_sizes)
    once = distinct(owner * max(len(unit_sizes), 1) + doc_units)
    doc, unit = once // max(len(unit_sizes), 1), once % max(len(unit_sizes), 1)
    size = unit_sizes[unit]
    ends = np.cumsum(size)
    link = unit_links[np.repeat(us.first[unit] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    seen = distinct(np.repeat(doc, size) * max(len(pairs), 1) + link) % max(len(pairs), 1)
    docs = np.bincount(seen, minlength=len(pairs))

    def one(x, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))

    long, small = pa.int64(), pa.int32()
    return batch(block=pa.array([number], long), id=one(ids, long), n_a=one(totals(us.n_a), long), n_b=one(totals(us.n_b), long),
                 n_groups=one(totals(us.n_groups), long), n_links=one(totals(unit_sizes), long), sha=one(sha, pa.string()), doc_units=one(doc_units, small),
                 doc_sizes=one(doc_sizes, small), unit_links=one(unit_links, small), unit_sizes=one(unit_sizes, small), pairs=one(pairs, long), docs=one(docs, small))


def _stacked(parts: list[Units]) -> Units:
    offsets = np.cumsum([0] + [len(p.links) for p in parts])
    return Units(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("n_a", "n_b", "n_groups")), [t for p in parts for t in p.text],
                 np.concatenate([p.links for p in parts]), np.concatenate([*(o + p.first[:-1] for o, p in zip(offsets, parts)), offsets[-1:]]))


def _closed(fragments: list[Fragment]) -> Units:
    """Whole documents as a unit each: nothing is open at their ends."""
    a_sizes, b_sizes = [f.a_sizes[:-1] for f in fragments], [f.b_sizes[:-1] for f in fragments]
    return units(*(np.concatenate(x) if x else np.empty(0, np.int64) for x in ([f.a for f in fragments], a_sizes, [f.b for f in fragments], b_sizes)),
                 np.array([len(x) for x in a_sizes], dtype=np.int64))


def _number(kind: int, n: int) -> int:
    context = TaskContext.get()
    return kind << 62 | (context.partitionId() if context else 0) << 32 | n


def short_block(number: int, ids: np.ndarray, texts: pa.Array, both: Pair) -> pa.RecordBatch:
    """Documents of one chunk. Regular texts are made of pieces; the rest go through the tokenizers whole."""
    texts = pc.fill_null(texts, "")
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(bool)
    odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False).astype(bool) if both.cuts else ~empty
    plain = np.flatnonzero(~odd & ~empty)
    parts, doc_units = [], [np.empty(0, np.int64)] * len(texts)
    known = 0
    if len(plain):
        body = pc.replace_substring_regex(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), r"(\pL)([.,])", rf"\1 {MARK}\2")
        lists = pc.split_pattern(body, " ")
        coded = lists.flatten().dictionary_encode()
        us = both.taken(both.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        known = len(us.n_a)
        flat, cuts = coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        lost = np.flatnonzero(us.n_a < 0)
        good = ~np.isin(np.repeat(np.arange(len(plain)), np.diff(cuts)), np.unique(np.repeat(np.arange(len(plain)), np.diff(cuts))[np.isin(flat, lost)])) if len(lost) else None
        for n, (i, lo, hi) in enumerate(zip(plain, cuts, cuts[1:])):
            if good is None or good[lo]:
                doc_units[i] = flat[lo:hi]
        parts.append(us)
    whole = np.flatnonzero(odd & ~empty)
    if len(whole):
        done = [(i, x) for i, x in zip(whole, both.encode(texts.take(pa.array(whole)).to_pylist())) if x is not None]
        if done:
            parts.append(_closed([both.fragment(*x) for _, x in done]))
            for n, (i, _) in enumerate(done):
                doc_units[i] = np.array([known + n])
    us = _stacked(parts) if parts else units(*(np.empty(0, np.int64),) * 5)
    return _block(number, ids, us, np.concatenate(doc_units).astype(np.int64), np.array([len(x) for x in doc_units], dtype=np.int64))


def _short(docs: DataFrame, paths: tuple) -> DataFrame:
    def run(batches):
        for n, t in enumerate(chunks(batches, limit=BLOCK_BYTES)):
            yield short_block(_number(0, n), t["id"].to_numpy(), t["text"].combine_chunks(), pair(*paths))

    return docs.select("id", "text").mapInArrow(tidy(run), BLOCK)


# ---- long documents -----------------------------------------------------------------------------------------------

RANGE = "row bigint, id bigint, no bigint, lo bigint, hi bigint, at bigint, data binary"
FRAGMENT = "row bigint, id bigint, no bigint, a array<int>, a_sizes array<int>, b array<int>, b_sizes array<int>, ok boolean"
_GRAPH = np.array([33 <= c < 127 for c in range(256)])


def ranges(text: bytes, size: int = RANGE_BYTES, cuts: bool = True) -> list[tuple[int, int, int, int]]:
    """Byte ranges (lo, hi) of a text that cover it, and around each the stretch (at, end) that tokenises like the whole.

    Safe places are single spaces between visible ASCII characters. Where the next one is far, a range goes on to it.
    """
    a = np.frombuffer(text, dtype=np.uint8)
    safe = np.flatnonzero((a[1:-1] == 32) & _GRAPH[a[:-2]] & _GRAPH[a[2:]]) + 1 if cuts and len(a) > 2 else np.empty(0, np.int64)
    safe = np.concatenate([[0], safe, [len(a)]])
    out, lo = [], 0
    while lo < len(a):
        hi = min(lo + size, len(a))
        end = int(safe[np.searchsorted(safe, hi)])
        if end - hi > size:
            hi = end
        out.append((lo, hi, int(safe[np.searchsorted(safe, lo, side="right") - 1]), end))
        lo = hi
    return out


def _long(docs: DataFrame, paths: tuple, size: int, fan: int) -> DataFrame:
    def cut(batches):
        both, n = pair(*paths), 0
        for b in batches:
            for i, t in zip(ints(b.column(0)).tolist(), b.column(1)):
                text = b" " + t.as_py().encode()
                for no, (lo, hi, at, end) in enumerate(ranges(text, size, both.cuts)):
                    yield batch(row=pa.array([_number(0, n)], pa.int64()), id=pa.array([i], pa.int64()), no=pa.array([no], pa.int64()), lo=pa.array([lo], pa.int64()),
                                hi=pa.array([hi], pa.int64()), at=pa.array([at], pa.int64()), data=pa.array([text[at:end]], pa.binary()))
                n += 1

    def rows(found: list[tuple], kind=pa.int32()):
        return batch(row=pa.array([x[0] for x in found], pa.int64()), id=pa.array([x[1] for x in found], pa.int64()), no=pa.array([x[2] for x in found], pa.int64()),
                     **{n: pa.array([getattr(x[3], n) for x in found], pa.list_(kind)) for n in ("a", "a_sizes", "b", "b_sizes")}, ok=pa.array([x[4] for x in found], pa.bool_()))

    def tokenise(batches):
        both = pair(*paths)
        for b in batches:
            for row, i, no, lo, hi, at, data in zip(*(c.to_pylist() for c in b.columns)):
                ids = both.encode([data[1:].decode()])[0]
                f = both.fragment(*ids, lo - at, hi - at) if ids else EMPTY
                yield rows([(row, i, no, f, ids is not None)])

    def composed(batches):
        for g in groups(batches, "slot"):
            # A slot is a hash of (row, no): sorted rows tell documents apart.
            found: dict[tuple, tuple] = {}
            for row, i, no, a, a_sizes, b, b_sizes, ok, _ in zip(*(c.to_pylist() for c in g.columns)):
                f = Fragment(*(np.array(x, dtype=np.int64) for x in (a, a_sizes, b, b_sizes)))
                key = (row, no // fan)
                was = found.get(key)
                found[key] = (row, i, no // fan, was[3] + f, was[4] and ok) if was else (row, i, no // fan, f, ok)
            for x in found.values():
                yield rows([x])

    def blocks(batches):
        held, size, n = [], 0, 0
        for b in batches:
            for _, i, _, a, a_sizes, bb, b_sizes, ok in zip(*(c.to_pylist() for c in b.columns)):
                held.append((i, Fragment(*(np.array(x, dtype=np.int64) for x in (a, a_sizes, bb, b_sizes))) if ok else None))
                size += 4 * len(a)
                if size >= BLOCK_BYTES:
                    yield flushed(n, held)
                    held, size, n = [], 0, n + 1
        if held:
            yield flushed(n, held)

    def flushed(n: int, held: list) -> pa.RecordBatch:
        whole = [f for _, f in held if f is not None]
        sizes = np.array([f is not None for _, f in held], dtype=np.int64)
        return _block(_number(1, n), np.array([i for i, _ in held], dtype=np.int64), _closed(whole), np.arange(len(whole)), sizes)

    parts = written(docs.select("id", "text").mapInArrow(tidy(cut), RANGE), "ranges")
    most, total = parts.agg(F.max("no"), F.sum(F.length("data"))).first()
    if most is None:
        return parts.sparkSession.createDataFrame([], BLOCK)
    tasks = -(-total // TASK_BYTES)
    now = parts.repartition(tasks, "row", "no").mapInArrow(tidy(tokenise), FRAGMENT)
    while most > 0:
        slot = F.xxhash64("row", F.floor(F.col("no") / fan))
        now = now.withColumn("slot", slot).repartition(tasks, "slot").sortWithinPartitions("slot", "row", "no").mapInArrow(tidy(composed), FRAGMENT)
        most //= fan
    return now.mapInArrow(tidy(blocks), BLOCK)


# ---- counts over the corpus ---------------------------------------------------------------------------------------

REPORT = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def blocks_of(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, long_bytes: int = LONG_BYTES, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> DataFrame:
    """All documents, aligned, as a table of blocks."""
    rows, paths = keyed(docs), (path_a, path_b)
    is_long = F.octet_length("text") > long_bytes
    return written(_short(rows.where(~F.coalesce(is_long, F.lit(False))), paths).unionByName(_long(rows.where(is_long), paths, range_bytes, fan)), "alignment", GROUP_ROWS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """How many documents link each id pair: pair, a, b, n, and whether no other pair of its A id has more. An A id has at most as many
    pairs as B has ids."""
    asked = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counted = asked.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    counted = counted.withColumn("a", F.shiftright("pair", B_BITS)).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1)))
    most = counted.groupBy("a").agg(F.max("n").alias("most"))
    return counted.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, **options) -> DataFrame:
    """One row per document: tokens, groups, links, and how its links stand in the corpus."""
    blocks = blocks_of(docs, **options)
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    told = asked.join(pair_counts(blocks), "pair").select("block", F.struct("pair", (F.col("n") * 2 + F.col("best").cast("long")).alias("c")).alias("s"))
    told = told.groupBy("block").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["c"]).alias("counts"))  # as many as the block has pairs

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                v = {n: ints(b.column(i)[r].values) if n != "sha" and b.column(i)[r].values is not None else b.column(i)[r].values
                     for i, n in enumerate(b.schema.names) if n != "block"}
                counts = v["counts"] if v["counts"] is not None else np.empty(0, np.int64)

                def sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
                    return np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(size)])])

                of_links = (counts >> 1)[v["unit_links"]], (counts & 1)[v["unit_links"]]
                total, best = (sums(sums(x, v["unit_sizes"])[v["doc_units"]], v["doc_sizes"]) for x in of_links)
                yield batch(**{n: v[n] for n in ("id", "n_a", "n_b", "n_groups", "n_links")}, n_best=best, count_sum=total, groups_sha256=v["sha"])

    fields = [f.split()[0] for f in BLOCK.split(", ") if f.split()[0] not in ("pairs", "docs")]
    out = blocks.select(*fields).join(told, "block", "left").mapInArrow(tidy(run), REPORT)
    return out.select(id_back().alias("doc_id"), *[n.split()[0] for n in REPORT.split(", ")[1:]])
