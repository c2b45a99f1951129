"""Token ids of many texts with a byte-level BPE of the tokenizers library, each different piece of text encoded once.

The vocabulary's splitting pattern never joins what stands before and after a single space or line feed that has non-space on
both sides, nor a letter and the full stop or comma after it. Between such places a text falls into pieces that encode by themselves,
so pieces are told apart by Arrow, new ones are encoded by the library in one call, and all ids are gathered from a table. Texts with
any other white space go to the library whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from crossover.llm.common import CACHES

#: White space next to white space, at an end, or other than a space or a line feed; and text that looks like a special token.
IRREGULAR = (r"[ \n][ \n]|\A[ \n]|[ \n]\z|<\||"
             r"[\x01\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]")
#: Pieces of a table; a process holds two, some 160 bytes a piece.
KEPT_PIECES = 300_000
#: Text per call: the more, the fewer of its pieces are different. A call takes some 40 times its text for a moment.
CALL_BYTES = 2 << 20
#: Text that goes to the library whole, per call: its objects take some 50 times the text.
WHOLE_BYTES = 1 << 19
LEARN = 10_000


MARK = "\x01"


class Table:
    """Ids of known pieces: piece p has pool[begin[known[p]]:begin[known[p] + 1]]."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.pool = np.empty(1 << 18, dtype=np.uint32)
        self.begin = np.zeros(1, dtype=np.int64)

    def add(self, pieces: list[str], ids: np.ndarray, begin: np.ndarray) -> None:
        """``begin``: where in ``ids`` each piece starts."""
        used = int(self.begin[-1])
        while used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[used : used + len(ids)] = ids
        self.begin = np.concatenate([self.begin[:-1], used + begin, [used + len(ids)]])
        n = len(self.known)
        self.known.update(zip(pieces, range(n, n + len(pieces))))

    def places(self, pieces: list[str]) -> np.ndarray:
        get = self.known.get
        return np.array([get(p, -1) for p in pieces], dtype=np.int64)

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and where each ends."""
        size = self.begin[place + 1] - self.begin[place]
        end = np.cumsum(size)
        return self.pool[np.repeat(self.begin[place] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)], end


class PieceEncoder:
    """Encoder with a bounded table of known pieces: when the young one is full it becomes the old one, and what is asked for again returns."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.kept = kept
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.opens = np.array([n[:1] in ("Ġ", "Ċ") for n in names])  # a space or a line feed in the vocabulary's letters
        self.young, self.old = Table(), Table()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Places of new pieces, which open with a line feed, with MARK (then they follow a letter), or else with the space before them."""
        is_marked = np.array([p[0] == MARK for p in pieces])
        order = np.concatenate([np.flatnonzero(~is_marked), np.flatnonzero(is_marked)])
        place = np.empty(len(pieces), dtype=np.int64)
        place[order] = len(self.young.known) + np.arange(len(pieces))
        marked = [p for p in pieces if p[0] == MARK]
        others = [p for p in pieces if p[0] != MARK]
        for lo in range(0, len(others), LEARN):  # the library's own objects for a token take far more room than its id
            some = others[lo : lo + LEARN]
            texts = [p if p[0] == "\n" else " " + p for p in some]
            ids = np.array(self._encode(["".join(texts)])[0], dtype=np.uint32)
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(texts) and at[0] == 0:
                self.young.add(some, ids, at)
            else:  # never seen; then one by one
                self._add_each(some, texts)
        if marked:
            self._add_each(marked, [p[1:] for p in marked])
        return place

    def _add_each(self, pieces: list[str], texts: list[str]) -> None:
        each = self._encode(texts)
        self.young.add(pieces, np.array([i for x in each for i in x], dtype=np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in each])[:-1]]).astype(np.int64))

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds of regular texts."""
        body = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n"), r"(\pL)([.,])", rf"\1 {MARK}\2")
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", body, ""), " ")
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far quicker than by scalars
        if len(self.young.known) > self.kept:
            self.young, self.old = Table(), self.young
        place = self.young.places(pieces)
        missing = np.flatnonzero(place < 0)
        new = [pieces[i] for i in missing.tolist()]
        if new:
            was = self.old.places(new) if self.old.known else np.full(len(new), -1)
            back, lost = np.flatnonzero(was >= 0), np.flatnonzero(was < 0)
            # Places follow each other in the order in which pieces are added.
            if len(back):
                place[missing[back]] = len(self.young.known) + np.arange(len(back))
                ids, end = self.old.ids(was[back])
                self.young.add([new[i] for i in back.tolist()], ids, np.concatenate([[0], end[:-1]]))
            if len(lost):
                place[missing[lost]] = self._learn([new[i] for i in lost.tolist()])
        ids, end = self.young.ids(place[coded.indices.to_numpy()])
        bounds = np.concatenate([[0], end])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return ids, bounds

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; NULL has none."""
        out: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * len(texts)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False).astype(bool)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(bool)
        plain = np.flatnonzero(~odd & ~empty)
        if len(plain):
            ids, at = self._pieces(texts.take(pa.array(plain)))
            for i, lo, hi in zip(plain, at, at[1:]):
                out[i] = ids[lo + 1 : hi]  # the first id is the line feed that was put before the text
        whole = np.flatnonzero(odd)
        if len(whole):
            at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)[whole]) // WHOLE_BYTES
            for some in np.split(whole, np.flatnonzero(np.diff(at)) + 1):
                for i, x in zip(some, self._encode(texts.take(pa.array(some)).to_pylist())):
                    out[i] = np.array(x, dtype=np.uint32)
        return out


_ENCODERS: dict[str, PieceEncoder] = {}
CACHES.append(_ENCODERS)


def encoder(path: str) -> PieceEncoder:
    """This process's encoder; workers are used again, so what it knows carries over to a stage's later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
