"""Plain versions of the operators for small inputs. Rows are (doc_id, text); a NULL doc_id sorts first."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def order(i):
    return -(1 << 63) if i is None else i


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def decontaminate(rows, items, k=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - k + 1) if w else 0):
            windows[tuple(w[i : i + k])].add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in rows:
        w = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        names = sorted({str(x) for x in found if x is not None})
        out.append((doc, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def line_dedup(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(order(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == order(doc)]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def near_sets(rows, k):
    out = []
    for _, text in rows:
        w = words(text, lower=True)
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def near_dedup(rows, k=5):
    sets, ids = near_sets(rows, k), [order(d) for d, _ in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return [(doc, len(s), find(i)) for (doc, _), s, i in zip(rows, sets, ids)]


def substring_dedup(rows, k=20):
    first = {}
    texts = [words(t) for _, t in rows]
    for (doc, text), w in zip(rows, texts):
        for i in range(len(w) - k + 1):
            place = (order(doc), text, i)
            g = tuple(w[i : i + k])
            first[g] = min(first.get(g, place), place)
    out = []
    for (doc, text), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] != (order(doc), text, i):
                gone.update(range(i, i + k))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def tokens(rows, end):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array(t.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4") for _, text in rows]


def crc(ids):
    return zlib.crc32(np.ascontiguousarray(ids).tobytes())


def check_packing(packed, rows, size=1024):
    """``packed``: (doc_id, piece, start, length, crc, sequence, offset). Returns the number of sequences."""
    want = defaultdict(list)
    for (doc, _), ids in zip(rows, tokens(rows, 2)):
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        for n, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[doc].append((n, lo, hi - lo, crc(ids[lo:hi])))
    got, sequences = defaultdict(list), defaultdict(list)
    for doc, piece, start, length, c, sequence, offset in packed:
        got[doc].append((piece, start, length, c))
        sequences[sequence].append((offset, length))
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)
