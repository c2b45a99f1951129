"""Simple-8b word-aligned coding of token ids, with escapes.

A 64-bit word holds a selector in its top 4 bits and as many ids of one width as its other 60 bits have room for. Ids come in
blocks of ``BLOCK``; the last word of a block may be part filled. A slot with all bits set is an escape: the id stands in the
block's list of 32-bit escapes, in order. Ids of more than ``ESCAPE_BITS`` bits are escapes, so that a rare id doesn't widen its
neighbours. Bytes, all little-endian:

    "S8B1", u32 ids, u32 ids of a block, u32 blocks, u32[blocks + 1] first word, u32[blocks + 1] first escape, u64[] words, u32[] escapes

The offsets let a reader decode any block alone, or all of them with a few array operations for each selector.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"S8B1"
BLOCK = 256
ESCAPE_BITS = 15
#: Ids in a word by selector; their width is 60 over it.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = tuple(60 // n for n in COUNTS)
U = np.uint64
#: Bits of value + 1, for values of up to 16 bits; larger ones count as the last.
_BITS = np.frexp(np.arange(1, (1 << 16) + 1, dtype=np.float64))[1].astype(np.uint8)


def encode(ids: np.ndarray, block: int = BLOCK, escape_bits: int = ESCAPE_BITS) -> bytes:
    n = len(ids)
    blocks = -(-n // block)
    values = np.zeros((blocks, block + COUNTS[0]), dtype=np.uint64)
    flat = np.zeros(blocks * block, dtype=np.uint64)
    flat[:n] = ids
    values[:, :block] = flat.reshape(blocks, block)
    # A width must leave its all-ones pattern free: bits of value + 1.
    bits = _BITS[np.minimum(values, U(len(_BITS) - 1)).astype(np.int32)] if escape_bits < 16 else np.frexp((values + U(1)).astype(np.float64))[1].astype(np.uint8)
    escaped = bits > escape_bits
    bits[escaped] = 1
    # Widest id among the next k, for every k of a selector, out of those for powers of two.
    doubled = {1: bits}
    while 2 * max(doubled) <= COUNTS[0]:
        k = max(doubled)
        doubled[2 * k] = np.maximum(doubled[k][:, :-k], doubled[k][:, k:])
    fits = np.full((blocks, block), len(COUNTS) - 1, dtype=np.int8)
    for s in range(len(COUNTS) - 2, -1, -1):
        k = COUNTS[s]
        part = doubled[1 << (k.bit_length() - 1)]
        shift = k - (1 << (k.bit_length() - 1))
        most = np.maximum(part[:, :block], part[:, shift : shift + block]) if shift else part[:, :block]
        np.copyto(fits, s, where=most <= WIDTHS[s])
    length = np.full(blocks, block, dtype=np.int64)
    if blocks:
        length[-1] = n - (blocks - 1) * block
    at, live, words = np.zeros(blocks, dtype=np.int64), np.arange(blocks), []
    step = np.array(COUNTS, dtype=np.int64)
    while len(live):
        pick = fits[live, at[live]]
        words.append((live, at[live], pick))
        at[live] += step[pick]
        live = live[at[live] < length[live]]
    b, p, pick = (np.concatenate(x) for x in zip(*words)) if words else (np.empty(0, dtype=np.int64),) * 3
    order = np.argsort(b * block + p)
    b, p, pick = b[order], p[order], pick[order]
    out = pick.astype(np.uint64) << U(60)
    slots, at = np.where(escaped, U((1 << 64) - 1), values).ravel(), b * values.shape[1] + p
    for s, (k, width) in enumerate(zip(COUNTS, WIDTHS)):
        mine = np.flatnonzero(pick == s)
        if len(mine):
            slot = slots[at[mine][:, None] + np.arange(k)] & U((1 << width) - 1)
            out[mine] |= np.bitwise_or.reduce(slot << (np.arange(k, dtype=np.uint64) * U(width)), axis=1)
    first_word = np.searchsorted(b, np.arange(blocks + 1))
    first_escape = np.concatenate([[0], np.cumsum(escaped[:, :block].sum(axis=1))])
    head = np.array([n, block, blocks], dtype="<u4").tobytes()
    return b"".join([MAGIC, head, first_word.astype("<u4").tobytes(), first_escape.astype("<u4").tobytes(), out.astype("<u8").tobytes(), values[escaped].astype("<u4").tobytes()])


def decode(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b segment")
    n, block, blocks = (int(x) for x in np.frombuffer(data, "<u4", 3, 4))
    at = 16
    first_word = np.frombuffer(data, "<u4", blocks + 1, at).astype(np.int64)
    first_escape = np.frombuffer(data, "<u4", blocks + 1, at + 4 * (blocks + 1)).astype(np.int64)
    at += 8 * (blocks + 1)
    words = np.frombuffer(data, "<u8", int(first_word[-1]), at)
    escapes = np.frombuffer(data, "<u4", int(first_escape[-1]), at + 8 * len(words))
    pick = (words >> U(60)).astype(np.int64)
    if len(pick) and pick.max() >= len(COUNTS):
        raise ValueError("unknown selector")
    step = np.array(COUNTS, dtype=np.int64)[pick]
    owner = np.repeat(np.arange(blocks), np.diff(first_word))
    total = np.concatenate([[0], np.cumsum(step)])
    start = owner * block + total[:-1] - total[first_word[owner]]
    end = np.minimum((owner + 1) * block, n)
    out = np.zeros(n, dtype=np.uint32)
    escaped = np.zeros(n, dtype=bool)
    for s, (k, width) in enumerate(zip(COUNTS, WIDTHS)):
        mine = np.flatnonzero(pick == s)
        if len(mine):
            mask = U((1 << width) - 1)
            slot = (words[mine][:, None] >> (np.arange(k, dtype=np.uint64) * U(width))) & mask
            place = start[mine][:, None] + np.arange(k)
            real = place < end[mine][:, None]
            out[place[real]] = slot[real].astype(np.uint32)
            escaped[place[real]] = (slot == mask)[real]
    out[escaped] = escapes
    return out
