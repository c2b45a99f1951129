"""Line-first cleaning: rules judge lines, failing lines go, and a document that loses too much of its text with them is rejected.

A line with a word fails if

- symbols: over a tenth of its word characters are of ``[#*$%&|<>]``;
- navigation: at least two of its words, and a quarter of them, are separators (``SEPARATORS``);
- boilerplate: it has at most ``SHORT_LINE`` words and one of ``PHRASES`` (A-Z lower-cased);
- punctuation: it doesn't end in one of ``ENDS``.

A document is kept if the base rules hold and at most half of its word characters stood in failing lines. Base rules: at least
``MIN_WORDS`` words, and at most a fifth of them in five-word windows that the text has twice or more.

Defined cases: a NULL or wordless text has no words, fails the base rules and is not kept; blank lines neither fail nor count;
a doc_id may be NULL or repeated, as each row is judged by itself; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crossover.llm.common import batch, id_back, keyed, mapped, texts_of
from crossover.llm.words import LOWER, Words, covered, mix, range_hashes

REPEAT_WINDOW = 5
MIN_WORDS = 10
SHORT_LINE = 30
SEPARATORS = ("|", "/", ">", "»", "›", "·", "•", "-", "::")
ENDS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", "»", ")", "。", "！", "？")
PHRASES = (
    "all rights reserved", "licensed under", "released under", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "use of cookies", "click here", "read more", "sign in", "log in", "subscribe to", "share this", "skip to content",
)

_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)
_ENDS = tuple(s.encode() for s in ENDS)
_PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = bytes(b"#*$%&|<>")

SCHEMA = ("id bigint, v bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
          "kept boolean, n_failed_lines bigint, lost_chars bigint, text string")


def failed_rule(line: bytes, words: list[bytes], chars: int) -> str | None:
    """The first rule that a line with words fails; ``chars``: code points in its words."""
    if 10 * (len(line) - len(line.translate(None, _SYMBOLS))) > chars:
        return "symbols"
    n = sum(w in _SEPARATORS for w in words)
    if n >= 2 and 4 * n >= len(words):
        return "navigation"
    if len(words) <= SHORT_LINE and _PHRASE.search(line.translate(LOWER)):
        return "boilerplate"
    return None if words[-1].endswith(_ENDS) else "punctuation"


def judge_lines(text: bytes) -> tuple[int, int, int, int, bytes]:
    """Word characters, repeated lines, failed lines, word characters of these, and the text without them."""
    seen, kept = set(), []
    total = repeated = failed = lost = 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            chars = len(b"".join(words).translate(None, _CONTINUED))
            total += chars
            repeated += line in seen
            seen.add(line)
            if failed_rule(line, words, chars):
                failed += 1
                lost += chars
                continue
        kept.append(line)
    return total, repeated, failed, lost, b"\n".join(kept)


def clean_lines(docs: DataFrame) -> DataFrame:
    """Per document row: key, base figures, base_failed, kept, failed lines, characters lost with them, and the cleaned text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(b.column(2))
        w = Words.of([b" ".join(t.split()) for t in texts])
        lo, hi = w.windows(REPEAT_WINDOW)
        owner = w.text_of_word()
        h = mix(range_hashes(w.hashes(), lo, hi) + mix(owner[lo].astype(np.uint64) + np.uint64(1)))
        _, which, count = np.unique(h, return_inverse=True, return_counts=True)
        again = count[which] > 1
        repeats = np.bincount(owner[covered(len(w), lo[again], hi[again])], minlength=len(texts))
        n = np.diff(w.first)
        symbols = np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], dtype=np.int64)
        total, dup, failed, lost, text = zip(*map(judge_lines, texts))
        total, lost = np.array(total, dtype=np.int64), np.array(lost, dtype=np.int64)
        base = (n < MIN_WORDS) | (100 * repeats > 20 * n)
        return batch(id=b.column(0), v=b.column(1), n_words=n, word_chars=total, n_symbols=symbols, n_dup_lines=np.array(dup, dtype=np.int64), n_repeat_words=repeats.astype(np.int64),
                     base_failed=base, kept=~base & (2 * lost <= total), n_failed_lines=np.array(failed, dtype=np.int64), lost_chars=lost, text=pa.array(text, pa.binary()).cast(pa.string()))

    return mapped(keyed(docs), run, SCHEMA)


def quality_report(docs: DataFrame) -> DataFrame:
    return clean_lines(docs).select(id_back().alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")
