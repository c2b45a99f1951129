"""Secrets in texts: three fixed forms, and strings near a sensitive word that zstandard finds new.

A candidate is a run of at least ``RUN`` characters with letters and digits, with a sensitive word before it on its line. Its novelty is what
it adds to the compressed size of the text around it, by a compressor that is primed with identifiers, against its own length. Names,
paths and repeated values are found in the surroundings or the dictionary and add little; a random string adds nearly all of itself.

The dictionary holds words of program text and then the identifiers that stand around candidates in the most documents of the corpus, of
which the commonest ``IDENTIFIERS`` fit (a list that does not grow with the corpus), counted over all documents.

Defined cases: a NULL or empty text has no findings; every row has a row of its own in the report, also repeated ones and those with a NULL
doc_id; an empty table gives none. Other columns are not read. Offsets are code points, the end exclusive. A candidate that overlaps a
finding of a fixed form is not reported again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossover.llm.common import batch, chunks, id_back, keyed, mapped, tidy

# The three forms, and the fewest characters of a finding (of its second group, if it has one).
FORMS = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 32),
}
#: What a text must hold (in any letters) to be looked at.
FORM_HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
WORDS = r"passw|pwd|passphrase|secret|token|credential|bearer|authoriz|auth[_-]?key|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|signing|signature"
SENSITIVE = re.compile(WORDS, re.I | re.A)
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}")
BEFORE, AROUND = 64, 256
#: Least share of a candidate's bytes that it adds to the compressed size, in percent.
NOVEL = 65
LEVEL, IDENTIFIERS, DICTIONARY_BYTES = 3, 2048, 32 << 10
#: Words of program text that stand in every dictionary.
COMMON = ("abstract access account admin application argument array assert async attribute auth authorization await base64 boolean break buffer callback catch class "
          "client code column command config configuration connection console const content context control cookie count create credential data database date debug "
          "default define delete description development dictionary directory document element email encode endpoint environment error event exception export extends "
          "false field file filter final float format function github global group handler hash header hidden host https identifier image implements import include "
          "index input instance integer interface internal json lambda language length library list local location logger login machine manager message method model "
          "module namespace network normal null number object operator option output package parameter parse password path pattern payload permission pipeline plugin "
          "policy postgres primary print private process production profile project property protected protocol provider proxy public query queue random read "
          "record redirect reference register release remote render repository request require resource response return role route schema script search secret section "
          "secure select self server service session setting signature source start state static status storage string struct system table target task template "
          "test text thread throw timeout timestamp title token transaction true type undefined union update upload user username utf-8 uuid valid value variable "
          "version view void while window worker write yaml").split()
_IDENTIFIER = re.compile(r"[A-Za-z_]{4,40}")


@dataclass
class Finding:
    kind: str
    start: int
    end: int

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def base_findings(text: str) -> list[Finding]:
    out = []
    for kind, (pattern, least) in FORMS.items():
        for m in pattern.finditer(text):
            if len(m[2] if pattern.groups else m[0]) >= least:
                out.append(Finding(kind, *m.span()))
    return sorted(out, key=lambda f: f.start)  # stable: kinds stay as listed


def candidates(text: str, found: list[Finding]) -> list[re.Match]:
    """Runs in sensitive surroundings that no finding of ``found`` (by start) overlaps."""
    if not SENSITIVE.search(text):
        return []
    out, at, reach = [], 0, 0
    for m in RUN.finditer(text):
        while at < len(found) and found[at].start < m.end():
            reach = max(reach, found[at].end)
            at += 1
        if reach <= m.start() and SENSITIVE.search(text[max(0, m.start() - BEFORE) : m.start()].rpartition("\n")[2]):
            out.append(m)
    return out


def _around(text: str, m: re.Match) -> tuple[str, str]:
    return text[max(0, m.start() - AROUND) : m.start()], text[m.end() : m.end() + AROUND]


class Novelty:
    """Marginal compressed bytes under a dictionary."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.compress = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_checksum=False).compress

    def marginal(self, value: str, before: str, after: str) -> int:
        return len(self.compress(f"{before}{value}{after}".encode())) - len(self.compress(f"{before}{after}".encode()))

    def is_new(self, text: str, m: re.Match) -> bool:
        return 100 * self.marginal(m[0], *_around(text, m)) >= NOVEL * len(m[0])


def _hinted(texts: pa.Array) -> np.ndarray:
    """Rows whose text may hold a finding or a candidate."""
    hit = pc.match_substring_regex(texts.cast(pa.string()), f"{FORM_HINT}|(?i:{WORDS})")
    return np.flatnonzero(pc.fill_null(hit, False).to_numpy(zero_copy_only=False))


def dictionary(docs: DataFrame) -> bytes:
    """Identifiers to prime compressors with, the commonest last, where a match costs least."""
    def count(batches):
        for t in chunks(batches):
            n: dict[str, int] = {}
            texts = t["text"].combine_chunks()
            for text in texts.take(pa.array(_hinted(texts))).to_pylist():
                for x in {x for m in candidates(text, base_findings(text)) for side in _around(text, m) for x in _IDENTIFIER.findall(side)}:
                    n[x] = n.get(x, 0) + 1
            if n:
                yield batch(word=list(n), n=pa.array(list(n.values()), pa.int64()))

    counted = docs.select("text").mapInArrow(tidy(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    rows = counted.orderBy(F.desc("n"), "word").limit(IDENTIFIERS).collect()  # at most IDENTIFIERS words of 40 letters
    out, size = [], 0
    for word in [*(r["word"] for r in rows), *COMMON]:
        size += len(word) + 1
        if size > DICTIONARY_BYTES:
            break
        out.append(word)
    return " ".join(reversed(out)).encode()


FINDINGS = "id bigint, v bigint, kinds array<string>, starts array<bigint>, ends array<bigint>"


def scan(docs: DataFrame, primed: bytes | None = None) -> DataFrame:
    """Findings of every document row: kinds (a fixed form, or ``novel``), starts and ends, by start."""
    rows = keyed(docs)
    primed = dictionary(rows) if primed is None else primed

    def find(b: pa.RecordBatch) -> pa.RecordBatch:
        novelty, texts = Novelty(primed), b.column(2)
        at = _hinted(texts)
        found: list[list[Finding]] = [[] for _ in range(b.num_rows)]
        for i, text in zip(at.tolist(), texts.take(pa.array(at)).to_pylist()):
            fixed = base_findings(text)
            found[i] = sorted([*fixed, *(Finding("novel", *m.span()) for m in candidates(text, fixed) if novelty.is_new(text, m))], key=lambda f: f.start)
        return batch(id=b.column(0), v=b.column(1), kinds=pa.array([[f.kind for f in x] for x in found], pa.list_(pa.string())),
                     starts=pa.array([[f.start for f in x] for x in found], pa.list_(pa.int64())), ends=pa.array([[f.end for f in x] for x in found], pa.list_(pa.int64())))

    return mapped(rows, find, FINDINGS)


def secret_report(docs: DataFrame, primed: bytes | None = None) -> DataFrame:
    """Per document: findings by kind, a digest of those of fixed forms, and all spans."""
    def said(condition: str) -> str:
        return f"array_join(transform(filter(arrays_zip(kinds, starts, ends), f -> {condition}), f -> concat_ws(':', f.kinds, f.starts, f.ends)), ',')"

    kinds = {f"n_{k}": F.expr(f"cast(size(filter(kinds, k -> k = '{k}')) as bigint)") for k in (*FORMS, "novel")}
    return scan(docs, primed).select(id_back().alias("doc_id"), *[c.alias(n) for n, c in kinds.items()],
                                     F.sha2(F.expr(said("f.kinds <> 'novel'")), 256).alias("base_sha256"), F.expr(said("true")).alias("spans"))
