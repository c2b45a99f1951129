"""Line dedup that moves line hashes and places instead of text.

Each task hashes the lines of its documents (128 bits) and settles what it can alone: of the documents that hold a key, only its
largest id may keep it, and with three or more the others lose it for certain. What is left, at most two rows for each key and
chunk of text, is range-partitioned by hash and sorted by (hash, id descending, place). A stream over the sorted rows meets the
keeper of a key first and the rows to drop after it, holding one document's rows at a time. So a line that stands in a third of all
documents costs two rows for each chunk, not one for each document.

The result is a keep bitmap for each document that loses lines (bit i for line i, zlib); documents are cut by it where their text is.

Defined cases: a NULL or empty text is one empty line; a document holds a key once for the count however often it repeats it, and
keeps all its lines of that key if it is the largest; rows that share a doc_id count as one document for a key; a NULL doc_id counts
as the smallest id; repeated rows each get their row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossover.llm.common import batch, chunks, free_name, id_back, ints, key_struct, keyed, mapped, numbered, texts_of, tidy
from crossover.llm.words import LOWER

MIN_CHARS = 20
MIN_DOCS = 3
SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = re.compile(rb"[\x80-\xbf]+")

ROWS = "h binary, id bigint, v bigint, places binary, docs int"
DROPS = "id bigint, v bigint, places binary"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of a line's key, None if the key is too short to count."""
    key = line.strip(SPACE).translate(LOWER)
    if len(key) < min_chars or len(CONTINUATION.sub(b"", key)) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h, id, v, places, docs): rows of a key still open, with how many documents they stand for; docs 0 marks settled drops."""

    def run(batches):
        for t in chunks(batches):
            ids, vs, texts = ints(t.column(0)), ints(t.column(1)), texts_of(t.column(2))
            held: dict[bytes, dict[tuple[int, int], list[int]]] = {}
            for i, v, text in zip(ids.tolist(), vs.tolist(), texts):
                mine: dict[bytes, list[int]] = {}
                for n, line in enumerate(text.split(b"\n")):
                    if len(line) >= min_chars and (h := line_key(line, min_chars)) is not None:
                        mine.setdefault(h, []).append(n)
                for h, places in mine.items():
                    held.setdefault(h, {})[(i, v)] = places
            drops: dict[tuple[int, int], list[int]] = {}
            out = []
            for h, owners in held.items():
                n = len(owners) if len(owners) < 2 else len({i for i, _ in owners})
                if n < min_docs:
                    out.extend((h, i, v, p, 1) for (i, v), p in owners.items())
                    continue
                top = max(i for i, _ in owners)
                for (i, v), p in owners.items():
                    if i == top:
                        out.append((h, i, v, p, n))
                    else:
                        drops.setdefault((i, v), []).extend(p)
            out.extend((xxhash.xxh3_128_digest(b"%d,%d" % k), *k, p, 0) for k, p in drops.items())
            for lo in range(0, len(out), 10_000):
                h, i, v, p, n = zip(*out[lo : lo + 10_000])
                yield batch(h=pa.array(h, pa.binary()), id=pa.array(i, pa.int64()), v=pa.array(v, pa.int64()),
                            places=pa.array([np.array(x, dtype="<u4").tobytes() for x in p], pa.binary()), docs=pa.array(n, pa.int32()))

    return keyed(docs).mapInArrow(tidy(run), ROWS)


def drops(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, v, places) of lines to drop, streamed out of rows sorted by hash, id descending."""

    def run(batches):
        last = top = before = None
        ids, enough, waiting = 0, False, []
        for b in batches:
            out = []
            for h, i, v, p, n in zip(*(c.to_pylist() for c in b.columns)):
                if n == 0:
                    out.append((i, v, p))
                    continue
                if h != last:
                    last, top, ids, enough, waiting = h, i, 1, False, []
                elif i != before:
                    ids += 1
                before, enough = i, enough or n >= min_docs or ids >= min_docs
                if i != top:
                    waiting.append((i, v, p))
                if enough and waiting:
                    out.extend(waiting)
                    waiting = []
            if out:
                i, v, p = zip(*out)
                yield batch(id=pa.array(i, pa.int64()), v=pa.array(v, pa.int64()), places=pa.array(p, pa.binary()))

    ordered = rows.repartitionByRange("h").sortWithinPartitions("h", F.desc("id"), "v")
    return ordered.mapInArrow(tidy(run), DROPS)


def bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, v, dropped): for each document that loses lines the zlib-packed bitmap of the lost ones."""
    lists = drops(line_rows(docs, min_chars, min_docs), min_docs).groupBy("id", "v").agg(F.collect_set("places").alias("places"))

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        maps = []
        for parts in b.column(2):
            at = np.concatenate([np.frombuffer(p, dtype="<u4") for p in parts.as_py()])
            bits = np.zeros(int(at.max()) + 1, dtype=bool)
            bits[at] = True
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        return batch(id=b.column(0), v=b.column(1), dropped=pa.array(maps, pa.binary()))

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pack(b)

    return lists.mapInArrow(tidy(run), "id bigint, v bigint, dropped binary")


def cut(text: bytes, dropped: bytes | None) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, and what is left of a text under its bitmap."""
    lines = text.split(b"\n")
    if dropped is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), dtype=np.uint8), bitorder="little")[: len(lines)]
    gone = set(np.flatnonzero(bits).tolist())
    return len(lines), len(gone), b"\n".join(x for n, x in enumerate(lines) if n not in gone)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per document row: key (id, v), n_lines, n_dropped, kept_sha256 and the cleaned text."""
    joined = keyed(docs).join(bitmaps(docs, min_chars, min_docs), ["id", "v"], "left")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        done = [cut(t, d) for t, d in zip(texts_of(b.column(2)), b.column(3).to_pylist())]
        return batch(id=b.column(0), v=b.column(1), n_lines=pa.array([x[0] for x in done], pa.int64()), n_dropped=pa.array([x[1] for x in done], pa.int64()),
                     kept_sha256=pa.array([hashlib.sha256(x[2]).hexdigest() for x in done], pa.string()), text=pa.array([x[2] for x in done], pa.binary()).cast(pa.string()))

    return mapped(joined, run, "id bigint, v bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, text string")


def line_report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select(id_back().alias("doc_id"), "n_lines", "n_dropped", "kept_sha256")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of each text and its new n_chars; a NULL text stays NULL, other columns stay as they are."""
    columns = docs.columns
    key = free_name(columns)
    lost = free_name([*columns, key], "__dropped")
    maps = bitmaps(docs).select(F.struct("id", "v").alias(key), F.col("dropped").alias(lost))
    joined = docs.withColumn(key, key_struct()).join(maps, key, "left").select(*[F.col(f"`{c}`") for c in columns], lost)

    text = columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        new = [None if t is None else t if d is None else cut(t.encode(), d)[2].decode() for t, d in zip(b.column(text).to_pylist(), b.column(len(columns)).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == text else b.column(i) for i in range(len(columns))], names=[f"c{i}" for i in range(len(columns))])

    out = mapped(numbered(joined), run, numbered(docs).schema, column=f"c{text}").toDF(*columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
