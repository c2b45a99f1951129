"""Language ID by compression: a text is coded with a raw-content zstandard dictionary of each language, and the smallest code wins.

Dictionaries are fitted on a bounded sample: of each label the ``SAMPLE_ROWS`` rows first in hash order, in all at most ``DICTIONARY_BYTES`` of text, shared out evenly as far as the rows are long enough. Whole texts are judged,
lower-cased and with all but letters as spaces, in blocks of ``BLOCK_BYTES`` so that a long text can't become its own dictionary. A text whose second best code is hardly longer
(``MARGIN`` of the best) is rejected.

Defined cases: a NULL text, or one without a letter, is ``und`` with score 0 and rejected; equal sizes go to the first label in
order; rows with a NULL label or text teach nothing; without any label all texts are ``und``; one label alone has nothing to beat it
and score 1; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossover.llm.common import CACHES, batch, id_back, keyed, mapped, numbered

SAMPLE_ROWS = 64
DICTIONARY_BYTES = 32 << 10
BLOCK_BYTES = 4 << 10
LEVEL = 6
MARGIN = 0.005
MAX_LABELS = 1000
SHARPNESS = 40.0
UNKNOWN = "und"


#: Lower-case letters and all bytes of longer characters stay.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def plain(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "


def held_out(name: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each label (of the MAX_LABELS commonest ones, ties by name).

    The sample is at most ``rows`` different texts of a label, the first by a hash, whatever the size of the table, and of each text at most
    its first ``size // rows * 8`` characters; prediction reads whole texts.
    """
    known = labelled.where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("v"), "text")
    # At most MAX_LABELS labels, and ``rows`` hashes of each, hence the broadcasts.
    labels = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LABELS).select("lang")
    order = Window.partitionBy("lang").orderBy("v")
    texts = known.select("lang", "v").distinct().join(F.broadcast(labels), "lang", "left_semi")
    chosen = texts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows)
    picked = known.join(F.broadcast(chosen), ["lang", "v"])
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in picked.select("lang", "n", F.substring("text", 1, size // rows * 8).alias("t")).distinct().collect():
        parts.setdefault(r.lang, []).append((r.n, r.t))
    out = {}
    for lang, texts in sorted(parts.items()):
        # Short rows leave room, which longer ones fill.
        share, whole = size // len(texts), [plain(t) for _, t in sorted(texts)]
        room = size - sum(min(len(t), share) for t in whole)
        cut = []
        for t in whole:
            more = min(room, max(0, len(t) - share))
            room -= more
            cut.append(t[: share + more])
        out[lang] = b"".join(cut)[:size]
    return out


class Model:
    """Compressors of one process."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.labels = sorted(dictionaries)
        self.coders = []
        for label in self.labels:
            d = zstandard.ZstdCompressionDict(dictionaries[label], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """Label, score, and how much longer the second best code is."""
        if text is None or not self.labels or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        raw = plain(text)
        parts = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        sizes = np.array([sum(len(c.compress(p)) for p in parts) for c in self.coders], dtype=np.float64)
        best = int(np.argmin(sizes))
        score = 1.0 / float(np.exp(-(sizes - sizes[best]) / sizes[best] * SHARPNESS).sum())
        rest = np.delete(sizes, best)
        return self.labels[best], score, float((rest.min() - sizes[best]) / sizes[best]) if len(rest) else 1.0


_MODELS: dict[int, Model] = {}
CACHES.append(_MODELS)


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Per document row: key (id, v), lang_pred, score, margin and rejected."""
    key = hash(tuple(sorted(dictionaries.items())))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        model = _MODELS.get(key) or _MODELS.setdefault(key, Model(dictionaries))
        label, score, lead = zip(*(model.judge(t) for t in b.column(2).to_pylist()))
        lead = np.array(lead)
        return batch(id=b.column(0), v=b.column(1), lang_pred=pa.array(label, pa.string()), score=np.array(score), margin=lead, rejected=lead < margin)

    return mapped(keyed(docs), run, "id bigint, v bigint, lang_pred string, score double, margin double, rejected boolean")


def language_report(docs: DataFrame) -> DataFrame:
    """Learns from rows outside the held-out fold; judges all."""
    model = fit(docs.where(~held_out()))
    out = classify(docs, model).withColumn("doc_id", id_back())
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def accepted(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``docs`` without the rows that are rejected, judged where they lie; nothing is shuffled. Without any label to learn from all stay."""
    dictionaries = fit(docs.where(~held_out()))
    if not dictionaries:
        return docs
    key = hash(tuple(sorted(dictionaries.items())))

    text = docs.columns.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        model = _MODELS.get(key) or _MODELS.setdefault(key, Model(dictionaries))
        return b.filter(pa.array([model.judge(t)[2] >= margin for t in b.column(text).to_pylist()], pa.bool_()))

    return mapped(numbered(docs), run, numbered(docs).schema, column=f"c{text}").toDF(*docs.columns)
