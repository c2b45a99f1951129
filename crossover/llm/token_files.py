"""Token ids of a corpus in ascending doc_id order, as Simple-8b segments.

Documents are range-partitioned by id; each range is a shard, written by one task as rows of a Parquet table in the shared folder.
A row is a segment: whole documents of about ``SEGMENT_IDS`` ids (one long document may fill a larger one), their sizes, the number
of the shard's ids before it, and the coded bytes of ``simple8b``. Spark's committer makes a shard appear whole or not at all, and
any store that Spark reaches will do.

Defined cases: a NULL or empty text is the end id alone; a NULL doc_id comes first; repeated rows are written each, next to each
other; an empty table writes no segment; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossover.llm.bpe import CALL_BYTES, encoder
from crossover.llm.common import batch, batches_of, id_back, ints, keyed, release, slices, tidy, written
from crossover.llm.simple8b import decode, encode

END = 0
SEGMENT_IDS = 1 << 18
TOKENIZER = "byte_bpe_50k.json"
SEGMENTS = "shard int, first bigint, ids array<bigint>, sizes array<int>, data binary"


def segments(docs: DataFrame, path: str | None = None, end: int = END, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    def run(batches):
        file = path or public_tokenizers.path(TOKENIZER)
        shard, before, ids, coded, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            return batch(shard=pa.array([shard], pa.int32()), first=pa.array([before], pa.int64()), ids=pa.array([ids], pa.list_(pa.int64())),
                         sizes=pa.array([[len(x) for x in coded]], pa.list_(pa.int32())), data=pa.array([encode(np.concatenate(coded))], pa.binary()))

        for b in slices(batches, limit=CALL_BYTES):
            for i, x in zip(ints(b.column(0)).tolist(), encoder(file).encode(b.column(2))):
                ids.append(i)
                coded.append(np.append(x, end).astype(np.uint32))
                size += len(coded[-1])
                if size >= segment_ids:
                    yield flush()
                    before, ids, coded, size = before + size, [], [], 0
            release()
        if ids:
            yield flush()

    return keyed(docs).repartitionByRange("id", "v").sortWithinPartitions("id", "v").mapInArrow(tidy(run), SEGMENTS)


def read_documents(table: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, decoded from the segments: doc_id, start, n_tokens, ids_crc32, and on demand the ids."""
    sizes = table.groupBy("shard").agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")).alias("n")).orderBy("shard").collect()  # one row for each shard
    base, total = {}, 0
    for r in sizes:
        base[r.shard] = total
        total += r.n

    def run(batches):
        for b in batches:
            for shard, first, ids, size, data in zip(*(b.column(i) for i in range(5))):
                values = decode(data.as_py()).astype("<u4")
                n = np.array(size.values, dtype=np.int64)
                cuts = np.concatenate([[0], np.cumsum(n)])
                parts = [values[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
                listed = {"tokens": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values.astype(np.int32)))} if with_ids else {}
                yield batch(id=ids.values, start=cuts[:-1] + base[shard.as_py()] + first.as_py(), n_tokens=n,
                            ids_crc32=np.array([zlib.crc32(p.tobytes()) for p in parts], dtype=np.int64), **listed)

    out = table.mapInArrow(tidy(run), "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", tokens array<int>" * with_ids)
    return out.select(id_back().alias("doc_id"), "start", "n_tokens", "ids_crc32", *["tokens"] * with_ids)


def token_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    with batches_of(docs.sparkSession, CALL_BYTES):
        table = written(segments(docs, path), "tokens")
    return read_documents(table)
