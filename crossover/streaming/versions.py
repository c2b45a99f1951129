"""A table that follows its changes in buckets of its key: versions by copy-on-write, and checksums that every change keeps up.

Below the table's folder:

    data/<token>/part=<b>        rows of a bucket as some version wrote them, deleted keys included
    manifests/<token>            for each bucket its folder and the checksum of its live rows
    versions/<number>            names a manifest and the last batch in it; its creation makes the version
    batches/batch_id=<n>         newest change per key of a micro-batch
    sums/batch_id=<n>            what the batch does to each bucket's checksum; its presence makes the batch

A fold rewrites the buckets that changed and points to the old folders of all others. A reader sees the newest version and the batches
after it. A batch looks up the rows that it replaces in the buckets it touches, takes their hashes out of the checksums and adds the new
ones. Two sides compare their checksums, a few numbers a bucket, and read only buckets that differ.

Columns lie in structs (``key``, ``row``), so that no name of the table can clash. Bucket lists, at most ``buckets`` integers, come to the
driver; rows never do. Versions need a file system that refuses to create an existing file, as HDFS does; of two folds at a time one fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from crossover.functions.hashing import checksum_aggregates, row_hash
from crossover.operators.validate import bucket, diff_rows
from crossover.streaming.changes import as_changes

BUCKETS = 256
SUMS = "bucket int, row_count bigint, hash_xor bigint, hash_sum decimal(38,0)"


def _nullable(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in t])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_nullable(t.elementType))
    return T.MapType(_nullable(t.keyType), _nullable(t.valueType)) if isinstance(t, T.MapType) else t


class BucketTable:
    """The table below ``path``. Rows are told apart by ``keys``; of the changes of a key the one with the highest ``seq`` counts.

    Changes carry all columns of the table, ``seq`` and ``op`` (D deletes). Checksums cover the table's columns, not these two.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS, seq: str = "seq", op: str = "op"):
        self.spark, self.path, self.keys, self.buckets, self.seq, self.op = spark, path.rstrip("/"), list(keys), buckets, seq, op

    # ---- files ----------------------------------------------------------------------------------------------------

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._files(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def head(self) -> dict | None:
        """The newest version: its number, manifest, last batch and the schema of the table's rows."""
        names = sorted(n for n in self._names("versions") if n.isdigit())
        if not names:
            return None
        text = self.spark.read.text(f"{self.path}/versions/{names[-1]}").first()["value"]
        return {"version": int(names[-1]), **json.loads(text)}

    def _publish(self, version: int, **content) -> None:
        path, fs = self._files(f"versions/{version:010d}")
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _known(self) -> dict:
        head = self.head()
        if head is None:
            raise ValueError(f"no table below {self.path}; create it first")
        return head

    def batches(self, head: dict | None = None) -> list[int]:
        """Batches that are complete and not in the version (the newest one)."""
        through = (head or self._known())["through"]
        found = [int(n.partition("=")[2]) for n in self._names("sums") if n.startswith("batch_id=")]
        return sorted(n for n in found if n > through and self._files(f"sums/batch_id={n}/_SUCCESS")[1].exists(self._files(f"sums/batch_id={n}/_SUCCESS")[0]))

    # ---- rows -----------------------------------------------------------------------------------------------------

    def _shaped(self, changes: DataFrame) -> DataFrame:
        data = [c for c in changes.columns if c not in (self.seq, self.op)]
        return changes.select(bucket(changes, self.keys, self.buckets).alias("bucket"), F.struct(*[F.col(f"`{k}`") for k in self.keys]).alias("key"),
                              F.col(f"`{self.seq}`").cast("long").alias("seq"), F.col(f"`{self.op}`").alias("op"),
                              row_hash(changes, data).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in data]).alias("row"))

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("bucket", "key")]
        return rows.groupBy("bucket", "key").agg(F.max_by(F.struct(*rest), F.struct("seq", "op", "hash")).alias("r")).select("bucket", "key", "r.*")

    def _schema(self, head: dict) -> T.StructType:
        return T.StructType.fromJson(json.loads(head["schema"]))

    def _manifest(self, head: dict, among: list[int] | None = None) -> dict[int, str]:
        """Folder of each bucket that has rows."""
        rows = self.spark.read.parquet(f"{self.path}/manifests/{head['manifest']}").select("bucket", "folder")
        found = {r["bucket"]: r["folder"] for r in rows.collect()}  # at most ``buckets`` rows
        return found if among is None else {b: found[b] for b in among if b in found}

    def _folders(self, head: dict, among: list[int] | None = None) -> list[str]:
        return [f"{self.path}/{f}" for f in sorted(self._manifest(head, among).values())]

    def stored(self, among: list[int] | None = None, before: int | None = None, head: dict | None = None) -> DataFrame:
        """Newest state of every key, deleted ones included, from the files of the asked buckets and the batches after the version.

        One version is read throughout, whatever is folded meanwhile.
        """
        head = head or self._known()
        schema = self._schema(head)
        folders = self._folders(head, among)
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        later = [f"{self.path}/batches/batch_id={n}" for n in self.batches(head) if before is None or n < before]
        if later:
            taken = self.spark.read.schema(schema).parquet(*later)
            rows = rows.select(schema.names).unionByName(taken if among is None else taken.where(F.col("bucket").isin(among)))
        return self._newest(rows.select(schema.names))

    def current(self, among: list[int] | None = None) -> DataFrame:
        """The table as it stands, or the rows of some buckets."""
        return self.stored(among).where(F.col("op") != "D").select("row.*")

    # ---- versions -------------------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, token: str) -> DataFrame:
        """Write buckets and return their manifest rows. A large bucket is split between tasks and has several files."""
        folder = f"{self.path}/data/{token}"
        rows.withColumn("part", F.col("bucket")).hint("rebalance", "part").write.partitionBy("part").parquet(folder)
        written = self.spark.read.schema(rows.schema).parquet(folder)
        live = F.col("op") != "D"
        count, xor, total = checksum_aggregates(F.when(live, F.col("hash")))
        return written.groupBy("bucket").agg(F.count_if(live).alias("row_count"), F.coalesce(xor, F.lit(0).cast("long")).alias("hash_xor"), F.coalesce(total, F.lit(0)).cast("decimal(38,0)").alias("hash_sum")).select(
            "*", F.concat(F.lit(f"data/{token}/part="), F.col("bucket").cast("string")).alias("folder"))

    def create(self, base: DataFrame) -> None:
        """Version 0 out of rows that were loaded in bulk."""
        rows, token = self._newest(self._shaped(as_changes(base, self.seq, self.op))), uuid.uuid4().hex
        self._write(rows, token).coalesce(1).write.parquet(f"{self.path}/manifests/{token}")
        self._publish(0, manifest=token, through=-1, schema=_nullable(rows.schema).json())

    def fold(self, forget: int | None = None) -> int:
        """The next version, with all complete batches in it; returns how many buckets were written.

        Deleted keys stay, so that a late older change cannot bring one back; below position ``forget`` nothing comes any more, and
        they go.
        """
        head = self._known()
        batches = self.batches(head)
        if not batches:
            return 0
        touched = self._touched(batches)
        rows = self.stored(touched, batches[-1] + 1, head)
        if forget is not None:
            rows = rows.where((F.col("op") != "D") | (F.col("seq") >= forget))
        token = uuid.uuid4().hex
        fresh = self._write(rows, token)
        kept = self.spark.read.parquet(f"{self.path}/manifests/{head['manifest']}").where(~F.col("bucket").isin(touched))
        kept.unionByName(fresh).coalesce(1).write.parquet(f"{self.path}/manifests/{token}")
        self._publish(head["version"] + 1, manifest=token, through=batches[-1], schema=head["schema"])
        return len(touched)

    def _touched(self, batches: list[int]) -> list[int]:
        rows = self.spark.read.schema(SUMS).parquet(*[f"{self.path}/sums/batch_id={n}" for n in batches])
        return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())  # at most ``buckets`` integers

    # ---- changes --------------------------------------------------------------------------------------------------

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """Keep a micro-batch and bring the checksums up to it. A batch that comes again replaces what it left, or is in a version already."""
        head = self._known()
        if batch_id <= head["through"]:
            return
        schema = self._schema(head)
        folder = f"{self.path}/batches/batch_id={batch_id}"
        self._newest(self._shaped(batch)).select([F.col(f.name).cast(f.dataType) for f in schema]).write.mode("overwrite").parquet(folder)
        new = self.spark.read.schema(schema).parquet(folder).select("bucket", "key", "seq", "op", "hash")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        old = self.stored(touched, batch_id, head).select("bucket", "key", *[F.col(c).alias(f"old_{c}") for c in ("seq", "op", "hash")])
        both = new.join(old, [new["bucket"] == old["bucket"], new["key"].eqNullSafe(old["key"])], "left").where("old_seq is null or old_seq < seq")

        def sums(live: Column, value: Column) -> list[Column]:
            hashed = F.when(live, value)
            return [F.count_if(live), F.coalesce(F.bit_xor(hashed), F.lit(0).cast("long")), F.coalesce(F.sum(hashed.cast("decimal(38,0)")), F.lit(0))]

        (n, x, s), (m, y, t) = sums(F.col("op") != "D", F.col("hash")), sums(F.coalesce(F.col("old_op") != "D", F.lit(False)), F.col("old_hash"))
        moved = both.groupBy(new["bucket"]).agg((n - m).alias("row_count"), x.bitwiseXOR(y).alias("hash_xor"), (s - t).cast("decimal(38,0)").alias("hash_sum"))
        moved.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sums/batch_id={batch_id}")

    def follow(self, changes: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """Take in a stream until its input is used up, or every ``interval``."""
        when = {"processingTime": interval} if interval else {"availableNow": True}
        return changes.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**when).start()

    def sums(self) -> DataFrame:
        """Checksum of each bucket's live rows, as of the last complete batch: a few numbers a bucket and batch are read, no rows."""
        head = self._known()
        parts = self.spark.read.parquet(f"{self.path}/manifests/{head['manifest']}").select("bucket", "row_count", "hash_xor", "hash_sum")
        later = [f"{self.path}/sums/batch_id={n}" for n in self.batches(head)]
        if later:
            parts = parts.unionByName(self.spark.read.schema(SUMS).parquet(*later))
        return parts.groupBy("bucket").agg(F.sum("row_count").alias("row_count"), F.bit_xor("hash_xor").alias("hash_xor"), F.sum("hash_sum").cast("decimal(38,0)").alias("hash_sum"))


def differing(source: BucketTable, target: BucketTable) -> list[int]:
    """Buckets whose checksums differ. An absent bucket is one without rows."""
    if (source.buckets, source.keys) != (target.buckets, target.keys):
        raise ValueError("both sides need the same keys and number of buckets")
    sides = [t.sums().where("row_count <> 0").select("bucket", F.struct("row_count", "hash_xor", "hash_sum").alias(n)) for t, n in ((source, "s"), (target, "t"))]
    found = sides[0].join(sides[1], "bucket", "full_outer").where(~F.col("s").eqNullSafe(F.col("t"))).select("bucket")
    return sorted(r["bucket"] for r in found.collect())


def check_round(source: BucketTable, target: BucketTable, columns: list[str] | None = None) -> DataFrame:
    """Keyed diff of two followed tables that reads the files of differing buckets only.

    Both sides hold rows in one form (see ``functions.comparing.comparable``); other forms give equal rows other hashes, and then buckets
    are read that turn out to be equal.
    """
    bad = differing(source, target)
    return diff_rows(source.current(bad), target.current(bad), source.keys, columns)
