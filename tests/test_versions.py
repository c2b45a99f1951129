"""Bucket tables: copy-on-write versions, checksums kept up by changes, rounds that read differing buckets only."""

import pytest
from pyspark.sql import functions as F

from crossover.operators import validate as v
from crossover.streaming import versions as vs
from tests.conftest import rows

SCHEMA = "id int, key string, seq bigint, op string"


def table(spark, path, n=200, buckets=16):
    t = vs.BucketTable(spark, str(path), ["id"], buckets)
    t.create(spark.range(n).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("v"), "id").alias("key")))
    return t


def same_sums(t):
    fresh = rows(v.bucket_checksums(t.current(), t.keys, t.buckets).where("row_count <> 0"))
    return rows(t.sums().where("row_count <> 0")) == fresh


def test_fold_writes_touched_buckets(spark, tmp_path):
    t = table(spark, tmp_path / "t", buckets=64)
    before = t._manifest(t.head())
    t.take(spark.createDataFrame([(1, "x", 5, "U"), (2, None, 6, "D"), (900, "new", 7, "I")], SCHEMA), 0)
    assert t.batches() == [0] and same_sums(t)
    n = t.fold()
    after = t._manifest(t.head())
    assert n <= 3 and sum(before.get(b) != after[b] for b in after) == n
    assert t.head()["version"] == 1 and t.head()["through"] == 0 and t.batches() == [] and t.fold() == 0
    assert same_sums(t) and t.current().count() == 200
    assert t.current([]).count() == 0


def test_batches_in_any_order_and_again(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    late, early = [(1, "late", 9, "U"), (3, "x", 3, "D")], [(1, "early", 4, "U"), (3, "y", 2, "U"), (700, "n", 1, "I"), (700, "n", 1, "I")]
    for n, part in enumerate((late, early, [])):
        for _ in range(2):  # a batch that is run again changes nothing
            t.take(spark.createDataFrame(part, SCHEMA), n)
            assert same_sums(t)
    assert t.current().where("id in (1, 3, 700)").orderBy("id").collect() == [(1, "late"), (700, "n")]
    t.fold(forget=3)
    assert same_sums(t) and t.stored().where("op = 'D'").count() == 1
    t.take(spark.createDataFrame(late, SCHEMA), 0)  # in a version already
    assert t.batches() == [] and same_sums(t)
    t.take(spark.createDataFrame([(4, "z", 1, "U")], SCHEMA), 3)
    t.fold(forget=10)
    assert t.stored().where("op = 'D'").count() == 1  # of another bucket, or still there


def test_half_written_batch_is_not_seen(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t._newest(t._shaped(spark.createDataFrame([(1, "half", 5, "U")], SCHEMA))).write.parquet(f"{t.path}/batches/batch_id=0")
    assert t.batches() == [] and t.current().where("key = 'half'").count() == 0
    t.take(spark.createDataFrame([(1, "whole", 5, "U")], SCHEMA), 0)
    assert t.current().where("id = 1").first()["key"] == "whole"


def test_two_folds_at_once(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    with pytest.raises(Exception, match="exist"):
        t._publish(0, manifest="x", through=0, schema="")


def test_absent_table(spark, tmp_path):
    t = vs.BucketTable(spark, str(tmp_path / "none"), ["id"])
    assert t.head() is None
    with pytest.raises(ValueError):
        t.current()


def test_a_fold_meanwhile_changes_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.take(spark.createDataFrame([(1, "x", 5, "U")], SCHEMA), 0)
    head = t.head()
    t.fold()
    assert t.batches() == [] and t.batches(head) == [0]
    assert t.stored(head=head).where("key.id = 1").first()["row"]["key"] == "x"


def test_round_reads_differing_buckets(spark, tmp_path):
    a, b = table(spark, tmp_path / "a"), table(spark, tmp_path / "b")
    assert vs.differing(a, b) == [] and vs.check_round(a, b).count() == 0
    for n, part in enumerate(([(5, "x", 1, "U")], [(6, "", 2, "D")])):
        a.take(spark.createDataFrame(part, SCHEMA), n)
        found = vs.check_round(a, b)
        assert rows(found) == rows(v.diff_rows(a.current(), b.current(), ["id"]))
        bad = vs.differing(a, b)
        read = {f.split("part=")[1].split("/")[0] for f in found.inputFiles() if "/data/" in f}
        assert read <= {str(x) for x in bad} and len(bad) <= 2
    a.fold()
    assert rows(vs.check_round(a, b)) == [(5, "mismatched", 1), (6, "extraneous", 1)]
    with pytest.raises(ValueError):
        vs.differing(a, vs.BucketTable(spark, b.path, ["id"], 4))
