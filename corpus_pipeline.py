"""From raw documents to packed training sequences: five stages over the operators of ``crossover.llm``.

Each stage gets all that its predecessor kept as ``docs`` and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossover.llm import decontaminate, language_id, line_dedup, minhash, packing
from crossover.llm.common import free_name, key_id, read, ship
from crossover.session import run_folder


def _stage(fn):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    run.__doc__, run.__name__ = fn.__doc__, fn.__name__
    return run


def _without(docs: DataFrame, gone: DataFrame, once: bool = False) -> DataFrame:
    """``docs`` less the rows with a key (id, v) of ``gone``; ``once`` also leaves out a kept document's repeated rows."""
    # Two plain columns rather than a struct, so that join and grouping share one shuffle.
    i, v = (free_name(docs.columns, n) for n in ("__id", "__v"))
    keys = gone.select(F.col("id").alias(i), F.col("v").alias(v)).distinct()
    kept = docs.withColumns({i: key_id(), v: F.xxhash64("text")}).join(keys, [i, v], "left_anti")
    return (kept.dropDuplicates([i, v]) if once else kept).select(*[F.col(f"`{c}`") for c in docs.columns])


@_stage
def known_language(spark, docs, sf_dir):
    """Documents whose language is not clear go; without a labelled document to learn from all stay."""
    return language_id.accepted(docs)


@_stage
def fresh_lines(spark, docs, sf_dir):
    """Lines that at least three documents share stay in the largest doc_id only; n_chars follows the text."""
    return line_dedup.cleaned(docs)


@_stage
def one_of_each(spark, docs, sf_dir):
    """Of each group of near copies the smallest doc_id stays (of texts that share it one), and of rows that repeat it one."""
    return _without(docs, minhash.near_components(docs).where("not kept"), once=True)


@_stage
def clean_of_tests(spark, docs, sf_dir):
    """Documents with a passage of the benchmark go."""
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"))


@_stage
def packed(spark, docs, sf_dir):
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", fresh_lines),
    ("near_dedup", one_of_each),
    ("decontamination", clean_of_tests),
    ("packing", packed),
]

#: Compression sizes and token ids have no SQL form; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder, and the next stage reads it."""
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = run_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
