"""The registered queries of this package: ``QUERIES[name](spark, folder)``, and SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crossover.llm import oracles
from crossover.llm.common import read, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_benchmark_decontamination", oracles.DECONTAMINATION)
def decontamination(spark, folder):
    from crossover.llm.decontaminate import decontaminate

    return decontaminate(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("id", "v")


@query("op5_line_dedup", oracles.LINE_DEDUP)
def line_dedup(spark, folder):
    from crossover.llm.line_dedup import line_report

    return line_report(read(spark, folder, "documents"))


@query("op7_substring_dedup", oracles.SUBSTRING_DEDUP)
def substring_dedup(spark, folder):
    from crossover.llm.substring_dedup import substring_report

    return substring_report(read(spark, folder, "documents"))


@query("op6_minhash_near_dedup", oracles.NEAR_DEDUP)
def near_dedup(spark, folder):
    from crossover.llm.minhash import near_report

    return near_report(read(spark, folder, "documents"), k=4)


@query("op2_token_files")
def token_files(spark, folder):
    from crossover.llm.token_files import token_report

    return token_report(read(spark, folder, "documents"))


@query("op10_best_fit_packing")
def best_fit_packing(spark, folder):
    from crossover.llm.packing import pack

    return pack(read(spark, folder, "documents"))


@query("op3_language_id")
def language_id(spark, folder):
    from crossover.llm.language_id import language_report

    return language_report(read(spark, folder, "documents"))


@query("op8_line_quality", oracles.LINE_QUALITY)
def line_quality(spark, folder):
    from crossover.llm.line_quality import quality_report

    return quality_report(read(spark, folder, "documents"))


@query("op4_merkle_fixity", oracles.FIXITY)
def merkle_fixity(spark, folder):
    from crossover.llm.fixity import audit, build_tree, damaged

    pages = read(spark, folder, "pages")
    return audit(build_tree(pages), build_tree(damaged(pages)))


@query("op9_quotation_linking", oracles.QUOTES)
def quotation_linking(spark, folder):
    from crossover.llm.quotes import link_conversations, quoted_mail

    return link_conversations(quoted_mail(read(spark, folder, "conversations")))


@query("op11_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark, folder):
    from crossover.llm.alignment import align

    return align(read(spark, folder, "documents"))


@query("op12_phrase_mining", oracles.PHRASE_MINING)
def phrase_mining(spark, folder):
    from crossover.llm.phrases import phrase_report

    return phrase_report(read(spark, folder, "documents"))


@query("op13_secret_scan")
def secret_scan(spark, folder):
    from crossover.llm.secrets import secret_report

    return secret_report(read(spark, folder, "documents"))
