"""The operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import runs_kernel
from .byte_bpe import round_trip
from .common import scratch_path, table
from .decontaminate import contamination
from .html_text import main_texts
from .langid import languages
from .line_dedup import drop_recurring_lines
from .oracle import SQL
from .near_dedup import near_duplicates
from .packing import pack
from .periodic_runs import periodic_runs, run_digests
from .pii import personal_data
from .quality import quality
from .toxicity import toxicity
from .vector_codes import vector_codes
from .warc import read_archives, write_archives


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), uri)
    return read_archives(spark, uri).drop("url")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, docs, table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), rewrite=runs_kernel.tail_repeats))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_warc, op3_near_dedup, op4_language, op5_html_text, op6_quality, op7_decontaminate, op8_pii, op9_packing, op10_toxicity, op11_periodic_runs, op12_vector_codes, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in SQL.items() if name in queries()}
