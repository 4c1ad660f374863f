"""One registered query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm import collocations, extraction, language, lines, lm, manifest, merkle, mixing, packing, planes, quality, simhash, sql, tokens, urls
from claimscope.llm.common import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(documents(spark, sf_dir))
    judged = quality.apply_policy(quality.apply_policy(entries, quality.BASE, into="base_kept"), quality.STANDARD)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"),
        "kept",
        "failed_bits",
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), tokens.tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(documents(spark, sf_dir))
    return taken.select("_row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = planes.new_folder(spark)
    manifest = planes.write(documents(spark, sf_dir), tokens.tokenizer_path(), folder)
    rows = planes.read(spark, manifest, folder)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), by_query=True)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = merkle.edit_report(documents(spark, sf_dir))
    return report.withColumn("edits", merkle.edit_places(F.col("edits")))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_report(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", "n_chars")


QUERIES = (
    op1_language_id,
    op2_quality_rules,
    op3_line_dedup,
    op4_packing,
    op5_lm_scoring,
    op6_simhash,
    op7_mixing,
    op8_token_planes,
    op9_url_filters,
    op10_fingerprints,
    op11_manifest,
    op12_collocations,
    op13_html_extraction,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
