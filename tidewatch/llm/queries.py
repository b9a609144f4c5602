"""The registered queries of this subpackage: one thin query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, conversations, decontam, html_style_tree, langid, minhash, mixing, quality, repeats, search, token_counts,
               token_files, urls)
from .queries_sql import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_html_style_tree(spark, sf_dir):
    return html_style_tree.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op2_minmax_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op3_repeated_strings(spark, sf_dir):
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


@query
def op4_quality_rules(spark, sf_dir):
    return quality.apply_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_url_filter(spark, sf_dir):
    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


@query
def op6_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents")).select(
        "doc_id", "held_out", "language.lang_pred", "language.score", "language.rejected")


@query
def op7_token_files(spark, sf_dir):
    manifest = token_files.write(_table(spark, sf_dir, "documents"), token_files.output_folder(spark))
    return token_files.read(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op8_decontamination(spark, sf_dir):
    found = decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "scan.n_words", "scan.n_hit", F.size("scan.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("scan.items", ","), 256).alias("items_sha256"), (F.col("scan.n_hit") > 0).alias("contaminated"))


@query
def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op10_mix_to_targets(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


@query
def op11_repair_conversations(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(rows), rows)


@query
def op12_shared_search(spark, sf_dir):
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op13_recursive_bpe(spark, sf_dir):
    coded = byte_bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
