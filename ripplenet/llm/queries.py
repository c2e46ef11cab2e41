"""Queries that apply the operators to the registered tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import oracles
from .collocations import mine_phrases
from .diffcover import remove_repeated_windows
from .hard_negatives import mine_negatives
from .hilbert import hilbert_shards
from .html_paths import extract_pages
from .langid import identify
from .orc_tokens import read_token_files, token_digests, write_token_files
from .prefix_free import remove_repeated_bytes
from .quality_rules import quality_verdicts
from .soft_mixing import mix_to_targets, quality_domains
from .superminhash import near_duplicates
from .templates import contaminated
from .url_filter import judge_urls


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(c.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(c.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op3_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(c.table(spark, sf_dir, "pages"))


def op4_url_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(c.table(spark, sf_dir, "pages"), html_col="html").select("page_id", "host", "path", "rule", "verdict")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    out = identify(docs, docs.where(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "shares")


def op6_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"), shingle_words=2)


def op7_prefix_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(c.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), "kept_sha256")


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = quality_domains(c.table(spark, sf_dir, "labels"))
    return mix_to_targets(c.table(spark, sf_dir, "documents"), labels, {"good": 0.95, "low": 0.05, "toxic": 0.0})


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "item_ids", "covered_words")


def op10_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(c.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_phrase_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(c.table(spark, sf_dir, "documents"))


def op12_pca_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = c.table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(vectors.withColumn("label", relabelled))


def op13_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = c.Scratch(spark, "orc-tokens").folder("files")
    write_token_files(c.table(spark, sf_dir, "documents"), path)
    return token_digests(read_token_files(spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_rules,
        op2_hilbert_shards,
        op3_tag_paths,
        op4_url_segments,
        op5_language_mixture,
        op6_superminhash,
        op7_prefix_free,
        op8_soft_mixing,
        op9_template_leaks,
        op10_difference_cover,
        op11_phrase_bitmaps,
        op12_pca_negatives,
        op13_orc_tokens,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": oracles.QUALITY,
        "op6_superminhash": oracles.NEAR_DUPLICATES,
        "op10_difference_cover": oracles.REPEATED_WINDOWS,
        "op11_phrase_bitmaps": oracles.PHRASES,
        "op12_pca_negatives": oracles.HARD_NEGATIVES,
    }
