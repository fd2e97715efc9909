"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import binary_output, decontaminate, hard_negatives, html_text, language, line_dedup, near_dup, packing, pieces, quality, sharding, suffix_dedup, whitening
from quillon.llm.common import crc32_utf8, table
from quillon.llm.tokens import default_tokenizer

#: Old shards of the resharding query: documents lie sharded by a hash of their source, so one source makes one hot shard.
OLD_SHARDS = 16


def op1_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = sharding.reshard_files(docs, F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS)), shards=8)
    # the digest is of the texts as they lie in the new shards' files
    written = {"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, "text_crc32": F.coalesce(crc32_utf8(F.col("text")), F.lit(0)).cast("long")}
    return done.withColumns(written).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard", "moved")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), default_tokenizer(), capacity=2048, end_id=0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "item_ids", "distance")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.token_output(table(spark, sf_dir, "documents"), default_tokenizer(), end_id=1)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(language.fold(F.col("doc_id")) != 0))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", (language.fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return done.select("doc_id", "n_lines", "n_removed", crc32_utf8(F.col("text")).alias("text_crc32"), F.octet_length("text").cast("long").alias("n_bytes"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.hard_negatives(rows)


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode(table(spark, sf_dir, "documents"), pieces.default_piece_model(), decoded=True)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_resharding, op2_packing, op3_quality_rules, op4_decontamination, op5_token_output, op6_html_extraction, op7_near_dedup, op8_language_id, op9_line_dedup, op10_suffix_dedup, op11_hard_negatives, op12_sentencepiece, op13_whitening)}
ORACLES: dict[str, str] = {"op3_quality_rules": quality.oracle(), "op6_html_extraction": html_text.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE}
