"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm import bwt_dedup, byte_bpe, decontaminate, imatch, language, passages, quality, simhash, storage, token_files, url_templates
from rowtide.llm.oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = storage.small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def op1_url_templates(spark, sf_dir):
    return url_templates.filter_urls(table(spark, sf_dir, "pages", "page_id", "url"))


def op2_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, distance=2)
    return found.select("doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op3_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op4_byte_bpe(spark, sf_dir):
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    back = byte_bpe.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, pattern)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_passages(spark, sf_dir):
    found = passages.remove_passages(table(spark, sf_dir, "documents", "doc_id", "text"), size=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_bwt_dedup(spark, sf_dir):
    found = bwt_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), size=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_token_files(spark, sf_dir):
    folder = storage.fresh_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_imatch(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "text")
    return imatch.fingerprint_edits(documents, imatch.lexicon(documents))


QUERIES = {f.__name__: f for f in (op1_url_templates, op2_simhash, op3_language, op4_byte_bpe, op5_decontaminate, op6_passages, op7_bwt_dedup, op8_quality, op9_token_files, op10_imatch)}

__all__ = ["ORACLES", "QUERIES"]
