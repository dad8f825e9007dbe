"""The registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeingest.llm import (
    align, bitplane, filteraudit, hostwords, isoforest, labelprop, linewindows, loglinear, simhash, spacedseed, vecpack, wordids,
    wrappers,
)
from lakeingest.llm.common import table
from lakeingest.llm.tokens import public_tokenizer


def op1_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of id planes, read back."""
    manifest = bitplane.write(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), "word_end")
    return bitplane.read(manifest)


def op2_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeated windows cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linewindows.dedup(docs).select(
        "doc_id", "text", F.col("lw_lines").alias("n_lines"), F.col("lw_removed").alias("n_removed"))


def op3_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return wrappers.main_text(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = simhash.group(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op5_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and the model's log10 probability."""
    return loglinear.score(table(spark, sf_dir, "documents"))


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut into pieces and packed into sequences."""
    packed = vecpack.pack(table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"), "space_led")
    return packed.drop("loss_tokens", "n_segments")


def op7_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's rule counts and the verdict of base rules and forest."""
    docs = table(spark, sf_dir, "documents")
    forest = isoforest.fit(docs, table(spark, sf_dir, "labels"))
    return isoforest.judge(docs, forest).drop("score")


def op8_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards, equal texts together where the quotas allow it."""
    return labelprop.shard(table(spark, sf_dir, "documents"))


def op9_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return hostwords.judge(table(spark, sf_dir, "pages"))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlap of a document with a benchmark item."""
    return spacedseed.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two tokenizers, their groups and links, and how common the linked ids are."""
    paths = public_tokenizer("byte_bpe_50k.json"), public_tokenizer("piece_bpe_32k.model")
    return align.align(table(spark, sf_dir, "documents"), *paths)


def op12_word_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded bytes, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = wordids.decode(wordids.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, per source."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_id_planes": op1_id_planes,
    "op2_line_windows": op2_line_windows,
    "op3_host_wrappers": op3_host_wrappers,
    "op4_simhash": op4_simhash,
    "op5_log_bilinear": op5_log_bilinear,
    "op6_vector_packing": op6_vector_packing,
    "op7_quality_forest": op7_quality_forest,
    "op8_label_shards": op8_label_shards,
    "op9_host_words": op9_host_words,
    "op10_spaced_seeds": op10_spaced_seeds,
    "op11_token_links": op11_token_links,
    "op12_word_ids": op12_word_ids,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE: dict[str, str] = {"op2_line_windows": linewindows.SQL, "op13_filter_audit": filteraudit.SQL}
