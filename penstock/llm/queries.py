"""The registered queries of this subpackage; ORACLES has the SQL that gives their rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLES  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_quality_rules

    return apply_quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import near_duplicate_classes

    return near_duplicate_classes(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats, repeat_digest

    return repeat_digest(remove_repeats(documents(spark, sf_dir)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, held_out, score_toxicity

    docs = documents(spark, sf_dir)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_shards import order_folder, read_back, write_training_order

    folder = order_folder(spark)
    written, count = write_training_order(documents(spark, sf_dir), folder)
    crc = read_back(spark, folder, count).select("slot", F.crc32("ids").alias("ids_crc32"))
    # Both sides have a row per sequence, so neither is broadcast, whatever the planner guesses of a Python step's size.
    return written.hint("merge").join(crc.hint("merge"), "slot").select("slot", "number", "shard", "record", "n_tokens", "doc_ids", "ids_crc32")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import fit_language_id, identify_language
    from .toxicity import held_out

    docs = documents(spark, sf_dir)
    return identify_language(docs, fit_language_id(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_folder, read_archives, write_archives

    folder = archive_folder(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder).agg(F.sum("records")).collect()
    return read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_benchmark_passages, hit_digest

    return hit_digest(find_benchmark_passages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, middle_digest

    return middle_digest(fill_in_middle(documents(spark, sf_dir)))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import fit_quality, held_out, score_quality

    docs = documents(spark, sf_dir)
    net = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op") and callable(f)}
