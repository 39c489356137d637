"""A corpus clean-up in five stages; part of penstock.llm.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before kept, and returns a DataFrame that is written as
Parquet and read again. All but the last return the columns of documents.

toxicity          rows whose score is 0.5 or more go; the classifier is fitted on labelled rows of docs
near_duplicates   of each class of linked texts the row with the least doc_id stays; texts without words stay all
repeats           words of passages of 50 words or more that occur elsewhere too are cut out of the text, whatever their bytes
decontamination   rows with a passage of the benchmark go
packing           what is left becomes pieces of sequences of 1024 tokens

n_chars follows the text. Rows may share an id or have none: every stage decides by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import drop_table, materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from penstock.llm.toxicity import fit_toxicity, score_toxicity

    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs.select(*COLUMNS), model, COLUMNS).where("score < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from penstock.llm.ngram_jaccard import first_of_each_class

    return first_of_each_class(docs, COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from penstock.llm.suffix_dedup import remove_repeats

    cut = remove_repeats(docs, COLUMNS, n_words=50)
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from penstock.llm.decontamination import find_benchmark_passages

    found = find_benchmark_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), COLUMNS)
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from penstock.llm.packing import pack_documents

    return pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
            if before is not None:
                drop_table(before)
            before = docs
    return docs


#: A fitted classifier and a linear program cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
