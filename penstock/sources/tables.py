"""Readers and writers of document tables. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


def read_documents(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Documents of Parquet, JSON lines, ORC or CSV files; or of plain text files, one document a file."""
    if kind == "text":
        files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))
        return files.select(F.xxhash64("source").alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"), "source")
    reader = spark.read.format(kind).schema(DOCUMENTS)
    if kind == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"')
    return reader.load(path)


def within_word_limit(docs: DataFrame, most: int = 3000) -> tuple[DataFrame, DataFrame]:
    """(documents within the limit, those over it)."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    return docs.where(n <= most), docs.where(n > most)


#: The most bytes of the input's files that one task is dealt.
TASK_BYTES = 16 << 20


def input_bytes(rows: DataFrame, looked_at: int = 100) -> int:
    """Bytes of the files that rows come from, 0 if from none; of more than `looked_at` files about so many: the others count as these do on average."""
    files, context = rows.inputFiles(), rows.sparkSession.sparkContext
    fs, uri = context._jvm.org.apache.hadoop.fs, context._jvm.java.net.URI
    paths = [fs.Path(uri(f)) for f in files[:looked_at]]
    return sum(p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths) * len(files) // max(len(paths), 1)


def read_table(spark: SparkSession, path: str, even: bool = False) -> DataFrame:
    """A Parquet table; where it has fewer files than the cluster has cores, its rows are dealt out once over the cores, in parts of TASK_BYTES at most.

    A file is often a single row group, and a row group is a task: a small table would keep one core busy. Tables of many files are read as they are;
    with even, for work that takes long over a row, those whose files are larger than TASK_BYTES are dealt out too.
    """
    table = spark.read.parquet(path)
    cores, files, size = spark.sparkContext.defaultParallelism, len(table.inputFiles()), input_bytes(table)
    return table.repartition(max(cores, -(-size // TASK_BYTES))) if files < cores or even and size > files * TASK_BYTES else table


def corpus_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line of all lines but headings (= marks) and blank ones."""
    return docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"\S") & ~F.col("line").rlike(r"^\s*=+ .* =+\s*$"))


def write_ngrams(counts: dict[int, DataFrame], path: str) -> None:
    """A count table per order below path, as read_ngrams() reads them."""
    for n, table in counts.items():
        table.write.mode("overwrite").parquet(f"{path}/order={n}")


def read_ngrams(spark: SparkSession, path: str) -> dict[int, DataFrame]:
    return {n: spark.read.schema("gram string, n long").parquet(f"{path}/order={n}") for n in (1, 2, 3)}


def reflow(lines: DataFrame) -> DataFrame:
    """doc_id, para_idx, para_text: wrapped lines (doc_id, line_idx, line) joined; blank lines and ends of sentences before capitals part."""
    log = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_idx", "line"))).alias("l"))
    joined = F.concat_ws("\n", F.transform("l", lambda x: F.trim(x["line"])))
    text = F.regexp_replace(joined, r"([a-z])-\n([a-z])", "$1$2")  # a word cut at the line's end
    text = F.regexp_replace(text, r"([.!?:])\n(?=[A-Z])", "$1\n\n")
    parts = F.transform(F.split(text, r"\n\n+"), lambda x: F.trim(F.regexp_replace(x, r"\s*\n\s*", " ")))
    rows = log.select("doc_id", F.posexplode(F.filter(parts, lambda x: x != "")).alias("para_idx", "para_text"))
    return rows.select("doc_id", F.col("para_idx").cast("long"), "para_text")
