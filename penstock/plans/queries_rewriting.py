"""Queries on rewriting: candidates, what a rewrite does to the words around it, and whole documents. Folds, so no SQL; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edit_sets as ES
from ..operators import packed_model as PM
from ..operators import rewrite_loop as RL
from .seeded import seeded


def edit_candidates(spark, sf_dir):
    """Candidates of every sentence of the seeded documents, with what they change."""
    rows = ES.propose(RL.text_pieces(seeded(spark, sf_dir)).select("doc_id", "piece_idx", "sentence"))  # what stands around a sentence is not looked for
    each = rows.select("doc_id", "piece_idx", F.posexplode("candidates").alias("place", "c"))
    return each.select("doc_id", "piece_idx", "place", F.size("c.edits").alias("n_edits"), F.md5("c.text").alias("digest"))


def changed_turns(spark, sf_dir):
    """Every turn of the conversations with its middle word replaced by its first: the words kept, in both contexts."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    model = PM.fit_packed(turns.select("text"), 50_000, 2)
    rows = turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("old")).withColumn("_w", F.split("old", " ")).withColumn("_k", (F.size("_w") / 2).cast("int"))
    start = F.length(F.array_join(F.slice("_w", 1, F.col("_k")), " ")) + F.when(F.col("_k") > 0, 1).otherwise(0)
    edit = F.struct(start.cast("int").alias("start"), (start + F.length(F.get("_w", F.col("_k")))).cast("int").alias("end"), F.get("_w", F.lit(0)).alias("replacement"), F.lit("swap").alias("transform"))
    rows = rows.withColumn("edits", F.array(edit))
    new = F.concat(F.substr("old", F.lit(1), F.col("edits")[0]["start"]), F.col("edits")[0]["replacement"], F.substr("old", F.col("edits")[0]["end"] + 1))
    rows = rows.select("conv_id", "turn", "old", new.alias("new"), "edits")
    rows = PM.with_logprobs_of(rows, {"old": "_o", "new": "_n"}, model)
    deltas = RL.paired_deltas(rows.select("conv_id", "turn", "old", "new", "edits", RL.probabilities("_o").alias("old_p"), RL.probabilities("_n").alias("new_p")))
    return deltas.select("conv_id", "turn", F.round("ref", 6).alias("ref"), F.round("delta", 6).alias("delta"), "n_kept", F.round("meaning", 6).alias("meaning"))


def rewritten_documents(spark, sf_dir):
    """The seeded documents, rewritten sentence by sentence under a model of the English ones."""
    docs = seeded(spark, sf_dir)
    model = PM.fit_packed(docs.where("lang = 'en'").select("text"), 50_000, 2)
    done = RL.rewrite_documents(docs, model)
    return done.select("doc_id", "n_sentences", "n_candidates", "n_changed", F.aggregate(F.map_values("rejected"), F.lit(0), lambda a, x: a + x).alias("n_rejected"), F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (edit_candidates, changed_turns, rewritten_documents)}
ORACLES: dict[str, str] = {}
