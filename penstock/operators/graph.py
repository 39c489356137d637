"""Similarity graphs and PageRank: graphs of a document in Arrow batches, very large ones as iterated joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def pagerank(weights: np.ndarray, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """Power iteration over a symmetric weight matrix; nodes without links spread evenly."""
    n = len(weights)
    out = weights.sum(axis=1)
    share = np.divide(weights, out[:, None], out=np.zeros_like(weights), where=out[:, None] > 0)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * (rank @ share + rank[out == 0].sum() / n)
        done = np.abs(new - rank).sum() < n * tolerance
        rank = new
        if done:
            break
    return rank


class Bags(NamedTuple):
    """Bags of words of a text's sentences: entries of a sparse matrix in order of sentence; words that one sentence alone has are left out."""

    n: int
    at: np.ndarray  # sentence of each entry
    word: np.ndarray  # word of each entry, from 0
    k: np.ndarray  # how often it has it
    square: np.ndarray  # sum of squares of each whole bag


def bags_of(words: np.ndarray, sizes: np.ndarray) -> Bags:
    """words: numbers that stand for words, sentence after sentence; sizes: words per sentence."""
    n = len(sizes)
    _, word = np.unique(words, return_inverse=True)
    many = int(word.max()) + 1 if len(word) else 1
    entry, k = np.unique(np.repeat(np.arange(n), sizes) * many + word, return_counts=True)
    at, word, k = entry // many, entry % many, k.astype(float)
    square = np.bincount(at, k * k, n)
    shared = np.bincount(word, minlength=many) > 1
    keep = shared[word]
    return Bags(n, at[keep], (np.cumsum(shared) - 1)[word[keep]], k[keep], square)


def cosines(bags: Bags) -> np.ndarray:
    """Cosines of the bags, 0 on the diagonal. Products and squares are whole numbers, so a cosine at a threshold is not moved by rounding."""
    m = np.zeros((bags.n, int(bags.word.max()) + 1 if bags.word.size else 0))
    m[bags.at, bags.word] = bags.k
    sim = m @ m.T
    np.fill_diagonal(sim, 0)
    return np.divide(sim, np.sqrt(np.outer(bags.square, bags.square)), out=np.zeros_like(sim), where=sim > 0)


def iterated(n: int, given: Callable[[np.ndarray], np.ndarray], linked: np.ndarray, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """pagerank of a symmetric matrix that is known by its products; linked: rows that are not all 0."""
    out = given(np.ones(n))
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * (given(np.divide(rank, out, out=np.zeros(n), where=linked)) + rank[~linked].sum() / n)
        done = np.abs(new - rank).sum() < n * tolerance
        rank = new
        if done:
            break
    return rank


def sparse_pagerank(bags: Bags) -> np.ndarray:
    """pagerank(cosines(bags)) by products with the bags alone: a round costs what the text has words, not the square of its sentences."""
    n, many = bags.n, int(bags.word.max()) + 1 if bags.word.size else 0
    v = bags.k / np.sqrt(bags.square[bags.at])
    own = np.bincount(bags.at, v * v, n)
    # Every entry's word is in another sentence too, so a sentence with an entry has a link.
    return iterated(n, lambda s: np.bincount(bags.at, v * np.bincount(bags.word, v * s[bags.at], many)[bags.word], n) - own * s, np.bincount(bags.at, minlength=n) > 0)


def threshold_pagerank(bags: Bags, threshold: float, block: int = 512) -> np.ndarray:
    """pagerank of the cosines from the threshold on: they are kept as products of whole numbers, a byte a pair of sentences in most texts."""
    n, most = bags.n, bags.square.max()
    m = np.zeros((n, int(bags.word.max()) + 1 if bags.word.size else 0), np.float32 if most < 1 << 24 else float)  # whole numbers stay exact
    m[bags.at, bags.word] = bags.k
    dots = np.zeros((n, n), np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint64)  # no product is above the largest square
    for i in range(0, n, block):
        dot = (m[i : i + block] @ m[i:].T).astype(float)
        dot[dot / np.sqrt(np.outer(bags.square[i : i + block], bags.square[i:])) < threshold] = 0
        np.fill_diagonal(dot, 0)
        dots[i : i + block, i:] = dot
        dots[i:, i : i + block] = dot.T
    root = np.sqrt(bags.square)
    del m

    def given(s: np.ndarray) -> np.ndarray:
        return np.concatenate([dots[i : i + block].astype(float) @ (s / root) for i in range(0, n, block)]) / root

    return iterated(n, given, dots.any(axis=1))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups: rows of one key follow each other, and what a batch's last key may yet go on with is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_pandas().to_numpy()
        if not keys.size:
            continue
        cut = int(np.flatnonzero(~same(keys, keys[-1]))[-1]) + 1 if not same(keys, keys[-1]).all() else 0
        if held and not same(held[-1].column(batch.schema.get_field_index(key)).slice(held[-1].num_rows - 1).to_pandas().to_numpy(), keys[0])[0]:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def same(keys: np.ndarray, key) -> np.ndarray:
    """Where keys are key; a null is as a null."""
    return pd.isna(keys) if pd.isna(key) else keys == key


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys, and the end."""
    null = pd.isna(keys)
    new = (null[1:] != null[:-1]) | (~null[1:] & ~null[:-1] & (keys[1:] != keys[:-1]))
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys)]])


def word_numbers(words: str = "words") -> Column:
    """Numbers that stand for the words in lower case: 64 bits of a hash, compared within one text."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def numbered_words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, offsets of rows) of a column of lists."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def central_sentences(sentences: DataFrame, threshold: float = 0.1, dense: int = 500) -> DataFrame:
    """doc_id, sent_idx, rank (largest is 1): sentences by PageRank over bag-of-words cosines, without word vectors.

    Sentences are exchanged by document as numbers of words and go by in order; a task holds one document's matrix at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "doc_id"):
            bounds = group_bounds(table["doc_id"].to_pandas().to_numpy())
            words, offsets = numbered_words(table["_w"])
            ranks = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                bags = bags_of(words[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1]))
                if bags.n <= dense:
                    sim = cosines(bags)
                    r = pagerank(np.where(sim >= threshold, sim, 0.0))
                else:
                    r = threshold_pagerank(bags, threshold)
                ranks.append(r / r.max())
            for batch in pa.table({"doc_id": table["doc_id"], "sent_idx": table["sent_idx"], "rank": pa.array(np.concatenate(ranks))}).combine_chunks().to_batches():
                yield batch

    rows = sentences.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("sent_idx").cast("long").alias("sent_idx"), word_numbers().alias("_w"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "sent_idx").mapInArrow(run, "doc_id long, sent_idx long, rank double")


def similarities(sentences: DataFrame, threshold: float) -> DataFrame:
    """doc_id, a, b, w: bag-of-words cosines of at least the threshold between a document's sentences, both ways."""
    bags = sentences.select("doc_id", "sent_idx", F.explode(F.transform("words", F.lower)).alias("word")).groupBy("doc_id", "sent_idx", "word").agg(F.count("*").alias("k"))
    norm = bags.groupBy("doc_id", "sent_idx").agg(F.sum(F.col("k") * F.col("k")).alias("q"))
    bags = bags.join(norm, ["doc_id", "sent_idx"])
    x, y = bags.select("doc_id", "word", F.col("sent_idx").alias("a"), F.col("k").alias("_x"), F.col("q").alias("_p")), bags.select("doc_id", "word", F.col("sent_idx").alias("b"), F.col("k").alias("_y"), F.col("q").alias("_q"))
    half = x.join(y, ["doc_id", "word"]).where("a < b").groupBy("doc_id", "a", "b").agg((F.sum(F.col("_x") * F.col("_y")) / F.sqrt((F.first("_p") * F.first("_q")).cast("double"))).alias("w")).where(F.col("w") >= threshold)
    return half.unionByName(half.select("doc_id", F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def joined_ranks(sentences: DataFrame, threshold: float, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-8) -> DataFrame:
    """The rows of central_sentences by iterated joins; a document stays as it is once its ranks have settled."""
    edges = checkpointed(similarities(sentences, threshold))
    size = sentences.groupBy("doc_id").agg(F.count("*").alias("n"))
    out = edges.groupBy("doc_id", F.col("a").alias("sent_idx")).agg(F.sum("w").alias("out"))
    nodes = sentences.select("doc_id", "sent_idx").join(size, "doc_id").join(out, ["doc_id", "sent_idx"], "left")
    nodes = nodes.select("doc_id", "sent_idx", "n", "out", (1.0 / F.col("n")).alias("rank"), F.lit(False).alias("done"))
    nodes = checkpointed(nodes)
    for _ in range(rounds):
        given = edges.join(nodes.where("not done").select("doc_id", F.col("sent_idx").alias("a"), (F.col("rank") / F.col("out")).alias("s")), ["doc_id", "a"])
        given = given.groupBy("doc_id", F.col("b").alias("sent_idx")).agg(F.sum(F.col("s") * F.col("w")).alias("got"))
        loose = nodes.groupBy("doc_id").agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        new = (1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / F.col("n"))
        step = nodes.join(given, ["doc_id", "sent_idx"], "left").join(loose, "doc_id").withColumn("new", F.when(F.col("done"), F.col("rank")).otherwise(new))
        moved = step.groupBy("doc_id").agg(F.sum(F.abs(F.col("new") - F.col("rank"))).alias("moved"))
        nodes = step.join(moved, "doc_id").select("doc_id", "sent_idx", "n", "out", F.col("new").alias("rank"), (F.col("done") | (F.col("moved") < F.col("n") * tolerance)).alias("done"))
        nodes = checkpointed(nodes)
        if nodes.where("not done").isEmpty():
            break
    top = nodes.groupBy("doc_id").agg(F.max("rank").alias("top"))
    return nodes.join(top, "doc_id").select("doc_id", "sent_idx", (F.col("rank") / F.col("top")).alias("rank"))


def central_sentences_any_length(sentences: DataFrame, threshold: float = 0.1, most: int = 16_000) -> DataFrame:
    """central_sentences for documents of every length: up to `most` sentences in one task (256 MB at a byte a pair), longer ones by iterated joins."""
    long_ = sentences.groupBy("doc_id").agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("doc_id")
    long_ = checkpointed(long_)
    short = central_sentences(sentences.join(long_, "doc_id", "left_anti"), threshold)
    if long_.isEmpty():
        return short
    return short.unionByName(joined_ranks(sentences.join(long_, "doc_id", "left_semi"), threshold))


def degree_weights(edges: DataFrame) -> DataFrame:
    """node, weight, degree of an undirected edge table (a, b, w)."""
    both = edges.select(F.col("a").alias("node"), "w").unionByName(edges.select(F.col("b").alias("node"), "w"))
    return both.groupBy("node").agg(F.sum("w").alias("weight"), F.count("*").alias("degree"))


def cooccurrence(sentences: DataFrame, concepts: DataFrame) -> DataFrame:
    """doc_id, a, b, n: how many sentences of a document hold both of two concept words (a before b)."""
    w = sentences.select("doc_id", "sent_idx", F.explode(F.array_distinct(F.transform("words", F.lower))).alias("c")).join(concepts, "c", "left_semi")
    x, y = w.select("doc_id", "sent_idx", F.col("c").alias("a")), w.select("doc_id", "sent_idx", F.col("c").alias("b"))
    return x.join(y, ["doc_id", "sent_idx"]).where("a < b").groupBy("doc_id", "a", "b").agg(F.count("*").alias("n"))
