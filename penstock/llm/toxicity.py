"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each once: its words (lower-cased ASCII letters, digits and all beyond ASCII), pairs of
neighbours, and pairs with one word between, hashed to ``2**bits`` coordinates. Training is FTRL-proximal with a
rate per coordinate; L1 keeps most weights at exactly 0, so the model is a short list of coordinates and weights whose
size is bounded by the training rows, and it is broadcast as such. Tasks score whole texts.

A fifth of the training rows is kept back; the logit that parts its two kinds best becomes score 0.5.

Training rows: labelled documents whose crc32(doc_id) mod 5 is not 0, at most ``max_rows`` of them (those with the
lowest hash of doc_id) with at most ``max_features`` features together. Tasks make the features where the texts are; the driver
gets those of the chosen rows alone. Only text is a feature.

Nulls and edge cases: null and empty texts get the score of the bias alone; null labels are no labels, of
several labels for an id the largest counts; a null doc_id is held out; repeated rows are scored alike; without labels
of both kinds every score is near the share of toxic rows, 0 or 1; other columns are ignored or carried, but for one named score
(ValueError); a score of just 0.5 is toxic; very long texts are read whole, in slices of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, ODD, bounded_rows, hash_words, mix64, pieces, reserve, text_buffer, words


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text, mod 5, is 0; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, coordinate) of each feature, with repeats, and the number of rows."""
    raw, offsets = text_buffer(column)
    raw = LOWER[raw]
    start, end, row = words(raw, offsets, ALNUM)
    h = hash_words(raw, start, end)
    shift = np.uint64(64 - bits)
    rows, coords = [row], [mix64(h) >> shift]
    for gap in (1, 2):
        if h.size > gap:
            same = row[:-gap] == row[gap:]
            pair = mix64(h[:-gap] * ODD[gap] + h[gap:] * ODD[gap + 3])
            rows.append(row[:-gap][same])
            coords.append(pair[same] >> shift)
    return np.concatenate(rows), np.concatenate(coords).astype(np.int64), len(offsets) - 1


def featurise(bits: int) -> callable:
    """Distinct coordinates of each text as little-endian unsigned 32-bit binaries, their number and a number of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in pieces(batch):
                row, at, n = features(part.column(part.schema.get_field_index("text")), bits)
                key = np.unique(row.astype(np.int64) << bits | at)
                cut = np.searchsorted(key, np.arange(n + 1) << bits)
                at = (key & ((1 << bits) - 1)).astype("<u4")
                out = [at[cut[i] : cut[i + 1]].tobytes() for i in range(n)]
                yield pa.record_batch(
                    [pa.array(np.arange(place, place + n)), part.column(part.schema.get_field_index("h")), pa.array(np.diff(cut).astype(np.int64)), part.column(part.schema.get_field_index("label")), pa.array(out, pa.binary())],
                    ["place", "h", "size", "label", "features"],
                )
                place += n

    return run


def train(rows: list[tuple[int, np.ndarray]], bits: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) of the weights that are not 0."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    share = sum(y for y, _ in rows) / len(rows) if rows else 0.0
    if share in (0.0, 1.0):
        return np.zeros(0, np.int64), np.zeros(0), 40.0 if share else -40.0
    bias, spread = np.log(share / (1 - share)), 1.0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for y, at in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            spread += g * g
            bias -= alpha / np.sqrt(spread) * g
    at = np.flatnonzero(np.abs(z) > l1)
    return at, weights(at), float(bias)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(h, label, text) of labelled documents outside the held-out fold, with at most max_rows different ids."""
    marked = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    # At most max_rows rows of two numbers are broadcast.
    h = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = marked.orderBy(h, "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(h.alias("h"), "label", F.coalesce("text", F.lit("")).alias("text"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 12_000, max_features: int = 40_000_000, bits: int = 20, alpha: float = 0.3, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, epochs: int = 3):
    """The model: (coordinates, weights, bias, bits)."""
    made = training_rows(docs, labels, label, max_rows).mapInArrow(featurise(bits), "place long, h long, size long, label int, features binary")
    got = bounded_rows(made, max_rows, max_features)
    data = [(int(y), np.frombuffer(x, "<u4")) for y, x in zip(got["label"].to_pylist(), got["features"].to_pylist())]
    at, weight, bias = train(data[len(data) // 5 :], bits, alpha, beta, l1, l2, epochs)
    table = np.zeros(1 << bits)
    table[at] = weight
    seen = [(bias + float(table[x].sum()), y) for y, x in data[: len(data) // 5]]
    return at, weight, bias - decision_point(seen), bits


def decision_point(seen: list[tuple[float, int]]) -> float:
    """The logit that parts the kinds best by F1, midway between its neighbours; 0 if either kind is missing."""
    seen = sorted(seen, reverse=True)
    toxic = sum(y for _, y in seen)
    if not 0 < toxic < len(seen):
        return 0.0
    best, cut, hits = -1.0, 0.0, 0
    for k, (x, y) in enumerate(seen):
        hits += y
        if k + 1 < len(seen) and seen[k + 1][0] < x and (f1 := 2 * hits / (k + 1 + toxic)) > best:
            best, cut = f1, (x + seen[k + 1][0]) / 2
    return cut


def score_toxicity(docs: DataFrame, model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry and the score of each row's whole text."""
    reserve(carry, ["score"])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, bias, bits = shared.value
        table = np.zeros(1 << bits, np.float64)
        table[at] = weight
        for batch in batches:
            for part in pieces(batch):
                row, coord, n = features(part.column(part.schema.get_field_index("text")), bits)
                hit = np.flatnonzero(table[coord])
                key = np.unique((row[hit] << bits) | coord[hit])
                total = np.bincount(key >> bits, weights=table[key & ((1 << bits) - 1)], minlength=n) + bias
                arrays = {c: part.column(part.schema.get_field_index(c)) for c in carry}
                arrays["score"] = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())
                yield pa.record_batch(list(arrays.values()), list(arrays))

    picked = docs.select(*carry, *([] if "text" in carry else ["text"]))
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField("score", T.DoubleType())])
    return picked.mapInArrow(run, schema)
