"""Quality by a byte-level convolutional network in numpy.

Layers: an embedding of bytes; ``filters`` learned filters, each over ``width`` bytes at every place of the text; chunks of two blocks of
``block`` places, each chunk overlapping the next by a block, so that every window of the whole document is in a chunk; the largest
answer of each filter in a chunk, through a rectifier; the mean and the maximum over a document's chunks; a logistic unit that
combines both into one probability. A window at a block's end reads into the next block, so no window is cut; after a text's end it reads padding.
``width`` divides ``block``.

Training: Adam on the log loss, gradients by hand. Only the window with the largest answer of a chunk gets a gradient. A fifth of the
rows is kept back: the logit that parts its two kinds best becomes score 0.5.

Training rows: labelled documents whose crc32(doc_id) mod 3 is not 1, at most ``max_rows`` of them (those with the lowest hash of doc_id) of
``max_bytes`` together (a text that would exceed it is passed over). Only text is a feature. Tasks score whole texts, ``BLOCKS`` blocks
at a time, whatever a text's length; the model (some ten kilobytes) is broadcast.

Nulls and edge cases: a null text is an empty one, and an empty text is one chunk of padding; null labels are no labels, of several
labels for an id the largest counts; a null doc_id is held out; repeated rows are scored alike; without labels of both kinds every score is near
the share of good rows, 0 or 1; a score of just 0.5 is good; other columns are ignored or carried, but for one named score (ValueError);
of equal answers in a chunk the first gets the gradient; a NUL byte counts as padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_rows, pieces, reserve, text_buffer
from .toxicity import decision_point

#: Blocks (of ``block`` places) whose answers are computed at once.
BLOCKS = 256


class Network(NamedTuple):
    embed: np.ndarray  # 256 x dims; padding (byte 0) is a row of its own
    filters: np.ndarray  # width * dims x filters
    bias: np.ndarray  # filters
    out: np.ndarray  # 2 * filters: of the mean, of the maximum
    shift: float
    width: int
    block: int


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text, mod 3, is 1; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def lay_out(raw: np.ndarray, offsets: np.ndarray, width: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts in whole blocks, filled up with zeros, and the first block of each text (and the end)."""
    size = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(np.maximum(-(-size // block), 1))])
    laid = np.zeros(int(first[-1]) * block + width, np.uint8)
    laid[np.arange(raw.size) + np.repeat(first[:-1] * block - offsets[:-1], size)] = raw
    return laid, first


def block_answers(net: Network, laid: np.ndarray, first: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest answer of each filter in each block and, if asked for, the place of its window.

    A block is read with ``width`` bytes of the next one, or zeros where its text ends.
    """
    w, h, blocks = net.width, net.block, int(first[-1])
    ends = np.zeros(blocks, bool)
    ends[first[1:] - 1] = True
    best = np.empty((blocks, net.bias.size), np.float32)
    where = np.zeros(best.shape, np.int64) if places else None
    for a in range(0, blocks, BLOCKS):
        b = min(blocks, a + BLOCKS)
        read = np.lib.stride_tricks.as_strided(laid[a * h :], (b - a, h + w), (h, 1)).copy()
        read[ends[a:b], h:] = 0
        e = net.embed[np.append(read.ravel(), np.zeros(w, np.uint8))]
        top = None
        for phase in range(w):
            # Windows that start at phase, phase + w, ... lie end to end: a matrix without a copy.
            x = e[phase : phase + (b - a) * (h + w)].reshape(-1, w * e.shape[1]) @ net.filters
            x = x.reshape(b - a, h // w + 1, -1)[:, : h // w]
            if places:
                k = x.argmax(axis=1)
                m = np.take_along_axis(x, k[:, None], axis=1)[:, 0]
                k = k * w + phase + (np.arange(a, b) * h)[:, None]
                better = np.ones(m.shape, bool) if top is None else m > top
                where[a:b] = np.where(better, k, where[a:b])
            else:
                m = x.max(axis=1)
            top = m if top is None else np.maximum(top, m)
        best[a:b] = top
    return best, where


def chunks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left block, right block, first chunk of each document): neighbours of a document; a single block is a chunk alone."""
    blocks = np.diff(first)
    many = np.maximum(blocks - 1, 1)
    start = np.concatenate([[0], np.cumsum(many)])
    left = np.arange(int(start[-1])) + np.repeat(first[:-1] - start[:-1], many)
    return left, left + np.repeat((blocks > 1).astype(np.int64), many), start


def logits(net: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    laid, first = lay_out(raw, offsets, net.width, net.block)
    best, _ = block_answers(net, laid, first)
    left, right, start = chunks_of(first)
    pooled = np.maximum(np.maximum(best[left], best[right]) + net.bias, 0)
    mean = np.add.reduceat(pooled, start[:-1], axis=0) / np.diff(start)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(pooled, start[:-1], axis=0)], axis=1) @ net.out + net.shift


def gradients(net: Network, raw: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss, for embed, filters, bias, out and shift."""
    w, f, dims = net.width, net.bias.size, net.embed.shape[1]
    laid, first = lay_out(raw, offsets, w, net.block)
    best, where = block_answers(net, laid, first, places=True)
    left, right, start = chunks_of(first)
    side = np.where((best[left] >= best[right]), left[:, None], right[:, None])
    pooled = np.maximum(np.take_along_axis(best, side, axis=0) + net.bias, 0)
    n = np.diff(start)
    mean, most = np.add.reduceat(pooled, start[:-1], axis=0) / n[:, None], np.maximum.reduceat(pooled, start[:-1], axis=0)
    both = np.concatenate([mean, most], axis=1)
    error = (1 / (1 + np.exp(-np.clip(both @ net.out + net.shift, -35, 35))) - y) / y.size
    own = np.repeat(np.arange(y.size), n)
    back = (error / n)[own][:, None] * net.out[:f]
    # The maximum over chunks goes to the first chunk that reaches it.
    reached = pooled == most[own]
    count = np.cumsum(reached, axis=0)
    before = np.where(start[:-1, None] > 0, count[start[:-1] - 1], 0)
    back += np.where(reached & (count - before[own] == 1), error[own][:, None] * net.out[f:], 0)
    back *= pooled > 0
    d_block = np.zeros(best.shape)
    np.add.at(d_block, (side.ravel(), np.tile(np.arange(f), side.shape[0])), back.ravel())
    block, k = np.nonzero(d_block)
    g = d_block[block, k]
    at = where[block, k][:, None] + np.arange(w)
    end = (first[1:] * net.block)[np.searchsorted(first, block, side="right") - 1]
    window = np.where(at < end[:, None], laid[at], 0)
    d_filters = np.zeros((f, w * dims))
    np.add.at(d_filters, k, g[:, None] * net.embed[window].reshape(k.size, -1))
    d_embed = np.zeros(net.embed.shape)
    pulled = g[:, None] * net.filters.T[k]
    np.add.at(d_embed, window.ravel(), pulled.reshape(-1, dims))
    d_embed[0] = 0
    return [d_embed, d_filters.T, back.sum(axis=0), both.T @ error, np.array(error.sum())]


def train(rows: list[tuple[int, bytes]], dims: int, filters: int, width: int, block: int, epochs: int, batch: int, rate: float) -> Network:
    rng = np.random.default_rng(11)
    embed = rng.normal(0, 0.5, (256, dims))
    embed[0] = 0
    share = sum(y for y, _ in rows) / len(rows) if rows else 0.0
    parts = [embed, rng.normal(0, 1 / np.sqrt(width * dims), (width * dims, filters)), np.zeros(filters), rng.normal(0, 0.1, 2 * filters), np.array(0.0)]
    net = lambda: Network(parts[0].astype(np.float32), parts[1].astype(np.float32), parts[2].astype(np.float32), parts[3], float(parts[4]), width, block)
    if share in (0.0, 1.0):
        parts[3][:] = 0
        parts[4] = np.array(40.0 if share else -40.0)
        return net()
    parts[4] = np.array(np.log(share / (1 - share)))
    first, second = [np.zeros(p.shape) for p in parts], [np.zeros(p.shape) for p in parts]
    step, steps = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            chosen = [rows[i] for i in order[a : a + batch].tolist()]
            raw = np.frombuffer(b"".join(t for _, t in chosen), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in chosen])])
            grads = gradients(net(), raw, offsets, np.array([y for y, _ in chosen], float))
            step += 1
            eta = rate * (1 - step / (steps + 1))
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                parts[i] = parts[i] - eta * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return net()


def training_texts(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(place, h, size, label, features: the text's bytes) of labelled documents outside the held-out fold."""
    marked = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    # At most max_rows rows of two numbers are broadcast.
    chosen = marked.orderBy(h, "doc_id").limit(max_rows)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.monotonically_increasing_id().alias("place"), h.alias("h"), F.octet_length(text).cast("long").alias("size"), "label", text.cast("binary").alias("features"))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 4000, max_bytes: int = 12_000_000, dims: int = 8, filters: int = 24, width: int = 16, block: int = 256, epochs: int = 10, batch: int = 16, rate: float = 0.01) -> Network:
    """The network, its score 0.5 at the logit that parts the kept-back rows best."""
    got = bounded_rows(training_texts(docs, labels, label, max_rows), max_rows, max_bytes)
    data = list(zip(got["label"].to_pylist(), got["features"].to_pylist()))
    kept_back = data[: len(data) // 5]
    net = train(data[len(data) // 5 :], dims, filters, width, block, epochs, batch, rate)
    if not kept_back:
        return net
    seen = [(float(logits(net, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]), y) for y, t in kept_back]
    return net._replace(shift=net.shift - parting(seen))


def parting(seen: list[tuple[float, int]]) -> float:
    """The logit that parts good and bad texts best, bad ones being the rarer kind that is looked for."""
    return -decision_point([(-x, 1 - y) for x, y in seen])


def score_quality(docs: DataFrame, net: Network, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry and the score of each row's whole text."""
    reserve(carry, ["score"])
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch):
                raw, offsets = text_buffer(part.column(part.schema.get_field_index("text")))
                arrays = {c: part.column(part.schema.get_field_index(c)) for c in carry}
                arrays["score"] = pa.array(1 / (1 + np.exp(-np.clip(logits(model, raw, offsets), -35, 35))), pa.float64())
                yield pa.record_batch(list(arrays.values()), list(arrays))

    picked = docs.select(*carry, *([] if "text" in carry else ["text"]))
    return picked.mapInArrow(run, T.StructType([*[docs.schema[c] for c in carry], T.StructField("score", T.DoubleType())]))
