"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are all strings of 2, 3 and 4 bytes after ASCII lower-casing and turning other ASCII into
spaces, hashed to ``buckets``. Their embeddings are averaged and a linear softmax gives the languages. Both layers are
trained together by stochastic gradient descent in numpy; for prediction they fold into one bucket x language table. A
bucket's share in a text counts in full going forward; its step back is cut at four times the mean share, so that a few frequent
subwords do not swing.
A temperature is fitted on a fifth of the training rows that the descent did not see, and there too the least score is found
from which on at least ``precision`` of the predictions are right: below it, `accepted` is false.

Training rows: documents with a language and crc32(doc_id) mod 5 not 0, at most ``max_rows`` (lowest hash of doc_id).

Nulls and edge cases: a null text or one without a letter is `und`, score 0, not accepted; a null lang is not learned from;
a null doc_id is held out; without training rows everything is `und`; very long texts are read whole; repeated rows get
the same result; other columns are ignored; of equally likely languages the first in the alphabet is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, byte_table, pieces, text_buffer
from .toxicity import held_out

SIZES = (2, 3, 4)
#: a-z and bytes beyond ASCII stay, A-Z are lowered, all else is a space.
LETTER = byte_table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if LETTER[b] else 32 for b in range(256)], np.uint32)
BITS = 15


def subwords(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: the bucket at every byte, flags of places where the subword stays in its text, and the text offsets."""
    raw, offsets = text_buffer(column)
    b = np.concatenate([FOLD[raw], np.full(max(SIZES), 32, np.uint32)])
    x = b[: raw.size] + np.uint32(1)
    for k in range(1, max(SIZES)):
        x = x * np.uint32(0x01000193) ^ b[k : k + raw.size]
        if k + 1 in SIZES:
            bucket = (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            inside = np.ones(raw.size, bool)
            for back in range(1, k + 1):
                at = offsets[1:] - back
                inside[at[at >= offsets[:-1]]] = False
            yield bucket, inside, offsets


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A number of the row, h, lang, how many distinct buckets, and they and their counts as 32-bit binaries."""
    place = TaskContext.get().partitionId() << 40
    for batch in batches:
        for part in pieces(batch):
            n = part.num_rows
            keys = []
            for bucket, inside, offsets in subwords(part.column(part.schema.get_field_index("text"))):
                row = np.repeat(np.arange(n), np.diff(offsets))
                keys.append((row << BITS | bucket)[inside])
            key, many = np.unique(np.concatenate(keys), return_counts=True)
            cut = np.searchsorted(key, np.arange(n + 1) << BITS)
            at, many = (key & ((1 << BITS) - 1)).astype("<u4"), many.astype("<u4")
            piece = lambda x: pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in range(n)], pa.binary())
            yield pa.record_batch(
                [pa.array(np.arange(place, place + n)), part.column(part.schema.get_field_index("h")), pa.array(np.diff(cut).astype(np.int64)), part.column(part.schema.get_field_index("lang")), piece(at), piece(many)],
                ["place", "h", "size", "lang", "at", "n"],
            )
            place += n


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: int, dims: int, epochs: int, rate: float) -> np.ndarray:
    """The bucket x language table of embeddings times softmax weights."""
    rng = np.random.default_rng(7)
    embed = rng.uniform(-1 / dims, 1 / dims, (1 << BITS, dims))
    out = np.zeros((dims, languages))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            y, at, share = rows[i]
            eta = rate * (1 - done / steps)
            hidden = share @ embed[at]
            error = softmax(hidden @ out)
            error[y] -= 1
            back = out @ error
            out -= eta * np.outer(hidden, error)
            embed[at] -= eta * len(at) * np.minimum(share, 4 / len(at))[:, None] * back
            done += 1
    return embed @ out


def fit_language_id(docs: DataFrame, max_rows: int = 3000, dims: int = 16, epochs: int = 5, rate: float = 0.2, precision: float = 0.99):
    """The model: (table, languages, temperature, least score that is accepted)."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    # At most max_rows ids are broadcast; their texts alone are counted, each where it is.
    chosen = usable.select("doc_id", "lang").orderBy(h, "doc_id", "lang").limit(max_rows).select("doc_id").distinct()
    rows = usable.join(F.broadcast(chosen), "doc_id").select(h.alias("h"), "lang", "text")
    # A text has at most 2**BITS buckets, so max_rows bounds what comes to the driver.
    got = bounded_rows(rows.mapInArrow(counted, "place long, h long, size long, lang string, at binary, n binary"), max_rows, max_rows << BITS)
    langs = sorted(set(got["lang"].to_pylist()))
    if not langs:
        return None
    data = []
    for lang, at, n in zip(got["lang"].to_pylist(), got["at"].to_pylist(), got["n"].to_pylist()):
        at, n = np.frombuffer(at, "<u4").astype(np.int64), np.frombuffer(n, "<u4").astype(float)
        if at.size:
            data.append((langs.index(lang), at, n / n.sum()))
    fitted, seen = data[len(data) // 5 :], data[: len(data) // 5]
    table = train(fitted, len(langs), dims, epochs, rate)
    logits, truth = np.array([x @ table[at] for _, at, x in seen]).reshape(-1, len(langs)), np.array([y for y, _, _ in seen], np.int64)
    heats = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(truth.size), truth] + 1e-12).mean() if truth.size else 0.0 for t in heats]
    heat = float(heats[int(np.argmin(loss))]) if truth.size else 1.0
    p = softmax(logits / heat)
    top, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, truth.size + 1))
    least = float(top[order][good[-1]]) if good.size else 1.0
    return table.astype(np.float32), langs, heat, least


def identify_language(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred, score, accepted for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, langs, heat, least = shared.value or (np.zeros((1 << BITS, 1), np.float32), ["und"], 1.0, 2.0)
        columns = [np.ascontiguousarray(table[:, c]) for c in range(len(langs))]
        names = np.array(langs, object)
        for batch in batches:
            for part in pieces(batch):
                n = part.num_rows
                total, count = np.zeros((n, len(langs))), np.zeros(n)
                for bucket, inside, offsets in subwords(part.column(part.schema.get_field_index("text"))):
                    full = np.flatnonzero(np.diff(offsets))
                    if not full.size:
                        continue
                    at = offsets[full]
                    count[full] += np.add.reduceat(inside.astype(np.int64), at)
                    for c, weights in enumerate(columns):
                        got = weights[bucket]
                        got *= inside
                        total[full, c] += np.add.reduceat(got, at, dtype=np.float64)
                p = softmax(total / np.maximum(count, 1)[:, None] / heat)
                best, top = p.argmax(axis=1), p.max(axis=1)
                letter = part.column(part.schema.get_field_index("has_letter")).to_numpy(zero_copy_only=False).astype(bool) & (shared.value is not None)
                yield pa.record_batch(
                    [part.column(part.schema.get_field_index("doc_id")), pa.array(np.where(letter, names[best], "und"), pa.string()), pa.array(np.where(letter, top, 0.0)), pa.array(letter & (top >= least))],
                    ["doc_id", "lang_pred", "score", "accepted"],
                )

    text = F.coalesce("text", F.lit(""))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text.rlike(r"\p{L}").alias("has_letter"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
