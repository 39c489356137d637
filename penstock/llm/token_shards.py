"""Training-order materialisation: fixed-length token sequences in binary shards, in a keyed random order.

Documents of a task are joined, an end id after each, and cut into sequences of ``length`` ids; a task's last one is filled up
with the end id. Sequences are numbered by task, then by place. A keyed Feistel network over the least even number of
bits that holds all numbers, walked until it falls below their count, is a permutation of them: it gives every
sequence its slot without a sort or a table. Slots are dealt by range to shards of ``shard_sequences`` records of one
size (stride), so slot s is at byte (s mod shard_sequences) * stride of shard s div shard_sequences, and a
reader can start or resume anywhere. A task that runs again writes a draft of its own and moves it into place.

Nulls and edge cases: a null or empty text is one end id; a null doc_id is null in the lists; repeated rows are read each;
an empty table gives no shards; other columns are ignored; a very long text is encoded whole, in one task, and cut as it goes;
there are no ties, each sequence has a number of its own; ids that do not fit into ``width`` bytes raise ValueError.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, drop_table, materialise, mix64, scratch_path
from .tokens import default_tokenizer, token_batches
from .warc import open_folder

ROUNDS = 6


def feistel(x: np.ndarray, half_bits: int, key: int) -> np.ndarray:
    """One pass of the network over 2 * half_bits bits."""
    mask = np.uint64((1 << half_bits) - 1)
    left, right = x >> np.uint64(half_bits), x & mask
    for k in range(ROUNDS):
        salt = np.uint64((key * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F) % (1 << 64))
        left, right = right, left ^ (mix64(right + salt) & mask)
    return left << np.uint64(half_bits) | right


def permuted(number: np.ndarray, count: int, key: int) -> np.ndarray:
    """The slots of sequence numbers below count: a permutation of 0..count - 1."""
    half = max(1, -(-max(1, (count - 1).bit_length()) // 2))
    out = feistel(number.astype(np.uint64), half, key)
    while (walk := out >= np.uint64(count)).any():
        out[walk] = feistel(out[walk], half, key)
    return out.astype(np.int64)


SEQUENCES = "part long, place long, n_tokens int, doc_ids array<long>, ids binary"


def sequences(docs: DataFrame, path: str, end_id: int, length: int, width: int) -> DataFrame:
    """Sequences of each task, ids as little-endian integers of `width` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, place, part = np.zeros(0, f"<u{width}"), [], 0, None
        # owners: [doc_id, ids of it that are still held]

        def cut(ids: np.ndarray, last: bool):
            nonlocal place, owners
            rows = {c: [] for c in ("part", "place", "n_tokens", "doc_ids", "ids")}
            end = ids.size if last else ids.size - ids.size % length
            at = 0
            for a in range(0, end, length):
                own = ids[a : a + length]
                n, inside = own.size, []
                need = n
                while need:
                    doc_id, left = owners[at]
                    inside.append(doc_id)
                    used = min(left, need)
                    need -= used
                    owners[at] = [doc_id, left - used]
                    at += left == used
                if n < length:
                    own = np.concatenate([own, np.full(length - n, end_id, own.dtype)])
                for c, v in zip(rows, (part, place, n, inside, own.tobytes())):
                    rows[c].append(v)
                place += 1
            owners = owners[at:]
            batch = pa.record_batch([pa.array(rows["part"], pa.int64()), pa.array(rows["place"], pa.int64()), pa.array(rows["n_tokens"], pa.int32()), pa.array(rows["doc_ids"], pa.list_(pa.int64())), pa.array(rows["ids"], pa.binary())], list(rows))
            return batch, ids[end:]

        for rows, ids, row_id in token_batches(batches, path, end_id):
            part = int(row_id[0]) >> 40 if len(row_id) else part
            owners += [[d, len(x) // 4] for d, x in zip(rows.column(0).to_pylist(), ids)]
            new = np.frombuffer(b"".join(ids), "<u4")
            if new.size and int(new.max()) >= 1 << (8 * width):
                raise ValueError(f"id {int(new.max())} does not fit into {width} bytes")
            new = new.astype(f"<u{width}")
            batch, held = cut(np.concatenate([held, new]), False)
            if batch.num_rows:
                yield batch
        if held.size:
            yield cut(held, True)[0]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SEQUENCES)


def write_training_order(docs: DataFrame, folder: str, key: int = 2024, length: int = 1024, shard_sequences: int = 16_384, tokenizer: str | None = None, end_id: int = 0, width: int = 2) -> tuple[DataFrame, int]:
    """Write the shards; gives (slot, number, shard, record, n_tokens, doc_ids) of all sequences, and their count."""
    table = materialise(sequences(docs, tokenizer or default_tokenizer(), end_id, length, width), "sequences")
    # One row per task; sums of them are run up.
    parts = table.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    count = table.count()

    shards = max(1, -(-count // shard_sequences))

    def place_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch and shard, its sequences in order of slot, compressed together."""
        press = zstandard.ZstdCompressor(level=6)
        for b in batches:
            slot = permuted(b.column(0).to_numpy(), count, key)
            order = np.argsort(slot)
            b, slot = b.take(pa.array(order)), slot[order]
            shard = slot // shard_sequences
            cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist() + [slot.size]
            part = lambda c, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), c.cast(kind))
            ids = b.column(3).to_pylist()
            blobs = [press.compress(b"".join(ids[x:y])) for x, y in zip(cut, cut[1:])]
            yield pa.record_batch(
                [pa.array(shard[cut[:-1]].astype(np.int32)), part(pa.array(slot), pa.int64()), part(b.column(0), pa.int64()), part(b.column(1), pa.int32()), part(b.column(2), pa.list_(pa.int64())), pa.array(blobs, pa.binary())],
                ["shard", "slots", "numbers", "n_tokens", "doc_ids", "ids"],
            )

    numbered = table.join(broadcast_if_small(parts), "part").select((F.col("before") + F.col("place")).alias("number"), "n_tokens", "doc_ids", "ids")
    slots = numbered.mapInArrow(place_slots, "shard int, slots array<long>, numbers array<long>, n_tokens array<int>, doc_ids array<array<long>>, ids binary")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard: at most shard_sequences records, put in order and written to a draft that is moved into place."""
        expand = zstandard.ZstdDecompressor()
        stride, rows, records, shard = length * width, [], {}, None
        for b in batches:
            for r in b.to_pylist():
                shard = r["shard"]
                data = expand.decompress(r["ids"])
                records |= {s: data[k * stride : (k + 1) * stride] for k, s in enumerate(r["slots"])}
                rows += zip(r["slots"], r["numbers"], r["n_tokens"], r["doc_ids"])
        if shard is None:
            return
        place, root = open_folder(folder)
        draft = f"{root}/_draft-{shard:08d}-{uuid.uuid4().hex}"
        with place.open_output_stream(draft, compression=None) as out:
            for s in sorted(records):
                out.write(records[s])
        place.move(draft, f"{root}/shard-{shard:08d}.bin")
        rows.sort()
        columns = list(zip(*rows))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())))], ["slot", "number", "n_tokens", "doc_ids"])

    place, root = open_folder(folder)
    place.create_dir(root, recursive=True)
    dealt = slots.repartitionById(shards, F.col("shard"))
    written = materialise(dealt.mapInArrow(write, "slot long, number long, n_tokens int, doc_ids array<long>"), "order")
    drop_table(table)
    return written.select("slot", "number", F.expr(f"cast(slot div {shard_sequences} as int)").alias("shard"), F.expr(f"slot % {shard_sequences}").alias("record"), "n_tokens", "doc_ids"), count


def read_slots(folder: str, first: int, count: int, length: int = 1024, shard_sequences: int = 16_384, width: int = 2) -> Iterator[np.ndarray]:
    """The ids of sequences first, first + 1, ... by seeking to their place."""
    place, root = open_folder(folder)
    stride, at = length * width, first
    while at < first + count:
        shard, record = divmod(at, shard_sequences)
        many = min(first + count - at, shard_sequences - record)
        with place.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(record * stride)
            for _ in range(many):
                yield np.frombuffer(f.read(stride), f"<u{width}")
        at += many


def read_back(spark: SparkSession, folder: str, count: int, length: int = 1024, shard_sequences: int = 16_384, width: int = 2, step: int = 4096) -> DataFrame:
    """(slot, ids) of all slots, read in ranges of `step` by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column(0).to_pylist():
                n = min(step, count - first)
                for a in range(first, first + n, 512):
                    m = min(512, first + n - a)
                    ids = [x.tobytes() for x in read_slots(folder, a, m, length, shard_sequences, width)]
                    yield pa.record_batch([pa.array(np.arange(a, a + m)), pa.array(ids, pa.binary())], ["slot", "ids"])

    starts = spark.range(0, max(count, 0), step, max(1, -(-count // step))).select("id")
    return starts.mapInArrow(run, "slot long, ids binary")


def order_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "order")
