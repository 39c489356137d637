"""What several operators share: tables in the shared folder, and numpy over Arrow text buffers.

Helpers on text work on a whole Arrow column at once: its UTF-8 bytes as one numpy array and the
rows' byte offsets. No Python string is made per row or word.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multipliers of the 64-bit finaliser and of word positions in a shingle.
MIX = np.uint64(0xD6E8FEB86659FD93)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


#: Paths of tables written within `with scratch(...)`, innermost last.
_scratch: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master /tmp/checkpoints where that is unset."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/checkpoints"
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, noted for scratch()."""
    path = f"{shared_folder(spark)}/penstock-{name}-{uuid.uuid4().hex}"
    for noted in _scratch:
        noted.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes at its end all tables and files that operators called within have left in the shared folder.

    Results are lazy and read those tables: write or collect them before the end.
    """
    noted: list[str] = []
    _scratch.append(noted)
    try:
        yield noted
    finally:
        _scratch.remove(noted)
        for path in noted:
            delete_path(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def drop_table(table: DataFrame) -> None:
    """Delete the files of a table from materialise() that nothing reads any more."""
    delete_path(table.sparkSession, table._written_to)


def bounded_rows(features: DataFrame, max_rows: int, max_size: int) -> pa.Table:
    """Rows of a feature table (place, h, size, ...) for training on the driver: by h, at most max_rows, of max_size together.

    Only (h, size, place) of max_rows rows is sorted; a row that would exceed max_size is passed over.
    """
    table = materialise(features, "features")
    first = table.select("h", "size", "place").orderBy("h", "size", "place").limit(max_rows).collect()
    chosen, total = [], 0
    for r in first:
        if total + r["size"] <= max_size:
            total += r["size"]
            chosen.append((r["place"],))
    keys = F.broadcast(table.sparkSession.createDataFrame(chosen, "place long"))  # max_rows numbers at most
    got = table.join(keys, "place", "left_semi").toArrow()
    drop_table(table)
    return got.sort_by([("h", "ascending"), ("size", "ascending"), ("place", "ascending")])


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df marked for broadcast if it has at most so many (narrow) rows, else as it is, for a join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def whole_groups(batches: Iterator[pa.RecordBatch], column: str, at_once: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by a column of longs: about at_once rows each, or one larger group."""
    held, rows, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        group = batch.column(batch.schema.get_field_index(column)).to_numpy()
        cut = int(np.searchsorted(group, group[-1]))  # rows before the last group, which may go on
        if rows + cut >= at_once and (cut or group[0] != last):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
        last = group[-1]
    if held:
        yield pa.Table.from_batches(held)


def hot_keys(keyed: DataFrame, column: str, least: int) -> list[int]:
    """Keys with a thousandth of all rows or more, and `least` rows at any rate: a thousand keys at most, whatever the input."""
    counts = keyed.groupBy(column).agg(F.count("*").alias("c")).where(F.col("c") >= max(least, keyed.count() // 1000))
    return [r[0] for r in counts.select(column).collect()]


def reserve(carry: Iterable[str], names: list[str]) -> None:
    """Raise if a carried column has the name of a result or of a column made on the way."""
    if clash := sorted({c.lower() for c in carry} & set(names)):
        raise ValueError(f"columns {clash} cannot be carried: rename them first")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes; wraps around on purpose."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; row i is bytes[offsets[i]:offsets[i + 1]], null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes; a longer text is a slice of its own."""
    column = batch.column(batch.schema.get_field_index("text"))
    sizes = np.diff(text_buffer(column)[1])
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def byte_table(inside) -> np.ndarray:
    """A table of 256 flags: which bytes belong to words."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words of [^\x20\x09-\x0D]+ : all but white space.
NOT_SPACE = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Lower-cases A-Z only.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Words of ASCII letters, digits and all beyond ASCII, upper case lowered before.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of word bytes; runs end where a row ends."""
    if raw.size == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = inside[raw]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < raw.size)]
    first[cut] = m[cut]
    last[cut - 1] = m[cut - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


#: Words over so many bytes are hashed one by one.
LONG = 2048


def hash_words(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], eight bytes at a time over all words at once."""
    if start.size == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (raw.size + 1, 8), (1, 1))
    size = end - start
    out = mix64(size.astype(np.uint64) * ODD[0])
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    at = np.flatnonzero(size <= LONG)
    done = 0
    while at.size:
        rest = size[at] - done
        x = np.ascontiguousarray(eight[start[at] + done]).view("<u8").ravel() & masks[np.minimum(rest, 8)]
        out[at] = mix64(out[at] ^ x)
        done += 8
        at = at[rest > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return out


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes (across rows too: the caller drops those)."""
    k = h.size - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(k, np.uint64)
    for j in range(n):
        out += h[j : j + k] * ODD[j % ODD.size] + ODD[(j + 3) % ODD.size]
        out ^= out >> np.uint64(29)
    return mix64(out)
