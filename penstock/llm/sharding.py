"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by (hash of text, doc_id); shard boundaries are found by counting exact bytes below
candidate keys: each round cuts the open interval of every boundary into ``2**probe_bits`` equal parts,
counts bytes in them in one pass over (key, size), and keeps the part that holds the boundary. A
boundary is settled when its interval holds no more bytes than ``tolerance`` of a shard or cannot be cut further.
Then the rows are exchanged once, into the cells of their shards.

Equal texts lie side by side, so a group of them is split only where a boundary falls inside it; the
second part of the key splits such a group however large it is, and the third, a number of the row that is written
down with the key, splits rows that are equal in text and doc_id.

Nulls and edge cases: a null text counts as empty (size 1); a null doc_id has the least key; repeated rows are rows each;
with fewer rows than shards some shards are empty; other columns are ignored; a text larger than a shard is one row, so
its shard is larger; of two equally near ends of a boundary's last interval the upper one counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Bits of each part of the key.
KEY_BITS = (60, 63, 63)
PARTS = ("k1", "k2", "k3")


def text_key(text: Column) -> Column:
    """The first 60 bits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def id_key(doc_id: Column) -> Column:
    """doc_id in 63 bits, in order, for ids of the usual range."""
    return F.coalesce(F.shiftright(doc_id.cast("long"), 1) + F.lit(1 << 62), F.lit(0)).cast("long")


class Boundary:
    """What is known of one boundary: bytes below its interval, and the interval itself."""

    def __init__(self, goal: int):
        self.goal, self.below, self.inside = goal, 0, None
        self.prefix: tuple[int, ...] = ()  # the values of earlier key parts that hold the boundary, once known
        self.low, self.bits = 0, KEY_BITS[0]  # the interval is [low, low + 2**bits) of the open part
        self.open = True

    def where(self) -> tuple:
        return self.prefix, self.low, self.bits


def find_boundaries(keyed: DataFrame, shards: int, tolerance: float = 0.001, probe_bits: int = 10) -> tuple[list[tuple[int, ...]], int]:
    """Keys (k1, k2, k3; later parts may be left out) at which shards 1.. begin, and the number of rows.

    What comes to the driver in a round is at most (shards - 1) * 2**probe_bits counts.
    """
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bounds = [Boundary(-(-total * j // shards)) for j in range(1, shards)]
    allowed = tolerance * total / shards
    for b in bounds:
        b.inside = total
        b.open = total > 0
    while open_now := {b.where(): b for b in bounds if b.open}:
        spot, part = F.lit(None).cast("int"), F.lit(None).cast("long")
        plan = []
        for n, (prefix, low, bits) in enumerate(open_now):
            step = max(0, bits - probe_bits)
            key = F.col(PARTS[len(prefix)])
            held = (key >= F.lit(low)) & (key <= F.lit(low + (1 << bits) - 1))
            for name, value in zip(PARTS, prefix):
                held &= F.col(name) == F.lit(value)
            spot = F.when(held, F.lit(n)).otherwise(spot)
            part = F.when(held, F.shiftright(key - F.lit(low), step)).otherwise(part)
            plan.append((prefix, low, bits, step))
        counted = keyed.select(spot.alias("spot"), part.alias("part"), "size").where("spot is not null").groupBy("spot", "part").agg(F.sum("size").alias("size"))
        found: dict[int, list[tuple[int, int]]] = {}
        for spot_id, part_id, size in counted.collect():
            found.setdefault(spot_id, []).append((part_id, size))
        where = {x: n for n, x in enumerate(open_now)}
        for b in bounds:
            if not b.open:
                continue
            prefix, low, bits, step = plan[where[b.where()]]
            below = b.below
            for part_id, size in sorted(found[where[b.where()]]):
                if below + size >= b.goal:
                    break
                below += size
            b.below, b.inside, b.low, b.bits = below, size, low + (part_id << step), step
            if b.bits == 0 and len(b.prefix) < 2 and b.inside > allowed:
                b.prefix += (b.low,)
                b.low, b.bits = 0, KEY_BITS[len(b.prefix)]
            elif b.bits == 0 or b.inside <= allowed:
                b.open = False
    keys = []
    for b in bounds:
        # The nearer end of the last interval.
        upper = b.low + (1 << b.bits) if b.below + b.inside - b.goal <= b.goal - b.below else b.low
        keys.append((*b.prefix, upper))
    return keys, rows


def shard_of(keys: list[tuple[int, ...]]) -> Column:
    """How many boundaries lie at or below the row's key."""
    total = F.lit(0)
    for key in keys:
        reached = F.lit(True)
        for name, value in reversed(list(zip(PARTS, key))):
            reached = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & reached)
        total = total + reached.cast("int")
    return total


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, cell_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Slots: a shard is cut into cells of about ``cell_rows`` rows by a hash of all key parts, so no text or id makes
    a large cell; a row's slot is the rows of the cells before its own plus its place there.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = materialise(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            text_key(text).alias("k1"),
            id_key(F.col("doc_id")).alias("k2"),
            F.monotonically_increasing_id().alias("k3"),
        ),
        "shard-keys",
    )
    keys, rows = find_boundaries(keyed, shards, tolerance)
    cells = max(1, math.ceil(rows / shards / cell_rows))
    placed = keyed.withColumn("shard", shard_of(keys)).withColumn("cell", F.pmod(F.xxhash64("k1", "k2", "k3"), F.lit(cells)).cast("int"))
    sizes = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = sizes.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    inside = placed.withColumn("place", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("k1", "k2", "k3")) - 1)
    return inside.join(before, ["shard", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
