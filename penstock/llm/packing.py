"""Packing documents into fixed-length sequences as a cutting-stock problem.

A document of n tokens gives n // capacity full sequences; its rest (1 to capacity - 1 tokens) is an item. Item
lengths are counted in bins of ``bin_tokens``, rounded up; this histogram, capacity / bin_tokens counts, is all that
comes to the driver. There a linear program over patterns (how many items of each bin share a sequence) is
solved by column generation: a revised simplex keeps the basis, and a knapsack dynamic program over the
capacity in bins prices new patterns. Pattern counts are rounded down, then up by size of fraction while items last.

Items are ranked within their bin and each pattern takes ranges of ranks, so a small table tells every item its
sequence. Rounding leaves items over, a pattern's worth for each bin at most, so a bounded number. They lie on
one tape that is cut every ``capacity`` tokens; its end is cut into powers of two.

Nulls and edge cases: a null or empty text is one end token; repeated rows are packed each on their own; an empty
table gives no pieces; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, materialise
from .tokens import default_tokenizer, token_batches


#: Patterns that a round of column generation pools at most.
POOL = 100


def knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room 0..capacity with unlimited items, and the item taken last (-1: none, a token is left over)."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = upto[room]
        if k:
            gain = best[room - lengths[:k]] + value[:k]
            i = int(gain.argmax())
            if gain[i] > best[room] + 1e-12:
                best[room], last[room] = gain[i], i
    return best, last


def pattern_in(last: np.ndarray, lengths: np.ndarray, room: int, start: int | None = None) -> np.ndarray:
    """The items of the best pattern for a room, with one item taken beforehand if start is given."""
    count = np.zeros(lengths.size)
    if start is not None:
        count[start] += 1
        room -= lengths[start]
    while room > 0:
        i = last[room]
        if i < 0:
            room -= 1
        else:
            count[i] += 1
            room -= lengths[i]
    return count


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.002, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, amounts) of a basic solution within `gap` of the linear program's optimum, or after `rounds`.

    Each round prices by one knapsack and pools the best patterns through single lengths; pivots go on within the
    pool while it improves. Prices are smoothed towards length / capacity, the prices of a loss-free packing; where
    that finds no better pattern, less so. Farley's bound says when to stop.
    """
    m = lengths.size
    basis = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / (capacity // lengths))
    amount = inverse @ demand
    fair = lengths / capacity
    bound, smooth = 0.0, 0.9
    for _ in range(rounds):
        dual = inverse.sum(axis=0)
        price = smooth * fair + (1 - smooth) * dual
        best, last = knapsack(lengths, price, capacity)
        bound = max(bound, float(price @ demand) / best[capacity])
        if amount.sum() <= bound * (1 + gap):
            break
        through = price + best[capacity - lengths]
        good = np.argsort(-through, kind="stable") if smooth == 0 else np.argsort(-(dual / fair) - (through > 1 - 1e-6), kind="stable")
        pool = np.unique(np.array([pattern_in(last, lengths, capacity, i) for i in good[:POOL].tolist()]), axis=0)
        pool = pool[pool @ dual > 1 + 1e-7]
        if not len(pool):
            if smooth == 0:
                break
            smooth = smooth - 0.3 if smooth > 0.3 else 0.0
            continue
        smooth = 0.9
        gain = pool @ dual
        for _ in range(2 * len(pool)):
            j = int(gain.argmax())
            if gain[j] <= 1 + 1e-7:
                break
            column = pool[j]
            step = inverse[:, column > 0] @ column[column > 0]
            up = np.flatnonzero(step > 1e-9)
            ratio = amount[up] / step[up]
            r = int(up[ratio.argmin()])
            least = amount[r] / step[r]
            amount = np.maximum(amount - least * step, 0)
            amount[r] = least
            row = inverse[r] / step[r]
            moved = np.flatnonzero(step)
            inverse[moved] -= step[moved, None] * row
            inverse[r] = row
            basis[:, r] = column
            gain += (1 - gain[j]) * (pool @ row)
    return basis, amount


def rounded_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(items by length, times)]: whole patterns within the demand."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not lengths.size:
        return []
    left = np.array([histogram[int(k)] for k in lengths], np.int64)
    basis, amount = column_generation(lengths, left.astype(float), capacity)
    patterns = np.rint(basis).astype(np.int64)
    used = np.floor(amount + 1e-6).astype(np.int64)
    for j in range(lengths.size):
        holds = patterns[:, j] > 0
        used[j] = min(used[j], *(left[holds] // patterns[holds, j]))
        left -= used[j] * patterns[:, j]
    for j in np.argsort(-(amount % 1), kind="stable").tolist():
        if capacity - lengths @ patterns[:, j] <= capacity // 50 and (left >= patterns[:, j]).all():
            used[j] += 1
            left -= patterns[:, j]
    return [({int(lengths[i]): int(patterns[i, j]) for i in np.flatnonzero(patterns[:, j])}, int(used[j])) for j in range(lengths.size) if used[j]]


def assignment(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Rows (bin, rank_from, rank_to, copies, first_sequence, place) and the number of sequences of patterns.

    The item of rank r goes to sequence first_sequence + (r - rank_from) // copies, to the place-th place there
    and on. A row with copies 0 has the ranks that are left over.
    """
    taken = dict.fromkeys(histogram, 0)
    rows: list[tuple] = []
    sequences = 0
    for items, times in rounded_patterns(histogram, capacity):
        place = 0
        for length, copies in items.items():
            rows.append((length, taken[length], taken[length] + copies * times, copies, sequences, place))
            taken[length] += copies * times
            place += copies
        sequences += times
    rows += [(k, taken[k], n, 0, 0, 0) for k, n in sorted(histogram.items()) if taken[k] < n]
    return rows, sequences


def tape_cuts(tokens: int, capacity: int) -> list[int]:
    """Where the tape's last sequences begin and end: after the full ones, powers of two."""
    cuts = [tokens // capacity * capacity]
    for bit in reversed(range(capacity.bit_length())):
        if (tokens % capacity) >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    return cuts


TOKENS = "doc_id long, row_id long, part long, n_tokens long, full_before long, rest int, ids binary"


def tokenised(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """A row per document: ids, their number, the rest's length, and the full sequences of earlier rows of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = 0
        for rows, ids, row_id in token_batches(batches, path, end_id):
            n = np.array([len(x) // 4 for x in ids], np.int64)
            own = n // capacity
            before = full + np.cumsum(own) - own
            full += int(own.sum())
            yield pa.record_batch(
                [rows.column(0), pa.array(row_id), pa.array(row_id >> 40), pa.array(n), pa.array(before), pa.array((n % capacity).astype(np.int32)), pa.array(ids, pa.binary())],
                ["doc_id", "row_id", "part", "n_tokens", "full_before", "rest", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS)


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 0, bin_tokens: int = 4, cell_rows: int = 50_000) -> DataFrame:
    """A row per piece: doc_id, row_id, start, length, doc_tokens, sequence_id, offset, ids (of the piece)."""
    spark = docs.sparkSession
    table = materialise(tokenised(docs, tokenizer or default_tokenizer(), end_id, capacity), "tokens")
    number = F.expr(f"n_tokens div {capacity}")

    # Full sequences are numbered by task, then by row; one sum per task is run up.
    parts = table.groupBy("part").agg(F.sum(number).alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("_before"))
    total_full = table.agg(F.coalesce(F.sum(number), F.lit(0))).first()[0]
    size = F.lit(capacity).cast("long")
    full = (
        table.where(F.col("n_tokens") >= capacity)
        .join(broadcast_if_small(parts), "part")
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), number - 1)).alias("k"))
        .select("doc_id", "row_id", (F.col("k") * size).alias("start"), size.alias("length"), F.col("n_tokens").alias("doc_tokens"), (F.col("_before") + F.col("full_before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids", (F.col("k") * size).alias("_from"))
    )

    # Ranks within a bin: cells of a bounded size, each with the rows before it.
    items = table.where("rest > 0").select("row_id", F.col("rest").cast("long").alias("rest"), F.expr(f"cast((rest + {bin_tokens - 1}) div {bin_tokens} as int)").alias("bin"))
    histogram = {r.bin: r.n for r in items.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    rows, patterns = assignment(histogram, capacity // bin_tokens)
    cells = max(1, -(-sum(histogram.values()) // cell_rows))
    items = items.withColumn("cell", F.pmod(F.xxhash64("row_id"), F.lit(cells)).cast("int"))
    counts = items.groupBy("bin", "cell").agg(F.count("*").alias("n"))
    before = counts.select("bin", "cell", (F.sum("n").over(Window.partitionBy("bin").orderBy("cell")) - F.col("n")).alias("_before"))
    ranked = (
        items.withColumn("_place", F.row_number().over(Window.partitionBy("bin", "cell").orderBy("row_id")) - 1)
        .join(before, ["bin", "cell"])
        .select("row_id", "rest", "bin", (F.col("_before") + F.col("_place")).alias("rank"))
    )
    # A row for each bin of each pattern at most, and a basis has as many patterns as there are bins.
    slots = F.broadcast(spark.createDataFrame(rows, "_bin int, rank_from long, rank_to long, copies long, first_sequence long, place long"))
    placed = ranked.join(slots, (F.col("bin") == F.col("_bin")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    placed = materialise(
        placed.select(
            "row_id", "rest", "rank", "bin", "copies",
            F.when(F.col("copies") > 0, F.col("first_sequence") + F.expr("(rank - rank_from) div greatest(copies, 1)")).alias("sequence"),
            (F.col("place") + F.expr("(rank - rank_from) % greatest(copies, 1)")).alias("place"),
        ),
        "placed",
    )
    in_pattern = placed.where("copies > 0").select(
        "row_id", (F.lit(total_full) + F.col("sequence")).alias("sequence_id"),
        (F.sum("rest").over(Window.partitionBy("sequence").orderBy("place")) - F.col("rest")).alias("offset"),
        F.col("rest").alias("length"), F.lit(0).cast("long").alias("_in_rest"),
    )
    # The tape: at most capacity tokens for each bin, whatever the input, so one task runs it up.
    tape = placed.where("copies = 0").withColumn("_b", F.sum("rest").over(Window.orderBy("bin", "rank"))).withColumn("_a", F.col("_b") - F.col("rest"))
    cuts = tape_cuts(placed.where("copies = 0").agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0], capacity)
    tail = F.array(*[F.lit(c).cast("long") for c in cuts])
    edges = F.array_sort(F.array_distinct(F.filter(F.concat(F.array("_a", "_b", F.expr(f"(_a div {capacity} + 1) * {capacity}")), tail), lambda x: (x >= F.col("_a")) & (x <= F.col("_b")))))
    cut = tape.withColumn("_e", edges).select("*", F.posexplode(F.slice("_e", 2, F.size("_e") - 1)).alias("_i", "_y")).withColumn("_x", F.get("_e", F.col("_i")))
    ending = F.col("_x") >= F.lit(cuts[0])
    nth = F.size(F.filter(tail, lambda c: c <= F.col("_x"))) - 1
    taped = cut.select(
        "row_id", (F.lit(total_full + patterns) + F.when(ending, F.lit(cuts[0] // capacity) + nth).otherwise(F.expr(f"_x div {capacity}"))).cast("long").alias("sequence_id"),
        F.when(ending, F.col("_x") - F.get(tail, nth)).otherwise(F.col("_x") % capacity).alias("offset"),
        (F.col("_y") - F.col("_x")).alias("length"), (F.col("_x") - F.col("_a")).alias("_in_rest"),
    )
    begins = F.col("n_tokens") - F.col("rest")
    rest_ids = table.where("rest > 0").select("doc_id", "row_id", "n_tokens", begins.alias("_begins"), F.expr("substring(ids, cast(4 * (n_tokens - rest) + 1 as int), 4 * rest)").alias("ids"))
    rests = rest_ids.join(in_pattern.unionByName(taped), "row_id").select(
        "doc_id", "row_id", (F.col("_begins") + F.col("_in_rest")).alias("start"), "length", F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset", "ids", F.col("_in_rest").alias("_from")
    )
    return full.unionByName(rests).withColumn("ids", F.expr("substring(ids, cast(4 * _from + 1 as int), cast(4 * length as int))")).drop("_from")
