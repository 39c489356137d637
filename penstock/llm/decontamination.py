"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are each ``window`` consecutive words (an item with fewer words is one window). A window's
tokens are its shingles of ``shingle`` words; over the whole corpus the shingles are ordered by document frequency,
and as a window must be contained entirely, its prefix is its one rarest shingle. Documents are joined with
the windows on that token; the token's place gives the alignment, the length bound drops alignments that leave the
document, hashes of all positions are compared, and what remains is verified byte by byte.

Equal items are one, and long ones are cut in Spark into parts of ``part_words`` words that overlap by a window less a word, so
they have the same windows. The index of a block of parts is broadcast; a block holds about ``block_bytes`` of their text, twice that at most,
and its index takes about ten times as much. Larger benchmarks take one pass over the documents per block, and hits add up.

Nulls and edge cases: null or empty texts and items have no words; a null item_id is the id "null"; items with
equal text all count; repeated rows are each reported; no items or no documents give no hits; any column may be
carried along, but for those named n_words, hits or items (ValueError); of equally rare shingles the one with the lower hash counts;
very long documents are searched whole, in a slice of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, drop_table, hash_words, materialise, pieces, reserve, text_buffer, window_hashes, words

RUN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


class Words:
    """The words of a slice of texts: hashes, rows, and the text with one space after each word."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_buffer(column)
        raw = LOWER[raw]
        self.start, self.end, self.row = words(raw, offsets, ALNUM)
        self.hash = hash_words(raw, self.start, self.end)
        self.raw = raw
        self.first = np.searchsorted(self.row, np.arange(len(offsets) - 1))
        self.count = np.diff(np.append(self.first, self.row.size))

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words with a space after each, and where each begins."""
        size = self.end - self.start + 1
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.full(int(at[-1]), 0x20, np.uint8)
        shift = np.repeat(at[:-1] - self.start, size - 1)
        inside = np.ones(int(at[-1]), bool)
        inside[at[1:] - 1] = False
        target = np.flatnonzero(inside)
        out[target] = self.raw[target - shift]
        return out.tobytes(), at

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the shingles of n words that stay in one text."""
        h = window_hashes(self.hash, n)
        if not h.size:
            return np.zeros(0, np.int64), h
        at = np.flatnonzero(self.row[: h.size] == self.row[n - 1 :])
        return at, h[at]


def ranges(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of first[i], first[i] + 1, ... many[i] times each."""
    owner = np.repeat(np.arange(first.size), many)
    return owner, first[owner] + np.arange(owner.size) - np.repeat(np.cumsum(many) - many, many)


class WindowIndex:
    """Distinct windows of a block of items, as places in their words' text, with the items they come from."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        w = Words(pa.array([t for _, t in items], pa.string()))
        self.text, at = w.joined()
        self.names = sorted({item for item, _ in items})
        place = {x: k for k, x in enumerate(self.names)}
        item = np.array([place[x] for x, _ in items], np.int64)
        size = np.minimum(w.count, window)
        owner, start = ranges(w.first, np.where(size > 0, w.count - size + 1, 0))
        size = size[owner]
        hashed = np.zeros(start.size, np.uint64)
        for n in np.unique(size).tolist():
            hashed[size == n] = window_hashes(w.hash, n)[start[size == n]]
        order = np.lexsort((item[owner], size, hashed))
        owner, start, size, hashed = owner[order], start[order], size[order], hashed[order]
        begin, end = at[start], at[start + size] - 1
        new = np.concatenate([[True], (hashed[1:] != hashed[:-1]) | (size[1:] != size[:-1])])[: start.size]
        for k in np.flatnonzero(~new).tolist():  # equal hashes: by their bytes
            new[k] = self.text[begin[k] : end[k]] != self.text[begin[k - 1] : end[k - 1]]
        first = np.flatnonzero(new)
        self.begin, self.end, self.words, self.hash = begin[first], end[first], size[first], hashed[first]
        self.item, self.item_cut = item[owner].astype(np.int32), np.append(first, start.size)
        self.tokens: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # shingle size -> window, offset, hash
        own_size = np.minimum(self.words, shingle)
        for n in np.unique(own_size).tolist():
            own = np.flatnonzero(own_size == n)
            k, place_ = ranges(start[first[own]], self.words[own] - n + 1)
            self.tokens[n] = own[k], place_ - start[first[own]][k], window_hashes(w.hash, n)[place_]
        self.vocabulary = {n: np.unique(h) for n, (_, _, h) in self.tokens.items()}

    def items_of(self, windows: np.ndarray) -> set[str]:
        return {self.names[i] for k in windows.tolist() for i in self.item[self.item_cut[k] : self.item_cut[k + 1]].tolist()}

    def order_by_rarity(self, frequency: dict[tuple[int, int], int]) -> None:
        """Keep each window's rarest shingle; ties go to the lower hash, then the earlier place."""
        self.prefix = {}
        for n, (win, off, h) in self.tokens.items():
            df = np.array([frequency.get((n, int(k)), 0) for k in np.searchsorted(self.vocabulary[n], h)], np.int64)
            order = np.lexsort((off, h, df, win))
            first = order[np.concatenate([[True], win[order][1:] != win[order][:-1]])]
            first = first[np.argsort(h[first], kind="stable")]
            self.prefix[n] = h[first], win[first], off[first]
        del self.tokens, self.vocabulary


def member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where h has values of the sorted table, and which: (place in h, place of its first equal in table)."""
    at = np.searchsorted(table, h)
    at[at == table.size] = 0
    hit = np.flatnonzero(table[at] == h) if table.size else np.zeros(0, np.int64)
    return hit, at[hit]


def count_shingles(shared) -> callable:
    """Documents that hold each shingle of the index, a row per slice and shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for part in pieces(batch):
                w = Words(part.column(0))
                for n, table in vocabulary.items():
                    place, h = w.shingles(n)
                    hit, k = member(h, table)
                    if hit.size:
                        seen = np.unique(w.row[place[hit]] * table.size + k)
                        ids, counts = np.unique(seen % table.size, return_counts=True)
                        yield pa.record_batch([pa.array(np.full(ids.size, n), pa.int32()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["n", "k", "df"])

    return run


def search(index: WindowIndex, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window in the texts of w."""
    starts, wins = [], []
    for n, (table, win, off) in index.prefix.items():
        place, h = w.shingles(n)
        hit, k = member(h, table)
        last = np.searchsorted(table, h[hit], side="right")
        many = last - k
        at = np.repeat(place[hit], many)
        entry = np.repeat(k - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        start, which = at - off[entry], win[entry]
        row, size = w.row[at], index.words[which]
        fits = (start >= w.first[row]) & (start + size <= w.first[row] + w.count[row])
        start, which = start[fits], which[fits]
        for size in np.unique(index.words[which]).tolist():
            own = index.words[which] == size
            a, b = start[own], which[own]
            same = window_hashes(w.hash, size)[a] == index.hash[b]
            starts.append(a[same])
            wins.append(b[same])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, which = np.concatenate(starts), np.concatenate(wins)
    if start.size:
        joined, at = w.joined()
        size = index.words[which]
        ok = [joined[a:b] == index.text[c:d] for a, b, c, d in zip(at[start].tolist(), (at[start + size] - 1).tolist(), index.begin[which].tolist(), index.end[which].tolist())]
        start, which = start[ok], which[ok]
    return start, which


def runs_of(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of intervals as disjoint runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def find_hits(shared, carry: list[str], first: bool) -> callable:
    """carry, text, n_words, hits, items of each row; later passes add to what earlier ones found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in pieces(batch):
                w = Words(part.column(part.schema.get_field_index("text")))
                rows = part.num_rows
                hits: list = [[] for _ in range(rows)] if first else [[(x["start"], x["end"]) for x in v] for v in part.column(part.schema.get_field_index("hits")).to_pylist()]
                items: list = [[] for _ in range(rows)] if first else part.column(part.schema.get_field_index("items")).to_pylist()
                start, which = search(index, w)
                order = np.argsort(w.row[start], kind="stable")
                start, which = start[order], which[order]
                row = w.row[start]
                cuts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if row.size else []
                for a, b in zip(cuts, [*cuts[1:], row.size]):
                    r = int(row[a])
                    s = start[a:b] - w.first[r]
                    new = runs_of(s, s + index.words[which[a:b]])
                    old = np.array([*hits[r], *new], np.int64)
                    hits[r] = runs_of(old[:, 0], old[:, 1])
                    items[r] = sorted({*items[r], *index.items_of(np.unique(which[a:b]))})
                arrays = {c: part.column(part.schema.get_field_index(c)) for c in [*carry, "text"]}
                arrays["n_words"] = pa.array(w.count, pa.int64())
                arrays["hits"] = pa.array([[{"start": a, "end": b} for a, b in v] for v in hits], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                arrays["items"] = pa.array(items, pa.list_(pa.string()))
                yield pa.record_batch(list(arrays.values()), list(arrays))

    return run


def item_parts(benchmark: DataFrame, window: int, part_words: int) -> DataFrame:
    """(item_id, text) of distinct items; of a long one, parts that together have its windows."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = items.select("item_id", F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)), F.lit(part_words))
    return split.select("item_id", "w", F.explode(starts).alias("a")).select("item_id", F.array_join(F.slice("w", F.col("a"), part_words + window - 1), " ").alias("text")).distinct()


def item_blocks(parts: DataFrame, block_bytes: int) -> int:
    """Into how many blocks to deal parts by hash so that none holds more than twice block_bytes, or four parts; one size comes to the driver."""
    size = F.octet_length("text") + 1
    total, largest = parts.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    blocks = max(1, -(-int(total) // block_bytes))
    while blocks > 1 and parts.groupBy(block_of(blocks)).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] > max(2 * block_bytes, 4 * largest):
        blocks *= 2
    return blocks


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))


def find_benchmark_passages(
    docs: DataFrame, benchmark: DataFrame, carry: tuple[str, ...] = ("doc_id",), window: int = 10, shingle: int = 3, block_bytes: int = 8 << 20, part_words: int = 20_000
) -> DataFrame:
    """carry, text, n_words, hits (runs of word places covered by a window) and items (ids), per row of docs."""
    reserve(carry, ["n_words", "hits", "items"])
    spark = docs.sparkSession
    docs = docs.select(*carry, *([] if "text" in carry else ["text"]))
    names = [c for c in carry if c != "text"]
    texts = docs.select("text")
    parts = materialise(item_parts(benchmark, window, part_words), "items")
    blocks = item_blocks(parts, block_bytes)
    out = docs
    for b in range(blocks):
        part = parts if blocks == 1 else parts.where(block_of(blocks) == b)
        index = WindowIndex([(r.item_id, r.text) for r in part.collect()], window, shingle)
        counting = spark.sparkContext.broadcast(index.vocabulary)
        counts = texts.mapInArrow(count_shingles(counting), "n int, k long, df long").groupBy("n", "k").agg(F.sum("df").alias("df")).collect()
        index.order_by_rarity({(r.n, r.k): r.df for r in counts})
        counting.unpersist()
        schema = T.StructType([*[docs.schema[c] for c in names], docs.schema["text"], T.StructField("n_words", T.LongType()), T.StructField("hits", RUN), T.StructField("items", T.ArrayType(T.StringType()))])
        out = out.mapInArrow(find_hits(spark.sparkContext.broadcast(index), names, b == 0), schema)
        if b + 1 < blocks:
            out = materialise(out, "decontamination")
    drop_table(parts)
    return out


def hit_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of what find_benchmark_passages() gives."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
