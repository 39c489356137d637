"""Repeated passages: remove every byte covered by a string of ``length`` bytes that also starts elsewhere.

1. Anchors. Of the first ``span_of(length)`` places of each window of ``length`` bytes, the one whose 16 bytes hash lowest is the
   window's anchor; equal windows have it at the same place. Windows of one anchor are one row: their core (the bytes
   all of them share, hashed), and all bytes that any of them covers (the context, hashed too).
2. Cores that occur once drop out. Contexts that occur twice repeat with all their windows. Cores with two contexts or more, one of
   them unique, need their bytes.
3. The suffix array. For each such core a task puts its contexts into one text of symbols: bytes left of the core,
   the core as one symbol, bytes right of it. Contexts that cannot share a window with any other are left out, ends that
   no other shares are cut off, and so are columns in which all contexts of the core agree. Baier's grouping sorts the
   suffixes of that text; a suffix's common prefix with its neighbours says how far to the right its windows repeat.
4. Covered bytes are united per text and cut out.

Texts are known by 64 bits of their MD5 and their length, so copies are handled once; a text with a copy repeats as a
whole. A core whose contexts have over ``SYMBOLS`` bytes is solved in its task by hashes of its windows instead of an array; one with over
``group_contexts`` different contexts is not sent to one task: its windows are hashed and counted in Spark.
Texts with a thousandth of all rows or more as copies (so a thousand texts at most) are thinned out in their tasks before they
meet, and their copies are spread over ``SALTS`` keys when results go back to rows.

With ``n_words`` the same search runs over codes: eight bytes of a hash for each word. Windows of 8 * n_words bytes that begin with a word are
windows of words, of any number of bytes; nothing of fewer words is cut, not even where several such repeats touch each other.

Nulls and edge cases: null and empty texts have 0 bytes and lose nothing, as do texts shorter than ``length``;
matches never cross texts; repeated rows count as copies of a text; a null doc_id is carried; an empty table gives an
empty result; texts of any length are read in overlapping stretches; which of several equal passages comes first does not matter,
all are cut. Carried columns may have any name but those of the results (ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MIX, NOT_SPACE, drop_table, hash_words, materialise, mix64, pieces, reserve, text_buffer, whole_groups, words
from .suffix_array import common_prefixes, suffix_array

STRETCH = 1 << 18
#: Over so many keys the copies of a very frequent text are spread.
SALTS = 256
#: A text is very frequent from so many copies on, or a thousandth of all rows where that is more.
HOT_COPIES = 1000
#: Contexts that are solved at once, in whole groups.
AT_ONCE = 20_000
#: Bytes of contexts, after trimming, that stand in one suffix array at most.
SYMBOLS = 300_000
ANCHOR = "core long, ctx long, key long, n int, a int, s1 int, s2 int"
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def span_of(length: int) -> int:
    """How many first places of a window may hold its anchor; at least 49 bytes of a window are its core."""
    return min(256, length - 48)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        base = int(MIX)
        inverse = pow(base, -1, 1 << 64)
        both = []
        for x in (base, inverse):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers.clear()
        _powers[size] = tuple(both)
    return _powers[size]


class Hashes:
    """Hashes of any stretch of some bytes, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = powers(raw.size + 1)
        self.sums = np.zeros(raw.size + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: raw.size], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first and last window start, core, context) of each anchor; places are within raw."""
    first, last = offsets[:-1], offsets[1:] - length  # window starts of each row
    if raw.size < length or not (last >= first).any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    eight = np.lib.stride_tricks.as_strided(raw, (raw.size - 7, 8), (1, 1))
    eights = np.ascontiguousarray(eight).view("<u8").ravel()
    k = mix64(eights[:-8] * MIX ^ mix64(eights[8:]))
    low = (k & np.uint64(0xFFFFFFFF00000000)) | np.arange(k.size, dtype=np.uint64)
    span, step = span_of(length), 1
    while 2 * step <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < span:
        low = np.minimum(low[: step - span], low[span - step :])
    count = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(first.size), count)
    start = np.arange(int(count.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    end = np.concatenate([new[1:], [at.size]]) - 1
    a, s1, s2 = at[new], start[new], start[end]
    h = Hashes(raw)
    core = h.of(a, a + length - span + 1)
    ctx = mix64(h.of(s1, s2 + length) + mix64(core + (a - s1).astype(np.uint64)))
    return row[new], a, s1, s2, core, ctx


def content_buffer(column: pa.Array, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, or of their codes: a hash of eight bytes for each word (a run without ASCII white space)."""
    raw, offsets = text_buffer(column)
    if not by_words:
        return raw, offsets
    start, end, row = words(raw, offsets, NOT_SPACE)
    return hash_words(raw, start, end).view(np.uint8), 8 * np.searchsorted(row, np.arange(offsets.size))


def stretches(batch: pa.RecordBatch, length: int, by_words: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row in batch, place of each row's first byte in its content); long contents come in overlapping parts."""
    done = 0
    for part in pieces(batch, STRETCH):
        raw, offsets = content_buffer(part.column(part.schema.get_field_index("text")), by_words)
        if part.num_rows == 1 and raw.size > 2 * STRETCH:
            for at in range(0, raw.size - length + 1, STRETCH):
                end = min(raw.size, at + STRETCH + length - 1)
                yield raw[at:end], np.array([0, end - at]), np.array([done]), np.array([at])
        else:
            yield raw, offsets, np.arange(done, done + part.num_rows), np.zeros(part.num_rows, np.int64)
        done += part.num_rows


#: Keys of texts that a task remembers, to pass copies over.
SEEN = 100_000


def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose (key, n) this task has not met lately; copies in other tasks are met again later."""
    seen: set = set()
    for batch in batches:
        keys = list(zip(batch.column(batch.schema.get_field_index("key")).to_pylist(), batch.column(batch.schema.get_field_index("n")).to_pylist()))
        keep = []
        for i, k in enumerate(keys):
            if k not in seen:
                seen.add(k)
                keep.append(i)
        if len(seen) > SEEN:
            seen.clear()
        if keep:
            yield batch.take(pa.array(keep)) if len(keep) < len(keys) else batch


def find_anchors(length: int, by_words: bool) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unseen(batches):
            key = batch.column(batch.schema.get_field_index("key")).to_numpy()
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()
            for raw, offsets, rows, base in stretches(batch, length, by_words):
                row, a, s1, s2, core, ctx = anchors(raw, offsets, length)
                shift = base[row] - offsets[:-1][row]
                own = rows[row]
                arrays = [core.view(np.int64), ctx.view(np.int64), key[own], n[own], (a + shift).astype(np.int32), (s1 + shift).astype(np.int32), (s2 + shift).astype(np.int32)]
                yield pa.record_batch([pa.array(x) for x in arrays], ["core", "ctx", "key", "n", "a", "s1", "s2"])

    return run


def cut_contexts(length: int, by_words: bool) -> callable:
    """The bytes of requested contexts, left of the core (reversed) and right of it."""

    after = length - span_of(length) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unseen(batches):
            for part in pieces(batch, STRETCH):
                raw, offsets = content_buffer(part.column(part.schema.get_field_index("text")), by_words)
                whole = raw.tobytes()
                out = {c: [] for c in ("core", "ctx", "key", "n", "a", "s1", "s2", "left", "right")}
                for i, (key, n, wanted) in enumerate(zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("key", "n", "wanted")))):
                    o = int(offsets[i])
                    for w in wanted:
                        a, s1, s2 = o + w["a"], o + w["s1"], o + w["s2"]
                        for c in ("core", "ctx", "a", "s1", "s2"):
                            out[c].append(w[c])
                        out["key"].append(key)
                        out["n"].append(n)
                        out["left"].append(whole[s1:a][::-1])
                        out["right"].append(whole[a + after : s2 + length])
                yield pa.record_batch([pa.array(out[c], pa.int64() if c in ("core", "ctx", "key") else pa.binary() if c in ("left", "right") else pa.int32()) for c in out], list(out))

    return run


def padded(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of bytes, rows filled with zeros, and the rows' sizes."""
    size = np.array([len(x) for x in parts], np.int64)
    out = np.zeros((len(parts), width), np.uint8)
    out[np.arange(width)[None, :] < size[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
    return out, size


def longest_shared(bytes_: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row, the longest prefix that another row of its group has too."""
    n, width = bytes_.shape
    keyed = np.zeros((n, width + 4), np.uint8)
    keyed[:, :4] = group.astype(">u4").view(np.uint8).reshape(n, 4)
    keyed[:, 4:] = bytes_
    order = np.argsort(keyed.view(f"V{width + 4}").ravel(), kind="stable")
    x, z, g = bytes_[order], size[order], group[order]
    differ = x[1:] != x[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.where(g[1:] == g[:-1], np.minimum(np.minimum(common, z[1:]), z[:-1]), 0)
    best = np.zeros(n, np.int64)
    best[1:] = common
    best[:-1] = np.maximum(best[:-1], common)
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def informative(bytes_: np.ndarray, extent: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which columns of each row are within its extent and differ, or end another row's extent, somewhere in its group."""
    width = bytes_.shape[1]
    inside = np.arange(width)[None, :] < extent[:, None]
    high = np.maximum.reduceat(np.where(inside, bytes_, 0), starts, axis=0)
    low = np.minimum.reduceat(np.where(inside, bytes_, 255), starts, axis=0)
    split = np.zeros((starts.size, width + 1), bool)
    split[group, extent] = True
    split[:, :width] |= high > low
    return inside & split[group, :width]


def repeated_windows(left: list[bytes], right: list[bytes], group: np.ndarray, low_u: np.ndarray, high_u: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(context, first u, last u): windows that start u bytes left of the anchor and occur in another context too.

    A window takes u bytes on the left and width - u on the right of the core. Rows of a group are adjacent.
    """
    lb, lz = padded(left, width)
    rb, rz = padded(right, width)
    l_most, r_most = longest_shared(lb, lz, group), longest_shared(rb, rz, group)
    keep = np.flatnonzero(l_most + r_most >= width)
    if not keep.size:
        return []
    lb, rb, l_most, r_most, g = lb[keep], rb[keep], l_most[keep], r_most[keep], group[keep]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    dense = np.cumsum(np.concatenate([[0], (g[1:] != g[:-1]).astype(np.int64)]))
    l_in, r_in = informative(lb, l_most, starts, dense), informative(rb, r_most, starts, dense)

    out: list[tuple[int, int, int]] = []
    edges = np.append(starts, keep.size)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a < 2:
            continue
        if int(l_in[a:b].sum() + r_in[a:b].sum()) > SYMBOLS:
            k = keep[a:b]
            first_u, last_u = np.maximum(low_u[k], width - r_most[a:b]), np.minimum(high_u[k], l_most[a:b])
            out += [(int(keep[a + i]), u1, u2) for i, u1, u2 in repeated_by_hash(lb[a:b], rb[a:b], first_u, last_u)]
            continue
        # Symbols: 0..255 bytes, 256 the core, above that an end of its own for each context.
        text: list[int] = []
        spots: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for i in range(a, b):
            lc, rc = np.flatnonzero(l_in[i]), np.flatnonzero(r_in[i])
            spots.append((len(text), lc, rc, i))
            text += lb[i, lc][::-1].tolist() + [256] + rb[i, rc].tolist() + [257 + i - a]
        order = suffix_array(text)
        shared = common_prefixes(text, order)
        best = [0] * len(text)
        for r, i in enumerate(order):
            best[i] = max(shared[r], shared[r + 1] if r + 1 < len(order) else 0)
        for begin, lc, rc, i in spots:
            row, m = int(keep[i]), lc.size
            for q in range(m + 1):
                # The suffix with q symbols left of the core: its windows start between two informative columns.
                matched = best[begin + m - q] - q - 1  # right symbols matched, if the core is reached
                if matched < 0:
                    continue
                reach = int(rc[matched]) if matched < rc.size else int(r_most[i])
                u1 = max(int(lc[q - 1]) + 1 if q else 0, width - reach, int(low_u[row]))
                u2 = min(int(lc[q]) if q < m else int(l_most[i]), int(high_u[row]))
                if u1 <= u2:
                    out.append((row, u1, u2))
    return out


def repeated_by_hash(lb: np.ndarray, rb: np.ndarray, first_u: np.ndarray, last_u: np.ndarray) -> list[tuple[int, int, int]]:
    """(context, first u, last u) as repeated_windows(), of one group: windows (u bytes of lb, the rest of rb) whose hash another context has too."""
    n, width = lb.shape
    up = powers(width)[0][:width]
    sides = []
    for x in (lb, rb):
        sums = np.zeros((n, width + 1), np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up, axis=1, out=sums[:, 1:])
        sides.append(sums)
    u = np.arange(width + 1)
    row, at = np.nonzero((u >= first_u[:, None]) & (u <= last_u[:, None]))
    h = mix64(mix64(sides[0][row, at]) + sides[1][row, width - at] * MIX + at.astype(np.uint64))
    del sides
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(h.size, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    row, at = row[twice], at[twice]
    begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])) if row.size else np.zeros(0, np.int64)
    end = np.append(begin[1:], row.size) - 1 if row.size else begin
    return list(zip(row[begin].tolist(), at[begin].tolist(), at[end].tolist()))


def solve_groups(length: int) -> callable:
    """Window starts that repeat, from contexts that come in order of core; some ten thousand are held at once."""
    width = span_of(length) - 1

    def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: t[c].to_numpy() for c in ("core", "ctx", "key", "n", "a", "s1", "s2")}
        order = np.lexsort((col["ctx"], col["core"]))
        core, ctx = col["core"][order], col["ctx"][order]
        order = order[np.concatenate([[True], (core[1:] != core[:-1]) | (ctx[1:] != ctx[:-1])])]
        col = {c: v[order] for c, v in col.items()}
        left, right = t["left"].take(order).to_pylist(), t["right"].take(order).to_pylist()
        group = np.cumsum(np.concatenate([[0], (col["core"][1:] != col["core"][:-1]).astype(np.int64)]))
        anchor = col["a"]
        found = repeated_windows(left, right, group, anchor - col["s2"], anchor - col["s1"], width)
        if found:
            row, u1, u2 = np.array(found).T
            yield pa.record_batch([pa.array(col["key"][row]), pa.array(col["n"][row]), pa.array((anchor[row] - u2).astype(np.int32)), pa.array((anchor[row] - u1).astype(np.int32))], ["key", "n", "s1", "s2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "core", AT_ONCE):
            yield from solved(t)

    return run


def hash_windows(length: int) -> callable:
    """(window hash, place) of every window of contexts whose core has too many for one task."""
    width = span_of(length) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                raw = np.frombuffer(r["left"][::-1] + r["right"], np.uint8)
                s = np.arange(r["s2"] - r["s1"] + 1)
                h = Hashes(raw).of(s, s + width)
                h = mix64(h + mix64(np.uint64(r["core"] % (1 << 64)) + (len(r["left"]) - s).astype(np.uint64)))
                k = s.size
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.full(k, r["key"])), pa.array(np.full(k, r["n"], np.int32)), pa.array((s + r["s1"]).astype(np.int32))], ["h", "key", "n", "s1"])

    return run


def add_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the code of each text."""
    for batch in batches:
        for part in pieces(batch):
            raw, offsets = content_buffer(part.column(part.schema.get_field_index("text")), True)
            whole, cut = raw.tobytes(), offsets.tolist()
            yield pa.record_batch([*part.columns, pa.array([whole[x:y] for x, y in zip(cut, cut[1:])], pa.binary())], [*part.schema.names, "_code"])


def word_runs(text: bytes, found: list[dict], count: int) -> list[list[int]]:
    """Byte places of maximal runs of words that repeated windows of `count` words cover; found has places in the text's code."""
    raw = np.frombuffer(text, np.uint8)
    start, end, _ = words(raw, np.array([0, raw.size]), NOT_SPACE)
    out: list[list[int]] = []
    last = -1
    for s1, s2 in sorted((x["s1"], x["s2"]) for x in found):
        a, b = -(-s1 // 8), s2 // 8  # windows that begin with a word
        if a > b:
            continue
        if out and a <= last:
            last = max(last, b + count)
            out[-1][1] = int(end[last - 1])
        else:
            last = b + count
            out.append([int(start[a]), int(end[last - 1])])
    return out


def cut_out(carry: list[str], length: int, count: int) -> callable:
    """carry, n_bytes, removed (runs of byte places), kept (the remaining bytes), kept_text (without parts of cut characters)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                raw, offsets = text_buffer(part.column(part.schema.get_field_index("text")))
                whole = raw.tobytes()
                removed, kept = [], []
                for i, found in enumerate(part.column(part.schema.get_field_index("_found")).to_pylist()):
                    runs: list[list[int]] = []
                    for s1, s2 in sorted((x["s1"], x["s2"]) for x in found or []):
                        if runs and s1 <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], s2 + length)
                        else:
                            runs.append([s1, s2 + length])
                    text = whole[offsets[i] : offsets[i + 1]]
                    if count:
                        runs = word_runs(text, found or [], count)
                    removed.append([{"start": a, "end": b} for a, b in runs])
                    ends = [0, *(x for r in runs for x in r), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
                arrays = {c: part.column(part.schema.get_field_index(c)) for c in carry}
                arrays["n_bytes"] = pa.array(np.diff(offsets))
                arrays["removed"] = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                arrays["kept"] = pa.array(kept, pa.binary())
                arrays["kept_text"] = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())
                yield pa.record_batch(list(arrays.values()), list(arrays))

    return run


def with_keys(rows: DataFrame, by_words: bool) -> DataFrame:
    """Adds _key, the first 64 bits of the MD5 of the text or its code, and _n, its bytes."""
    content = "text"
    if by_words:
        rows, content = rows.mapInArrow(add_codes, T.StructType([*rows.schema.fields, T.StructField("_code", T.BinaryType())])), "_code"
    digest = F.conv(F.substring(F.md5(content), 1, 16), 16, -10).cast("long")
    return rows.withColumns({"_key": digest, "_n": F.octet_length(content)}).drop("_code")


def find_repeats(rows: DataFrame, length: int, group_contexts: int, by_words: bool) -> tuple[DataFrame, list[int]]:
    """(key, n, found: ranges of window starts that repeat) of each text that has any, and the keys of very frequent texts."""
    texts = rows.where(F.col("_n") >= length).select(F.col("_key").alias("key"), F.col("_n").alias("n"), "text")
    found = materialise(texts.mapInArrow(find_anchors(length, by_words), ANCHOR), "anchors")
    copies = materialise(texts.groupBy("key", "n").agg(F.count("*").alias("c")).where("c > 1"), "copies")
    # A thousand keys at most, whatever the input.
    hot = [r.key for r in copies.where(F.col("c") >= max(HOT_COPIES, rows.count() // 1000)).select("key").collect()]

    # Anchors whose core occurs once drop out first: two numbers of each are exchanged for that.
    company = materialise(found.groupBy("core").agg(F.count("*").alias("_c")).where("_c > 1").select(F.col("core").alias("_core")), "company")
    # By sorting at every size, so that frequent cores can be split.
    met = materialise(found.hint("merge").join(company.hint("merge"), F.col("core") == F.col("_core"), "left_semi"), "met")
    drop_table(found)
    drop_table(company)

    # Contexts and how they occur; a context occurs twice if its first and last occurrence differ.
    place = F.struct("key", "n", "a", "s1", "s2")
    contexts = met.groupBy("core", "ctx").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).withColumn("twice", F.col("lo") != F.col("hi"))
    contexts = materialise(contexts.select("core", "ctx", "lo", "twice"), "contexts")
    cores = contexts.groupBy("core").agg(F.count("*").alias("many"), F.min(F.col("twice").cast("int")).alias("all_twice")).where("many > 1 and all_twice = 0")
    cores = materialise(cores.select(F.col("core").alias("_core"), "many"), "cores")
    same = met.join(contexts.where("twice").select(F.col("ctx").alias("_ctx")), F.col("ctx") == F.col("_ctx"), "left_semi").select("key", "n", "s1", "s2")

    wanted = contexts.join(cores, F.col("core") == F.col("_core")).select("core", "ctx", "many", "lo.*").groupBy("key", "n").agg(F.collect_list(F.struct("core", "ctx", "a", "s1", "s2")).alias("wanted"))
    single = texts
    if hot:
        single = single.where(~F.col("key").isin(hot)).union(single.where(F.col("key").isin(hot)).mapInArrow(unseen, single.schema))
    bytes_ = materialise(single.join(wanted, ["key", "n"]).select("key", "n", "text", "wanted").mapInArrow(cut_contexts(length, by_words), ANCHOR + ", left binary, right binary"), "bytes")
    grouped = bytes_.join(cores.where(F.col("many") <= group_contexts), F.col("core") == F.col("_core")).drop("_core", "many")
    partly = grouped.repartition("core").sortWithinPartitions("core").mapInArrow(solve_groups(length), "key long, n int, s1 int, s2 int")
    spent = [bytes_, contexts, cores, met, copies]
    if cores.where(F.col("many") > group_contexts).limit(1).count():
        large = bytes_.join(cores.where(F.col("many") > group_contexts), F.col("core") == F.col("_core"), "left_semi").dropDuplicates(["core", "ctx"])
        windows = materialise(large.mapInArrow(hash_windows(length), "h long, key long, n int, s1 int"), "windows")
        spent.append(windows)
        where = F.struct("key", "n", "s1")
        many = windows.groupBy("h").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).where("lo != hi").select("h")
        partly = partly.unionByName(windows.join(many, "h", "left_semi").select("key", "n", "s1", F.col("s1").alias("s2")))
    whole = copies.select("key", "n", F.lit(0).alias("s1"), (F.col("n") - length).alias("s2"))
    covered = same.unionByName(partly).unionByName(whole).groupBy("key", "n").agg(F.collect_list(F.struct("s1", "s2")).alias("found"))
    covered = materialise(covered, "covered")
    for t in spent:
        drop_table(t)
    return covered, hot


def remove_repeats(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), length: int = 400, group_contexts: int = 10_000, n_words: int = 0) -> DataFrame:
    """carry, n_bytes, removed (runs of places), kept (bytes), kept_text for each row of docs.

    With n_words, what repeats is a window of so many words instead of `length` bytes: words are runs without ASCII white space, the
    white space between them may differ, and what is cut goes from the first byte of a run of covered words to the last.
    """
    if n_words:
        length = 8 * n_words  # of a text's code, eight bytes of a hash per word
    if length < 64:
        raise ValueError("length must be at least 64 bytes, n_words at least 8")
    names = [c for c in carry if c != "text"]
    reserve(names, ["n_bytes", "removed", "kept", "kept_text", "_key", "_n", "_salt", "_found", "_code"])
    rows = with_keys(docs.select(*names, F.coalesce("text", F.lit("")).alias("text")), bool(n_words))
    covered, hot = find_repeats(with_keys(docs.select(F.coalesce("text", F.lit("")).alias("text")), bool(n_words)), length, group_contexts, bool(n_words))
    # Texts too short to repeat meet nothing, so each has a key of its own; copies of frequent texts are spread.
    long_, number = F.col("_n") >= length, F.monotonically_increasing_id()
    salt = F.when(F.col("_key").isin(hot) & long_, F.pmod(number, F.lit(SALTS)).cast("int")).otherwise(0) if hot else F.lit(0)
    keyed = rows.select(*names, "text", F.when(long_, F.col("_key")).otherwise(number).alias("_key"), F.when(long_, F.col("_n")).otherwise(-1).alias("_n"), salt.alias("_salt"))
    salts = F.when(F.col("key").isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    sides = covered.select(F.col("key").alias("_key"), F.col("n").alias("_n"), F.explode(salts).alias("_salt"), F.col("found").alias("_found"))
    rows = keyed.join(sides, ["_key", "_n", "_salt"], "left")
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])
    return rows.select(*names, "text", "_found").mapInArrow(cut_out(names, length, n_words), schema)


def repeat_digest(cut: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what remove_repeats() gives."""
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
