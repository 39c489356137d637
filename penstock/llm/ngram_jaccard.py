"""N-gram Jaccard join: classes of documents whose sets of 5-word shingles link at a similarity of 0.75 or more.

1. Sets. A document's shingles are hashed to 64 bits; its class is the hash of its sorted set, so documents
   with equal sets are one. Shingles follow their hash order.
2. Candidates. Linked sets of n and m shingles share at least ceil(0.75 n), so of the first ceil(0.25 n) + c shingles
   of both, c are common (c: 0.15 n of the smaller). A task that gets all of a shingle among these counts its sets; a set with
   too few shared ones is linked with nothing. Of the others the rarest shingles that prefix filtering asks for become edges
   to one set of the shingle, never between all its sets. Components of these edges hold all links. Shingles that very many
   sets have are found first, by partial counts; they stay with their sets instead of meeting in a task.
   A component too large for a task is a chain of chance meetings in most cases, so its sets are held whole against each other
   first: the same filter over all of their shingles, where only sets that have a shingle among their rarest meet. What is left
   falls into components again.
3. T-occurrence search. A component's sets meet in one task (one that is still too large in several, by pairs of blocks). There
   each set looks for sets that share at least T of its shingles: short inverted lists are merged and counted, what they
   find is looked up in the long lists by binary search (DivideSkip), and sizes decide exactly. A set that has been
   reached need not be found again, so a search only looks for sets that are not in a class yet. In a large component all
   sets are first held against one of them, row by row; only those that it does not link to need searches.
4. Classes get the least doc_id of their documents.

Nulls and edge cases: a null, empty or blank text has no shingles and is linked with nothing; texts of one to four words have
one shingle; a null doc_id is linked like any other but never names a class that has another id; repeated rows are in one
class; an empty table gives an empty result; other columns are ignored. A similarity of just 0.75 links. A very long text is one set,
in memory at once (8 bytes a word). Texts with a thousandth of all rows as copies are thinned out in their tasks before copies meet.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, drop_table, hash_words, hot_keys, materialise, mix64, partitions, pieces, reserve, text_buffer, whole_groups, window_hashes, words
from .components import connected_components

WORDS = 5
#: Similarity as a fraction of integers.
NEED, OF = 75, 100
#: Bytes of text handled at once, and how many sets of such a slice make a shingle worth counting.
SLICE = 2 << 20
OFTEN = 4
#: Shingles of a bucket, which a task holds at once, and the least number of buckets; rows of sets that a task turns into edges at once.
BUCKET, BUCKETS = 2_000_000, 12
SETS_AT_ONCE = 20_000
#: A text is very frequent from so many copies on, or a thousandth of all rows where that is more.
HOT_COPIES = 1000
SETS = "unit long, sig long, linked boolean, grams binary"


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    raw, offsets = text_buffer(column)
    raw = LOWER[raw]
    start, end, row = words(raw, offsets, NOT_SPACE)
    h = hash_words(raw, start, end)
    first = np.searchsorted(row, np.arange(len(offsets)))
    grams = window_hashes(h, WORDS)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WORDS:
            yield np.unique(grams[a : b - WORDS + 1])
        else:
            yield window_hashes(h[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def required(n):
    """The least overlap of a set of n with any set linked to it."""
    return -(-NEED * n // OF)


def extra(n):
    """How many common shingles a sample of n shingles' set is made for."""
    return np.maximum(1, 3 * n // 20)


def common_sampled(n):
    """How many common shingles the samples of a set of n and of any linked set share at least."""
    return extra(required(n))


def sample_size(n):
    return np.minimum(n, n - required(n) + extra(n))


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text key, set size and class of each row."""
    for batch in batches:
        for part in pieces(batch, SLICE):
            n, sig = [], []
            for s in shingle_sets(part.column(part.schema.get_field_index("text"))):
                n.append(s.size)
                sig.append(signature(s))
            yield pa.record_batch([part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("key")), pa.array(n, pa.int64()), pa.array(sig, pa.int64())], ["doc_id", "key", "n", "sig"])


def often_sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sampled shingles that several sets of a slice have: how many, and one of the sets."""
    for batch in batches:
        for part in pieces(batch, SLICE):
            sets = {signature(s): s[: int(sample_size(s.size))] for s in shingle_sets(part.column(part.schema.get_field_index("text"))) if s.size}
            if sets:
                token = np.concatenate(list(sets.values()))
                sig = np.repeat(np.array(list(sets), np.int64), [t.size for t in sets.values()])
                token, first, many = np.unique(token, return_index=True, return_counts=True)
                often = many >= OFTEN
                yield pa.record_batch([pa.array((token[often] >> np.uint64(16)).astype(np.int64)), pa.array(many[often]), pa.array(sig[first[often]])], ["token", "n", "root"])


def common_shingles(texts: DataFrame, hot_sets: int) -> pa.Table:
    """(token, n, root) of shingles that at least hot_sets sets have, or a thousandth of all rows where that is more.

    So there are at most a thousand times the shingles of an average sample: some megabytes at any size.
    """
    least = max(hot_sets, texts.count() // 1000)
    counted = texts.select("text").mapInArrow(often_sampled, "token long, n long, root long").groupBy("token").agg(F.sum("n").alias("n"), F.min("root").alias("root"))
    return counted.where(F.col("n") >= least).orderBy("token").toArrow()


def own_common_shingles(shared) -> callable:
    """For each set its sampled shingles that are common, as shared_shingles() gives the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, many, root = shared.value
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch, SLICE):
                out = {c: [] for c in ("sig", "n", "df", "token", "root")}
                for s in shingle_sets(part.column(part.schema.get_field_index("text"))):
                    own = s[: int(sample_size(s.size))] >> np.uint64(16)
                    at = np.searchsorted(token, own)
                    at[at == token.size] = 0
                    at = at[token[at] == own] if own.size else at
                    if at.size and (g := signature(s)) not in seen:
                        seen.add(g)
                        for c, v in zip(out, (g, s.size, np.minimum(many[at], 0xFFFFFFFF).astype("<u4").tobytes(), token[at].astype("<u8").tobytes(), root[at].astype("<i8").tobytes())):
                            out[c].append(v)
                if len(seen) > 100_000:
                    seen.clear()
                if out["sig"]:
                    yield pa.record_batch([pa.array(v, pa.int64() if c in ("sig", "n") else pa.binary()) for c, v in out.items()], list(out))

    return run


def dealt_shingles(token: np.ndarray, own: np.ndarray, sigs: list[int], sizes: list[int], buckets: int) -> pa.RecordBatch:
    """A row per bucket of shingles: the shingles (48 bits), which of the bucket's sets has each, and these sets."""
    bucket = (token & np.uint64(0xFFFFFF)).astype(np.int64) * buckets >> 24
    order = np.argsort(bucket, kind="stable")
    token, own, bucket = token[order] >> np.uint64(16), own[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    sig, size = np.array(sigs, "<i8"), np.array(sizes, "<u4")
    out = {c: [] for c in ("bucket", "low", "high", "own", "sig", "size")}
    for b in np.unique(bucket).tolist():
        t, o = token[cut[b] : cut[b + 1]], own[cut[b] : cut[b + 1]]
        there, o = np.unique(o, return_inverse=True)
        out["bucket"].append(b)
        out["low"].append((t & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
        out["high"].append((t >> np.uint64(32)).astype("<u2").tobytes())
        out["own"].append(o.astype("<u2" if there.size < 1 << 16 else "<u4").tobytes())
        out["sig"].append(sig[there].tobytes())
        out["size"].append(size[there].tobytes())
    return pa.record_batch([pa.array(v, pa.int32() if c == "bucket" else pa.binary()) for c, v in out.items()], list(out))


def deal_samples(buckets: int, shared=None) -> callable:
    """For each slice and bucket of shingles: the sampled shingles (48 bits), which set of the slice has each, and the sets.

    Common shingles (shared) are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch, SLICE):
                sigs, sizes, tokens = [], [], []
                for s in shingle_sets(part.column(part.schema.get_field_index("text"))):
                    if s.size and (g := signature(s)) not in seen:
                        seen.add(g)
                        sigs.append(g)
                        sizes.append(s.size)
                        tokens.append(s[: int(sample_size(s.size))])
                if len(seen) > 100_000:
                    seen.clear()
                if not sigs:
                    continue
                own = np.repeat(np.arange(len(sigs), dtype="<u4"), [t.size for t in tokens])
                token = np.concatenate(tokens)
                if shared is not None:
                    common = shared.value[0]
                    at = np.searchsorted(common, token >> np.uint64(16))
                    at[at == common.size] = 0
                    rare = common[at] != token >> np.uint64(16)
                    own, token = own[rare], token[rare]
                yield dealt_shingles(token, own, sigs, sizes, buckets)

    return run


def deal_whole_sets(buckets: int) -> callable:
    """The same of all shingles of sets (sig, root, grams): those of different components never meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, root, grams = (batch.column(i).to_pylist() for i in range(3))
            a, total = 0, 0
            for b in range(1, len(sig) + 1):
                total += len(grams[b - 1])
                if total >= SLICE or b == len(sig):
                    sizes = [len(g) // 8 for g in grams[a:b]]
                    own = np.repeat(np.arange(b - a, dtype="<u4"), sizes)
                    salt = mix64(np.array(root[a:b], np.int64).view(np.uint64))
                    yield dealt_shingles(mix64(np.frombuffer(b"".join(grams[a:b]), "<u8") ^ salt[own]), own, sig[a:b], sizes, buckets)
                    a, total = b, 0

    return run


def shared_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set and bucket: its sampled shingles that other sets have too, with their number of sets and one set."""
    for t in whole_groups(batches, "bucket", 1):
        yield from shared_in_bucket(t)


def shared_in_bucket(t: pa.Table) -> Iterator[pa.RecordBatch]:
    low, high, sigs, sizes = [], [], [], []
    for lo, hi, own, sig, size in zip(*(t[c].to_pylist() for c in ("low", "high", "own", "sig", "size"))):
        lo = np.frombuffer(lo, "<u4")
        own = np.frombuffer(own, "<u2" if len(own) == 2 * lo.size else "<u4")
        low.append(lo)
        high.append(np.frombuffer(hi, "<u2"))
        sigs.append(np.frombuffer(sig, "<i8")[own])
        sizes.append(np.frombuffer(size, "<u4")[own])
    if not low:
        return
    token = np.concatenate(low).astype(np.uint64) | np.concatenate(high).astype(np.uint64) << np.uint64(32)
    del low, high
    sig, size = np.concatenate(sigs), np.concatenate(sizes)
    del sigs, sizes
    # A shingle of one set only is of no use; most are.
    order = np.argsort(token, kind="stable")
    t = token[order]
    again = np.concatenate([[False], t[1:] == t[:-1]])
    again[:-1] |= again[1:]
    order = order[again]
    token, sig, size = token[order], sig[order], size[order]
    order = np.lexsort((sig, token))
    token, sig, size = token[order], sig[order], size[order]
    if not token.size:
        return
    new = np.concatenate([[True], token[1:] != token[:-1]])
    fresh = new | np.concatenate([[True], sig[1:] != sig[:-1]])
    token, sig, size, new = token[fresh], sig[fresh], size[fresh], new[fresh]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, token.size))
    df, root = np.repeat(many, many), np.repeat(sig[first], many)
    keep = df > 1
    token, sig, size, df, root = token[keep], sig[keep], size[keep], df[keep], root[keep]
    order = np.lexsort((token, sig))
    token, sig, size, df, root = token[order], sig[order], size[order], df[order], root[order]
    cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if sig.size else np.zeros(0, np.int64)
    edges = np.append(cut, sig.size)
    for a in range(0, cut.size, 2000):
        own = range(a, min(a + 2000, cut.size))
        piece = lambda x, kind: [x[edges[i] : edges[i + 1]].astype(kind).tobytes() for i in own]
        yield pa.record_batch(
            [pa.array(sig[cut[a : a + 2000]]), pa.array(size[cut[a : a + 2000]].astype(np.int64)), pa.array(piece(df, "<u4"), pa.binary()), pa.array(piece(token, "<u8"), pa.binary()), pa.array(piece(root, "<i8"), pa.binary())],
            ["sig", "n", "df", "token", "root"],
        )


def prefix_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): a set and a set that has one of its rarest sampled shingles; nothing for sets that share too few. Rows come in order of set."""
    for t in whole_groups(batches, "sig", SETS_AT_ONCE):
        yield from edges_of_sets(t)


def rarest_shared(t: pa.Table, sampled: callable, least: callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sig, token, root) of the rarest shared shingles of each set, one of which any linked set has among its own too.

    Of sampled(n) shingles of a set of n, any linked set shares least(n) or more; nothing for sets that share fewer with all others.
    """
    parts = {c: [] for c in ("sig", "n", "df", "token", "root")}
    size = [len(x) // 4 for x in t["df"].to_pylist()]
    parts["sig"].append(np.repeat(t["sig"].to_numpy(), size))
    parts["n"].append(np.repeat(t["n"].to_numpy(), size))
    for c, kind in (("df", "<u4"), ("token", "<u8"), ("root", "<i8")):
        parts[c].append(np.frombuffer(b"".join(t[c].to_pylist()), kind))
    sig, n, df, token, root = (np.concatenate(v) for v in parts.values())
    order = np.lexsort((token, df, sig))
    sig, n, root, token = sig[order], n[order], root[order], token[order]
    once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (token[1:] != token[:-1])])  # copies in other tasks
    sig, n, root, token = sig[once], n[once], root[once], token[once]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    many = np.diff(np.append(first, sig.size))
    place = np.arange(sig.size) - np.repeat(first, many)
    alone = sampled(n) - np.repeat(many, many)
    use = (np.repeat(many, many) >= least(n)) & (place < sampled(n) - least(n) + 1 - alone)
    return sig[use], token[use], root[use]


def edges_of_sets(t: pa.Table) -> Iterator[pa.RecordBatch]:
    sig, _, root = rarest_shared(t, sample_size, common_sampled)
    pairs = np.unique(np.stack([sig, root], axis=1)[sig != root], axis=0)
    for a in range(0, len(pairs), 100_000):
        yield pa.record_batch([pa.array(pairs[a : a + 100_000, 0]), pa.array(pairs[a : a + 100_000, 1])], ["a", "b"])


def rarest_of_whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, sig) of the rarest shingles of whole sets, which come in order of set."""
    for t in whole_groups(batches, "sig", SETS_AT_ONCE):
        sig, token, _ = rarest_shared(t, lambda n: n, required)
        for a in range(0, sig.size, 100_000):
            yield pa.record_batch([pa.array(token[a : a + 100_000].view(np.int64)), pa.array(sig[a : a + 100_000])], ["token", "sig"])


def send_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, sig, linked (to the component's pivot) and the whole set, for each unit a candidate belongs to; copies that meet in this task go once."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        for part in pieces(batch, SLICE):
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(part.column(part.schema.get_field_index("text")))]
            units = part.column(part.schema.get_field_index("units")).to_pylist()
            sig = part.column(part.schema.get_field_index("sig")).to_pylist()
            linked = part.column(part.schema.get_field_index("linked")).to_pylist()
            rows = []
            for us, g, known, s in zip(units, sig, linked, sets):
                if (g, us[0]) not in seen:
                    seen.add((g, us[0]))
                    rows += [(u, g, known, s) for u in us]
            if len(seen) > 100_000:
                seen.clear()
            for a in range(0, len(rows), 500):
                u, g, known, s = zip(*rows[a : a + 500])
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(g, pa.int64()), pa.array(known, pa.bool_()), pa.array(s, pa.binary())], ["unit", "sig", "linked", "grams"])


class InvertedLists:
    """Inverted lists of shingles over some sets, and T-occurrence search in them."""

    def __init__(self, token: np.ndarray, owner: np.ndarray, tokens: int):
        order = np.lexsort((owner, token))
        self.owner = owner[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(token, minlength=tokens))])

    def restricted(self, keep: np.ndarray) -> None:
        """Drop sets that need not be found any more."""
        stay = keep[self.owner]
        total = np.concatenate([[0], np.cumsum(stay)])
        self.owner, self.begin = self.owner[stay], total[self.begin]

    def search(self, tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(sets, overlaps) of all sets with at least `least` of the tokens."""
        size = self.begin[tokens + 1] - self.begin[tokens]
        tokens, size = tokens[size > 0], size[size > 0]
        if tokens.size < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # DivideSkip: this many of the longest lists are only probed.
        probed = min(least - 1, int(least / (0.01 * math.log(int(size.max()) + 1) + 1)))
        order = np.argsort(-size, kind="stable")
        long_, short = tokens[order[:probed]], tokens[order[probed:]]
        found, count = self.merged(short)
        enough = count >= least - probed
        found, count = found[enough], count[enough]
        for t in long_.tolist():
            if not found.size:
                break
            row = self.owner[self.begin[t] : self.begin[t + 1]]
            at = np.searchsorted(row, found)
            at[at == row.size] = 0
            count = count + (row[at] == found)
        return found[count >= least], count[count >= least]

    def merged(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sets on the lists of the tokens and how often: a heap merge of few entries, a sorted merge in numpy of many."""
        lists = [self.owner[self.begin[t] : self.begin[t + 1]] for t in tokens.tolist()]
        if sum(x.size for x in lists) <= 64:
            found: list[int] = []
            count: list[int] = []
            for x in heapq.merge(*(v.tolist() for v in lists)):
                if found and found[-1] == x:
                    count[-1] += 1
                else:
                    found.append(x)
                    count.append(1)
            return np.array(found, np.int64), np.array(count, np.int64)
        return np.unique(np.concatenate(lists), return_counts=True)


def linked_classes(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    """For each set the first set of its class, by breadth-first T-occurrence searches among sets not reached yet.

    Sets that are known to be in one class are in no inverted list; searches start from them.
    """
    size = np.array([s.size for s in sets], np.int64)
    vocabulary, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(size.size), size)
    begin = np.concatenate([[0], np.cumsum(size)])
    root = np.full(size.size, -1)
    free = ~known
    listed = free[owner]
    lists = InvertedLists(token[listed], owner[listed], vocabulary.size)
    left = indexed = int(free.sum())
    first = np.flatnonzero(known)
    root[first] = first[:1]
    for seed in [*first[:1].tolist(), *np.flatnonzero(free).tolist()]:
        if known[seed]:
            queue = first.tolist()
        elif root[seed] >= 0:
            continue
        else:
            root[seed], free[seed] = seed, False
            left -= 1
            queue = [seed]
        while queue and left:
            q = queue.pop()
            found, overlap = lists.search(token[begin[q] : begin[q + 1]], int(required(size[q])))
            fits = free[found] & ((NEED + OF) * overlap >= NEED * (size[q] + size[found]))
            found = found[fits]
            if found.size:
                root[found], free[found] = seed, False
                left -= found.size
                queue += found.tolist()
            if left < indexed // 2:
                lists.restricted(free)
                indexed = left
    return root


def solve_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): set and a set of its class, one for all of the class, from units that come in order of unit.

    Links between sets that a pivot links to are known, and are not among the pairs.
    """

    def solved(rows: dict[int, tuple[bool, bytes]]) -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            sigs = np.array(sorted(rows), np.int64)
            known = np.array([rows[int(g)][0] for g in sigs])
            root = sigs[linked_classes([np.frombuffer(rows[int(g)][1], "<u8") for g in sigs], known)]
            own = (root != sigs) & ~known
            if own.any():
                yield pa.record_batch([pa.array(sigs[own]), pa.array(root[own])], ["a", "b"])

    now, rows = None, {}
    for batch in batches:
        for unit, sig, known, grams in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if unit != now:
                yield from solved(rows)
                now, rows = unit, {}
            rows[sig] = known, grams
    yield from solved(rows)


def against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sig and whether the set links to its component's pivot."""
    for batch in batches:
        linked = []
        for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
            overlap = np.intersect1d(x, y, assume_unique=True).size
            linked.append((NEED + OF) * overlap >= NEED * (x.size + y.size))
        yield pa.record_batch([batch.column(0), pa.array(linked, pa.bool_())], ["sig", "linked"])


def refined(inside: DataFrame) -> DataFrame:
    """Sets (sig, root, grams) of components, of those that may have links, with the smaller components that these are in.

    All shingles of a set are exchanged once, packed, and its rarest ones once more: linear in the sets, however long the chain.
    """
    spark = inside.sparkSession
    tasks, shingles = partitions(spark), inside.agg(F.coalesce(F.sum(F.octet_length("grams")), F.lit(0))).first()[0] // 8
    buckets = max(1, -(-shingles // BUCKET))
    dealt = inside.select("sig", "root", "grams").mapInArrow(deal_whole_sets(buckets), "bucket int, low binary, high binary, own binary, sig binary, size binary")
    dealt = dealt.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    shared = dealt.mapInArrow(shared_shingles, "sig long, n long, df binary, token binary, root binary")
    rare = materialise(shared.repartition("sig").sortWithinPartitions("sig").mapInArrow(rarest_of_whole_sets, "token long, sig long"), "rare")
    first = rare.groupBy("token").agg(F.min("sig").alias("b"), F.count("*").alias("c")).where("c > 1").select("token", "b")
    edges = rare.join(first.hint("merge"), "token").where("sig <> b").select(F.col("sig").alias("a"), "b").distinct()
    found = connected_components(edges)
    out = materialise(inside.drop("root").join(found.hint("merge"), F.col("sig") == F.col("node")).select("sig", "root", "grams"), "refined")
    drop_table(rare)
    return out


def split_components(inside: DataFrame, unit_shingles: int) -> tuple[DataFrame, DataFrame]:
    """(links to pivots, (unit, sig, linked, grams) of the rest) of the sets (sig, root, grams) of components that are too large for a task.

    The sets a pivot does not link to are dealt to blocks, all sets of the component to blocks too, and each pair of the two
    kinds is a unit. A set goes to as many units as there are blocks of the other kind.
    """
    inside = materialise(inside.dropDuplicates(["sig"]), "large")
    pivots = inside.groupBy("root").agg(F.min("sig").alias("pivot"))
    of_pivot = inside.join(pivots.select("pivot"), F.col("sig") == F.col("pivot")).select(F.col("root").alias("_root"), F.col("grams").alias("_grams"))
    held = materialise(inside.join(of_pivot, F.col("root") == F.col("_root")).select("sig", "grams", "_grams").mapInArrow(against_pivot, "sig long, linked boolean"), "pivots")
    state = inside.select("sig", "root", (F.octet_length("grams") / 8).cast("long").alias("n")).join(held, "sig").join(pivots, "root")
    links = state.where("linked and sig <> pivot").select(F.col("sig").alias("a"), F.col("pivot").alias("b"))
    half = F.lit(unit_shingles / 2)
    sizes = state.groupBy("root").agg(F.ceil(F.sum("n") / half).cast("int").alias("all_blocks"), F.ceil(F.sum(F.when(~F.col("linked"), F.col("n")).otherwise(0)) / half).cast("int").alias("open_blocks")).where("open_blocks > 0")
    of = lambda blocks, salt: F.pmod(F.xxhash64("sig", F.lit(salt)), F.col(blocks)).cast("int")
    unit = lambda i, j: F.xxhash64("root", i, j)
    every = F.transform(F.sequence(F.lit(0), F.col("open_blocks") - 1), lambda i: unit(i, of("all_blocks", 1)))
    open_ = F.transform(F.sequence(F.lit(0), F.col("all_blocks") - 1), lambda j: unit(of("open_blocks", 2), j))
    units = F.when(F.col("linked"), every).otherwise(F.array_distinct(F.concat(every, open_)))
    placed = state.join(sizes, "root").select("sig", units.alias("units"), "linked")
    return links, inside.select("sig", "grams").join(placed, "sig").select(F.explode("units").alias("unit"), "sig", "linked", "grams")


def once_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key this task has not met; there are few different keys."""
    seen: set[int] = set()
    for batch in batches:
        keep = []
        for i, k in enumerate(batch.column(batch.schema.get_field_index("key")).to_pylist()):
            if k not in seen:
                seen.add(k)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep))


def classified(docs: DataFrame, unit_shingles: int, hot_sets: int) -> DataFrame:
    """doc_id, key of the text, n and class of each row of docs."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key().alias("key"))
    described = materialise(texts.mapInArrow(describe, "doc_id long, key long, n long, sig long"), "sets")

    spark = docs.sparkSession
    shingles = described.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = partitions(spark)
    buckets = max(min(tasks, BUCKETS), -(-2 * shingles // (5 * BUCKET)))  # a set is a row in each bucket, so no more than needed
    common = common_shingles(texts, hot_sets)
    known = None
    if common.num_rows:
        known = spark.sparkContext.broadcast((common["token"].to_numpy().astype(np.uint64), common["n"].to_numpy(), common["root"].to_numpy()))
    dealt = texts.select("text").mapInArrow(deal_samples(buckets, known), "bucket int, low binary, high binary, own binary, sig binary, size binary")
    dealt = dealt.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    shared = dealt.mapInArrow(shared_shingles, "sig long, n long, df binary, token binary, root binary")
    if known is not None:
        shared = shared.union(texts.select("text").mapInArrow(own_common_shingles(known), "sig long, n long, df binary, token binary, root binary"))
    edges = materialise(shared.repartition("sig").sortWithinPartitions("sig").mapInArrow(prefix_edges, "a long, b long"), "candidates")
    candidates = connected_components(edges)

    # One text stands for each class of equal sets.
    stand = described.where("n > 0").groupBy("sig").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    members = materialise(candidates.join(stand, F.col("node") == F.col("sig")).select("sig", "key", "n", "root"), "members")
    sizes = materialise(members.groupBy("root").agg(F.sum("n").alias("total")), "sizes")
    single = texts.select("key", "text")
    if hot := hot_keys(described, "key", HOT_COPIES):
        single = single.where(~F.col("key").isin(hot)).union(single.where(F.col("key").isin(hot)).mapInArrow(once_per_task, single.schema))
    large = sizes.where(F.col("total") > unit_shingles).select("root")
    # Members grow with the corpus, so they are never broadcast, however few they are.
    placed = members.select("key", "sig", F.array("root").alias("units"), F.lit(False).alias("linked"))
    sets = single.join(placed.hint("merge"), "key").mapInArrow(send_sets, SETS)
    spent, pivoted = [edges, members, sizes, described], None
    if large.limit(1).count():
        sets = materialise(sets, "sets")
        held = sets.withColumnRenamed("unit", "root")
        # Few of the components are large: one in unit_shingles shingles at most.
        alone = refined(held.join(F.broadcast(large), "root", "left_semi").select("sig", "root", "grams"))
        spent += [sets, alone]
        still = materialise(alone.groupBy("root").agg(F.sum(F.octet_length("grams")).alias("total")).where(F.col("total") > 8 * unit_shingles).select("root"), "still")
        spent.append(still)
        fits = alone.join(F.broadcast(still), "root", "left_anti").select(F.col("root").alias("unit"), "sig", F.lit(False).alias("linked"), "grams")
        sets = sets.join(F.broadcast(large), F.col("unit") == F.col("root"), "left_anti").unionByName(fits)
        if still.limit(1).count():
            pivoted, rest = split_components(alone.join(F.broadcast(still), "root", "left_semi"), unit_shingles)
            sets = sets.unionByName(rest)
    links = materialise(sets.repartition("unit").sortWithinPartitions("unit").mapInArrow(solve_units, "a long, b long"), "links")
    spent.append(links)
    classes = connected_components(links.union(pivoted)) if pivoted is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    rows = described.join(classes, F.col("sig") == F.col("node"), "left").select("doc_id", "key", "n", F.coalesce("root", "sig").alias("class"))
    rows = materialise(rows, "classes")
    for t in spent:
        drop_table(t)
    return rows


def text_key() -> Column:
    """The first 64 bits of the MD5 of the text (null: empty)."""
    return F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16), 16, -10).cast("long")


def near_duplicate_classes(docs: DataFrame, unit_shingles: int = 2_000_000, hot_sets: int = 20_000) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    A task's unit holds about unit_shingles shingles at most; a shingle of hot_sets sets or more is not dealt to a task.
    """
    rows = classified(docs, unit_shingles, hot_sets)
    least = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    # Rows without shingles are in no class, and would all meet in one key.
    named = rows.where("n > 0").join(least, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return named.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_of_each_class(docs: DataFrame, carry: tuple[str, ...], unit_shingles: int = 2_000_000, hot_sets: int = 20_000) -> DataFrame:
    """The columns carry of one row of each class, and of all rows whose text has no words.

    The row of least doc_id (null last) stays, of several the one whose text hashes lowest; of rows equal in both any one.
    """
    reserve(carry, ["_key", "_doc_id"])
    rows = classified(docs, unit_shingles, hot_sets)
    first = rows.where("n > 0").groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("w")).select(F.col("w.doc_id").alias("_doc_id"), F.col("w.key").alias("_key"))
    words = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = docs.select(*carry, *[c for c in ("doc_id", "text") if c not in carry])
    # A key of its own for what has no words, so that such rows meet nothing and nobody.
    keyed = own.withColumn("_key", text_key())
    kept = keyed.where(words).join(first, (F.col("doc_id").cast("long").eqNullSafe(first["_doc_id"])) & (keyed["_key"] == first["_key"]), "left_semi")
    if rows.where("n > 0").groupBy("doc_id", "key").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "_key"])
    return kept.select(*carry).unionByName(own.where(~words).select(*carry))
