"""N-gram Jaccard join and repeated passages: against brute force; suffix arrays."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from penstock.llm.components import connected_components
from penstock.llm.ngram_jaccard import first_of_each_class, near_duplicate_classes
from penstock.llm.suffix_array import common_prefixes, suffix_array
from penstock.llm.suffix_dedup import remove_repeats, repeat_digest

from .conftest import prose


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def edited(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(999)}"
    return " ".join(w)


@pytest.mark.parametrize("unit,hot,once", [(8_000_000, 20_000, 20_000), (600, 20_000, 3), (8_000_000, 6, 20_000), (600, 6, 3)])
def test_classes(spark, hard, unit, hot, once, monkeypatch):
    """All paths: components in a task or split (unit), common shingles apart (hot), buckets, groups and frequent texts (once)."""
    from penstock.llm import ngram_jaccard

    monkeypatch.setattr(ngram_jaccard, "OFTEN", 2)
    monkeypatch.setattr(ngram_jaccard, "SETS_AT_ONCE", once)
    monkeypatch.setattr(ngram_jaccard, "BUCKET", 100 * once)
    monkeypatch.setattr(ngram_jaccard, "HOT_COPIES", once)
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    for b in range(6):
        base = prose(60 + 20 * b, 50 + b)
        rows += [(1000 + 100 * b + k, edited(base, 7 * b + k, k % 5)) for k in range(12)]
    chain = prose(80, 99).split()
    rows += [(5000 + k, " ".join(chain[4 * k : 4 * k + 48])) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in near_duplicate_classes(docs, unit, hot).collect())
    assert got == brute_classes(rows)
    assert len({c for _, _, c in got}) < len(rows) - 20


def test_chain_of_chance_meetings(spark, monkeypatch):
    """Sets that share a third with the next hang together in one component; whole, they fall apart, and none goes to several units."""
    from penstock.llm import ngram_jaccard

    chain = prose(1300, 98).split()
    rows = [(k, " ".join(chain[32 * k : 32 * k + 48])) for k in range(40)] + [(900 + k, edited(" ".join(chain[:48]), k, 1)) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_jaccard, "split_components", lambda *a: pytest.fail("a set would go to a unit for each block"))
    got = Counter(tuple(r) for r in near_duplicate_classes(docs, 300).collect())
    assert got == brute_classes(rows)


def test_classes_empty(empty):
    assert near_duplicate_classes(empty).count() == 0
    assert first_of_each_class(empty, ("doc_id", "text")).count() == 0


def test_first_of_each_class(spark):
    """Rows are told apart by id and text: one of a class stays, all without words stay."""
    t, u, v = prose(60, 1), prose(60, 2), prose(60, 3)
    rows = [(6, t), (13, t), (13, u), (13, u), (None, v), (None, v + " end"), (2, None), (2, ""), (None, " "), (None, " "), (20, prose(40, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n").repartition(3)
    got = Counter(tuple(r) for r in first_of_each_class(docs, ("doc_id", "text", "n")).collect())
    signed = min((int.from_bytes(hashlib.md5(x.encode()).digest()[:8], "big", signed=True), x) for x in (v, v + " end"))[1]
    assert got == Counter([(6, t, 1), (13, u, 1), (None, signed, 1), (2, None, 1), (2, "", 1), (None, " ", 1), (None, " ", 1), (20, prose(40, 9), 1)])


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(500, 540)]
    root = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {x: y for x, y in root.items() if x in got} and all(root[x] == x for x in set(root) - set(got))


def test_suffix_array():
    r = random.Random(5)
    for _ in range(500):
        s = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(0, 40))]
        order = suffix_array(s)
        assert order == sorted(range(len(s)), key=lambda i: s[i:])
        for k, n in enumerate(common_prefixes(s, order)):
            if k:
                a, b = s[order[k - 1] :], s[order[k] :]
                assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1]


def brute_repeats(rows, length=400):
    starts = Counter()
    for _, t in rows:
        b = (t or "").encode()
        starts.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        covered = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                covered[k : k + length] = True
        spans = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum())
        out[d, len(b), int(covered.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~covered].tobytes()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("group,length,hot,once,symbols", [(100_000, 400, 1000, 20_000, 300_000), (100_000, 400, 1000, 20_000, 0), (1, 400, 1000, 20_000, 300_000), (100_000, 240, 2, 5, 40), (1, 240, 2, 5, 300_000), (100_000, 64, 1000, 50, 300_000), (100_000, 64, 1000, 50, 0)])
def test_repeats(spark, hard, group, length, hot, once, symbols, monkeypatch):
    """All paths: cores solved by an array or by hashes in a task (symbols) or counted in Spark (group), frequent texts spread (hot), groups solved piecemeal (once)."""
    from penstock.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SYMBOLS", symbols)
    monkeypatch.setattr(suffix_dedup, "HOT_COPIES", hot)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", once)
    rows = [(r.doc_id, r.text) for r in hard.collect() if r.doc_id != 13 or len(r.text) < 9000]
    r = random.Random(8)
    passages = [prose(100, 400 + k)[: r.randint(380, 620)] for k in range(5)]
    for k in range(60):
        p = r.choice(passages)
        a, b = r.randint(0, 60), r.randint(0, 60)
        rows.append((100 + k, prose(r.randint(0, 30), 500 + k) + p[a : len(p) - b] + prose(r.randint(0, 30), 600 + k)))
    rows += [(300, "ab" * 600), (301, "z" * 401), (302, "q" * 400), (303, "é" * 300 + "x"), (304, "y" + "é" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(x) for x in repeat_digest(remove_repeats(docs, group_contexts=group, length=length)).collect())
    assert got == brute_repeats(rows, length)


def brute_word_repeats(rows, count):
    """(id, text without words that a window of `count` words covers which also starts elsewhere)."""
    spots = [[(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in rows]
    windows = lambda w: [tuple(x[2] for x in w[k : k + count]) for k in range(len(w) - count + 1)]
    seen = Counter(x for w in spots for x in windows(w))
    out = Counter()
    for (d, t), w in zip(rows, spots):
        covered = np.zeros(len(w), bool)
        for k, x in enumerate(windows(w)):
            if seen[x] > 1:
                covered[k : k + count] = True
        kept, at = b"", 0
        for k in range(len(w)):
            if covered[k] and not (k and covered[k - 1]):
                kept += (t or "").encode()[at : w[k][0]]
            if covered[k]:
                at = w[k][1]
        out[d, (kept + (t or "").encode()[at:]).decode()] += 1
    return out


@pytest.mark.parametrize("group,hot,once", [(100_000, 1000, 20_000), (1, 2, 5)])
def test_repeats_of_words(spark, hard, group, hot, once, monkeypatch):
    from penstock.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT_COPIES", hot)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", once)
    rows = [(r.doc_id, r.text) for r in hard.collect() if r.doc_id != 13 or len(r.text) < 9000]
    r = random.Random(9)
    passages = [prose(80, 800 + k).split() for k in range(5)] + [[r.choice("abcdefghij") for _ in range(75)]]
    for k in range(60):
        p = r.choice(passages)
        a, b = r.randint(0, 25), r.randint(0, 25)
        rows.append((100 + k, prose(r.randint(0, 30), 900 + k) + " " + r.choice([" ", "\n", "  "]).join(p[a : len(p) - b]) + "\t" + prose(r.randint(0, 30), 1000 + k)))
    rows += [(300, "go " * 49), (301, "go " * 50), (302, " ".join(f"w{k}" for k in range(200)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((x.doc_id, x.kept_text) for x in remove_repeats(docs, group_contexts=group, n_words=50).collect())
    assert got == brute_word_repeats(rows, 50)


def test_touching_short_repeats_stay_and_short_words_go(spark):
    """Two passages of 30 words side by side, each of which occurs elsewhere, are no passage of 50; 60 words of two letters are one."""
    a, b, c = prose(30, 1), prose(30, 2), " ".join(x + y for x in "abcdefghij" for y in "klmnop")
    rows = [(1, f"{prose(40, 3)} {a} {b} {prose(40, 4)}"), (2, f"{prose(40, 5)} {a} {prose(40, 6)}"), (3, f"{prose(40, 7)} {b} {prose(40, 8)}"), (4, f"{prose(40, 9)} {c} {prose(40, 10)}"), (5, f"{prose(40, 11)}\n{c}\n{prose(40, 12)}")]
    docs = spark.createDataFrame(rows, "key long, text string").selectExpr("key", "text", "7 as n", "8 as found").repartition(3)
    got = {r.key: r for r in remove_repeats(docs, ("key", "n", "found"), n_words=50).collect()}
    assert all(got[k].kept_text == t and not got[k].removed for k, t in rows[:3])
    assert all(c not in got[k].kept_text and len(got[k].removed) == 1 and len(got[k].kept_text.split()) == 80 for k in (4, 5)) and (got[5].n, got[5].found) == (7, 8)
    with pytest.raises(ValueError):
        remove_repeats(docs.selectExpr("key as removed", "text"), ("removed",))


def test_long_texts_in_stretches(spark, monkeypatch):
    from penstock.llm import suffix_dedup

    base = prose(900, 1)
    rows = [(1, base + prose(300, 2)), (2, prose(200, 3) + base[1000:4000] + prose(20, 4))]
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([t for _, t in rows])], ["text"])
    parts = list(suffix_dedup.stretches(batch, 400))
    assert len(parts) > 5
    for i, (_, t) in enumerate(rows):
        places = sorted(int(b[0]) + k for raw, off, row, b in parts if row[0] == i for k in range(off[-1] - 399))
        assert places == list(range(len(t.encode()) - 399))


def test_repeats_empty(empty):
    assert remove_repeats(empty).count() == 0
