"""Quality rules, histogram-sort sharding, decontamination: against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from penstock.llm.decontamination import find_benchmark_passages, hit_digest
from penstock.llm.quality_rules import apply_quality_rules
from penstock.llm.sharding import shard_documents


def measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c = Counter(tri)
    covered = {k + j for k, x in enumerate(tri) if c[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_measures(hard):
    got = apply_quality_rules(hard).collect()
    assert len(got) == hard.count()
    expected = Counter((r.doc_id, *measures(r.text or "")) for r in hard.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_host_verdict_reaches_documents(spark):
    """On a host that breaks the symbol rule throughout, a document with a broken soft rule goes; the same one stays elsewhere."""
    from .conftest import prose

    soft = lambda k: prose(60, k) + " #" * 12
    rows = [(k, soft(k), "bad") for k in range(60)] + [(100 + k, prose(60, 100 + k), "good") for k in range(60)] + [(200, soft(200), "good"), (201, prose(60, 201), "bad")]
    got = {r.doc_id: r for r in apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0].kept and got[0].host_rejected and not got[0].base_failed
    assert got[200].kept and got[201].kept and got[100].kept


def test_small_host_is_shrunk(spark):
    """One failing document does not condemn its host when hosts fail rarely."""
    from .conftest import prose

    rows = [(k, prose(60, k), f"h{k % 10}") for k in range(300)] + [(900, prose(60, 9) + " #" * 12, "tiny")]
    got = {r.doc_id: r for r in apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[900].kept and not got[900].host_rejected


def test_long_text_and_null_hosts(spark):
    t = "word other " * 40_000
    rows = [(1, t, None), (2, t, "h"), (3, None, None)]
    got = {r.doc_id: r for r in apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].n_words == got[2].n_repeat_words == 80_000 and not got[1].host_rejected and got[3].n_words == 0
    with pytest.raises(ValueError):
        apply_quality_rules(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, n_words string"), host="n_words")


def test_rules_empty(empty):
    assert apply_quality_rules(empty).count() == 0


def test_shards(hard, sf, spark):
    for docs, tolerance in ((hard, None), (spark.read.parquet(f"{sf}/documents.parquet"), 0.2)):
        got = shard_documents(docs).collect()
        text = {(r.doc_id, zlib.crc32((r.text or "").encode())): (r.text or "").encode() for r in docs.collect()}
        assert len(got) == docs.count()
        total = sum(r.size for r in got)
        for s in range(16):
            own = [r for r in got if r.shard == s]
            assert sorted(r.slot for r in own) == list(range(len(own)))
            if tolerance:
                assert abs(sum(r.size for r in own) - total / 16) <= max(tolerance * total / 16, max(r.size for r in got))
        assert all(r.size == len(text[r.doc_id, r.text_crc32]) + 1 and r.law == "bytes" and r.grown_shard is None for r in got)


def test_hot_text_is_split(spark):
    rows = [(k, "the same text" if k % 3 else f"text {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard_documents(docs, cell_rows=100).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(16))


def test_repeated_rows_are_split(spark):
    """Rows equal in text and id are parted too, and every boundary is as near to its goal as a row allows."""
    rows = [(7, "the same row")] * 2000 + [(k, f"text {k}") for k in range(500)] + [(8, "longer row " * 9)] * 300
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), cell_rows=50, tolerance=0.0).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(t) + 1) for d, t in rows)
    goal = sum(r.size for r in got) / 16
    for s in range(16):
        own = [r for r in got if r.shard == s]
        assert abs(sum(r.size for r in own) - goal) <= 101 and sorted(r.slot for r in own) == list(range(len(own)))


def test_boundaries_equal_a_plain_sort(spark):
    """Without tolerance shards are what a sort by (MD5 of text, id) cut at the goals gives."""
    rows = [(k, f"text number {k * k} " * (1 + k % 7)) for k in range(400)]
    got = {r.doc_id: r.shard for r in shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), tolerance=0.0).collect()}
    ordered = sorted(rows, key=lambda r: (int(hashlib.md5(r[1].encode()).hexdigest()[:15], 16), r[0]))
    total = sum(len(t) + 1 for _, t in rows)
    below, cuts = [0], []
    for _, t in ordered:
        below.append(below[-1] + len(t) + 1)
    for j in range(1, 16):
        goal = -(-total * j // 16)
        k = next(i for i, b in enumerate(below) if b >= goal)
        cuts.append(k if below[k] - goal <= goal - below[k - 1] else k - 1)
    assert [got[d] for d, _ in ordered] == [sum(c <= i for c in cuts) for i in range(len(ordered))]


def test_shards_empty(empty):
    assert shard_documents(empty).count() == 0


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_hits(text, items):
    w, hit, found = words_of(text), set(), set()
    for item, t in items:
        v = words_of(t)
        n = min(10, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes,part_words", [(16 << 20, 20_000), (300, 20_000), (16 << 20, 7), (700, 7)])
def test_decontamination(spark, hard, block_bytes, part_words):
    texts = {r.doc_id: r.text for r in hard.collect()}
    items = [(1, " ".join(texts[9].split()[60:90])), (2, "One, two!"), (3, None), (4, ""), (5, "ÜBER " + texts[6][:200].upper()), (6, texts[6][300:600]), (7, "c"), (8, "###"), (9, texts[13][5000:5400]), (10, " ".join(texts[9].split()[60:75]))]
    bench = spark.createDataFrame(items * 3, "item_id long, text string")
    got = hit_digest(find_benchmark_passages(hard, bench, block_bytes=block_bytes, part_words=part_words)).collect()
    expected = Counter((r.doc_id, *brute_hits(r.text, items)) for r in hard.collect())
    assert Counter(tuple(r) for r in got) == expected
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)


def test_decontamination_empty(spark, hard, empty):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert find_benchmark_passages(empty, bench).count() == 0
    assert not any(r.contaminated for r in hit_digest(find_benchmark_passages(hard, bench.where("item_id = 2"))).collect())
