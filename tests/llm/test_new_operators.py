"""Fill-in-the-middle, quality network and prefix trie: against brute force, scalar versions and held-out rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from penstock.llm import fill_in_middle as fim
from penstock.llm import prefix_trie as pt
from penstock.llm import quality_classifier as qc
from penstock.llm.common import text_buffer

from .conftest import prose


# Fill-in-the-middle


def brute_middle(doc_id, text):
    t = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    n, sha = len(t), lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, n, form, a, b - a, sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(t)


@given(st.text(max_size=300))
@settings(max_examples=150, deadline=None)
def test_boundaries(text):
    index, at = fim.Boundaries(text.encode()), 0
    assert index.n == len(text)
    for k, c in enumerate(text + "."):
        assert index.select(k) == at
        at += len(c.encode())


def test_boundaries_of_a_long_text():
    text = "é👍a" * 40_000
    index = fim.Boundaries(text.encode())
    for k in (0, 1, 5_000, 59_999, 119_999, 120_000):
        assert index.select(k) == len(text[:k].encode())


@pytest.mark.parametrize("hot,remembered", [(1000, 16 << 20), (3, 16 << 20), (1000, 500)])
def test_middles(spark, hard, hot, remembered, monkeypatch):
    monkeypatch.setattr(fim, "HOT_COPIES", hot)
    monkeypatch.setattr(fim, "REMEMBERED", remembered)
    more = [(100 + k, "same text ü " * 9, "en", "s", "x", 1) for k in range(60)] + [(300 + k, f"a <P> b{k}", "en", "s", "x", 1) for k in range(3)] + [(400 + k, "<S" if k % 2 else "<", "en", "s", "x", 1) for k in range(9)]
    docs = hard.unionByName(spark.createDataFrame(more, hard.schema)).repartition(4)
    got = Counter(tuple(r) for r in fim.middle_digest(fim.fill_in_middle(docs)).collect())
    assert got == Counter(brute_middle(r.doc_id, r.text) for r in docs.collect())
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_texts_under_one_hash_stay_apart(spark, monkeypatch):
    """Groups are contents, not hashes: with one hash for all texts the result is the same."""
    monkeypatch.setattr(fim.F, "xxhash64", lambda c: fim.F.lit(7).cast("long"))
    docs = spark.createDataFrame([(k, f"text {k % 5} " * 20) for k in range(40)], "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in fim.middle_digest(fim.fill_in_middle(docs)).collect())
    assert got == Counter(brute_middle(r.doc_id, r.text) for r in docs.collect())


def test_middle_columns(spark, hard, empty):
    out = fim.fill_in_middle(hard.withColumnsRenamed({"n": "key"}), ("doc_id", "text", "size", "key"))
    assert out.columns[:4] == ["doc_id", "text", "size", "key"] and out.count() == hard.count()
    assert all(fim.F is not None and r.output is not None for r in out.collect())
    with pytest.raises(ValueError):
        fim.fill_in_middle(hard, ("doc_id", "n"))
    assert fim.fill_in_middle(empty).count() == 0


# Quality network


def small_net(seed=0, width=4, block=8, filters=3, dims=2):
    r = np.random.default_rng(seed)
    embed = r.normal(size=(256, dims))
    embed[0] = 0
    return qc.Network(embed, r.normal(size=(width * dims, filters)), r.normal(size=filters), r.normal(size=2 * filters), 0.3, width, block)


def slow_logit(net, text):
    """The network of one text, window by window."""
    blocks = max(1, -(-len(text) // net.block))
    x = np.zeros(blocks * net.block + net.width, int)
    x[: len(text)] = list(text)
    answers = [np.array([net.embed[x[i : i + net.width]].ravel() @ net.filters for i in range(b * net.block, (b + 1) * net.block)]).max(axis=0) for b in range(blocks)]
    chunks = [np.maximum(answers[k], answers[k + 1]) for k in range(blocks - 1)] or answers
    pooled = np.array([np.maximum(c + net.bias, 0) for c in chunks])
    return float(np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)]) @ net.out + net.shift)


def together(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def test_network_equals_slow_version(monkeypatch):
    r = random.Random(1)
    texts = [b"", b"a", b"12345678", bytes(r.randrange(1, 256) for _ in range(301)), "é ü".encode(), bytes(r.randrange(1, 256) for _ in range(40))]
    for blocks in (1, 3, 256):
        monkeypatch.setattr(qc, "BLOCKS", blocks)
        got = qc.logits(small_net(), *together(texts))
        assert np.allclose(got, [slow_logit(small_net(), t) for t in texts], atol=1e-4)


def test_gradients_equal_differences():
    r = random.Random(2)
    texts = [bytes(r.randrange(1, 256) for _ in range(n)) for n in (0, 5, 30, 77)]
    y, net = np.array([1.0, 0.0, 1.0, 0.0]), small_net(3)
    loss = lambda n: float(np.mean(np.logaddexp(0, z := qc.logits(n, *together(texts))) - y * z))
    grads = qc.gradients(net, *together(texts), y)
    for field, g in zip(("embed", "filters", "bias", "out"), grads):
        value = getattr(net, field)
        for at in r.sample([tuple(x) for x in np.argwhere(np.abs(g) > 1e-6)], 8 if field in ("embed", "filters") else 2):
            step = np.zeros(value.shape)
            step[at] = 1e-4
            slope = (loss(net._replace(**{field: value + step})) - loss(net._replace(**{field: value - step}))) / 2e-4
            assert abs(slope - g[at]) < 2e-3 + 0.02 * abs(slope), (field, at)
    slope = (loss(net._replace(shift=net.shift + 1e-4)) - loss(net._replace(shift=net.shift - 1e-4))) / 2e-4
    assert abs(slope - grads[4]) < 1e-3


def test_quality_on_held_out_rows(spark, sf):
    from penstock.llm.queries import op12_quality_classifier

    rows = op12_quality_classifier(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(a == b for a, b in seen) >= 0.9 * len(seen)


def test_quality_edges(spark, hard, empty):
    labels = spark.createDataFrame([(6, 1), (9, 0), (9, 1), (12, None), (None, 0), (13, 0)], "doc_id long, quality int")
    net = qc.fit_quality(hard, labels, epochs=1)
    out = qc.score_quality(hard, net, ("doc_id", "size", "n")).collect()
    assert len(out) == hard.count() and all(0 <= r.score <= 1 for r in out)
    blank = {r.score for r in qc.score_quality(hard.where("text is null or text = ''"), net).collect()}
    assert len(blank) == 1
    only_good = qc.fit_quality(hard, spark.createDataFrame([(6, 1), (9, 1)], "doc_id long, quality int"))
    assert all(r.score > 0.99 for r in qc.score_quality(hard, only_good).collect())
    assert qc.score_quality(empty, qc.fit_quality(empty, labels)).count() == 0
    with pytest.raises(ValueError):
        qc.score_quality(hard.withColumn("score", qc.F.lit(1)), net, ("doc_id", "score"))


def test_kept_back_rows_part(spark):
    import pyarrow as pa

    raw, offsets = text_buffer(pa.array(["ab", None, "c"]))
    assert offsets.tolist() == [0, 2, 2, 3] and qc.parting([(2.0, 1), (1.0, 1), (-1.0, 0), (-3.0, 0)]) == 0.0


# Prefix trie


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    convs = {c: [(r, x) for _, _, r, x in sorted(t, key=lambda y: y[:2])] for c, t in convs.items()}
    built = {}
    for c, t in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(convs.get(c - c % 100, [])[:h] + t[h:])
    nodes = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    saved, leaves = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += not kids[k]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], sha([c for c in m if len(built[c]) == len(k)])) for k, m in nodes.items())


TURNS = "conv_id long, turn long, role string, text string, depth long, node string"


def trie_rows(spark, rows):
    return Counter(tuple(r) for r in pt.prefix_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(3)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    r = random.Random(seed)
    rows = [(c, k, r.choice(["user", "assistant"]), r.choice(["hi", "why ü", "no", ""])) for c in [*range(30), *range(100, 120), 205, 307] for k in range(r.randrange(1, 7))]
    rows += [(400, None, None, None), (400, None, "user", "x"), (400, 3, "user", None), (400, 3, "user", None), (400, 3, "assistant", "b"), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(500 + c, k, "user", f"t{k}") for c in range(25) for k in range(9)] + [(603, k, "user", "long " * k) for k in range(40)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_nested_conversations(spark):
    """Every conversation is a prefix of the next one: the deepest peeling."""
    rows = [(100 * c, k, "user", f"t{k}") for c in range(1, 9) for k in range(c)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_without_rows(spark):
    assert not trie_rows(spark, []) and not trie_rows(spark, [(None, 1, "user", "x")])


def test_bare_conversation_is_a_member_of_the_root(spark):
    """A conversation whose turns are all replaced, by a base that is not there, keeps no turn."""
    c = next(c for c in range(100, 999) if c % 100 and zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "gone")]
    assert trie_rows(spark, rows) == brute_trie(rows) and len(brute_trie(rows)) == 1


def test_long_text_of_prose():
    assert len(prose(10, 1).split()) == 10
