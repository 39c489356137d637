"""Toxicity, language, packing, token shards, archives: held-out accuracy, round trips and brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from penstock.llm.language_id import fit_language_id, identify_language
from penstock.llm.packing import assignment, column_generation, pack_documents
from penstock.llm.token_shards import order_folder, permuted, read_back, read_slots, write_training_order
from penstock.llm.tokens import Encoder
from penstock.llm.toxicity import fit_toxicity, held_out, score_toxicity
from penstock.llm.warc import archive_folder, read_archives, write_archives

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference_ids():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_tokenizers(spark, reference_ids, hard):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [r.text or "" for r in hard.collect()] + ["<|endoftext|> a", "  a  b \n\n c\t", "it's we'll 12 3.5", " x y \x1c z", "日本語 مرحبا 🙂🙂", "'S 'LL"]
    assert Encoder(BPE).encode(texts) == [np.array(x, "<u4").tobytes() for x in reference_ids(texts)]
    assert Encoder(BPE).plain is not None and Encoder(public_tokenizers.path("word_bpe_49k.json")).plain is None


def test_long_white_space(spark, reference_ids):
    """Runs that backtracking cannot manage: whole jobs of packing and of shards give the ids of tokenizers."""
    texts = [" " * 2_000_000, "a" + "\t" * 1_000_000 + "b", ("\n" * 49_999 + "a") * 5, "x" * 300_000]
    assert Encoder(BPE).encode(texts) == [np.array(x, "<u4").tobytes() for x in reference_ids(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(pack_documents(docs).collect(), list(enumerate(texts)), reference_ids)
    written, count = write_training_order(docs, order_folder(spark))
    assert written.agg(F.sum("n_tokens")).first()[0] == sum(len(x) + 1 for x in reference_ids(texts))


def check_pieces(pieces, docs, reference_ids, capacity=1024):
    ids = Counter()
    for (d, t), x in zip(docs, reference_ids([t or "" for _, t in docs])):
        ids[d, tuple(x) + (0,)] += 1
    by_row, by_sequence = {}, {}
    for p in pieces:
        by_row.setdefault((p.doc_id, p.row_id), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    got = Counter()
    for (d, _), own in by_row.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        assert all(len(p.ids) == 4 * p.length and p.length > 0 for p in own)
        whole = np.frombuffer(b"".join(p.ids for p in own), "<u4")
        assert whole.size == own[0].doc_tokens
        got[d, tuple(whole.tolist())] += 1
    assert got == ids
    waste = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        sizes = [p.length for p in own]
        assert [p.offset for p in own] == list(np.cumsum([0] + sizes)[:-1]) and sum(sizes) <= capacity
        if sum(sizes) & (sum(sizes) - 1):
            waste += capacity - sum(sizes)
    return waste / (capacity * len(by_sequence)) if by_sequence else 0


def test_packing(spark, hard, empty, reference_ids):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    check_pieces(pack_documents(hard).collect(), rows, reference_ids)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    waste = check_pieces(pack_documents(docs, cell_rows=20).collect(), [(r.doc_id, r.text) for r in docs.collect()], reference_ids)
    assert waste < 0.01
    assert pack_documents(empty).count() == 0


def test_cutting_stock():
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 65)
    demand = np.where(lengths > 32, 20, rng.integers(100, 400, 64)).astype(float)  # small items fill up the large ones
    patterns, amount = column_generation(lengths, demand, 64)
    assert (patterns.T @ lengths <= 64).all() and np.allclose(patterns @ amount, demand) and (amount >= 0).all()
    assert amount.sum() <= 1.01 * lengths @ demand / 64
    rows, sequences = assignment({int(k): int(d) for k, d in zip(lengths, demand)}, 64)
    for k, d in zip(lengths.tolist(), demand.tolist()):
        ranges = sorted((r[1], r[2]) for r in rows if r[0] == k)
        assert ranges[0][0] == 0 and ranges[-1][1] == d and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("count", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(count):
    for key in (0, 7):
        assert sorted(permuted(np.arange(count), count, key).tolist()) == list(range(count))
    if count > 64:
        assert (permuted(np.arange(count), count, 1) != permuted(np.arange(count), count, 2)).any()


def test_token_shards(spark, hard, empty, reference_ids):
    folder = order_folder(spark)
    written, count = write_training_order(hard, folder, length=64, shard_sequences=50)
    rows = written.collect()
    assert sorted(r.slot for r in rows) == sorted(r.number for r in rows) == list(range(count))
    ids = {r.slot: r.ids for r in read_back(spark, folder, count, 64, 50, step=33).collect()}
    total = Counter()
    for r in rows:
        got = np.frombuffer(ids[r.slot], "<u2")
        assert got.size == 64 and (got[r.n_tokens :] == 0).all() and r.slot == 50 * r.shard + r.record
        total.update(got[: r.n_tokens].tolist())
    expected = Counter()
    for x in reference_ids([r.text or "" for r in hard.collect()]):
        expected.update([*x, 0])
    assert total == expected
    resumed = [x.tobytes() for x in read_slots(folder, 45, 10, 64, 50)]
    assert resumed == [ids[s] for s in range(45, 55)]
    again, _ = write_training_order(hard, order_folder(spark), length=64, shard_sequences=50)
    assert {(r.slot, r.number) for r in again.collect()} == {(r.slot, r.number) for r in rows}
    assert write_training_order(empty, order_folder(spark))[1] == 0
    with pytest.raises(Exception, match="does not fit"):
        write_training_order(hard, order_folder(spark), width=1)


def test_numbers_of_sequences(spark, hard, reference_ids):
    """In one task, sequences by number are the documents' ids one after the other, and doc_ids are those they hold."""
    docs = [(r.doc_id, r.text) for r in hard.collect()]
    folder = order_folder(spark)
    written, count = write_training_order(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), folder, length=64, shard_sequences=50)
    ids = {r.slot: np.frombuffer(r.ids, "<u2") for r in read_back(spark, folder, count, 64, 50).collect()}
    stream = [(d, i) for (d, _), x in zip(docs, reference_ids([t or "" for _, t in docs])) for i in [*x, 0]]
    rows = sorted(written.collect(), key=lambda r: r.number)
    assert len(rows) == -(-len(stream) // 64)
    for r in rows:
        own = stream[64 * r.number : 64 * r.number + 64]
        assert ids[r.slot][: r.n_tokens].tolist() == [i for _, i in own]
        assert [d for k, d in enumerate(r.doc_ids) if not k or d != r.doc_ids[k - 1]] == [d for k, (d, _) in enumerate(own) if not k or d != own[k - 1][0]]


def fold(spark, ids):
    return {r.doc_id: r.h for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out(F.col("doc_id")).alias("h")).collect()}


def test_held_out_fold(spark):
    got = fold(spark, range(50))
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_toxicity(spark, hard, empty):
    from .conftest import prose

    rows = [(k, prose(60, k) + (" you vile fool " if k % 4 == 0 else " ") + prose(30, 900 + k)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs, labels)
    assert 0 < len(model[0]) < 2000
    score = dict(score_toxicity(docs, model).collect())
    unseen = [k for k, h in fold(spark, range(400)).items() if h]
    assert all((score[k] >= 0.5) == (k % 4 == 0) for k in unseen)
    got = score_toxicity(hard, model, ("doc_id", "source")).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(empty, model).count() == 0
    nothing = fit_toxicity(docs, labels.where("toxic = 0"))
    assert all(s < 0.5 for _, s in score_toxicity(docs, nothing).collect())
    assert all(s < 0.5 for _, s in score_toxicity(docs, fit_toxicity(docs, labels.where("doc_id < 0"))).collect())


def test_scalar_ftrl(spark):
    """Weights equal those of a plain loop over the update rule of each coordinate."""
    import math
    import random

    from penstock.llm.toxicity import train

    r = random.Random(4)
    rows = [(int(k % 3 == 0), np.array(sorted(r.sample(range(64), 9) + ([64] if k % 3 == 0 else [])), "<u4")) for k in range(80)]
    alpha, beta, l1, l2, epochs = 0.3, 1.0, 0.5, 0.1, 2
    share = sum(y for y, _ in rows) / len(rows)
    bias, spread, z, n = math.log(share / (1 - share)), 1.0, [0.0] * 128, [0.0] * 128
    w = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(epochs):
        for y, at in rows:
            own = {int(i): w(int(i)) for i in at}
            g = 1 / (1 + math.exp(-(bias + sum(own.values())))) - y
            for i, x in own.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * x
                n[i] += g * g
            spread += g * g
            bias -= alpha / math.sqrt(spread) * g
    at, weight, got = train(rows, 7, alpha, beta, l1, l2, epochs)
    assert at.tolist() == [i for i in range(128) if abs(z[i]) > l1] and 0 < at.size < 65
    assert np.allclose(weight, [w(i) for i in at.tolist()]) and abs(got - bias) < 1e-9


def test_scalar_features_and_scores(spark, hard):
    """Scores equal sums over a plain set of words, neighbours and skip pairs; language scores equal averages over a plain list of subwords."""
    import pyarrow as pa

    from penstock.llm import language_id
    from penstock.llm.toxicity import features

    texts = [r.text or "" for r in hard.collect() if len(r.text or "") < 3000]
    words = lambda t: [w for w in "".join(c.lower() if c.isascii() else c for c in t).replace("\x00", " ").translate({k: " " for k in range(128) if not chr(k).isalnum()}).split(" ") if w]
    row, at, n = features(pa.array(texts, pa.string()), 20)
    for i, t in enumerate(texts):
        w = words(t)
        grams = {(x,) for x in w} | {(1, *x) for x in zip(w, w[1:])} | {(2, *x) for x in zip(w, w[2:])}
        assert len(set(at[row == i].tolist())) == len(grams)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_language_id(docs, max_rows=200)
    table, langs, heat, _ = model
    got = {r.doc_id: r for r in identify_language(docs.limit(40), model).collect()}
    for r in docs.limit(40).collect():
        b = bytes(int(x) for x in language_id.FOLD[np.frombuffer(r.text.encode(), np.uint8)])
        total, count = np.zeros(len(langs)), 0
        for k in language_id.SIZES:
            for a in range(len(b) - k + 1):
                x = b[a] + 1
                for c in b[a + 1 : a + k]:
                    x = (x * 0x01000193 % (1 << 32)) ^ c
                total += table[(x * 0x9E3779B1 % (1 << 32)) >> (32 - language_id.BITS)]
                count += 1
        e = np.exp(total / count / heat - (total / count / heat).max())
        assert got[r.doc_id].lang_pred == langs[int(e.argmax())] and abs(got[r.doc_id].score - (e / e.sum()).max()) < 1e-4


def test_toxicity_on_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = score_toxicity(docs, fit_toxicity(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", "toxic").collect()
    hit = sum(r.score >= 0.5 for r in got if r.toxic) / sum(r.toxic for r in got)
    false = sum(r.score >= 0.5 for r in got if not r.toxic) / sum(not r.toxic for r in got)
    assert hit > 0.75 and false < 0.03


def test_language(spark, hard, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit_language_id(docs)
    got = identify_language(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    edge = identify_language(hard, model).collect()
    assert len(edge) == hard.count()
    letters = {r.doc_id: any(c.isalpha() for c in r.text or "") for r in hard.collect()}
    assert all((r.lang_pred == "und" and r.score == 0 and not r.accepted) if not letters[r.doc_id] else r.lang_pred in model[1] for r in edge)
    assert identify_language(empty, model).count() == 0
    assert all(r.lang_pred == "und" for r in identify_language(hard, fit_language_id(empty)).collect())


@pytest.mark.parametrize("split,spread", [(8 << 20, False), (700, True)])
def test_archives(spark, split, spread, monkeypatch):
    """In one range and in many; groups of equal payloads broadcast, or met by key with frequent ones spread."""
    from penstock.llm import warc

    from .conftest import prose

    if spread:
        monkeypatch.setattr(warc, "broadcast_if_small", lambda df, rows: df)
        monkeypatch.setattr(warc, "HOT_COPIES", 2)

    html = {1: prose(400, 1), 2: prose(400, 1), 3: "small", 4: "small", 5: None, 6: "", 7: "é" * 600, 8: prose(400, 1), 9: prose(3000, 9), 10: "WARC/1.1\r\n\r\n" * 200}
    rows = [(k, f"http://a/{k}", v, k) for k, v in html.items()] + [(None, None, prose(400, 1), 0), (7, "u", "é" * 600, 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)
    folder = archive_folder(spark)
    assert write_archives(pages, folder).agg(F.sum("records")).first()[0] == len(rows)
    got = read_archives(spark, folder, split).collect()
    assert len(got) == len(rows)
    last = {1: 8, 2: 8, 8: 8, None: 8, 7: 7}
    expected = Counter()
    for k, _, v, _ in rows:
        b = (v or "").encode()
        revisit = len(b) >= 1000 and last.get(k, k) != k
        expected[k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", last[k] if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")


def test_damaged_and_long_members(spark, tmp_path):
    """Records around a damaged member are still found; a payload of many ranges is read by the owner of its start."""
    import random

    from penstock.llm.warc import record_bytes

    noise = bytes(random.Random(1).randrange(32, 127) for _ in range(300_000))
    record = lambda k, p: record_bytes(k, "u", p, hashlib.sha1(p).hexdigest(), None, 6)
    broken = bytearray(record(2, b"b" * 5000))
    broken[12:40] = bytes(28)
    (tmp_path / "x.warc.gz").write_bytes(record(1, b"a" * 2000) + bytes(broken) + record(3, noise) + record(4, b""))
    got = {r.page_id: r.payload_digest for r in read_archives(spark, str(tmp_path), 10_000).collect()}
    assert got == {1: hashlib.sha1(b"a" * 2000).hexdigest(), 3: hashlib.sha1(noise).hexdigest(), 4: hashlib.sha1(b"").hexdigest()}


def test_scratch_leaves_nothing(spark, hard):
    import os

    from penstock.llm.common import scratch

    with scratch(spark) as noted:
        assert pack_documents(hard).count() > 0
        assert any(os.path.exists(p) for p in noted)
    assert noted and not any(os.path.exists(p) for p in noted)


def test_archives_empty(spark):
    folder = archive_folder(spark)
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder).count()
    assert read_archives(spark, folder).count() == 0
