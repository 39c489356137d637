"""The pipeline's stages on a small table: each one's decisions against brute force on its own input."""

import sys
from collections import Counter
from pathlib import Path

import pytest

from penstock.llm.common import materialise

from .conftest import prose
from .test_models_and_files import check_pieces
from .test_rules_and_shards import brute_hits
from .test_similarity import brute_classes, brute_word_repeats, edited

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    base, shared = prose(150, 1), prose(120, 2)
    rows = [(k, prose(80, 100 + k) + (" you vile fool " if k % 5 == 0 else " ") + prose(20, 700 + k)) for k in range(150)]
    rows += [(200 + k, edited(base, k, k % 3)) for k in range(12)] + [(230, base), (231, base), (232, None), (233, ""), (234, "é" * 300)]
    rows += [(240 + k, prose(30, 900 + k) + " " + shared + " " + prose(30, 950 + k)) for k in range(4)]
    bench = [(1, prose(80, 110)[:200]), (2, None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, bench


def test_stages(spark, world):
    import corpus_pipeline as cp

    folder, rows, bench = world
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        if name != "packing":
            assert set(cp.COLUMNS) <= set(out.columns)
            docs = materialise(out, f"test-{name}")
            seen[name] = before, [(r.doc_id, r.text) for r in docs.collect()]
            assert all(r.n_chars == len(r.text or "") for r in docs.collect()) or name in ("toxicity", "near_duplicates")
        else:
            ids = Counter(r.doc_id for r in out.collect())
            assert set(ids) == {d for d, _ in before}

    before, after = seen["toxicity"]
    assert {d for d, _ in before} - {d for d, _ in after} == {k for k in range(150) if k % 5 == 0}
    before, after = seen["near_duplicates"]
    least = {d: c for d, n, c in brute_classes(before)}
    assert sorted(d for d, _ in after) == sorted(d for d, t in before if not (t or "").split() or least[d] == d)
    before, after = seen["repeats"]
    text = dict(after)
    assert Counter(after) == brute_word_repeats(before, 50)
    assert all(len(text[240 + k]) < 550 for k in range(4)) and all(text[d] == (t or "") for d, t in before if d < 150)
    before, after = seen["decontamination"]
    assert {d for d, _ in before} - {d for d, _ in after} == {d for d, t in before if brute_hits(t, bench)[4]}
    assert {d for d, _ in before} - {d for d, _ in after} <= {110}


def test_run(spark, world):
    """All stages by brute force, one after the other, give the documents and tokens that run() packs."""
    import corpus_pipeline as cp
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, rows, bench = world
    out = cp.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    left = [(d, t) for d, t in rows if not (d < 150 and d % 5 == 0)]
    least = {d: c for d, n, c in brute_classes(left)}
    left = [(d, t) for d, t in left if not (t or "").split() or least[d] == d]
    left = [x for x, n in brute_word_repeats(left, 50).items() for _ in range(n)]
    left = [(d, t) for d, t in left if not brute_hits(t, bench)[4]]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = Counter({d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in left})
    got, pieces = Counter(), out.collect()
    for r in pieces:
        got[r.doc_id] += r.length
    assert got == tokens and all(r.doc_tokens == tokens[r.doc_id] for r in pieces)


def test_rows_that_share_an_id(spark, world, tmp_path):
    """Stages decide by row, not by id, with repeated and null ids and clashing names."""
    import corpus_pipeline as cp

    a, b, shared = prose(70, 1), prose(70, 2), prose(60, 3)
    rows = [(1, a), (1, b), (None, f"{prose(30, 4)} {shared}"), (None, f"{prose(30, 5)} {shared}"), (1, None), (None, prose(20, 6))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, h string, key long")
    docs.write.parquet(path := f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(path)
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, docs, world[0])
        got, given = Counter((r.doc_id, r.text or "") for r in out.collect()), [(r.doc_id, r.text) for r in docs.collect()]
        assert got == (brute_word_repeats(given, 50) if name == "repeats" else Counter((d, t or "") for d, t in given)), name


def test_toxicity_keeps_columns_that_clash(spark, world):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{world[0]}/documents.parquet").selectExpr("*", "1 as score", "2 as label")
    assert cp.toxicity(spark, docs, world[0]).columns == list(cp.COLUMNS)


def test_packing_sees_all(spark, world):
    from penstock.llm.packing import pack_documents
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    docs = spark.read.parquet(f"{world[0]}/documents.parquet")
    check_pieces(pack_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], ids)
