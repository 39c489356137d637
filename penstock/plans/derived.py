"""Rows derived from the given tables for the fixtures: SQL that Spark and DuckDB read alike, over whole tables.

Braces name tables. Texts are the English documents with seeds (ASCII but for a handful of characters), so that both engines see the same words.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import sentences
from .queries_text import SENTENCES
from .seeded import SEEDS, seeded

SECTIONS = ("introduction", "results", "conclusion", "body", "methodology")
HEADINGS = ("Abstract", "1. Introduction", "Results", "Discussion", "References")
ASCII = r"[^\x00-\x7F]"


def tables_in(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def _seeds() -> str:
    text = f"regexp_replace(text, '{ASCII}', '_', 'g')"
    for old, new in SEEDS:
        text = f"replace({text}, '{old.replace("'", "''")}', '{new.replace("'", "''")}')"
    return f"seeds AS (SELECT doc_id, {text} AS text FROM documents WHERE lang = 'en')"


def english(spark, sf_dir):
    """Seeded English documents in ASCII."""
    plain = lambda d: d.where("lang = 'en'").withColumn("text", F.regexp_replace("text", ASCII, "_"))
    return plain(seeded(spark, sf_dir)).select("doc_id", "text")


def _cases(column: str, values: tuple[str, ...]) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_SENTS = SENTENCES.replace("FROM documents)", "FROM seeds)")


def _sentences(spark, sf_dir):
    s = sentences(english(spark, sf_dir))
    return s.select(F.col("doc_id") + 1000, "sent_idx", F.expr(_cases("sent_idx", SECTIONS)), "sentence")


def _flow(spark, sf_dir):
    return sentences(english(spark, sf_dir)).select(F.col("doc_id") + 1000, "sent_idx", "para_idx", "n_words", "sentence")


def _lines(spark, sf_dir):
    """Lines of the seeded English documents, every sixth one a heading."""
    rows = english(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    heading = F.expr(_cases("floor(i / 6)", HEADINGS))
    return rows.select(F.col("doc_id") + 1000, "i", F.when(F.col("i") % 6 == 0, heading).otherwise(F.col("line")))


_LINES = f"""WITH {_seeds()}, x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM seeds)
SELECT doc_id + 1000, i, CASE WHEN i % 6 = 0 THEN {_cases("(i // 6)", HEADINGS)} ELSE line END FROM x"""

#: name -> (Spark, DuckDB)
DERIVED_PAIRS = {
    "fx_sentences": (_sentences, f"WITH {_seeds()}, {_SENTS} SELECT doc_id + 1000, sent_idx, {_cases('sent_idx', SECTIONS)}, sentence FROM sents"),
    "fx_flow": (_flow, f"WITH {_seeds()}, {_SENTS} SELECT doc_id + 1000, sent_idx, para_idx, len(words), sentence FROM sents"),
    "fx_lines": (_lines, _LINES),
    "fx_report": (_lines, _LINES),
    "fx_texts": (lambda spark, sf_dir: english(spark, sf_dir).select(F.col("doc_id") + 1000, "text"), f"WITH {_seeds()} SELECT doc_id + 1000, text FROM seeds"),
}

_EN = "(SELECT doc_id + 1000 AS doc_id, text, length(text) AS n FROM {documents} WHERE lang = 'en')"
_KINDS = ("quote", "url", "number", "keep", "term", "code")
_RULES = ("wordy_phrase", "filler", "long_sentence", "cliche", "hedge", "stock_phrase", "weak_verb")
_CONCEPTS = ("pump", "Valve", "heat", "flow", "hose")
_ORIGINS = ("student_insert", "ai", "student_edit", "engine")

DERIVED = {
    "fx_spans": f"SELECT l_orderkey + 1000, l_partkey % 90, l_partkey % 90 + l_suppkey % 17, {_cases('l_suppkey', _KINDS)} FROM {{lineitem}}",
    "fx_windows": "SELECT o_orderkey + 1000, 1, o_custkey % 60, o_custkey % 60 + 30 FROM {orders}",
    "fx_edit_docs": f"SELECT doc_id, text FROM {_EN} x",
    "fx_edits": f"SELECT doc_id, 0, 3, 'A' FROM {_EN} x WHERE n > 60 UNION ALL SELECT doc_id, 10 + doc_id % 9, 18 + doc_id % 9, '' FROM {_EN} x WHERE n > 60 UNION ALL SELECT doc_id, 20, 31, 'other' FROM {_EN} x WHERE n > 60",
    "fx_offsets": f"SELECT doc_id, doc_id % 40 FROM {_EN} x UNION ALL SELECT doc_id, 41 + doc_id % 7 FROM {_EN} x",
    "fx_issues": f"SELECT l_orderkey + 1000, {_cases('l_suppkey', _RULES)}, l_partkey % 50, l_partkey % 50 + 1 + l_suppkey % 23 FROM {{lineitem}}",
    "fx_answers": f"SELECT doc_id, split_part(text, ' ', 2), split_part(text, ' ', 4) FROM {_EN} x",
    "fx_origins": f"SELECT doc_id % 50 + 1000, {_cases('doc_id', _ORIGINS)}, text FROM {_EN} x",
    "fx_progress": "SELECT o_orderkey + 1000, o_custkey % 12, o_custkey % 12 - o_custkey % 3 * (CASE WHEN o_custkey % 12 > 2 THEN 1 ELSE 0 END), o_custkey % 5, o_custkey % 3, 6 + o_orderkey % 3, o_custkey % 6, 6, o_custkey % 97 + 0.26, o_orderkey % 89 + 0.17 FROM {orders}",
    "fx_viva": f"SELECT l_orderkey + 1000, l_linenumber % 3 + 1, CAST(l_partkey % 101 AS DOUBLE), {_cases('l_suppkey', _CONCEPTS)} FROM {{lineitem}}",
    "fx_reviews": "SELECT user_id + 1000, CAST(event_id AS DOUBLE), event_id % 4 + 1 FROM {events}",
    "fx_words": f"SELECT split_part(text, ' ', 3) FROM {_EN} x WHERE length(split_part(text, ' ', 3)) > 2",
    "fx_lm": "SELECT item_id + 1000, text FROM {benchmark}",
    "fx_lm_tests": "SELECT item_id + 1000, substr(text, 1, 60) FROM {benchmark}",
    "fx_mentions": f"SELECT l_orderkey + 1000, {_cases('l_suppkey', ('figure', 'table'))}, l_partkey % 6 + 1, l_partkey * 8 + l_linenumber FROM {{lineitem}}",
    "fx_edited": f"SELECT doc_id, 'a ' || text FROM {_EN} x",
    "fx_changes": f"SELECT doc_id, 1, 0, 4, substr(text, 1, 4), 'zz', 'accepted', 0.9 FROM {_EN} x WHERE n > 60 UNION ALL SELECT doc_id, 2, 10, 16, substr(text, 11, 6), 'yy', CAST(NULL AS STRING), 0.85 FROM {_EN} x WHERE n > 60 UNION ALL SELECT doc_id, 3, 30 + doc_id % 5, 40, substr(text, 31 + doc_id % 5, 10 - doc_id % 5), '', CAST(NULL AS STRING), 0.7 + 0.2 * (doc_id % 2) FROM {_EN} x WHERE n > 60",
    "fx_fits": f"SELECT doc_id, split_part(text, '. ', 1), {_cases('doc_id', ('academic', 'casual', 'neutral'))}, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 3 AS DOUBLE) END, CASE WHEN doc_id % 3 = 0 THEN 1.5 END, doc_id % 3, 0.5, CASE WHEN doc_id % 5 > 0 THEN doc_id % 4 END, -2.0 - doc_id % 3 * 0.25, -2.0 - doc_id % 7 * 0.131, 0.77 + doc_id % 5 * 0.047 FROM {_EN} x",
    "fx_edit_set": "SELECT l_orderkey + 1000, l_linenumber % 2, l_orderkey * 8 + l_linenumber, l_partkey % 40, l_partkey % 40 + l_suppkey % 9 FROM {lineitem}",
    "fx_quiz": f"SELECT o_orderkey + 1000, o_custkey, 'Q' || CAST(o_custkey AS STRING), CASE WHEN o_custkey % 3 > 0 THEN {_cases('o_custkey', _CONCEPTS)} END, CASE WHEN o_custkey % 4 = 0 THEN CAST(o_custkey % 101 AS DOUBLE) END FROM {{orders}}",
    "fx_given": f"SELECT o_orderkey + 1000, o_custkey, {_cases('o_orderkey', ('PUMP ', 'valve', 'none'))} FROM {{orders}} WHERE o_orderkey % 5 > 0",
    "fx_terms": "SELECT p_partkey + 1000, split_part(p_name, ' ', 1), CASE WHEN p_size % 5 > 0 THEN p_type END FROM {part}",
    "fx_old_paras": "SELECT conv_id + 1000, turn, text, CASE WHEN turn % 3 = 0 THEN 'got' WHEN turn % 3 = 1 THEN 'confusing' END FROM {conversations} WHERE text IS NOT NULL AND lower(text) = text",
    "fx_weak": "SELECT p_partkey + 1000, replace(p_name, ' ', '|'), replace(p_type, ' ', '|') FROM {part}",
    "fx_deck": "SELECT event_id + 1000, CAST(event_id * 7 % 20000 AS DOUBLE) FROM {events}",
    "fx_doctor": f"SELECT l_orderkey + 1000, CAST(l_partkey % 3 AS STRING), {_cases('l_suppkey', ('units.case', 'abbr.x', 'figures.order', 'claims.y'))}, l_linenumber FROM {{lineitem}}",
    "fx_swaps": f"SELECT doc_id, split_part(text, '. ', 1), 'the', 'of' FROM {_EN} x WHERE length(split_part(text, '. ', 1)) > 3",
    "fx_rewrite": f"SELECT l_orderkey + 1000, l_linenumber * 30, l_linenumber * 30 + 5 + l_partkey % 24, {_cases('l_suppkey', ('body', 'references', 'results', 'heading'))}, l_partkey % 9 FROM {{lineitem}}",
    "fx_barred": "SELECT l_orderkey + 1000, l_linenumber * 30 + l_suppkey % 4, l_linenumber * 30 + 4 + l_suppkey % 9 FROM {lineitem}",
    "fx_shift": "SELECT o_orderkey + 1000, o_custkey % 77 FROM {orders} WHERE o_custkey % 3 > 0",
    "fx_options": "SELECT p_partkey % 97 + 1000, p_name || CAST(p_partkey AS STRING) FROM {part}",
    "fx_offered": "SELECT o_custkey + 1000, o_orderpriority || CAST(o_orderkey AS STRING) FROM {orders}",
    "fx_owned": "SELECT c_custkey + 1000, c_name FROM {customer} WHERE c_custkey % 4 > 0",
    "fx_history": "SELECT l_orderkey + 1000, l_linenumber * 1000000 + l_partkey * 1000 + l_suppkey, l_partkey % 3 + 1, CAST(l_suppkey % 101 AS DOUBLE) FROM {lineitem}",
    "fx_facts": f"SELECT doc_id, CAST(doc_id AS STRING) || ' pumps and ' || split_part(text, '. ', 1) || ' or 12.5' FROM {_EN} x",
    "fx_gates": "SELECT l_orderkey * 8 + l_linenumber + 1000, CAST(l_partkey % 64 AS DOUBLE) / 67, CAST(36 + l_suppkey % 33 AS DOUBLE) / 71, CAST(l_orderkey % 16 AS DOUBLE) / 17, CAST(l_linenumber % 3 AS DOUBLE), CAST(l_partkey % 13 AS DOUBLE) / 63 FROM {lineitem}",
    "fx_candidates": f"SELECT l_orderkey + 1000, l_linenumber % 2, l_partkey * 10000 + l_suppkey * 10 + l_linenumber, CAST(l_suppkey % 9 AS STRING), l_partkey % 3 + 1, {_cases('l_suppkey', ('meaning', 'fluency', 'grammar'))} FROM {{lineitem}}",
    "fx_pairs": f"SELECT doc_id, text, 'zzz ' || text, 0, 0, 'zzz ' FROM {_EN} x WHERE n > 0 UNION ALL SELECT doc_id + 1000000, text, text || ' end', n, n, ' end' FROM {_EN} x WHERE n > 0",
}
