"""Keyphrases of each document by the statistics of its words (Campos et al., "YAKE!", 2020), without a model, and phrases as protected terms.

A word's weight joins case, place, frequency, context and spread over sentences; the lower, the more it matters. A phrase is one to three
words in a row, none of them a stop word (closed classes, or shorter than three letters), with only white space between. All phrases of a
document stand in line, best first; one stays that neither holds nor lies in a phrase kept before and is not within `alike` of its spelling, until
`top` have stayed. With `pool`, only so many stand in line; no query gives it.

A text's keyphrases come from its own row: rows are dealt out once, then Arrow batches are cut into blocks of BLOCK letters whose tokens, words
and phrases are counted as numbers in numpy (windows and joins over rows of words cost some thirty times as much). A text without phrases, and
a null one, give no row. Rows that share an id, or have none, are texts of their own. Ties: by spelling; scores are compared at ten decimals.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import input_bytes
from .issues import QUIET

#: Words of the closed classes with three letters; those with more are QUIET.
SHORT = "the and but for nor yet any all few one two him her his its our you who how why not too are was were has had did can may let off out per via".split()
STOP = sorted({*QUIET, *SHORT})
MOST_WORDS = 3
#: The bytes of the input's files whose texts are one task's.
PART_BYTES = 2 << 20
#: The letters of texts that are worked on at a time; a longer text is one block.
BLOCK = 1 << 20
_STOP = frozenset(STOP)
_BLANK, _LETTER, _JOINER, _OTHER = range(4)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """What each code point is: a letter of any script, a sign that may stand in a word, white space, or another sign."""
    kinds = np.fromiter((_LETTER if category(chr(c))[0] == "L" else _OTHER for c in range(0x110000)), np.uint8, 0x110000)
    kinds[[ord(c) for c in " \t\r\n"]] = _BLANK
    kinds[[ord(c) for c in "'’-"]] = _JOINER
    return kinds


class Tokens(NamedTuple):
    """The tokens of a block's texts in order: words in any script, and runs of other signs."""

    text: str  # all texts, a line's end after each
    base: np.ndarray  # where each text begins
    doc: np.ndarray  # which text a token is of
    start: np.ndarray
    end: np.ndarray
    is_word: np.ndarray
    fresh: np.ndarray  # whether it begins a sentence
    sent: np.ndarray  # its sentence, numbered through the block
    first_sent: np.ndarray  # the first sentence of its text


def cut(texts: list[str]) -> Tokens:
    """A word is a letter with the letters and joiners that follow. A sentence starts with a line, and with a capital, quote or bracket after [.!?] and white space."""
    joined = "\n".join([*texts, ""])
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    base = np.cumsum(size) - size
    x = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[x]
    # A joiner goes with the word before it, else with other signs.
    last = np.maximum.accumulate(np.where(kind != _JOINER, np.arange(x.size), 0))
    kind = np.where(kind == _JOINER, np.where(kind[last] == _LETTER, _LETTER, _OTHER), kind)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1, [x.size]]) if x.size else np.zeros(1, np.int64)
    runs = np.flatnonzero(kind[edges[:-1]] != _BLANK)
    start, end = edges[runs], edges[runs + 1]
    doc = np.searchsorted(base, start, "right") - 1
    before = np.maximum(np.arange(start.size) - 1, 0)
    first = (doc != doc[before]) | (np.arange(start.size) == 0)
    lines = np.cumsum(x == 10)
    capital = ((x[start] >= 65) & (x[start] <= 90)) | np.isin(x[start], [ord(c) for c in '"“('])
    closed = np.isin(x[end[before] - 1], [ord(c) for c in ".!?"]) & (start > end[before]) & capital
    fresh = first | (lines[start] > lines[end[before] - 1]) | closed
    sent = np.cumsum(fresh) - 1
    opens = np.flatnonzero(first)
    return Tokens(joined, base, doc, start, end, kind[start] == _LETTER, fresh, sent, np.repeat(sent[opens], np.diff(np.append(opens, start.size))))


class Words(NamedTuple):
    at: np.ndarray  # the word's token
    spelling: list[str]  # of each number of a word, in lower case
    word: np.ndarray  # number of the spelling
    group: np.ndarray  # number of the word in its text
    weight: np.ndarray  # by group
    stop: np.ndarray  # by group
    follows: np.ndarray  # whether the word before stands directly before it in its sentence


def _distinct(of: np.ndarray, near: np.ndarray, groups: int, words: int) -> np.ndarray:
    """How many different words stand near each group, as a share of all that do; 0 where none does."""
    many = np.bincount(of, minlength=groups)
    key = np.sort(of * words + near)
    different = np.bincount(key[np.diff(key, prepend=-1) != 0] // words, minlength=groups)
    return np.divide(different, many, out=np.zeros(groups), where=many > 0)


def weighted(tokens: Tokens) -> Words:
    """The words among the tokens with their weights."""
    at = np.flatnonzero(tokens.is_word)
    forms, spelling = {}, {}
    form = np.array([forms.setdefault(tokens.text[a:b], len(forms)) for a, b in zip(tokens.start[at].tolist(), tokens.end[at].tolist())], np.int64)
    lower = [f.lower() for f in forms]
    word = np.array([spelling.setdefault(w, len(spelling)) for w in lower], np.int64)[form]
    spelling = list(spelling)
    capital = np.array([f[0] != w[0] for f, w in zip(forms, lower)], bool)[form] & ~tokens.fresh[at]
    loud = np.array([f == f.upper() and len(re.sub("['’-]", "", f)) > 1 for f in forms], bool)[form]
    doc, sent, v = tokens.doc[at], tokens.sent[at], len(spelling)
    key, group, tf = np.unique(doc * v + word, return_inverse=True, return_counts=True)
    g, owner = key.size, key // v
    stop = np.array([len(w) < 3 or w in _STOP for w in spelling], bool)[key % v]
    follows = np.zeros(at.size, bool)
    follows[1:] = (np.diff(at) == 1) & (np.diff(sent) == 0)
    here = np.flatnonzero(follows)
    context = _distinct(group[here], word[here - 1], g, v) + _distinct(group[here - 1], word[here], g, v)
    # The sentences of each word, once each, in order.
    order = np.argsort(group, kind="stable")
    by, own = group[order], (sent - tokens.first_sent[at])[order]
    once = np.ones(at.size, bool)
    once[1:] = (np.diff(by) != 0) | (np.diff(own) != 0)
    sf, own = np.bincount(by[once], minlength=g), own[once]
    offset = np.cumsum(sf) - sf
    middle = (own[offset + (sf - 1) // 2] + own[offset + sf // 2]) / 2
    case = np.maximum(np.bincount(group, capital, g), np.bincount(group, loud, g)) / (1 + np.log(tf))
    texts = np.flatnonzero(np.concatenate([[True], np.diff(owner) != 0]))
    of = np.repeat(np.arange(texts.size), np.diff(np.append(texts, g)))
    last = np.flatnonzero(np.concatenate([np.diff(doc) != 0, [True]]))
    n_sent = (sent - tokens.first_sent[at])[last] + 1
    open_words = np.bincount(of, ~stop, texts.size)
    many = np.maximum(open_words, 1)
    mean = np.bincount(of, np.where(stop, 0, tf), texts.size) / many
    spread = np.sqrt(np.bincount(of, np.where(stop, 0, (tf - mean[of]) ** 2), texts.size) / many)
    usual = np.where(open_words > 0, mean + spread, 1.0)
    rel = 1 + context * tf / np.maximum.reduceat(tf, texts)[of]
    weight = rel * np.log(np.log(3 + middle)) / (case + tf / usual[of] / rel + sf / n_sent[of] / rel)
    return Words(at, spelling, word, group, weight, stop, follows)


def phrases(words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first word, occurrences, score) of the different phrases of one, two and three words, each list in the order of texts."""
    v, out = max(len(words.spelling), 1), []
    opens = ~words.stop[words.group]
    weight = words.weight[words.group]
    heads, number, p, s = np.flatnonzero(opens), words.group, weight, weight
    for k in range(MOST_WORDS):
        if k:
            heads = heads[heads + k < opens.size]
            heads = heads[opens[heads + k] & words.follows[heads + k]]
        key = number[heads] if k == 0 else number[heads] * v + words.word[heads + k]
        _, first, same, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        first = heads[first]
        if k:
            p, s = p.copy(), s.copy()
            p[heads] *= weight[heads + k]
            s[heads] += weight[heads + k]
            number = np.zeros(opens.size, np.int64)
            number[heads] = same
        out.append((first, n, p[first] / (n * (1 + s[first]))))
    return out


@lru_cache(1 << 10)
def most_edits(size: int, alike: float) -> int:
    """The most edits within which a phrase of so many letters is alike, -1 if none."""
    k = -1
    while k < size and 1 - (k + 1) / size > alike:
        k += 1
    return k


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of a and b is at most so many."""
    if abs(len(a) - len(b)) > most:
        return False
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[same:], b[same:]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        last, row[low - 1] = row[low - 1], i if low == 1 else most + 1
        least = row[low - 1]
        for j in range(low, high + 1):
            held = row[j] if j < i + most else most + 1
            if x != b[j - 1]:
                last = 1 + min(last, held, row[j - 1])
            last, row[j] = held, last
            if row[j] < least:
                least = row[j]
        if least > most:
            return False
    return row[len(b)] <= most


def letters_of(phrase: str) -> int:
    """A bit for each letter, so that an edit changes one of them at most each way."""
    out = 0
    for c in phrase:
        out |= 1 << (ord(c) & 127)
    return out


def thinned(scores: np.ndarray, spelling: Callable[[int], str], top: int, pool: int | None, alike: float) -> list[tuple[int, str]]:
    """(place in scores, phrase) of those that stay, best first."""
    order = np.argsort(scores, kind="stable")
    ranked, at, seen = scores[order], 0, 0
    kept: list[tuple[int, str, int]] = []
    while at < order.size and len(kept) < top and (pool is None or seen < pool):
        end = at + 1
        while end < order.size and ranked[end] == ranked[at]:
            end += 1
        for phrase, i in sorted((spelling(i), i) for i in order[at:end].tolist()):
            seen += 1
            if len(kept) == top or pool is not None and seen > pool:
                break
            own = letters_of(phrase)
            for _, other, its in kept:
                if phrase in other or other in phrase:
                    break
                most = most_edits(max(len(phrase), len(other)), alike)
                if (own & ~its).bit_count() <= most and (its & ~own).bit_count() <= most and within(phrase, other, most):
                    break
            else:
                kept.append((i, phrase, own))
        at = end
    return [(i, phrase) for i, phrase, _ in kept]


def block_phrases(texts: list[str], top: int, pool: int | None, alike: float) -> list[tuple]:
    """(number of the text, place, phrase, n, score, start, end) of the keyphrases of texts."""
    tokens = cut(texts)
    if not tokens.is_word.any():
        return []
    words = weighted(tokens)
    lists = phrases(words)
    cuts = [np.searchsorted(tokens.doc[words.at[first]], np.arange(len(texts) + 1)).tolist() for first, _, _ in lists]
    rounded = [np.round(score, 10) for _, _, score in lists]
    out = []
    for d in range(len(texts)):
        spans = [(c[d], c[d + 1]) for c in cuts]
        ends = np.cumsum([b - a for a, b in spans]).tolist()
        if not ends[-1]:
            continue

        def place(i: int) -> tuple[int, int]:
            k = 0 if i < ends[0] else 1 if i < ends[1] else 2
            return k, i - (ends[k] - (spans[k][1] - spans[k][0])) + spans[k][0]

        def spelling(i: int) -> str:
            k, j = place(i)
            w = lists[k][0][j]
            return " ".join([words.spelling[x] for x in words.word[w : w + k + 1].tolist()])

        for rank, (i, phrase) in enumerate(thinned(np.concatenate([r[a:b] for r, (a, b) in zip(rounded, spans)]), spelling, top, pool, alike)):
            k, j = place(i)
            first, n, score = (x[j].item() for x in lists[k])
            start, end = tokens.start[words.at[first]], tokens.end[words.at[first + k]]
            out.append((d, rank, phrase, n, score, (start - tokens.base[d]).item(), (end - tokens.base[d]).item()))
    return out


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts): runs of a batch's texts of BLOCK letters at most, or one text; null is empty."""
    first, held, size = 0, [], 0
    for i, raw in enumerate(column.cast(pa.large_binary())):
        text = (raw.as_py() or b"").decode("utf-8", "replace")
        if held and size + len(text) > BLOCK:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def _dealt(docs: DataFrame, text: str) -> DataFrame:
    """_row, doc_id and text in as many parts as keep a task's texts to PART_BYTES of the input's files, whatever the session's number is."""
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(docs) // PART_BYTES))
    return docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.col(text).alias("_text")).repartition(parts, "_row")


def _by_blocks(docs: DataFrame, text: str, found: Callable[[list[str]], list[tuple]], fields: list[T.StructField]) -> DataFrame:
    """_row, doc_id and the fields that found() gives for texts, with the number of the text first."""
    schema = T.StructType([T.StructField("_row", T.LongType()), docs.schema["doc_id"], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
        for batch in batches:
            for first, texts in _blocks(batch.column(2)):
                if rows := found(texts):
                    number, *columns = zip(*rows)
                    at = pa.array(np.array(number) + first)
                    arrays = [pa.array(c, types[f.dataType]) for c, f in zip(columns, fields)]
                    yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *arrays], schema.names)

    return _dealt(docs, text).mapInArrow(run, schema)


def placed_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """_row, doc_id, pos, token, start, end, sent: every token with its offsets and the number of its sentence."""

    def found(texts: list[str]) -> list[tuple]:
        t = cut(texts)
        opens = np.searchsorted(t.doc, np.arange(len(texts)))
        columns = [t.doc, np.arange(t.doc.size) - opens[t.doc], t.start - t.base[t.doc], t.end - t.base[t.doc], t.sent - t.first_sent]
        return [(d, p, t.text[a : a + e - s], s, e, n) for (d, p, s, e, n), a in zip(zip(*(c.tolist() for c in columns)), t.start.tolist())]

    kinds = {"pos": T.LongType(), "token": T.StringType(), "start": T.LongType(), "end": T.LongType(), "sent": T.LongType()}
    return _by_blocks(docs, text, found, [T.StructField(n, k) for n, k in kinds.items()])


def keyphrases(docs: DataFrame, text: str = "text", top: int = 10, pool: int | None = 30, alike: float = 0.8) -> DataFrame:
    """_row, doc_id, place (from 0), phrase (lower case), n, score, start, end of each document's keyphrases."""
    kinds = {"place": T.LongType(), "phrase": T.StringType(), "n": T.LongType(), "score": T.DoubleType(), "start": T.LongType(), "end": T.LongType()}
    return _by_blocks(docs, text, lambda texts: block_phrases(texts, top, pool, alike), [T.StructField(n, k) for n, k in kinds.items()])


def terms(docs: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """Protected spans of kind `term` (_row, doc_id, kind, start, end, surface): first occurrences of keyphrases of two words or more, or that occur `least` times."""
    found = keyphrases(docs, text, pool=None).where((F.col("n") >= least) | F.col("phrase").contains(" "))
    return found.select("_row", "doc_id", F.lit("term").alias("kind"), "start", "end", F.col("phrase").alias("surface"))
