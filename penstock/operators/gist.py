"""The gist of each document: its most central sentence, with the first one favoured, put plainly and within a number of words.

Sentences of four words or more stand for a text (all, where there is none so long). With one or two of them the longest is chosen, the earlier of
equals; else PageRank over bag-of-words cosines (there are no word vectors here), the first sentence's rank times FIRST. The chosen one loses
brackets with what they hold, an opening transition and stock phrases, wordy ones give way to plain ones, and what is over `most` words is cut.

All comes from a text's own row, without an exchange: its sentences go by in order. Up to `dense` sentences the cosines stand in a matrix; longer
texts are ranked by products with their bags of words, so a text costs a task its words. Rows that share an id are texts of their own; a text
without words, and a null one, have no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sentences as split_sentences
from .flow import OPENING
from .graph import Bags, bags_of, cosines, group_bounds, numbered_words, pagerank, sparse_pagerank, whole_groups, word_numbers
from .issues import SCORED
from .phrasebook import Phrase, build_phrases, build_trie, matches, render

#: The first sentence's bias, the fewest words of a sentence that may stand for a text, the most of a gist.
FIRST, LEAST_WORDS, MOST_WORDS = 1.15, 4, 22


def central(bags: Bags, n_words: np.ndarray, dense: int = 500) -> int:
    """Which of a text's sentences is the central one; ranks are compared at nine decimals, the earlier of equals wins."""
    if bags.n <= 2:
        return int(np.argmax(n_words))
    rank = pagerank(cosines(bags)) if bags.n <= dense else sparse_pagerank(bags)
    rank[0] *= FIRST
    return int(np.argmax(np.round(rank / rank.max(), 9)))


def central_rows(sentences: DataFrame, dense: int = 500) -> DataFrame:
    """_row, doc_id, sent_idx, sentence: the central sentence of each text; a text's sentences follow each other, as where they were split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "_row"):
            bounds = group_bounds(table["_row"].to_numpy())
            words, offsets = numbered_words(table["_w"])
            sizes, chosen = np.diff(offsets), []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = np.arange(a, b)
                if (sizes[a:b] >= LEAST_WORDS).any():
                    own = own[sizes[a:b] >= LEAST_WORDS]
                places = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in own]) if own.size < b - a else slice(offsets[a], offsets[b])
                chosen.append(own[central(bags_of(words[places], sizes[own]), sizes[own], dense)])
            yield from table.select(["_row", "doc_id", "sent_idx", "sentence"]).take(pa.array(chosen)).combine_chunks().to_batches()

    rows = sentences.select("_row", F.col("doc_id").cast("long").alias("doc_id"), "sent_idx", "sentence", word_numbers().alias("_w"))
    return rows.mapInArrow(run, "_row long, doc_id long, sent_idx long, sentence string")


def gist_phrases() -> list[Phrase]:
    """The book's phrases that have a plainer wording, and stock phrases, which go."""
    plain = [p for p in build_phrases() if p.wording is not None]
    taken = {p.surface for p in plain}
    return plain + [Phrase(p, p, "base", "") for p in SCORED["stock_phrase"] if p not in taken]


@F.pandas_udf(T.StringType())
def put_plainly(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    book = gist_phrases()
    trie = build_trie(book)

    def one(text: str) -> str:
        out, at = [], 0
        for start, end, i in matches(text, trie):
            out += [text[at:start], render(book[i].wording, text[start:end])]
            at = end
        return "".join([*out, text[at:]])

    for batch in texts:
        yield batch.map(one)


def shortened(text: Column, most: int = MOST_WORDS) -> Column:
    """At most `most` words, a capital first and a closing mark last; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r" +([,.;:!?])", "$1"), r"^[ ,;:]+|[ ,;:]+$", "")
    words = F.split(bare, " ")
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(words, 1, most), " "), "[,;:]+$", ""), F.lit("…"))
    kept = F.when(F.size(words) > most, cut).otherwise(bare)
    kept = F.concat(F.upper(F.left(kept, F.lit(1))), F.substr(kept, F.lit(2)))
    return F.when(bare.rlike(r"[\p{L}\p{N}]"), F.when(kept.rlike("[.!?…]$"), kept).otherwise(F.concat(kept, F.lit("."))))


def gists(docs: DataFrame, text: str = "text", most: int = MOST_WORDS, dense: int = 500) -> DataFrame:
    """_row, doc_id, sent_idx, sentence, gist of each document with a word; gist is null where phrases and brackets were all there was."""
    rows = central_rows(split_sentences(docs, text), dense)
    bare = F.regexp_replace("sentence", r"\([^()]*\)", "")
    rows = rows.withColumn("_g", put_plainly(bare)).withColumn("_g", F.regexp_replace("_g", OPENING, ""))
    return rows.select("_row", "doc_id", "sent_idx", "sentence", shortened(F.col("_g"), most).alias("gist"))
