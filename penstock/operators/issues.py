"""Issues: rules that emit (doc_id, sent_idx, rule, start, end, severity), lexicon matches, and de-duplication.

Lexicons are our own small tables; a lexicon is one alternation, longest phrase first, and hits are joined with the
table on the lower-cased surface.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import own_text

#: Our own phrases: lexicon -> phrase -> plainer wording ("" : drop, None: flag only).
LEXICONS: dict[str, dict[str, str | None]] = {
    "wordy_phrase": {"due to the fact that": "because", "in order to": "to", "a lot of": "much", "at this point in time": "now", "a large number of": "many", "has the ability to": "can", "with regard to": "about"},
    "filler": {"very": "", "really": "", "quite": "", "rather": "", "basically": "", "clearly": "", "actually": ""},
    "hedge": {"perhaps": None, "might": None, "seem": None, "likely": None, "possibly": None, "may": None},
    "cliche": {"it goes without saying": None, "at the end of the day": None, "think outside the box": None},
    "claim": {"prove": None, "proves": None, "always": None, "never": None, "the best": None, "undoubtedly": None},
    "vague_source": {"many studies": None, "research shows": None, "it is often said": None, "experts agree": None},
}
_TAKEN = "do does did doing done make makes made making perform performs performed performing conduct conducts conducted conducting give gives gave giving given".split() + ["carry out", "carries out", "carried out", "carrying out"]
_NOUNS = ("an analysis of", "an assessment of", "a calculation of", "a comparison of", "a description of", "an evaluation of", "an examination of", "an investigation of", "a study of", "a test of", "an explanation of", "a measurement of")
#: Our own phrases that only the scores count: stock phrases; and a weak verb with the noun that could be the verb.
SCORED: dict[str, dict[str, str | None]] = {
    "stock_phrase": dict.fromkeys(["in today's world", "it is important to note", "it is worth noting", "plays a crucial role", "plays a vital role", "plays a key role", "a wide range of", "in conclusion", "delve into", "delves into", "a testament to", "ever-evolving", "rich tapestry", "in the realm of", "navigate the complexities", "cutting-edge"]),
}
WEAK_VERB = r"(?i)(?:^|[^A-Za-z])((?:" + "|".join(_TAKEN) + ") (?:" + "|".join(_NOUNS) + r"))(?=$|[^A-Za-z])"
#: Hedges that count only where another hedge stands within so many words before.
STACKED, STACK_WORDS = {"may"}, 6
#: Words whose repetition is natural: the closed classes of English (pronouns, determiners, prepositions, conjunctions, auxiliaries,
#: adverbs of degree and place) with four letters or more. Stands in for parts of speech.
QUIET = [
    w
    for words in (
        "they them their theirs themselves your yours yourself yourselves mine myself ours ourselves hers herself himself itself whom whose which what whatever whoever",
        "this that these those some such same each every either neither both many much more most less least fewer several another other others none enough",
        "about above across after against along among amid around before behind below beneath beside between beyond despite down during except from inside into near onto outside over past since through throughout toward towards under underneath until upon with within without",
        "although because whereas while though unless whether than when whenever where wherever therefore thus hence else than",
        "have having been being does doing done were will would shall should could might must cannot ought",
        "also even ever here just never only once quite rather still then there too very again almost already always often perhaps soon yet however",
    )
    for w in words.split()
    if len(w) > 3
]
#: Which rule names a span that several rules mark: the first one.
PRIORITY = ["stock_phrase", "cliche", "wordy_phrase", "filler", "hedge", "weak_verb"]


def alternation(phrases) -> str:
    """Phrases longest first, whole words, any case."""
    return r"(?i)(?:^|[^A-Za-z])(" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))) + r")(?=$|[^A-Za-z])"


def lexicon_hits(sentences: DataFrame, lexicons: dict[str, dict[str, str | None]] = LEXICONS) -> DataFrame:
    """The sentences' rows by lexicon and phrase, with the plainer wording."""
    arrays = []
    for name, phrases in lexicons.items():
        hits = F.regexp_extract_all("sentence", F.lit(alternation(phrases)), F.lit(1))
        arrays.append(tagged(name, hits))
    rows = sentences.select("doc_id", "sent_idx", F.explode(F.concat(*arrays)).alias("h")).select("doc_id", "sent_idx", "h.lexicon", "h.phrase")
    table = sentences.sparkSession.createDataFrame([(n, p, r) for n, t in lexicons.items() for p, r in t.items()], "lexicon string, phrase string, plain string")
    return rows.join(F.broadcast(table), ["lexicon", "phrase"])  # some dozens of phrases


def tagged(name: str, hits: Column) -> Column:
    return F.transform(hits, lambda m: F.struct(F.lit(name).alias("lexicon"), F.lower(m).alias("phrase")))


def long_sentences(sentences: DataFrame) -> DataFrame:
    """Over 30 words: info; over 40: warn."""
    return sentences.where("n_words > 30").select("doc_id", "sent_idx", "n_words", F.when(F.col("n_words") > 40, "warn").otherwise("info").alias("severity"))


def repeated_openers(sentences: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, first_sent, n, opener: runs of consecutive sentences with one first word; paragraphs do not end them."""
    own = own_text(sentences)
    order = Window.partitionBy(*own).orderBy("sent_idx")
    rows = sentences.select(*own, "sent_idx", F.lower(F.get("words", F.lit(0))).alias("opener"))
    new = (F.lag("opener").over(order) != F.col("opener")).cast("int")
    rows = rows.withColumn("run", F.sum(F.coalesce(new, F.lit(1))).over(order))
    return rows.groupBy(*own, "run", "opener").agg(F.min("sent_idx").alias("first_sent"), F.count("*").alias("n")).where(F.col("n") >= least).select("doc_id", "first_sent", "n", "opener")


def near_repeats(sentences: DataFrame, back: int = 2, letters: int = 4) -> DataFrame:
    """doc_id, sent_idx, word: words of four letters or more that one of the two sentences before, in the paragraph, has too.

    A sentence moves once, with its different long words; the words themselves are not exchanged.
    """
    own = own_text(sentences)
    long_words = F.array_distinct(F.filter(F.transform("words", F.lower), lambda w: F.length(w) >= letters))
    order = Window.partitionBy(*own, "para_idx").orderBy("sent_idx").rowsBetween(-back, -1)
    rows = sentences.select(*own, "para_idx", "sent_idx", long_words.alias("_bag"))
    before = F.collect_list(F.struct("sent_idx", "_bag")).over(order)
    near = F.flatten(F.transform(F.filter(before, lambda x: F.col("sent_idx") - x["sent_idx"] <= back), lambda x: x["_bag"]))
    return rows.withColumn("_near", near).select("doc_id", "sent_idx", F.explode(F.array_intersect("_bag", "_near")).alias("word"))


def keep_specific(issues: DataFrame) -> DataFrame:
    """One issue per span, and none of a ranked rule inside an issue of a rule that ranks as high or higher.

    Containment and rank are transitive, so it does not matter whether the container itself stays. In order of start, and the longer first,
    a container comes before what it contains: how far the issues of each rank have reached says all, without a join.
    """
    rank = F.array_position(F.array(*[F.lit(r) for r in PRIORITY]), F.col("rule"))
    first = Window.partitionBy("doc_id", "start", "end").orderBy("_rank", "rule")
    before = Window.partitionBy("doc_id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    rows = issues.withColumn("_rank", rank).withColumn("_n", F.when(F.col("_rank") > 0, F.row_number().over(first.partitionBy("doc_id", "start", "end", F.col("_rank") > 0))))
    ranked = F.col("_n") == 1
    reach = F.array(*[F.max(F.when(ranked & (F.col("_rank") <= k), F.col("end"))).over(before) for k in range(1, len(PRIORITY) + 1)])
    inside = F.coalesce(F.get(reach, F.col("_rank").cast("int") - 1) >= F.col("end"), F.lit(False))
    kept = rows.withColumn("_inside", inside).where((F.col("_rank") == 0) | (ranked & ~F.col("_inside")))
    return kept.drop("_rank", "_n", "_inside")


def unsupported_claims(sentences: DataFrame) -> DataFrame:
    """doc_id, sent_idx of sentences with a strong claim and no number, citation or example in them or the next one."""
    own = own_text(sentences)
    order = Window.partitionBy(*own).orderBy("sent_idx")
    evidence = F.col("sentence").rlike(r"[0-9]|\([A-Z][a-z]+,? [0-9]{4}\)|\[[0-9]+\]|(?i)for example|e\.g\.")
    claim = F.col("sentence").rlike(alternation(LEXICONS["claim"]))
    rows = sentences.select(*own, "sent_idx", claim.alias("claim"), evidence.alias("shown")).withColumn("next", F.coalesce(F.lead("shown").over(order), F.lit(False)))
    return rows.where("claim and not shown and not next").select("doc_id", "sent_idx")


def plain_runs(sentences: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, first_sent, n: runs of sentences of a section without a number or a name inside the sentence."""
    own = own_text(sentences)
    order = Window.partitionBy(*own).orderBy("sent_idx")
    concrete = F.col("sentence").rlike(r"[0-9]|[a-z,] [A-Z][a-z]+")
    rows = sentences.select(*own, "section", "sent_idx", concrete.alias("c"))
    new = F.col("c") | F.coalesce(F.lag("c").over(order) | (F.lag("section").over(order) != F.col("section")), F.lit(True))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(order)).where("not c")
    return rows.groupBy(*own, "run").agg(F.min("sent_idx").alias("first_sent"), F.count("*").alias("n")).where(F.col("n") >= least).select("doc_id", "first_sent", "n")


def spots_within_caps(spots: DataFrame, per_document: int = 25) -> DataFrame:
    """The best spot of a sentence, two of a section, and so many of a document, by priority and place."""
    by = lambda *p: Window.partitionBy(*p).orderBy("priority", "sent_idx", "phrase")
    one = spots.withColumn("_n", F.row_number().over(by("doc_id", "sent_idx"))).where("_n = 1")
    two = one.withColumn("_n", F.row_number().over(by("doc_id", "section"))).where("_n <= 2")
    return two.withColumn("_n", F.row_number().over(by("doc_id"))).where(F.col("_n") <= per_document).drop("_n")
