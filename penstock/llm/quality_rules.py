"""Quality rules by host, with DataFrame functions only.

Every document gets base measures; rules on them fail or pass. Failures are counted by host
(``source``), each host's rate for a rule is shrunk towards all hosts by a beta prior that the hosts'
own counts give (method of moments), and the host's verdict goes back to its documents: on a host
whose shrunk rate for some rule is at least ``host_rate``, a document stays only if it breaks no rule.
On other hosts a document stays unless it fails the base rules.

Nulls and edge cases: a null or empty text has no words and so fails the base rules; a null host is
no host (its documents are judged alone); repeated rows count as often as they occur; an empty table
gives an empty result; other columns are ignored; a rate equal to ``host_rate`` rejects a host; a very long text is measured whole
within its row, by a sort of its windows. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, reserve

SPACE = r"[\x20\x09-\x0D]+"
#: name -> rule on the base measures (true: broken). The first two are the base rules.
RULES = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "lengths": "word_chars < 2 * n_words or word_chars > 12 * n_words",
}
BASE = ("short", "repeats")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever body does with it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window occurring twice or more, for an array of words.

    Windows are sorted by a 64-bit hash with their place; places of equal neighbours are the repeated
    windows; the lengths of their union are added up in order of place.
    """

    def from_sorted(s: Column) -> Column:
        n = F.size(s)
        same = lambda x, k: (
            ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k + 1 < n) & (F.get(s, k + 1)["h"] == x["h"]))
        )
        at = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct(
            (a["total"] + i + 3 - F.greatest(a["end"], i)).alias("total"), (i + 3).alias("end")
        )
        return F.aggregate(at, start, step, lambda a: a["total"])

    def from_words(x: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(x) - 3),
            lambda i: F.struct(F.xxhash64(F.get(x, i), F.get(x, i + 1), F.get(x, i + 2)).alias("h"), i.alias("i")),
        )
        return let(F.sort_array(windows), from_sorted)

    return F.when(F.size(w) >= 4, let(w, from_words)).otherwise(0)


def base_measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """keep, then n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and a flag per rule."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.filter(F.split(t, SPACE), lambda x: x != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = docs.select(
        *keep,
        let(w, lambda x: F.struct(F.size(x).cast("long").alias("n"), repeated_words(x).cast("long").alias("r"))).alias("_w"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d"))).alias("_l"),
    ).select(
        *keep,
        F.col("_w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.n").alias("n_lines"),
        (F.col("_l.n") - F.col("_l.d")).alias("n_dup_lines"),
        F.col("_w.r").alias("n_repeat_words"),
    )
    return measured.select("*", *[F.expr(rule).alias(f"fails_{name}") for name, rule in RULES.items()])


def host_verdicts(measured: DataFrame, host: str = "source", host_rate: float = 0.5) -> DataFrame:
    """(host, n_docs, rate_<rule>..., host_rejected): shrunk failure rates of each host.

    The prior of a rule: with m the mean rate and v the variance of the hosts' rates (weighted by
    documents, less what sampling alone would give), its strength is m (1 - m) / v - 1, kept within
    10 and 1e6; alpha and beta are m and 1 - m times the strength.
    """
    counts = (
        measured.where(F.col(host).isNotNull())
        .groupBy(host)
        .agg(F.count("*").alias("n_docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"k_{r}") for r in RULES])
    )
    sums = [F.sum("n_docs").alias("_n"), F.count("*").alias("_h")]
    for r in RULES:
        k = F.col(f"k_{r}")
        sums += [F.sum(k).alias(f"_k_{r}"), F.sum(k * k / F.col("n_docs")).alias(f"_q_{r}")]
    # One row of sums comes to the driver: a mean and a variance per rule.
    prior = counts.agg(*sums).first()
    rates = []
    for r in RULES:
        n, hosts = prior["_n"] or 0, prior["_h"]
        m = prior[f"_k_{r}"] / n if n else 0.0
        spread = m * (1 - m)
        v = prior[f"_q_{r}"] / n - m * m - spread * hosts / n if n else 0.0
        strength = min(max(spread / v - 1, 10.0), 1e6) if v > 0 else 1e6
        rates.append(((F.col(f"k_{r}") + m * strength) / (F.col("n_docs") + strength)).alias(f"rate_{r}"))
    rated = counts.select(host, "n_docs", *rates)
    return rated.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) >= host_rate)


def apply_quality_rules(docs: DataFrame, host: str = "source", text: str = "text", host_rate: float = 0.5) -> DataFrame:
    """doc_id, the host, base measures, base_failed, host_rejected and kept, one row per row of docs."""
    reserve([host], ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "_host", "n_docs"])
    measured = materialise(base_measures(docs, text, ("doc_id", host)), "quality")
    verdicts = host_verdicts(measured, host, host_rate).select(F.col(host).alias("_host"), "host_rejected")
    broken = F.greatest(*[F.col(f"fails_{r}").cast("int") for r in RULES]) > 0
    base = F.greatest(*[F.col(f"fails_{r}").cast("int") for r in BASE]) > 0
    # Rows without a host meet no verdict, and would all meet in one key.
    judged = measured.where(F.col(host).isNotNull()).join(verdicts, F.col(host) == F.col("_host"), "left").drop("_host")
    alone = measured.where(F.col(host).isNull()).withColumn("host_rejected", F.lit(None).cast("boolean"))
    return (
        judged.unionByName(alone)
        .withColumn("base_failed", base)
        .withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
        .withColumn("kept", ~base & ~(F.col("host_rejected") & broken))
    )
