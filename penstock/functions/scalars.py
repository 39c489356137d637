"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(x: Column, low: float, high: float) -> Column:
    """(x - low) / (high - low) within 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


#: Letters whose full capital is several letters, and their capitals of one letter.
_SMALL, _CAPITAL = "ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ", "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ"


def capital(letter: Column) -> Column:
    """The letter's capital of one letter, or the letter where there is none such: a text keeps its length."""
    one = F.translate(letter, _SMALL, _CAPITAL)
    return F.when(F.length(F.upper(one)) == F.length(one), F.upper(one)).when(one != letter, one).otherwise(letter)


def band_score(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear through ascending points, flat beyond both ends."""
    out = F.when(x <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(x <= x1, F.lit(float(y0)) + (x - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(points[-1][1])))


def issue_id(rule: Column, start: Column, end: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", rule, start, end)), 1, 10)


def article_for(word: Column) -> Column:
    """a or an: vowel start, a few spoken exceptions, and letters that are spelt out in acronyms."""
    low = F.lower(word)
    return (
        F.when(low.rlike("^(?:hour|honest|honour|heir)"), "an")
        .when(low.rlike("^(?:uni|use|usu|eu|one|once)"), "a")
        .when(word.rlike("^[A-Z]{2,}"), F.when(word.rlike("^[AEFHILMNORSX]"), "an").otherwise("a"))
        .when(low.rlike("^[aeiou]"), "an")
        .otherwise("a")
    )


def similar_length(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(2.0), F.greatest(a, b) * 0.15)


def score_band(score: Column) -> Column:
    return F.when(score >= 70, "good").when(score >= 40, "partial").otherwise("weak")


def interval_label(minutes: Column) -> Column:
    """min below a day, then days, months, years."""
    days = F.round(minutes / 1440.0)
    return (
        F.when(minutes < 1440, F.concat(F.round(minutes).cast("long").cast("string"), F.lit(" min")))
        .when(days < 30, F.concat(days.cast("long").cast("string"), F.lit(" d")))
        .when(days < 365, F.concat(F.round(days / 30.0).cast("long").cast("string"), F.lit(" mo")))
        .otherwise(F.concat(F.round(days / 365.0, 1).cast("decimal(10,1)").cast("string"), F.lit(" y")))
    )


def answer_norm(text: Column) -> Column:
    """Lower case, punctuation to spaces, one space between words, no leading article."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s-]", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(t, r"^(?:the|a|an)\s+", ""))


def answer_sentence(text: Column) -> Column:
    """One space between words, a capital first, a full stop last."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    t = F.concat(F.upper(F.substring(t, 1, 1)), t.substr(F.lit(2), F.length(t)))
    return F.when(t == "", t).when(t.rlike(r"[.!?]$"), t).otherwise(F.concat(t, F.lit(".")))


def cloze_correct(answer: Column, key: Column, typos: int = 2, long_key: int = 5) -> Column:
    """Equal after normalising; or as many words, each within the typo distance where the key word is long."""
    a, k = F.split(answer_norm(answer), " "), F.split(answer_norm(key), " ")
    near = F.forall(F.zip_with(a, k, lambda x, y: (x == y) | ((F.length(y) > long_key) & (F.levenshtein(x, y) <= typos))), lambda ok: ok)
    return (answer_norm(answer) != "") & ((answer_norm(answer) == answer_norm(key)) | ((F.size(a) == F.size(k)) & near))


def sm2_step(card: Column, grade: Column, at: Column) -> Column:
    """A card (ease, interval, reps, lapses, due_minutes) after a review: again, hard, good, easy are 1 to 4."""
    q = F.when(grade == 1, 1).when(grade == 2, 3).when(grade == 3, 4).otherwise(5)
    miss = F.lit(5) - q
    ease = F.greatest(F.lit(1.3), card["ease"] + (F.lit(0.1) - miss * (F.lit(0.08) + miss * F.lit(0.02))))
    reps = card["reps"] + 1
    interval = F.when(reps == 1, F.lit(1.0)).when(reps == 2, F.lit(6.0)).otherwise(F.floor(card["interval"] * ease + 0.5).cast("double"))
    lost = q < 3
    return F.struct(
        ease.alias("ease"),
        F.when(lost, F.lit(0.0)).otherwise(interval).alias("interval"),
        F.when(lost, F.lit(0)).otherwise(reps).cast("int").alias("reps"),
        (card["lapses"] + lost.cast("int")).cast("int").alias("lapses"),
        (at + F.when(lost, F.lit(10.0)).otherwise(interval * 1440.0)).alias("due"),
    )


def fnv1a36(text: Column) -> Column:
    """The 32-bit FNV-1a hash over the text's UTF-16 units, in base 36: ids of cards. A null text has none, an empty one the offset's."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    folded = F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.conv(folded.cast("string"), 10, 36))
