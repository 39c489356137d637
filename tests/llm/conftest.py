import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty, blank and long texts, copies, near copies, repeated rows, shared passages, clashing names."""
    base, shared = prose(120, 1), prose(90, 2)
    near = base.replace(base.split()[60], "changed")
    rows = [
        (1, None, "en", "a", "x", 1), (2, "", "en", "a", "x", 1), (3, " \n\t ", None, "a", "x", 1), (4, "one two", "en", None, "x", 1), (5, "One TWO", "de", "b", None, 1),
        (6, base, "en", "a", "x", 1), (7, base, "en", "a", "x", 1), (8, near, "en", "a", "x", 1), (9, prose(50, 3) + " " + shared + "\nend " + prose(20, 4), "fr", "b", "x", 1),
        (10, prose(40, 5) + "\n" + shared + ". " + prose(9, 6), "fr", "b", "x", 1), (11, "é" * 500 + " ß ü", "de", "c", "x", 1), (12, "ab " * 900, "en", "c", "x", 1),
        (13, prose(30_000, 7), "en", "c", "x", 1), (13, base, "en", "a", "x", 1), (None, prose(70, 8), "es", "c", "x", 1), (14, "### $$$ 123 !!!", "en", "c", "x", 1),
        (15, "line one\nline one\nline two\n\nline one", "en", "b", "x", 1), (16, "x" * 5000, "en", "b", "x", 1), (17, "a b c d", "en", "b", "x", 1), (18, "a b c d e", "en", "b", "x", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string, n int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
