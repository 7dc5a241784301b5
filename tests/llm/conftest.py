import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, part string, i long, n long, h string, path string, run long, slot int, score long, rank long, __part int, __at long"
TAIL = (1, "p", 2, 3, "h", "x", 4, 5, 6, 7, 8, 9)


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns named as the operators name theirs."""
    from random import Random

    r = Random(8)
    word = lambda: "".join(r.choice("abcdeXYZéüß") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(0, None, "en", "s", None), (1, "", None, None, 0), (2, " \n\t ", "en", "s", 4), (3, "One!", "de", "é", 4), (4, "It's 3 o'clock. <|endoftext|> H̱ó ...", None, "s", 9), (None, "no id " + text(30), None, None, 4), (None, None, None, None, None)]
    rows += [(i, text(3 * i), ["en", "en", "fr", None][i % 4], "s", i) for i in range(5, 90)]
    rows += [(200, text(40_000), "en", "s", None), (201, "x" * 60_000, "en", "s", 1), (202, "é" * 3000 + "́", "solo", None, 1)] + [(7, "twice", "en", "s", 1)] * 3
    return spark.createDataFrame([(*x, *TAIL) for x in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
