import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, key long, "
    "fingerprint string, n_words string, mix_slot string, h string, rn string, secret_spans string, quality_score string"
)


def prose(r, n):
    return " ".join(r.choice("the of and red green stone river Über llano ciel maßen walk runs token key").lower() + str(r.randrange(40)) if r.random() < 0.3 else r.choice("the of and red green stone river Über llano ciel maßen walk runs".split()) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, copies, repeated rows, ties, and columns named like results."""
    r = random.Random(11)
    base = [prose(r, r.randrange(5, 120)) + (".\n" + prose(r, 30) if r.random() < 0.5 else "") for _ in range(30)]
    long = " ".join(prose(r, 50) for _ in range(200))
    texts = [*base, base[0], base[1], base[2] + " more", base[3].upper(), "", None, " \n\t ", "word", "aaaa" * 300, long, long[5:], "日本語のテキスト" * 80, "日本語のテキスト" * 80]
    rows = [(i * 3, t, "en", f"s{i % 3}" if i % 7 else None, None, "x", i, "y", "z", "w", "h", "1", "a", "b") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[4], None, "s1", 1, *["x", 1, *["y"] * 7])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
