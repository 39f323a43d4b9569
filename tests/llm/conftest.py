import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, rep string, score string"


def make_rows():
    """Copies, near copies, shared passages, nulls in any column, empty, blank and long texts; columns with names that clash."""
    r = random.Random(5)
    word = lambda: "".join(r.choice(["th", "er", "in", "on", "ée", "st", "a"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() + ("." if r.random() < 0.1 else "") + ("\n" if r.random() < 0.05 else "") for _ in range(n))
    passage, base, texts = prose(60), prose(300), []
    texts += [prose(r.randint(3, 120)) for _ in range(40)]
    texts += [base] * 5
    for _ in range(8):
        w = base.split(" ")
        for _ in range(r.randint(1, 20)):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [prose(30) + " " + passage + " " + prose(30) for _ in range(6)]
    texts += ["x" * 700, "ab" * 400, "a line of words\n" * 40, prose(9000)]
    texts += [None, "", " \n\t ", "one", "One", "tail <|endoftext|> x", "Caps AND caps", "caps and CAPS", "  lead", "two  gaps\n\nhere \n", "é" * 150 + "日本"]
    rows = [(k, t, r.choice(["en", "de", None]), r.choice(["src0", "src0", "src1", "src2", None]), len(t) if t else None, 1, "s", "r", "q") for k, t in enumerate(texts)]
    rows += [(None, "a row without an id and some words", "en", "src1", 34, 1, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
