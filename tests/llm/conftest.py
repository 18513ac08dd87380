import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n long, word string, component_id long, topic string, score double"
EN = "the of and to in that with they have from this which there were their would about could these after".split()
DE = "der die und das nicht ist ein eine mit auf auch sich dem den wird sind noch nach wie aber".split()


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def rows(n=60, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        lines = [prose(rng, EN if lang == "en" else DE, rng.randrange(4, 14)) for _ in range(rng.randrange(1, 6))]
        out.append([i, "\n".join(lines), lang, f"s{i % 7}"])
    for i in range(10):
        out[i * 3][1] += "\nlicensed under the same old terms"
    out[11][1] = out[5][1]
    out[12][1] = out[5][1].replace(" ", "  ", 1)
    return out


def edge_rows():
    long = "word " * 20000
    return [[1, None, None, None], [2, "", "en", "s1"], [3, long, "en", "s1"], [3, long, "en", "s1"], [None, "the and of", "en", None], [4, "x" * 3000, None, "s2"], [5, " \n\t ", "de", "s3"], [6, "123 456", "de", "s3"], [7, "▁ 漢字  é𓀀\r\n end", "en", "s1"], [8, "the and of", "en", "s4"], [8, "other text here", "de", "s4"]]


def frame(spark, data):
    return spark.createDataFrame([(*r, len(r[1] or ""), "h", 1, "w", 9, "t", 0.5) for r in data], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, rows()).persist()


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, edge_rows()).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
