import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, fp string, score string, w string, n int, spans string, component_id string, _found string, fold string, s string"
SMALL = "/root/testdata/sf0.001"


def rows(texts):
    """Documents with columns whose names operators use inside."""
    return [(i, t, "en", "src0", len(t or ""), *("x" if k != 4 else 7 for k in range(10))) for i, t in texts]


@pytest.fixture(scope="session")
def edge_texts():
    rnd = random.Random(7)
    words = ["the", "of", "Tree", "and", "pot", "Licence", "mit", "license", "É", "straße", "x1", "42"]
    long = " ".join(rnd.choice(words) for _ in range(30_000))
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "word"),
        (5, "two words"),
        (5, "two words"),
        (6, "the MIT License and the mit-license; General Public License. Apache  License"),
        (7, long),
        (8, "a" * 50_000),
        (9, "1" * 20_000 + " 1.2.3.4.5.6.7.8 " + "@" * 500 + "a@b.c"),
        (None, "no id at all, mit license"),
        (10, "same text " * 40),
        (11, "same text " * 40),
        (12, "line one\nline one\n\nline two\nline one"),
        (13, "\u0000nul \U0001f600 emoji é ΣΑΣ İstanbul <|endoftext|> it's, don't."),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_texts):
    return spark.createDataFrame(rows(edge_texts), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
