import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, size int, slot string, shard string,"
    " row_key string, component string, label int, word string, h1 long, kept string, score string, host string"
)
MORE = (7, 1, "x", "y", "k", "c", 1, "w", 2, "kept", "s", "h")
TABLE = "docs"


def some_rows(n=60, seed=1):
    """Documents with copies, near copies, shared passages, and odd cases."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(12, 150))]
        if k % 7 == 0:
            words[5:5] = passage[: r.randint(45, 60)]
        texts.append(" ".join(words))
    texts[10] = texts[4]
    texts[11] = texts[4]
    near = texts[5].split()
    near[3] = "changed"
    texts[12] = " ".join(near)
    rows = [(k + 1, t, "en" if k % 3 else "de", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    rows += [
        (100, None, "en", "s1", None),
        (101, "", None, "s1", 0),
        (102, " \n\t ", "en", None, 4),
        (103, "one", "en", None, 3),
        (104, "!!! ###", "de", "é", 7),
        (None, texts[4], None, None, 1),
        (None, None, None, None, None),
        (1, texts[0], "en", "s0", len(texts[0])),  # a row again
        (2, "another text with the id of a document", "en", "s1", 1),
        (105, " ".join(["again and", *["again and"] * 3000]), "en", "s2", 1),
        (106, " ".join(r.choice(vocabulary) for _ in range(20_000)), "fr", "s2", 1),
        (107, "Grüße\u00a0an ALLE İstanbul\u2028x\x1cy", "de", "s3", 1),
    ]
    return [(*row, *MORE) for row in rows]


@pytest.fixture(scope="session")
def rows():
    return some_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
