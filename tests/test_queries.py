"""Registered queries against DuckDB on the smallest tables."""

import os

import pytest

from corpusloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def same(spark_rows, duck_rows):
    columns = sorted(spark_rows.columns)
    assert columns == sorted(duck_rows.columns)
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (spark_rows, duck_rows))
    assert a.equals(b)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_and_sql_agree(spark, duck, name):
    same(catalogue.QUERIES[name](spark, FOLDER).toPandas(), duck.sql(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    found = catalogue.QUERIES[name](spark, FOLDER)
    assert found.count() > 0 and found.where(" or ".join(f"`{c}` is not null" for c in found.columns)).count() == found.count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def by_hand(text):
    """The sentences of a line, read character by character."""
    abbreviations = "Mr Mrs Ms Dr Prof St No vs etc e.g i.e z.B bzw usw Hr Fr Nr M Mme Sr Sra Ud pág cf".split()
    out, start, k = [], 0, 0
    while k < len(text):
        end = k
        while k < len(text) and text[k].isspace():
            k += 1
        if k == end:
            k += 1
            continue
        before, after = text[:end], text[k:].lstrip("\"'“‘„«([¿¡")
        closed = next((n for n in range(3) if len(before) > n and before[-n - 1] in ".!?…" and all(c in "\"'”’»)]" for c in before[len(before) - n :])), None)
        word = before[:-1].split(" ")[-1].lstrip("(\"'“„«[") if before.endswith(".") else ""
        short = word in abbreviations or (len(word) == 1 and word.isupper())
        if closed is not None and after and (after[0].isupper() or after[0].isdigit()) and not short:
            out.append(text[start:end].strip())
            start = k
    return [s for s in [*out, text[start:].strip()] if s]


def test_all_pairs_are_cut_into_sentences(spark, tmp_path):
    texts = [
        "One here. Two there! (Three.) Four\nEins da. Zwei dort! (Drei.) Vier\nOnly one",
        "Dr. A. Smith went. He left\nHr. B. Schmidt ging. Er blieb\n\"Stop!\" He said. 3 times\n»Halt!« Er rief. 3 mal",
        "no end at all\nkein Ende\nx. lower case stays\ny. klein",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for k, text in enumerate(texts):
        lines = text.split("\n")
        for n, (a, b) in enumerate(zip(lines, lines[1:])):
            a, b = by_hand(a), by_hand(b)
            want += [(k, n, part, x, y) for part, (x, y) in enumerate(zip(a, b))] if len(a) == len(b) else []
    got = catalogue.QUERIES["split_sentences_all"](spark, str(tmp_path)).select("doc_id", "line_no", "part", "src", "trg").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert max(r.part for r in got) == 3


def test_rows_with_tags_are_dropped(spark):
    whole = sum(catalogue.table(spark, FOLDER, name).count() for name in ("pages", "documents"))
    kept = catalogue.QUERIES["opus_html_tags_whole"](spark, FOLDER)
    assert 0 < kept.count() < whole and kept.where("text rlike '<p>'").count() == 0


def test_suffixes_of_later_lines_are_stripped(spark, tmp_path):
    texts = [(200 + 4 * k + 50, "\n".join(f"{c} {k} line" for c in "abcdefghijkl")) for k in range(2)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["strip_suffix"](spark, str(tmp_path)).orderBy("line").collect()
    assert [r.text for r in got] == [c for k in range(2) for c in (f"{c}" for c in "abcdefghijkl")]
    assert {r.suffix: r.n for r in catalogue.QUERIES["suffix_counts"](spark, str(tmp_path)).collect()} == {" 0 line": 12, " 1 line": 12}


def on_texts(spark, tmp_path, name, texts):
    """A query and its SQL over documents with these texts."""
    import duckdb

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), connection.sql(catalogue.ORACLES[name]).df())


def test_quotes_of_the_lines_themselves_are_kept(spark, tmp_path):
    lines = ["plain", 'ends in "one"', 'ends in "two"', 'two ""inside"" it', 'two ""inside"" it too', '"', '"', "", "", '""', '""', "last"]
    on_texts(spark, tmp_path, "deescape_tsv", ["\n".join(lines), "\n".join(lines[1:])])


def test_names_of_placeholders_in_a_text_take_no_place(spark, tmp_path):
    many = " ".join("é" * k for k in range(1, 24))
    on_texts(spark, tmp_path, "placeholders_unknown", [f"7@ and 12@ {many} 7@", f"{many}@3@é", "5@ only", many])


def test_prefilter_of_placeholders_changes_nothing(spark):
    from corpusloom.operators import placeholders as p

    texts = ["", None, "none", "3@ only", "a@b.co", "https://x.org/y www.a.b", "http://a.b @", "www.no", "://", "mail a.b@c.d, 19@ and www.x.y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "line_no long, text string")
    plain = [*p.RULES[:-1], f"(?:{p.RULES[-1]})"]  # a rule that the prefilter does not know
    found = [sorted(p.encode(rows, ["text"], rules=r).collect(), key=lambda x: x.line_no) for r in (p.RULES, plain)]
    assert found[0] == found[1] and sum(len(r.mapping) for r in found[0]) == 8
