"""The pipeline, stage by stage, on documents with known cases."""

import importlib
import random

import pytest

import corpus_pipeline
from corpusloom.llm import queries

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = []
    for k in range(80):
        text = " ".join(f"w{r.randrange(5000)}" for _ in range(r.randint(40, 90)))
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
    rows.append((200, rows[0][1], "en", "s1", 1))  # a copy
    rows.append((201, "too short", "en", "s1", 1))
    rows.append((202, None, None, None, None))
    leak = "this is a passage of the benchmark that nobody should train on at all"
    own = " ".join(f"w{r.randrange(5000)}" for _ in range(60))
    rows.append((203, own + " " + leak, "en", None, 1))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.columns
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append({r.doc_id for r in docs.collect()})
        if k < 4:
            assert docs.columns == before
    assert ids[0] == {*range(80), 200, 203}
    assert ids[1] == {*range(80), 203}
    assert ids[2] == set(range(80))
    assert ids[3] <= set(range(80)) and ids[4] == ids[3]
    assert docs.columns[-2:] == ["shard", "slot"]


def test_each_stage_on_documents_of_their_own(spark, tmp_path):
    """Copies, near copies, null and blank texts, repeated rows and labels without a document, one stage after the other."""
    r = random.Random(3)
    made = lambda n: [f"v{r.randrange(9000)}" for _ in range(n)]
    words = {k: made(60) for k in range(40)}
    leak = made(14)
    words[41] = [*words[3][:30], "other", *words[3][31:]]  # five of 56 shingles differ
    words[42] = [*words[4][:20], *made(20), *words[4][40:]]  # half of them do
    words[43] = [*made(40), *leak]
    rows = [(k, " ".join(w), "en", f"s{k % 2}", 1) for k, w in words.items()]
    rows += [(50, rows[5][1], None, None, None), rows[6], (51, None, None, None, None), (52, " \n", "", "", 0), (None, None, None, None, None)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    spark.createDataFrame([(1, " ".join(leak)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (0, 1, 0), (777, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    found = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        found.append(sorted(x.doc_id for x in docs.collect()))
    assert found[0] == sorted([*range(40), 6, 41, 42, 43, 50])
    assert found[1] == [*range(40), 42, 43]
    assert found[2] == [*range(40), 42]
    assert set(found[3]) <= {*range(40), 42} and len(found[4]) == len(found[3])


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 60 and {r.doc_id for r in out.collect()} <= set(range(80))


def test_stages_take_empty_tables(spark, folder):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], COLUMNS), folder).count() == 0


def test_registration():
    entry = importlib.import_module("__spark_entry__")
    found = entry.queries()
    assert {n.split("_")[0] for n in found if n.startswith("op") and n[2].isdigit()} == {f"op{k}" for k in range(1, 14)}
    assert "pipeline" in found and set(queries.ORACLES) <= set(found)
