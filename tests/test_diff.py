"""Ordered and inline differences, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import sequences
from corpusloom.operators import diff


def table_of_lengths(a, b):
    same = lambda x, y: any(p == q for p, q in zip(x, y, strict=True))
    lengths = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            lengths[i + 1][j + 1] = lengths[i][j] + 1 if same(x, y) else max(lengths[i][j + 1], lengths[i + 1][j])
    return lengths[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 20])
def test_common_subsequences_are_longest(bits, monkeypatch):
    monkeypatch.setattr(sequences, "TABLE_BITS", bits)
    r = random.Random(4)
    for _ in range(400):
        columns = r.choice([1, 1, 2])
        a, b = ([tuple(r.choice("abcd") for _ in range(columns)) for _ in range(r.randint(0, 14))] for _ in "ab")
        got = sequences.common(a, b)
        assert all(x < y and p < q for (x, p), (y, q) in zip(got, got[1:], strict=False))
        assert all(any(p == q for p, q in zip(a[i], b[j], strict=True)) for i, j in got)
        # With several columns being the same is not transitive; taking equal ends first may cost a match.
        assert len(got) == table_of_lengths(a, b) if columns == 1 else len(got) >= table_of_lengths(a, b) - 1


def test_rising_subsequences_are_longest():
    r = random.Random(5)
    for _ in range(200):
        values = r.sample(range(50), r.randint(0, 12))
        best = [1] * len(values)
        for k in range(len(values)):
            best[k] = 1 + max([best[m] for m in range(k) if values[m] < values[k]], default=0)
        got = [values[k] for k in sequences.rising(values)]
        assert got == sorted(got) and len(got) == max(best, default=0)


def edited(rows, r):
    rows = list(rows)
    for _ in range(r.randint(0, 12)):
        at = r.randrange(len(rows)) if rows else 0
        what = r.randrange(5)
        if what == 0 and rows:
            del rows[at : at + r.randint(1, 4)]
        elif what == 1:
            rows[at:at] = [(f"new{r.randrange(99)}", "x")] * r.randint(1, 3)
        elif what == 2 and rows:
            rows[at] = (rows[at][0], "changed")
        elif what == 3 and rows:
            rows[at:at] = [("", None)] * r.randint(1, 5)
        elif rows:
            block = rows[at : at + 5]
            del rows[at : at + 5]
            to = r.randrange(len(rows) + 1)
            rows[to:to] = block
    return rows


def frame(spark, rows, parts=3):
    data = [(3 * k, *row) for k, row in enumerate(rows)]
    return spark.createDataFrame(data, "line_no long, src string, trg string").repartition(parts)


def applied(before, script):
    """The script's matches rise, tell of all rows once, and have the right status; its cost."""
    pairs = sorted((s.before_no // 3, s.after_no // 3, s.status) for s in script if s.status in ("identical", "changed"))
    assert all(x < y and p < q for (x, p, _), (y, q, _) in zip(pairs, pairs[1:], strict=False))
    return pairs


@pytest.mark.parametrize("most", [3, 200_000])
def test_edit_scripts_turn_one_frame_into_the_other(spark, most):
    r = random.Random(6)
    base = [(f"s{k}" if k % 4 else "", f"t{k % 7}") for k in range(80)]
    for _ in range(4):
        after = edited(base, r)
        script = diff.diff_ordered(frame(spark, base), frame(spark, after), ["src", "trg"], most_anchors=most).collect()
        for i, j, status in applied(base, script):
            assert (status == "identical") == (base[i] == after[j]) and (base[i][0] == after[j][0] or base[i][1] == after[j][1])
        assert sorted(s.before_no // 3 for s in script if s.status != "added") == list(range(len(base)))
        assert sorted(s.after_no // 3 for s in script if s.status != "removed") == list(range(len(after)))
        assert all(tuple(s.before) == base[s.before_no // 3] for s in script if s.before)
        if most > 100:  # without a sample of the anchors, the script is that of the loop over whole frames
            code = [tuple(x) for x in base], [tuple(x) for x in after]
            assert [(i, j) for i, j, _ in applied(base, script)] == sequences.patience(*code)


def test_differences_of_empty_and_equal_frames(spark):
    rows = [("a", "b"), ("a", "b"), (None, None)]
    none = frame(spark, [])
    assert diff.diff_ordered(none, none, ["src", "trg"]).count() == 0
    assert {x.status for x in diff.diff_ordered(frame(spark, rows), none, ["src", "trg"]).collect()} == {"removed"}
    assert [x.status for x in diff.diff_ordered(frame(spark, rows), frame(spark, rows), ["src", "trg"]).collect()] == ["identical"] * 3


def test_a_long_corpus_is_the_work_of_several_tasks(spark):
    lines = spark.range(100_000).select(F.col("id").alias("line_no"), F.concat(F.lit("line "), "id").alias("src"))
    after = lines.where("line_no % 1000 <> 7").withColumn("line_no", (F.col("line_no") + 90_000) % 100_000)  # the end moves to the front
    after = after.withColumn("line_no", F.when(F.col("line_no") >= 90_000, F.col("line_no") + 10).otherwise(F.col("line_no")))
    script = diff.diff_ordered(lines, after, ["src"], most_anchors=2000).persist()
    found = {r.status: r["count"] for r in script.groupBy("status").count().collect()}
    assert found == {"identical": 89_910, "removed": 100 + 9_990, "added": 9_990}
    held = script.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 1
    script.unpersist()


def test_inline_spans_are_shortest_scripts(spark):
    r = random.Random(9)
    texts = ["the quick brown fox jumps", "", "a", "übergröße 😀 x", "aaaa"]
    cases = []
    for k in range(150):
        x = r.choice(texts)
        y = list(x)
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randint(0, 2)] = r.choice(["", "q", "zz", "ü"])
        cases.append((k, x, "".join(y)))
    df = spark.createDataFrame([*cases, (900, None, "a"), (901, "a", None)], "k int, a string, b string").repartition(3)
    several = 0
    for row in df.select("*", diff.inline_diff(F.col("a"), F.col("b")).alias("s")).collect():
        if row.a is None or row.b is None:
            assert row.s is None
            continue
        cost = len(row.a) + len(row.b) - 2 * table_of_lengths([(c,) for c in row.a], [(c,) for c in row.b])
        if cost > 0.5 * max(len(row.a), len(row.b)):
            assert row.s is None
            continue
        assert "".join(s.text for s in row.s if s.kind != "insert") == row.a and "".join(s.text for s in row.s if s.kind != "delete") == row.b
        assert sum(len(s.text) for s in row.s if s.kind != "equal") == cost
        assert all(x.kind != y.kind for x, y in zip(row.s, row.s[1:], strict=False))
        several += sum(s.kind != "equal" for s in row.s) > 2
    assert several > 10


def test_long_texts_that_only_lose_or_gain_characters_are_not_searched(monkeypatch):
    from corpusloom.functions import sequences

    def never(a, b):
        raise AssertionError("a common subsequence was searched")

    long, want = "the same old tale again, " * 4000, ("equal", "delete", "insert")
    short = long.replace("a", "").replace("e", "")
    monkeypatch.setattr(sequences, "common", never)
    for before, after in ((long, short), (short, long), (long, ""), ("", "x"), ("abc", "xyz"), ("aab", "ab")):
        found = sequences.spans(before, after, 1.0) if before != "abc" else sequences.spans(before, after, 0.5)
        if before == "abc":
            assert found is None
            continue
        assert {k for k, _ in found} <= set(want) and all(t for _, t in found)
        assert "".join(t for k, t in found if k != "insert") == before and "".join(t for k, t in found if k != "delete") == after
        assert sum(len(t) for k, t in found if k != "equal") == abs(len(before) - len(after))


def test_cells_of_an_ordered_diff_are_not_as_many_as_its_anchors(spark):
    from corpusloom.operators import diff

    rows = spark.range(5000).selectExpr("id as before_no", "id as after_no", "struct(id as high, id * 7919 as low) as name")
    before, after = diff.coarse_path(rows.select("before_no", "name"), rows.select("after_no", "name"), 200_000)
    assert len(before) == len(after) == 5 and list(before) == sorted(before)
