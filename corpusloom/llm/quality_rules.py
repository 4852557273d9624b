"""Quality rules: a learned decision list over document statistics.

The statistics are plain column expressions over whole texts. From a bounded sample of labelled
documents, sequential covering learns rules for documents to reject: a rule is grown condition by
condition (by information gain), pruned on documents it was not grown on, and kept if it is
precise there; the documents it covers are then set aside and the next rule is grown. The list
comes back as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACES, bounded, cut, let

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Features that rules may test, over the columns of `text_statistics`.
FEATURES = (
    "n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "mark_share",
    "dup_line_share", "repeat_share", "unique_share", "words_per_line",
)


def words_of(text: Column) -> Column:
    """The words of a text, runs of anything but ASCII white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    none = F.array().cast("array<string>")
    return let(trimmed, lambda t: F.when(t == "", none).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


def repeated_words(words: Column) -> Column:
    """How many words lie in 5-word windows that occur twice or more in the text.

    Only texts in which a window repeats sort their windows' hashes; the places of the repeated
    ones, in order, then cover min(5, distance to the one before) new words each.
    """
    zero = F.lit(0).cast("long")

    def places(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(sorted_pairs: Column) -> Column:
            def same(x: Column, k: Column) -> Column:
                before = F.get(sorted_pairs, k - 1)["h"]
                after = F.get(sorted_pairs, k + 1)["h"]
                return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

            return F.sort_array(F.transform(F.filter(sorted_pairs, same), lambda x: x["i"]))

        return let(pairs, twice)

    def covered(at: Column) -> Column:
        start = F.struct(zero.alias("n"), F.lit(-WINDOW).alias("last"))
        step = F.aggregate(
            at,
            start,
            lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
        )
        return step["n"]

    def count(h: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        )
        some = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(covered(places(h))))
        return F.when(F.size(h) < WINDOW, zero).otherwise(some)

    # Each word is hashed once; windows are hashes of hashes.
    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def _dropping(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, "")).cast("long")


def text_statistics(text_col: str = "text") -> list[Column]:
    """Columns of counts over a whole text (null counts as empty): n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_upper, n_digits, n_marks, n_lines, n_unique."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.length(text).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    of_lines = let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), F.size(F.array_distinct(x)).cast("long").alias("different")),
    )
    of_words = let(
        words_of(F.col(text_col)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_unique"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    return [
        of_words.alias("of_words"),
        of_lines.alias("of_lines"),
        _dropping(text, SPACES).alias("word_chars"),
        (length - _dropping(text, SYMBOLS)).alias("n_symbols"),
        (length - _dropping(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        (length - _dropping(text, "0123456789")).alias("n_digits"),
        (length - _dropping(text, ".,;:!?")).alias("n_marks"),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: Column) -> DataFrame:
    """The id, `keep`, the counts of `text_statistics`, FEATURES and base_failed of each row."""
    counted = docs.select(F.col(id_col).alias("id"), *keep, *text_statistics(text_col))
    flat = cut(counted).select(
        "*",
        "of_words.*",
        F.col("of_lines.n_lines").alias("n_lines"),
        (F.col("of_lines.n_lines") - F.col("of_lines.different")).alias("n_dup_lines"),
    )

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    features = {
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "unique_share": share("n_unique", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return flat.withColumns(features).withColumn("base_failed", failed).drop("of_words", "of_lines")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_most: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] <= self.value if self.at_most else x[self.feature] >= self.value

    def column(self) -> Column:
        return F.col(self.feature) <= self.value if self.at_most else F.col(self.feature) >= self.value


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, cuts: int) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < most and not bad[inside].all():
        p0, n0 = bad[inside].sum(), inside.sum()
        best = (0.0, None)
        for feature in FEATURES:
            values = x[feature][inside]
            for value in np.unique(np.quantile(values, np.linspace(0, 1, cuts))):
                for condition in (Condition(feature, True, float(value)), Condition(feature, False, float(value))):
                    held = values <= value if condition.at_most else values >= value
                    p, n = bad[inside][held].sum(), held.sum()
                    if 0 < p and n < n0:
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if gain > best[0] + 1e-9:
                            best = (gain, condition)
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The prefix of the rule with the best smoothed precision on other documents; and its support."""
    best = ((), 0.0, 0)
    for k in range(1, len(rule) + 1):
        inside = covers(rule[:k], x)
        precision = (bad[inside].sum() + 0.5) / (inside.sum() + 1)
        if precision > best[1] + 1e-9:
            best = (rule[:k], precision, int(inside.sum()))
    return best


def learn_rules(
    x: dict[str, np.ndarray],
    bad: np.ndarray,
    max_rules: int = 12,
    max_conditions: int = 4,
    min_precision: float = 0.9,
    min_support: int = 3,
    cuts: int = 40,
    seed: int = 5,
) -> list[Rule]:
    """Rules for rejection by sequential covering, in order. Without bad examples, none."""
    rng = np.random.default_rng(seed)
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    for _ in range(max_rules):
        at = np.flatnonzero(left)
        if not bad[at].any():
            break
        order = rng.permutation(at)
        grow, prune = order[: 2 * len(order) // 3], order[2 * len(order) // 3 :]
        if not len(grow) or not bad[grow].any():
            break
        rule = _grow({f: v[grow] for f, v in x.items()}, bad[grow], max_conditions, cuts)
        if not rule:
            break
        rule, precision, support = _prune(rule, {f: v[prune] for f, v in x.items()}, bad[prune])
        if not rule or precision < min_precision or support < min_support:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The decision list as one conditional expression: false for what a rule rejects, else true."""
    decided = F.lit(True)
    for rule in reversed(rules):
        held = rule[0].column()
        for condition in rule[1:]:
            held &= condition.column()
        decided = F.when(held, False).otherwise(decided)
    return decided


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    quality_col: str = "quality",
    max_labelled: int = 20_000,
    keep: Sequence[Column] = (),
) -> tuple[DataFrame, list[Rule]]:
    """Statistics of each row of `docs` with base_failed and kept, and the learned rules.

    The rules are learned from about `max_labelled` labelled documents at most that pass the base rules,
    chosen by a hash of their ids; only their numbers reach the driver. Rows with a null
    label are no examples; a document with several labels gives several. Without labels no rule is
    learned, and what passes the base rules is kept. Null and empty texts have no words and fail
    the base rules. Rows may repeat; each gets its own row. An empty table gives an empty result.
    """
    stats = statistics(docs, id_col, text_col, *keep)
    marked = labels.select(F.col(label_id_col).alias("label_id"), F.col(quality_col).alias("label")).where("label is not null")
    passed = stats.where(~F.col("base_failed")).select("id", *FEATURES)
    examples = passed.join(marked, F.col("id") == F.col("label_id")).select(
        *[F.col(f).cast("double").alias(f) for f in FEATURES], "label", F.xxhash64("id").alias("turn")
    )
    rows = sorted(bounded(examples, "turn", max_labelled).collect(), key=lambda r: (r["turn"], *(r[f] for f in FEATURES), r["label"]))
    x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    rules = learn_rules(x, np.array([r["label"] == 0 for r in rows], bool))
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that the base rules and the learned list keep. The statistics are joined
    back by a hash of id and text, so equal rows share one verdict."""
    key = F.xxhash64(id_col, text_col)
    judged, _ = judge(docs, labels, id_col, text_col, keep=(key.alias("row_key"),), **options)
    good = judged.where("kept").select(F.col("row_key").alias("__row_key")).distinct()
    return docs.withColumn("__row_key", key).join(good, "__row_key", "left_semi").select(*docs.columns)
