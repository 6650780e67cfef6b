"""Document quality by weak supervision. DataFrame functions only.

Eight rules look at a document, and each votes good (1), bad (-1) or abstains (0).
None decides alone. Expectation-maximisation over how often each pattern of votes
occurs estimates each rule's accuracy and the share of good documents; a document
is kept if the posterior probability that it is good, given its votes, reaches
``threshold``. Documents count for their pattern only, so that the estimate works
on at most 3 ** 8 patterns however many documents there are.

A rule has two accuracies, for good and for bad documents, and is independent of the
others given which it is: a bad document passes most rules, so a bad vote weighs more
than a good one. Bounds keep a rule from turning round or being beyond doubt.

Defined results: null and empty texts have no words and fail the base checks;
repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, materialize, table, words

#: Fixed values of the base counts.
SYMBOLS = "#*$%&|<>"
MARKS = "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WINDOW = 5

#: Where a rule's accuracies on good and on bad documents start, and the imagined votes behind them.
START = (0.97, 0.4)
PRIOR = 10.0

#: Rule, measure, smallest and largest good value, smallest and largest value that is not bad.
RULES = (
    ("length", "n_words", 30.0, math.inf, 20.0, math.inf),
    ("word_length", "mean_word", 3.0, 9.0, 2.0, 14.0),
    ("symbols", "symbol_share", 0.0, 0.05, 0.0, 0.25),
    ("marks", "mark_share", 0.0, 0.1, 0.0, 0.22),
    ("lines", "dup_line_share", 0.0, 0.0, 0.0, 0.3),
    ("repeats", "repeat_share", 0.0, 0.03, 0.0, 0.15),
    ("capitals", "capital_share", 0.0, 0.2, 0.0, 0.5),
    ("variety", "variety", 0.25, 1.0, 0.08, 1.0),
)


def signals(docs: DataFrame) -> DataFrame:
    """The base counts and the rules' measures of each whole text; one row per document, doc_id and numbers only.

    ``n_repeat_words`` sorts a text's windows by hash only if some hash occurs
    twice, pairs neighbours, and adds up the union of the windows that they mark.
    """
    text = F.coalesce("text", F.lit(""))
    gone = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    has_word = lambda line: F.translate(line, SPACE_CHARS, "") != ""
    last = F.col("n_words") - (WINDOW - 1)
    none = F.array().cast("array<bigint>")
    counted = (
        docs.select("doc_id", text.alias("t"), words(F.col("text")).alias("w"), F.filter(F.split(text, "\n"), has_word).alias("lines"))
        .withColumn("n_words", F.size("w").cast("long"))
        .withColumn("h", F.when(last < 1, none).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1)).cast("int")), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))))
        .select(
            "doc_id", "n_words", F.length(F.translate("t", SPACE_CHARS, "")).cast("long").alias("word_chars"), gone(SYMBOLS).cast("long").alias("n_symbols"),
            F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            gone(MARKS).alias("n_marks"), gone("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"), gone("abcdefghijklmnopqrstuvwxyz").alias("lower"),
            F.size(F.array_distinct("w")).alias("n_distinct"),
            F.when(F.size(F.array_distinct("h")) == F.size("h"), none).otherwise(F.col("h")).alias("h"),
        )
    )
    place = F.arrays_zip(F.col("h").alias("h"), F.sequence(F.lit(1), F.greatest(F.size("h"), F.lit(1))).alias("i"))
    marked = (
        counted.withColumn("s", F.when(F.size("h") == 0, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.array_sort(place)))
        .withColumn("n", F.size("s"))
        .withColumn("twice", F.when(F.col("n") < 2, F.array().cast("array<int>")).otherwise(
            F.array_sort(F.array_distinct(F.flatten(F.zip_with(
                F.slice("s", F.lit(1), F.col("n") - 1), F.slice("s", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))),
                lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))))))
        .withColumn("n_twice", F.size("twice"))
    )
    covered = F.aggregate(
        F.zip_with("twice", F.slice("twice", F.lit(2), F.greatest(F.col("n_twice"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda total, x: total + x,
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return (
        marked.withColumn("n_repeat_words", F.when(F.col("n_twice") == 0, F.lit(0)).otherwise(covered).cast("long"))
        .withColumn("letters", F.col("upper") + F.col("lower"))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "n_words").alias("symbol_share"),
            share("n_marks", "word_chars").alias("mark_share"),
            share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
            share("upper", "letters").alias("capital_share"), share("n_distinct", "n_words").alias("variety"),
        )
    )


def vote(measure: str, low: float, high: float, bad_below: float, bad_above: float) -> Column:
    x = F.col(measure)
    return F.when((x < bad_below) | (x > bad_above), -1).when((x >= low) & (x <= high), 1).otherwise(0)


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 40) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over vote patterns and their counts.

    Gives the share of good documents and for each rule how often it is right on a
    good and on a bad document, when it votes. ``PRIOR`` imagined votes start each.
    """
    good, accuracy = 0.8, [START] * n_rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        posts = [posterior(votes, good, accuracy) for votes, _ in patterns]
        good = min(0.98, max(0.05, sum(p * n for p, (_, n) in zip(posts, patterns, strict=True)) / total))
        fitted = []
        for j in range(n_rules):
            right, cast = [PRIOR * START[0], PRIOR * START[1]], [PRIOR, PRIOR]
            for p, (votes, n) in zip(posts, patterns, strict=True):
                if votes[j]:
                    for kind, share in enumerate((p, 1 - p)):
                        right[kind] += n * share * (votes[j] == (1, -1)[kind])
                        cast[kind] += n * share
            on_good = min(0.995, max(0.7, right[0] / cast[0]))
            on_bad = min(0.95, max(1.05 - on_good, right[1] / cast[1]))
            fitted.append((on_good, on_bad))
        accuracy = fitted
    return good, accuracy


def weights(accuracy: tuple[float, float]) -> tuple[float, float]:
    """What a good and a bad vote add to the log odds that the document is good."""
    on_good, on_bad = accuracy
    return math.log(on_good / (1 - on_bad)), math.log((1 - on_good) / on_bad)


def posterior(votes: tuple[int, ...], good: float, accuracy: list[tuple[float, float]]) -> float:
    logit = math.log(good / (1 - good)) + sum(weights(a)[v < 0] for v, a in zip(votes, accuracy, strict=True) if v)
    return 1 / (1 + math.exp(-logit))


def weak_supervision(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: its counts, votes, base_failed, quality (the posterior) and kept."""
    votes = [f"vote_{name}" for name, *_ in RULES]
    measured = materialize(signals(docs), "quality")
    voted = measured.select("*", *(vote(*rule).alias(v) for v, (_, *rule) in zip(votes, RULES, strict=True)))
    # At most 3 ** 8 rows come to the driver.
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*votes).count().collect()]
    good, accuracy = estimate(sorted(patterns), len(votes)) if patterns else (0.8, [START] * len(votes))
    logit = F.lit(math.log(good / (1 - good)))
    for v, (if_good, if_bad) in zip(votes, map(weights, accuracy), strict=True):
        logit = logit + F.when(F.col(v) > 0, F.lit(if_good)).when(F.col(v) < 0, F.lit(if_bad)).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-logit))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op6(spark, sf_dir: str) -> DataFrame:
    judged = weak_supervision(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
