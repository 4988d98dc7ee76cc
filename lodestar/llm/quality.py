"""Quality rules as weak supervision: votes, accuracies by expectation-maximisation, posterior filtering."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, words

#: Votes are 1 (good), -1 (bad) or 0 (abstains), in this order.
RULES = ("symbols", "repeats", "lines", "word_length", "variety", "ending")


def _windows(w: Column) -> Column:
    """The hash of each 3-word window, by position."""
    hashed = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))


def _low(w: Column) -> Column:
    """The power of two from which on bits are a window's hash; those below hold its position, in as few bits as the text needs."""
    bits = F.ceil(F.log2(F.greatest(F.size(w), F.lit(2)).cast("double"))).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits)


def _packed(hashes: Column, low: Column) -> Column:
    """Windows as one sorted array of longs, the high bits of the hash and the position; empty where all hashes differ, so that nothing can repeat."""
    packed = F.transform(hashes, lambda x, i: x.bitwiseAND(-low).bitwiseOR(i.cast("long")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def _repeated(w: Column, packed: Column, low: Column | None = None) -> Column:
    """Positions of the windows found twice or more, in order.

    ``packed`` is sorted, so windows of one hash are neighbours: those are candidates. Where neighbours of one
    hash always have the same words, each hash stands for one window and all candidates repeat. Else they are
    sorted by their words, which brings equal ones together whatever else shares their hash.
    """
    low = _low(w) if low is None else low
    alike = lambda x, y: x.bitwiseAND(-low) == y.bitwiseAND(-low)
    at = lambda x: x.bitwiseAND(low - 1).cast("int")
    same = lambda x, y: F.coalesce(x["words"] == y["words"], F.lit(False))

    def window(x: Column) -> Column:
        return F.struct(F.struct(F.get(w, at(x)).alias("a"), F.get(w, at(x) + 1).alias("b"), F.get(w, at(x) + 2).alias("c")).alias("words"), at(x).alias("at"))

    def differ(x: Column, y: Column) -> Column:
        return (F.get(w, at(x)) != F.get(w, at(y))) | (F.get(w, at(x) + 1) != F.get(w, at(y) + 1)) | (F.get(w, at(x) + 2) != F.get(w, at(y) + 2))

    # Arrays that are read more than once are bound by a lambda's argument.
    def by_words(maybe: Column) -> Column:
        found = F.transform(F.array(F.sort_array(F.transform(maybe, window))), lambda g: F.filter(g, lambda x, i: same(x, F.get(g, i - 1)) | same(x, F.get(g, i + 1))))
        return F.transform(F.flatten(found), lambda x: x["at"])

    def positions(maybe: Column) -> Column:
        clash = F.filter(maybe, lambda x, i: alike(x, F.get(maybe, i - 1)) & differ(x, F.get(maybe, i - 1)))
        return F.when(F.size(clash) == 0, F.transform(maybe, at)).otherwise(by_words(maybe))

    maybe = F.filter(packed, lambda x, i: alike(x, F.get(packed, i - 1)) | alike(x, F.get(packed, i + 1)))
    return F.when(F.size(packed) > 0, F.sort_array(F.flatten(F.transform(F.array(maybe), positions)))).otherwise(F.array().cast("array<int>"))


def base_columns(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` to ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` and what the rules vote on.

    All from functions of one row, so nothing is shuffled and a text of any length stays in its row.
    Null text counts as no words.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("w", words("text"))
    # ``h`` and ``p`` are read more than once, so Spark keeps them as columns rather than repeating what they stand for.
    d = d.withColumns({"h": _windows(F.col("w")), "low": _low(F.col("w"))})
    d = d.withColumn("p", _packed(F.col("h"), F.col("low")))
    d = d.withColumn("s", _repeated(F.col("w"), F.col("p"), F.col("low")))
    steps = F.aggregate(F.transform("s", lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get("s", i - 1)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    d = d.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), lines.alias("lines"), F.coalesce(steps, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.rtrim(F.col("text")).rlike(r"[.!?\"”»)…。！？]\s*$").alias("ends"),
    )
    d = d.select("*", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines")).drop("lines")
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def votes(features: DataFrame) -> DataFrame:
    """Adds ``votes``, one per rule of ``RULES``. The absence of a fault says little, so most rules then abstain rather than vote for a document."""
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    vote = lambda bad, good=F.lit(False): F.when(bad, -1).when(good, 1).otherwise(0)
    length = F.col("word_chars") / n
    return features.withColumn("votes", F.array(
        vote(F.col("n_symbols") * 10 > n, F.col("n_symbols") * 50 < n),
        vote(F.col("n_repeat_words") * 10 > 3 * n),
        vote(F.col("n_dup_lines") * 10 > 3 * lines),
        vote((length < 2.5) | (length > 14)),
        vote(F.col("n_distinct") < 2 * F.sqrt(n.cast("double"))),
        vote(~F.col("ends"), F.col("ends")),
    ))


def fit(patterns: Iterable[tuple[tuple[int, ...], int]], rounds: int = 50, prior: float = 0.8, accuracy: float = 0.8) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents, and per rule its accuracy on good and on bad ones, by expectation-maximisation.

    ``patterns`` are (votes, number of documents). Rules are taken as independent given quality; an
    abstention says nothing. Accuracies stay within 0.55 and 0.995, so a rule never turns round.
    """
    patterns = list(patterns)
    acc = [(accuracy, accuracy)] * len(RULES)
    for _ in range(rounds):
        good_total = 0.0
        right = [[1.0, 2.0, 1.0, 2.0] for _ in RULES]  # good: right, votes; bad: right, votes; one pseudo-count each
        for v, n in patterns:
            g = posterior(v, prior, acc) * n
            good_total += g
            for x, r in zip(v, right, strict=True):
                if x:
                    r[0] += g * (x > 0)
                    r[1] += g
                    r[2] += (n - g) * (x < 0)
                    r[3] += n - g
        total = sum(n for _, n in patterns)
        prior = min(max(good_total / total, 0.01), 0.99) if total else prior
        acc = [(min(max(a / b, 0.55), 0.995), min(max(c / d, 0.55), 0.995)) for a, b, c, d in right]
    return prior, acc


def weights(prior: float, acc: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of the prior, and what a good and a bad vote of each rule add to them."""
    return math.log(prior / (1 - prior)), [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in acc]


def posterior(v: tuple[int, ...], prior: float, acc: list[tuple[float, float]]) -> float:
    bias, w = weights(prior, acc)
    return 1 / (1 + math.exp(-bias - sum(up if x > 0 else down for x, (up, down) in zip(v, w, strict=True) if x)))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``documents`` to the base columns, ``base_failed``, ``quality`` (posterior probability) and ``kept``.

    Built-in functions only. What reaches the driver are the counts of the vote patterns, at most 3
    to the number of rules, however long the table. Rows are scored by a sum of log odds. Empty and
    null texts fail the base test; repeated rows fare alike; an empty table gives no rows.
    """
    features = materialize(votes(base_columns(docs)), "quality")
    counted = features.where("not base_failed").groupBy("votes").count().collect()
    bias, w = weights(*fit(sorted((tuple(r["votes"]), r["count"]) for r in counted)))
    odds = F.lit(bias)
    for i, (up, down) in enumerate(w):
        odds = odds + F.when(F.col("votes")[i] > 0, up).when(F.col("votes")[i] < 0, down).otherwise(0.0)
    out = features.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
