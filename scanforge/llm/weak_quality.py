"""Quality rules with weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (0) or abstains (null). Rows are counted by their pattern of
votes, at most 3 to the number of rules, and expectation-maximisation over the patterns
estimates each rule's accuracies without labels. A document is kept when its posterior
probability of being good is high enough, so no single rule decides alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanforge.llm.common import Workspace, as_own, own_columns

#: A line that ends as sentences do.
LINE_END = r"""[.!?:;…。！？"'”’)\]][\x20\x09-\x0D]*\z"""


def _doubled(name: str, half: int) -> Column:
    return F.transform(name, lambda x, i: F.xxhash64(x, F.get(name, i + half)))


def measures(texts: DataFrame) -> DataFrame:
    """``texts(own, text)`` with ``own`` and what the rules measure over the whole text.

    Words are maximal runs without ASCII white space; null text has none. ``n_repeat_words``
    counts words in 8-word windows that the text holds twice or more.
    """
    out = texts.select("own", F.coalesce("text", F.lit("")).alias("_text"))
    out = out.withColumn("_w", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    out = out.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    # Hashes of windows of 2, 4 and 8 words, each of two halves; the last 7 reach over the end.
    for half, name, before in ((1, "_h2", "_h"), (2, "_h4", "_h2"), (4, "_h8", "_h4")):
        out = out.withColumn(name, _doubled(before, half))
    out = out.withColumn("_g", F.slice("_h8", 1, F.greatest(F.size("_h8") - 7, F.lit(0))))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Windows in order of hash and place: equal neighbours are repeats.
    out = out.withColumn(
        "_s",
        F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    )

    def repeated(x, k):
        before = F.get("_s", k - 1).getField("h") == x.getField("h")
        after = F.get("_s", k + 1).getField("h") == x.getField("h")
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    out = out.withColumn("_at", F.array_sort(F.transform(F.filter("_s", repeated), lambda x: x.getField("i"))))
    covered = F.aggregate(
        F.transform("_at", lambda p, k: F.least(F.lit(8), F.coalesce(F.get("_at", k + 1), p + 8) - p)), F.lit(0).cast("bigint"), lambda a, x: a + x
    )
    n_words, n_lines = F.size("_w").cast("long"), F.size("_lines").cast("long")
    return out.select(
        "own",
        n_words.alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct_words"),
        F.length(F.regexp_replace("_text", r"[^0-9]+", "")).cast("long").alias("n_digits"),
        F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.size(F.filter("_lines", lambda x: x.rlike(LINE_END))).cast("long").alias("n_ended_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """The rules: 1 good, 0 bad, null abstains. Bounds are loose; between them a rule abstains.

    Each rule looks at another side of a text, as the model takes them to err independently.
    """

    def share(part: str, whole: str, good: float, bad: float) -> Column:
        x = F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))
        if good < bad:
            return F.when(x <= good, 1).when(x > bad, 0)
        return F.when(x >= good, 1).when(x < bad, 0)

    mean = F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double"))
    return {
        "symbols": share("n_symbols", "n_words", 0.05, 0.1),
        "repeats": share("n_repeat_words", "n_words", 0.02, 0.1),
        "dup_lines": F.when(F.col("n_lines") >= 4, share("n_dup_lines", "n_lines", 0.05, 0.2)),
        "word_length": F.when((mean >= 4.2) & (mean <= 6.5), 1).when((mean < 3) | (mean > 8), 0),
        "line_ends": share("n_ended_lines", "n_lines", 0.9, 0.6),
        "upper_case": share("n_upper", "word_chars", 0.1, 0.3),
        "digits": share("n_digits", "word_chars", 0.05, 0.1),
        "variety": F.when((F.col("n_words") >= 50) & (F.col("n_words") <= 2000), share("n_distinct_words", "n_words", 0.4, 0.25)),
    }


#: Before any row is seen: the share of good rows, P(good vote | good), P(bad vote | bad), and the rows that this counts for.
PRIOR, START, WEIGHT = 0.8, (0.97, 0.2), 2.0
ROUNDS = 100


def fit_accuracies(patterns: list[tuple[tuple, int]], rules: int, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """The share of good rows and each rule's P(good vote | good) and P(bad vote | bad).

    Expectation-maximisation of a two-class model in which rules vote independently and
    abstentions say nothing. It starts from rules that seldom vote against a good row and
    each find a fifth of the bad ones, which tells which class is the good one. Two rows of
    that kind in each class count with the rest in every round. A rule whose bad votes turn out rarer on bad rows than on good ones
    is held to equal rates; there are no other bounds, so such a rule, like one that votes at random, decides nothing.
    """
    prior, accuracy = PRIOR, [START] * rules
    for _ in range(rounds if patterns else 0):
        good_n, total = 0.0, 0.0
        sums = [[WEIGHT * START[0], WEIGHT, WEIGHT * START[1], WEIGHT] for _ in range(rules)]
        for pattern, n in patterns:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds(pattern, prior, accuracy)))))
            good_n, total = good_n + p * n, total + n
            for s, v in zip(sums, pattern, strict=True):
                if v is not None:
                    s[0] += p * n * v
                    s[1] += p * n
                    s[2] += (1 - p) * n * (1 - v)
                    s[3] += (1 - p) * n
        prior = (good_n + WEIGHT * PRIOR) / (total + WEIGHT)
        # A bad vote is at least as frequent on bad rows as on good ones, so it never speaks for a row.
        accuracy = [(s[0] / s[1], max(s[2] / s[3], 1 - s[0] / s[1])) for s in sums]
    return prior, accuracy


def log_odds(pattern: tuple, prior: float, accuracy: list[tuple[float, float]]) -> float:
    out = math.log(prior / (1 - prior))
    for v, (good, bad) in zip(pattern, accuracy, strict=True):
        if v == 1:
            out += math.log(good / (1 - bad))
        elif v == 0:
            out += math.log((1 - good) / bad)
    return out


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(df: DataFrame, text_col: str = "text", least: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``df`` (all) with the measures, ``base_failed``, ``p_good`` and ``kept``.

    A document that fails the base (under 20 words, or over 30 per cent of its words in
    repeated 8-word windows) is rejected and its votes are not counted; of the others those
    whose posterior probability of being good is ``least`` or more are kept. Null or empty text has
    no words and so fails the base. Each row is judged by itself, so repeated rows get equal
    results. Columns of ``df`` that carry the names of results are replaced; other names clash
    with nothing. On an empty table the start values stand.

    One pass measures the texts and writes what it found, with the columns to carry, to the
    shared folder. Only counts of vote patterns leave the executors: at most 3 ** 8 rows,
    however large the corpus is.
    """
    ws = Workspace(df.sparkSession, "quality")
    own = [c for c in carry or df.columns if c not in {*NAMES, "base_failed", "p_good", "kept"}]
    measured = ws.table(measures(df.select(as_own(df, own), F.col(f"`{text_col}`").alias("text"))), "measured")
    rules = votes()
    counted = measured.select(base_failed().alias("failed"), *(v.cast("int").alias(k) for k, v in rules.items())).groupBy("failed", *rules).count().collect()
    patterns = sorted(((tuple(r[k] for k in rules), r["count"]) for r in counted if not r["failed"]), key=str)
    prior, accuracy = fit_accuracies(patterns, len(rules))
    score = F.lit(math.log(prior / (1 - prior)))
    for v, (good, bad) in zip(rules.values(), accuracy, strict=True):
        score = score + F.when(v == 1, math.log(good / (1 - bad))).when(v == 0, math.log((1 - good) / bad)).otherwise(0.0)
    p = 1 / (1 + F.exp(-score))
    judged = measured.select("own", *NAMES, base_failed().alias("base_failed"), p.alias("p_good"))
    return judged.select(*own_columns(own), *NAMES, "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= least)).alias("kept"))
