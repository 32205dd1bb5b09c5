"""Operator 10: quality rules with risk-controlled thresholds, DataFrame functions only.

Base rules use fixed limits. Further limits are learned: for each stratum
(language) and rule, every cutoff of a fixed grid is tested on labelled rows.
Each rule may spend an equal part of the risk. With n good labelled rows of
which k would be rejected, the exact binomial tail P(X <= k | n, risk / rules)
must not exceed ``delta`` divided by the number of tests (Bonferroni over
strata, rules and cutoffs); the strictest cutoff that passes is used. So with
confidence 1 - delta the learned rules together reject at most ``risk`` of the
good rows of any stratum. A stratum without enough labels rejects nothing.

Defined cases: null text has no words; null ids and repeated rows give one
result row each; a label repeated for an id counts once, as bad if any copy is
bad; null strata are one stratum; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import durable

WINDOW = 5
SPACE = "[\\x20\\x09-\\x0D]+"
#: Rule -> (numerator, denominator) of a share that is high in poor text, in thousandths.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
}
#: Cutoffs in thousandths; a row is rejected by a rule if its share is above the cutoff.
GRID = (5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 700, 900)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeat_words(words: Column, k: int = WINDOW) -> Column:
    """Words that lie in a k-word window found at least twice.

    Windows are compared by 64-bit hash. The sort is only reached by texts
    whose hashes are not all different.
    """
    hashed = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(k)]))

    def count(h: Column) -> Column:
        # bound once through transform over a one-element array, so that the sorted windows are made once
        placed = F.array(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
        starts = F.get(
            F.transform(
                placed,
                lambda s: F.array_sort(
                    F.filter(
                        F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])),
                        lambda i: i.isNotNull(),
                    )
                ),
            ),
            0,
        )
        done = F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-k).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(k), i - acc["last"])).alias("n"), i.alias("last")),
        )
        return done["n"]

    bound = F.transform(F.array(hashed), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(count(h)))
    return F.when(F.size(words) <= k, F.lit(0)).otherwise(F.get(bound, 0)).cast("long")


def features(docs: DataFrame, *, stratum_col: str = "lang") -> DataFrame:
    """Per row the base counts and the further counts that the learned rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    had = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    had = had.withColumn("words", _words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0))
    return had.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
    )


def _share(rule: str) -> Column:
    """Share in thousandths, 0 for an empty denominator."""
    top, bottom = RULES[rule]
    return F.coalesce(F.try_divide(F.lit(1000) * F.col(top), F.col(bottom)), F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """Exact P(X <= k) for X ~ Binomial(n, p), term by term in logarithms; 1 where k is above the mean (no limit of interest is that high)."""
    odds = math.log(p / (1 - p))
    start = F.struct((n * math.log(1 - p)).alias("log"), F.exp(n * math.log(1 - p)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, lambda a, i: F.when(i > k, a).otherwise(step(a, i)))["sum"]
    return F.when(k > n * p, 1.0).otherwise(F.least(F.lit(1.0), summed))


def thresholds(found: DataFrame, labels: DataFrame, *, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Strictest safe cutoff per stratum and rule: one row per stratum, a column per rule (null: none is safe)."""
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    held = found.join(good.filter("quality = 1"), "doc_id")
    cuts = F.array(*[F.lit(float(c)) for c in GRID])
    long = held.select("stratum", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), _share(r).alias("share")) for r in RULES])).alias("x")).select("stratum", "x.rule", F.size(F.filter(cuts, lambda c: c < F.col("x.share"))).alias("above"))
    # above: how many cutoffs reject the row; the count rejected by cutoff j is the rows with above > j
    per = long.groupBy("stratum", "rule").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("above") > j).alias(f"k{j}") for j in range(len(GRID))])
    per = durable(per)  # a row per stratum and rule
    strata = per.withColumn("limit", F.lit(delta / max(1, per.count() * len(GRID))))
    safe = [F.when(binomial_tail(F.col(f"k{j}"), F.col("n"), risk / len(RULES)) <= F.col("limit"), F.lit(float(c))) for j, c in enumerate(GRID)]
    picked = strata.select("stratum", "rule", F.array_min(F.array(*safe)).alias("cut"))
    return picked.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"cut_{r}") for r in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame, *, stratum_col: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` per row; ``failed_rules`` names the learned rules that reject it."""
    found = durable(features(docs, stratum_col=stratum_col))
    cuts = thresholds(found, labels, risk=risk, delta=delta)
    base_failed = (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))
    rejects = F.filter(F.array(*[F.when(_share(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]), lambda r: r.isNotNull())
    out = found.join(cuts, "stratum", "left").withColumn("base_failed", base_failed).withColumn("failed_rules", F.array_join(rejects, ","))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")
