"""Quality rules whose thresholds carry a risk guarantee.

Each rule rejects a document when a metric exceeds a cutoff. Labelled good
documents are the holdout: for a stratum, rule and cutoff with k rejections
among n good documents, p = P(Binomial(n, risk) <= k) is an exact p-value for
"the cutoff rejects more than ``risk`` of good documents". Cutoffs of a rule
are tested from the most lenient on and testing stops at the first that is not
significant (fixed-sequence testing), at level ``delta`` divided by strata x
rules (Bonferroni); ``risk`` itself is divided by the number of rules. So with
probability 1 - delta, in every stratum all rules together reject at most
``risk`` of the good documents that pass the base; what the base rejects is
fixed beforehand and not part of the guarantee. Among certified cutoffs the one with most bad less
``cost`` times good rejections is used. A stratum with too few labels to
certify anything rejects nothing beyond the base.

All of it is DataFrame expressions: repeated windows are found within the row
by sorting window hashes, and the binomial tail is a fold over 0..k.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, materialize, small, text_of

#: (rule, metric of the feature row, cutoffs from lenient to strict).
RULES = (
    ("symbols", "n_symbols / n_words", (2.0, 1.0, 0.6, 0.4, 0.3, 0.2, 0.1)),
    ("repeats", "n_repeat_words / n_words", (0.18, 0.15, 0.12, 0.1, 0.05)),
    ("dup_lines", "n_dup_lines / n_words", (0.2, 0.1, 0.05, 0.02)),
    ("long_words", "word_chars / n_words", (20.0, 15.0, 12.0, 10.0, 9.0)),
)
WINDOW = 5


def _repeat_words(words: Column) -> Column:
    """Words that lie in windows of five words found at least twice."""
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda j: F.least(F.lit(WINDOW), F.get(at, j) - F.get(at, j - 1)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda n, x: n + x)

    def twins(s: Column) -> Column:
        h = lambda j: F.get(s, j)["h"]
        twice = lambda j: F.coalesce(h(j) == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(h(j) == F.get(s, j + 1)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twice), lambda j: F.get(s, j)["i"]))

    def count(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(order, twins), covered))

    return let(words, lambda w: F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(let(windows(w), count)))


def features(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed for each row.

    A null or empty text has no words, so it fails the base. ``carry`` adds
    ``row``, the whole input row.
    """
    body = text_of()
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    cols = docs.select("doc_id", "lang", body.alias("body"), F.regexp_extract_all(body, F.lit(WORD), F.lit(0)).alias("words"), *row)
    filled = lambda b: F.filter(F.split(b, "\n", -1), lambda x: x.rlike(WORD))
    out = cols.select(
        "doc_id", "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("body", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(filled(F.col("body")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        *(["row"] if carry else []),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact up to rounding; 1 where k is over n * p."""
    step = math.log(p) - math.log1p(-p)
    start = F.struct(F.lit(0).cast("long").alias("i"), (n * math.log1p(-p)).cast("double").alias("term"), F.lit(0.0).alias("total"))

    def add(s: Column, _: Column) -> Column:
        return F.struct((s["i"] + 1).alias("i"), (s["term"] + F.log((n - s["i"]) / (s["i"] + 1)) + step).alias("term"), (s["total"] + F.exp(s["term"])).alias("total"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, add, lambda s: s["total"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(tail)


def cutoffs(feats: DataFrame, labels: DataFrame, rules: Sequence = RULES, risk: float = 0.05, delta: float = 0.05, cost: int = 20) -> DataFrame:
    """stratum (may be null), then a column per rule: the certified cutoff in use, or null.

    A document is good if all its labels have quality 1, bad if one has 0;
    labels without doc_id or quality, or without a document, count for
    nothing. Documents that fail the base are not in the holdout.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("good"))
    held = feats.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("l_id")).select(F.col("lang").alias("stratum"), F.col("good") == 1, *[F.expr(m).alias(f"m_{r}") for r, m, _ in rules]).toDF("stratum", "good", *[f"m_{r}" for r, _, _ in rules])
    is_good, tests = F.col("good"), []
    for r, _, grid in rules:
        for i, cut in enumerate(grid):
            tests += [F.count_if(is_good & (F.col(f"m_{r}") > cut)).alias(f"g_{r}_{i}"), F.count_if(~is_good & (F.col(f"m_{r}") > cut)).alias(f"b_{r}_{i}")]
    counts = held.groupBy("stratum").agg(F.count_if(is_good).alias("n"), *tests)
    level = delta / len(rules)
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(float(c)).alias("cut"), F.col(f"g_{r}_{i}").alias("g"), F.col(f"b_{r}_{i}").alias("b")) for r, _, grid in rules for i, c in enumerate(grid)])).alias("t")
    strata = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    t = counts.withColumn("strata", strata).select("stratum", "n", "strata", rows).select("stratum", "n", "strata", "t.*")
    t = t.withColumn("fails", (binomial_tail(F.col("g"), F.col("n"), risk / len(rules)) * F.col("strata") > level).cast("int"))
    t = t.withColumn("failed", F.max("fails").over(W.partitionBy("stratum", "rule").orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    # Most (bad - cost * good); the most lenient of equals. Nothing gained: no cutoff.
    best = F.max(F.when((F.col("failed") == 0) & (F.col("b") - cost * F.col("g") > 0), F.struct((F.col("b") - cost * F.col("g")).alias("gain"), (-F.col("i")).alias("i"), "cut")))["cut"]
    return t.groupBy("stratum").pivot("rule", [r for r, _, _ in rules]).agg(best)


def judge(feats: DataFrame, labels: DataFrame, rules: Sequence = RULES, **options) -> DataFrame:
    """``feats`` with kept: false if the base failed or a certified cutoff of its stratum is exceeded."""
    cuts = materialize(cutoffs(feats, labels, rules, **options).toDF("stratum", *[f"cut_{r}" for r, _, _ in rules]), "cutoffs")
    joined = feats.join(small(cuts), F.col("lang").eqNullSafe(F.col("stratum")), "left")
    over = F.lit(False)
    for r, metric, _ in rules:
        over = over | F.coalesce(F.expr(f"try_divide({metric.split(' / ')[0]}, {metric.split(' / ')[1]})") > F.col(f"cut_{r}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over).drop("stratum", *[f"cut_{r}" for r, _, _ in rules])


def quality_rules(docs: DataFrame, labels: DataFrame, carry: bool = False, **options) -> DataFrame:
    """features() with the verdict ``kept``; features are computed once and kept in the shared folder."""
    return judge(materialize(features(docs, carry), "features"), labels, **options)
