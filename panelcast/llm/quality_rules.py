"""Quality classifier: a sparse rule ensemble.

1. Statistics of each whole text (lengths, shares of character classes,
   repetition), one vectorised pass.
2. A small forest (Spark ML) over labelled rows; every path from a root to a
   node is a conjunctive rule over the statistics.
3. A lasso-penalised logistic regression (Spark ML) over all rules keeps few of
   them with a weight.
4. The kept rules are compiled into one Spark column expression, so scoring
   needs no model object, only the statistics.

Learning takes the labelled rows that are not held out, at most about
``max_train`` of them by a hash of the id.  Labels, language, source and id are
never inputs of a score.

Edge cases: null text counts as empty and has all statistics 0, so it gets a
score like any other; null labels are left out; several labels of one id count
as their mean, rounded (a half is 1); without labels of both kinds the score is
the share (n1 + 1) / (n + 2) for every row; documents without a label are only
scored; a null id counts as not held out.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, claim, drop_staged, fresh, held_out, staged

MAX_TRAIN = 40_000
TREES = 24
DEPTH = 3
LASSO = 0.002
CUT = 0.3

STATS = ("chars", "words", "mean_word", "upper", "digit", "symbol", "bang", "pipe", "punct", "blank",
         "wide", "distinct_words", "top_word", "repeats", "lines", "distinct_lines", "words_per_line",
         "symbol_words", "upper_words", "long_words")

_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#$%&*@^~<>{}[]=+\\_", np.uint8)
_PUNCT = np.frombuffer(b".,;:?'\"()-", np.uint8)
_BLANK = np.array([9, 10, 11, 12, 13, 32])
_MARKS = tuple("#$%&*!|")


def text_stats(text: str | None) -> tuple[float, ...]:
    if not text:
        return (0.0,) * len(STATS)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(raw, minlength=256)
    n = len(raw)
    words = text.split()
    lines = text.split("\n")
    w = max(1, len(words))
    seen: dict[str, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    return (
        math.log1p(n), math.log1p(len(words)), (n - count[_BLANK].sum()) / w,
        count[_UPPER].sum() / n, count[_DIGIT].sum() / n, count[_SYMBOL].sum() / n,
        count[33] / n, count[124] / n, count[_PUNCT].sum() / n, count[_BLANK].sum() / n,
        count[128:].sum() / n, len(seen) / w, max(seen.values(), default=0) / w,
        sum(map(str.__eq__, words, words[1:])) / w,
        math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(w / len(lines)),
        sum(x.endswith(_MARKS) for x in words) / w, sum(map(str.isupper, words)) / w,
        sum(len(x) > 24 for x in words) / w)


def stats_function():
    """A vectorised function text -> struct of ``STATS``."""
    @F.pandas_udf(", ".join(f"{c} double" for c in STATS))
    def stats(texts: pd.Series) -> pd.DataFrame:
        claim("quality")
        return pd.DataFrame([text_stats(t) for t in texts], columns=list(STATS), dtype="float64")
    return stats


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row's whole text."""
    return docs.select("doc_id", "text").select("doc_id", stats_function()("text").alias("s")).select("doc_id", "s.*")


def _paths(node, limits: dict, out: set) -> None:
    if limits:
        out.add(tuple(sorted((f, *b) for f, b in limits.items())))
    if node.numDescendants() == 0:
        return
    split = node.split()
    f, t = split.featureIndex(), split.threshold()
    low, high = limits.get(f, (-math.inf, math.inf))
    _paths(node.leftChild(), {**limits, f: (low, min(high, t))}, out)
    _paths(node.rightChild(), {**limits, f: (max(low, t), high)}, out)


def tree_rules(model) -> list[tuple]:
    """All distinct path rules of a fitted forest, as tuples of
    (feature, low, high): low < value <= high for each."""
    out: set = set()
    for tree in model.trees:
        _paths(tree._java_obj.rootNode(), {}, out)
    return sorted(out)


def rule_column(rule: tuple, prefix: str = "") -> Column:
    """A rule as a Spark condition on the statistics."""
    parts = []
    for f, low, high in rule:
        c = F.col(prefix + STATS[f])
        if low > -math.inf:
            parts.append(c > low)
        if high < math.inf:
            parts.append(c <= high)
    return reduce(lambda a, b: a & b, parts)


class RuleModel:
    """Kept rules with weights; ``score`` is a plain column expression."""

    def __init__(self, bias: float, rules: list[tuple[tuple, float]]):
        self.bias, self.rules = bias, rules

    def score(self, prefix: str = "") -> Column:
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            z = z + F.when(rule_column(rule, prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def describe(self) -> list[str]:
        say = lambda f, a, b: " and ".join([f"{STATS[f]} > {a:.4g}"] * (a > -math.inf) + [f"{STATS[f]} <= {b:.4g}"] * (b < math.inf))
        return [f"{w:+.3f} if " + " and ".join(say(*c) for c in r) for r, w in self.rules]


def learn(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, trees: int = TREES,
          depth: int = DEPTH, lasso: float = LASSO, modulus: int = 5, rest: int = 0) -> RuleModel:
    """Fit on the labelled rows of ``stats`` (narrow: numbers only, no text)."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    marks = (labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & ~held_out(modulus, rest))
             .groupBy("doc_id").agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("double").alias("label")))
    marks = bounded_sample(marks, "doc_id", max_train)
    train = staged(stats.join(marks, "doc_id"), "quality-train")
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        p = (ones + 1) / (n + 2)
        return RuleModel(math.log(p / (1 - p)), [])
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=64,
                                    featureSubsetStrategy="0.4", bootstrap=False, minInstancesPerNode=5, seed=11)
    whole = VectorAssembler(inputCols=list(STATS), outputCol="x").transform(train)
    rules = tree_rules(forest.fit(whole))
    if not rules:
        p = (ones + 1) / (n + 2)
        return RuleModel(math.log(p / (1 - p)), [])
    flags = train.select("label", *[rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    fit = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso,
                             standardization=False, maxIter=60).fit(
        VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(flags).select("label", "x"))
    w = fit.coefficients.toArray()
    drop_staged(train)
    return RuleModel(float(fit.intercept), [(r, float(x)) for r, x in zip(rules, w) if abs(x) > 1e-6])


def classify(docs: DataFrame, labels: DataFrame, cut: float = CUT, modulus: int = 5, rest: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.  The texts are read
    once; the numbers are kept as a table in the shared folder."""
    stats = staged(with_stats(docs), "quality-stats")
    model = learn(stats, labels, modulus=modulus, rest=rest)
    return (stats.withColumn("score", model.score())
            .select("doc_id", held_out(modulus, rest).alias("held_out"), "score",
                    (F.col("score") >= cut).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is ``cut`` or more."""
    stats = staged(with_stats(docs), "quality-stats")
    model = learn(stats, labels)
    drop_staged(stats)
    s = fresh(docs, "quality_stats")
    return docs.withColumn(s, stats_function()("text")).where(model.score(f"{s}.") >= cut).drop(s)
