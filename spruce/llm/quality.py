"""Quality classifier: a sparse rule ensemble.

1. Statistics of every whole text (shares of kinds of characters, lengths and
   repetition of words) are computed once, by numpy in an Arrow UDF.
2. Shallow trees are grown on the labelled rows (Spark ML random forest, no
   row sampling).  Each path from the root to a node is a rule: a conjunction of
   bounds on statistics.
3. Lasso logistic regression weighs the rules; most weights become zero.
4. The rules that are left are compiled to one Spark column expression, which scores all
   rows.

Trees and weights are fitted by distributed Spark jobs over all labelled rows;
only the trees' text and the weights come to the driver.  Rare labels weigh as much as
common ones in the trees; the lasso sees the labels as they are, so the score is a probability.

Defined results: null text is the empty text.  A label that is null or
neither 0 nor 1 is none.  A document with several labels has the smallest.
Without labels every score is 0.5; with one label only it is that label.  Rows equal in text get
equal scores, each row its own; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from functools import cache, reduce
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, cut, held_out

STATISTICS = [
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digit", "space", "newline", "point", "mark",
    "symbol", "other", "distinct_words", "repeated_words", "distinct_lines", "line_words", "long_words", "upper_words",
]
KINDS = ["upper", "lower", "digit", "space", "newline", "point", "mark", "symbol", "other"]


@cache
def _kind_of() -> np.ndarray:
    out = np.full(0x110000, KINDS.index("other"), dtype=np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch == "\n":
            kind = "newline"
        elif ch.isspace():
            kind = "space"
        elif ch.isalpha():
            kind = "upper" if ch.isupper() else "lower"
        elif ch.isdigit():
            kind = "digit"
        elif ch in ".,;:'\"()-":
            kind = "point"
        elif ch in "!?":
            kind = "mark"
        elif cp < 128:
            kind = "symbol"
        else:
            continue
        out[cp] = KINDS.index(kind)
    return out


def statistics(text: str | None) -> list[float]:
    text = text or ""
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    count = dict(zip(KINDS, np.bincount(_kind_of()[codes], minlength=len(KINDS)).tolist()))
    words = text.split()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = max(1, count["upper"] + count["lower"])
    lines = [x for x in text.split("\n") if x]
    w, chars = max(1, len(words)), max(1, n)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), lengths.sum() / w, float(np.log1p(lengths.max(initial=0))),
        count["upper"] / letters, count["digit"] / chars, count["space"] / chars, count["newline"] / chars,
        count["point"] / chars, count["mark"] / chars, count["symbol"] / chars, count["other"] / chars,
        len(set(words)) / w, sum(map(str.__eq__, words[1:], words[:-1])) / w,
        len(set(lines)) / max(1, len(lines)), float(np.log1p(len(words) / max(1, len(lines)))),
        float((lengths > 20).sum()) / w, sum(map(str.isupper, words)) / w,
    ]


def with_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with the statistics as an array of double."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.withColumn(out, stats(column(docs, text)))


Rule = tuple[tuple[int, str, float], ...]


def tree_paths(described: str) -> set[Rule]:
    """The rules of a forest, from Spark ML's description of its trees."""
    rules: set[Rule] = set()
    path: list[tuple[int, str, float]] = []
    for line in described.splitlines():
        if re.match(r"\s*Tree ", line):
            path = []
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        if m[2] == "If":
            path.append((int(m[3]), m[4], float(m[5])))
        else:  # the second branch: what followed the first one is over
            while path and not (path[-1][0] == int(m[3]) and path[-1][1] == "<=" and path[-1][2] == float(m[5])):
                path.pop()
            path[-1] = (int(m[3]), ">", float(m[5]))
        rules.add(tuple(sorted(path)))
    return rules


def tightest(rule: Rule) -> Rule:
    """One bound of each kind for each statistic."""
    held: dict[tuple[int, str], float] = {}
    for i, op, x in rule:
        held[i, op] = x if (i, op) not in held else (min if op == "<=" else max)(x, held[i, op])
    return tuple(sorted((i, op, x) for (i, op), x in held.items()))


class RuleEnsemble:
    """Rules with weights and an intercept; ``column`` compiles them."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float) -> None:
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @staticmethod
    def condition(stats: Column, rule: Rule) -> Column:
        return reduce(and_, [stats[i] <= F.lit(x) if op == "<=" else stats[i] > F.lit(x) for i, op, x in rule])

    def column(self, stats: Column) -> Column:
        """The score, 0 to 1."""
        parts = [F.when(self.condition(stats, r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights)]
        while len(parts) > 1:  # a balanced sum
            parts = [reduce(add, parts[i:i + 2]) for i in range(0, len(parts), 2)]
        z = reduce(add, parts, F.lit(float(self.intercept)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -z))))


def learn(rows: DataFrame, trees: int = 24, depth: int = 3, strength: float = 0.002, seed: int = 11) -> RuleEnsemble:
    """Fit on ``rows`` (stats array<double>, label double 0 or 1)."""
    rows = rows.select(array_to_vector("stats").alias("features"), "stats", F.col("label").cast("double").alias("label"))
    seen = {int(r["label"]): r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return RuleEnsemble([], [], 0.0 if not seen else (700.0 if 1 in seen else -700.0))
    n = sum(seen.values())
    weight = F.when(F.col("label") == 1, F.lit(n / (2 * seen[1]))).otherwise(F.lit(n / (2 * seen[0])))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, bootstrap=False, subsamplingRate=1.0, weightCol="w",
                                    featureSubsetStrategy="sqrt", minInstancesPerNode=2).fit(rows.withColumn("w", weight))
    rules = sorted({tightest(r) for r in tree_paths(forest.toDebugString)})
    if not rules:
        return RuleEnsemble([], [], float(np.log(seen[1] / seen[0])))
    hits = F.array(*[RuleEnsemble.condition(F.col("stats"), r).cast("double") for r in rules])
    lasso = LogisticRegression(regParam=strength, elasticNetParam=1.0, maxIter=100, standardization=False)
    fitted = lasso.fit(cut(rows.select(array_to_vector(hits).alias("features"), "label")))
    kept = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray()) if w]
    return RuleEnsemble([r for r, _ in kept], [w for _, w in kept], float(fitted.intercept))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality",
            threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; learned from the rows that are not held out."""
    rows = docs.select(column(docs, key).alias("doc_id"), column(docs, text).alias("text"))
    rows = cut(with_statistics(rows).select("doc_id", "stats", held_out(F.col("doc_id")).alias("held_out")))
    marks = labels.select(column(labels, key).alias("doc_id"), column(labels, label).cast("string").try_cast("double").alias("label"))
    marks = marks.where("label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    known = cut(rows.where(~F.col("held_out")).join(marks, "doc_id").select("stats", "label"))
    score = learn(known).column(F.col("stats"))
    return rows.withColumn("score", score).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
