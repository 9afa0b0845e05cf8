"""Mixing sources to target weights (DataFrame operations only).

The token share p of a source becomes the weight ``p ** t / sum(p ** t)``.
The exponent t in [0, 1] is found by bisection: the largest at which the
entropy of the weights is at least ``target_entropy`` times that of equal
weights, raised if needed to the smallest at which no source is repeated
more than ``max_repeats`` times (the repetition limit comes first).  One
aggregate over the sources' totals serves eight bisections.

``budget`` is the number of tokens to give out; without it, it is the
smallest with which every source is used whole at least once, so that
mixing repeats small sources and drops nothing.  The weights are realised as
block permutations: a source's rows are dealt to blocks of about
``block_rows`` by the hash of their id, and in each epoch the blocks and the rows in a
block stand in another order.  A row is given out as often as its place
begins below the source's budget.  The places come from running sums in a block
and over the blocks, so a source that holds a third of all rows is many
tasks, and only one row for each block goes to the sum over its blocks.

Result: the rows of ``docs`` (all columns) with epoch, tokens, start (place
in the source's order, in tokens), source_budget and mix_key (start through
source_budget; ordering by it interleaves the sources by weight all along).

Defined results: tokens of a row are UTF-8 bytes of the text plus 1 (null:
1), or ``tokens`` if given (below 1 counts as 1, null as 1).  Null is a
source of its own.  Rows with one id count each; equal rows take places next to each
other.  An empty table gives an empty table.  Input columns with the
names of the added columns are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut

STEPS = 24
STEPS_A_PASS = 8
#: Tables of at most so many rows of at most about 100 bytes are broadcast.
SMALL = 50_000
ADDED = ["epoch", "tokens", "start", "source_budget", "mix_key"]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _measures(shares: DataFrame, exponents: list[float], ratio: float | None) -> dict[float, tuple[float, float]]:
    """Entropy and largest repetition at each exponent; ``ratio``: budget through all tokens, None: cover."""
    e = shares.select("p", F.explode(F.array(*[F.lit(x) for x in exponents])).alias("t"))
    got = e.groupBy("t").agg(F.sum(F.expr("power(p, t)")).alias("z"), F.sum(F.expr("power(p, t) * ln(p)")).alias("a"),
                             F.min("p").alias("least"), F.max("p").alias("most"))
    out = {}
    for r in got.collect():  # one row for each exponent
        t, z = r["t"], r["z"]
        repeats = (r["most"] / r["least"]) ** (1 - t) if ratio is None else ratio * r["least"] ** (t - 1) / z
        out[t] = (math.log(z) - t * r["a"] / z, repeats)
    return out


def _bisect(shares: DataFrame, ratio: float | None, low_if) -> tuple[float, float]:
    """Bisect [0, 1]; ``low_if(measure)`` tells that the sought place is above."""
    lo, hi = 0.0, 1.0
    for _ in range(STEPS // STEPS_A_PASS):
        n = 1 << STEPS_A_PASS
        grid = _measures(shares, [lo + (hi - lo) * j / n for j in range(1, n)], ratio)
        at = sorted(grid)
        a, b = 0, n  # places in the grid; 0 is lo, n is hi
        while b - a > 1:
            m = (a + b) // 2
            a, b = (m, b) if low_if(grid[at[m - 1]]) else (a, m)
        lo, hi = (at[a - 1] if a else lo), (at[b - 1] if b < n else hi)
    return lo, hi


def exponent(shares: DataFrame, n_sources: int, target_entropy: float, max_repeats: float,
             ratio: float | None = None) -> float:
    """The exponent for sources with shares ``p``."""
    goal = target_entropy * math.log(n_sources)
    entropy, repeats = _measures(shares, [1.0], ratio)[1.0]
    if repeats > max_repeats * (1 + 1e-12):
        raise ValueError(f"the budget repeats the sources {repeats:.3f} times at least; max_repeats is {max_repeats}")
    t = 1.0 if entropy >= goal else _bisect(shares, ratio, lambda m: m[0] >= goal)[0]
    if _measures(shares, [t], ratio)[t][1] > max_repeats:
        t = _bisect(shares, ratio, lambda m: m[1] > max_repeats)[1]
    return t


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", tokens: str | None = None,
        target_entropy: float = 0.9, max_repeats: float = 4.0, budget: int | None = None,
        block_rows: int = 8192, seed: str = "mix") -> DataFrame:
    size = (F.greatest(F.lit(1), F.coalesce(column(docs, tokens).cast("long"), F.lit(1))) if tokens else
            F.octet_length(F.coalesce(column(docs, text), F.lit(""))).cast("long") + 1)
    src = column(docs, source).cast("string")
    tie = F.xxhash64(*[column(docs, c) for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])
    rows = docs.withColumns({
        "__tokens": size, "__source": F.when(src.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), src)),
        "__id": F.coalesce(column(docs, key).cast("string"), F.lit("")), "__tie": tie})
    totals = cut(rows.groupBy("__source").agg(F.sum("__tokens").alias("total"), F.count("*").alias("n")))
    n_sources, everything = totals.agg(F.count("*"), F.sum("total")).first()
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    if not n_sources:
        return docs.select(*[column(docs, c) for c in kept], F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("tokens"),
                           F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("source_budget"),
                           F.lit(0.0).alias("mix_key"))
    shares = totals.withColumn("p", F.col("total").cast("double") / F.lit(float(everything)))
    ratio = None if budget is None else budget / everything
    t = exponent(shares, n_sources, target_entropy, max_repeats, ratio)
    z, gap = shares.agg(F.sum(F.expr(f"power(p, {t!r}D)")), F.max(F.expr(f"power(p, 1D - {t!r}D)"))).first()
    give = float(everything) * z * gap if budget is None else float(budget)
    share_of = F.round(F.expr(f"power(p, {t!r}D)") / F.lit(z) * F.lit(give)).cast("long")
    plan = shares.select(
        "__source", F.col("total").alias("__total"), F.ceil(F.col("n") / F.lit(block_rows)).cast("long").alias("__blocks"),
        (F.greatest(F.col("total"), share_of) if budget is None else share_of).alias("__budget"))
    rows = rows.join(_small(plan, n_sources), "__source").where("__budget > 0")
    number = lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("__block", number(F.concat_ws(":", F.lit(seed), F.col("__id"))) % F.col("__blocks"))
    rows = rows.withColumn("__epoch", F.explode(F.expr("sequence(0, cast((__budget - 1) div __total as int))")))
    rows = rows.withColumn("__order", F.md5(F.concat_ws(":", F.lit(seed), F.col("__epoch"), F.col("__id")).cast("binary")))
    by = ["__source", "__epoch", "__block"]
    blocks = rows.groupBy(*by).agg(F.sum("__tokens").alias("block_tokens"))
    over = Window.partitionBy("__source", "__epoch").orderBy(
        F.md5(F.concat_ws(":", F.lit(seed), F.col("__epoch"), F.lit("block"), F.col("__block")).cast("binary")))
    before = F.sum("block_tokens").over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.withColumn("__before", before - F.col("block_tokens")).select(*by, "__before")
    inside = Window.partitionBy(*by).orderBy("__order", "__id", "__tie").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__in", F.sum("__tokens").over(inside) - F.col("__tokens")).join(blocks, by)
    rows = rows.withColumn("__start", F.col("__epoch") * F.col("__total") + F.col("__before") + F.col("__in"))
    rows = rows.where(F.col("__start") < F.col("__budget"))
    return rows.select(*[column(rows, c) for c in kept], F.col("__epoch").alias("epoch"),
                       F.col("__tokens").alias("tokens"), F.col("__start").alias("start"),
                       F.col("__budget").alias("source_budget"),
                       (F.col("__start").cast("double") / F.col("__budget").cast("double")).alias("mix_key"))
