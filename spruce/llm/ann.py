"""Nearest neighbours by largest inner product, with cross-polytope hashing.

Vectors are brought to the unit sphere by the usual extension for inner
products: a candidate is divided by the largest norm of its range and gets one more
component that fills it up to length 1, a query is divided by its own norm and
gets a zero; then the largest inner product is the smallest angle.  A range holds the norms
within a factor of ``2 ** (1 / RANGES)``, counted down from the largest, so a few long vectors do not push the others
to the added axis; queries probe every range, and one of at most ``whole`` vectors is one bucket that all probe.  Each table
turns the sphere by a pseudo-rotation (random signs and a fast Hadamard transform,
three times) and assigns a vector to the nearest of the signed axes, that
is its largest component by size, with the sign.  A query looks up
the ``probes`` axes it is closest to in each of the ``tables``, as many whatever the table's size: the share of the vectors that
a query meets and the recall on its neighbourhood do not hang on how many rows there are.

A query takes no candidate twice: in a bucket it meets only the vectors that
its earlier tables have not shown it.  A bucket is dealt to blocks of about ``block`` vectors, and the queries
that probe it to blocks of about ``asks``, so a task holds a block of each whatever the bucket's size; a query
is compared with each block in numpy, in double precision, and only its best
``k`` of the block go on; the best of all blocks are the answer.  A query that has found fewer than ``k`` (or than there
are) is compared with all vectors, in blocks too.  The comparison adds the products in
the order of the components, so equal vectors get equal scores.

Defined results: vectors that are null, zero, or hold a null or a component
that is not finite take no part, nor do those whose length is not the most
common one (the smaller on ties).  Rows with one id and equal vectors count once; with one
id and different vectors, each is a query and a candidate, and answers are
merged under the id.  Null ids take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut


RANGES = 2  # norm ranges from a norm to its double


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows, scaled to keep lengths; the width is a power of 2."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def rotated(unit: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """The pseudo-rotations of unit vectors, (table, row, axis); the width is padded to a power of 2."""
    n, d = unit.shape
    width = 1 << (d - 1).bit_length()
    padded = np.zeros((n, width))
    padded[:, :d] = unit
    out = np.empty((tables, n, width))
    for t in range(tables):
        rng = np.random.default_rng([seed, t, width])
        x = padded
        for _ in range(3):
            x = hadamard(x * rng.choice([-1.0, 1.0], size=width))
        out[t] = x
    return out


def axis_order(turned: np.ndarray, probes: int) -> np.ndarray:
    """Nearest signed axes of each row, nearest first: 2 * axis, plus 1 for the negative end."""
    both = np.stack([turned, -turned], axis=-1).reshape(*turned.shape[:-1], -1)
    probes = min(probes, both.shape[-1])
    top = np.argpartition(-both, probes - 1, axis=-1)[..., :probes]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, -1), axis=-1, kind="stable"), -1)


def probes_for(n: int) -> int:
    """A number of axes for a caller who knows that a table of ``n`` vectors is dense and takes fewer for a larger one (40 at 500 vectors,
    18 at 50,000, 4 at 500 million).  ``nearest`` does not use it: where near vectors do not grow nearer with the table, recall falls."""
    return max(2, min(40, round(40 * (500 / max(n, 1)) ** (1 / 6))))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with v an array of double, of the rows that take part."""
    rows = vectors.select(column(vectors, key).cast("long").alias("id"),
                          column(vectors, vector).cast("array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) "
                      "AND abs(x) < double('infinity')) AND exists(v, x -> x != 0)")
    return rows.dropDuplicates(["id", "v"])


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, added up in the order of the components (not by BLAS, whose order may vary by place)."""
    out = np.zeros((len(queries), len(candidates)))
    for j in range(queries.shape[1]):
        out += queries[:, j, None] * candidates[None, :, j]
    return out


def largest_of(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` largest of each row, largest first, ties to the smaller id; -inf is none."""
    near = s > -np.inf
    if s.shape[1] > k:
        near &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    r, c = np.nonzero(near)
    order = np.lexsort((ids[c], -s[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first]


def nearest(vectors: DataFrame, is_query: Column | None = None, key: str = "vec_id", vector: str = "embedding", k: int = 20,
            tables: int = 8, probes: int = 40, block: int = 2048, asks: int = 8192, seed: int = 7,
            whole: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best found for each id that satisfies ``is_query``, a condition on
    the column ``id`` (all ids if None).

    ``probes`` axes are looked up in each table.  Norm ranges of at most ``whole`` vectors (``block`` unless given) are one
    bucket; with 0 every range is hashed.
    """
    rows = cut(usable(vectors, key, vector))
    top = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if top is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = top["d"]
    rows = rows.where(F.size("v") == d)
    rows = rows.withColumn("norm", F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + x * x))"))
    common = (F.col("norm") > 0) & (F.col("norm") < F.lit(float("inf")))  # the sum of squares did not leave the doubles
    longest = rows.where(common).agg(F.max("norm")).first()[0] or 1.0
    down = F.floor((F.log2(F.lit(longest)) - F.log2("norm")) * F.lit(RANGES))
    rows = rows.withColumn("r", F.when(common, down).otherwise(-1).cast("int"))
    # a row for each range: a few thousand at most, as a double's exponents are bounded
    ranges = {r["r"]: r for r in rows.groupBy("r").agg(F.max("norm").alias("largest"), F.count("*").alias("n")).collect()}

    def unit(v: np.ndarray, query: bool, largest: np.ndarray | None = None) -> np.ndarray:
        v = v / (np.abs(v).max(axis=1, keepdims=True) if query else largest[:, None])
        square = (v * v).sum(axis=1, keepdims=True)
        if query:
            return np.hstack([v / np.sqrt(square), np.zeros_like(square)])
        return np.hstack([v, np.sqrt(np.maximum(0, 1 - square))])

    len_of = {r: x["n"] for r, x in ranges.items()}
    whole = block if whole is None else whole
    norm_of = {r: x["largest"] or 1.0 for r, x in ranges.items()}

    def index(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at:at + 512]
                axes = [[-1]] * len(part)  # of a small range
                hashed = [i for i, r in enumerate(part["r"]) if len_of[r] > whole]
                if hashed:
                    of = part.iloc[hashed]
                    turned = rotated(unit(np.stack(of["v"].to_numpy()), False, of["r"].map(norm_of).to_numpy()), tables, seed)
                    for i, x in zip(hashed, axis_order(turned, 1)[:, :, 0].T.tolist()):
                        axes[i] = x
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "r": part["r"], "axes": axes})

    def probe(batches):
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at:at + 512]
                axes = axis_order(rotated(unit(np.stack(part["v"].to_numpy()), True), tables, seed), probes)
                lists = axes.transpose(1, 0, 2).reshape(len(part), -1).astype(np.int32)
                yield pd.DataFrame({"id": part["id"], "v": part["v"], "probed": list(lists)})

    indexed = rows.mapInPandas(index, "id long, v array<double>, r int, axes array<int>")
    asked = rows if is_query is None else rows.where(is_query)
    asked = asked.select("id", "v").mapInPandas(probe, "id long, v array<double>, probed array<int>")
    asked = cut(asked)
    # a vector is in one bucket of each table of its range; buckets and those who probe them are dealt to blocks by the hash of the id
    entries = indexed.select("id", "v", "r", "axes", F.posexplode("axes").alias("t", "axis"))
    probed = F.posexplode(F.concat("probed", F.array(F.lit(-1)))).alias("at", "axis")  # -1: the small ranges
    wanted = asked.select("id", "v", "probed", F.expr(f"size(probed) div {tables}").alias("per"), probed)
    wanted = wanted.withColumn("t", F.expr("cast(if(axis < 0, 0, at div per) AS int)"))
    held = entries.groupBy("r", "t", "axis").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    sought = wanted.groupBy("t", "axis").agg(F.ceil(F.count("*") / F.lit(asks)).cast("int").alias("ask_blocks"))
    few = F.broadcast(cut(held.join(sought, ["t", "axis"])))  # 2 * width rows for each table of a range at most
    own = lambda n: F.pmod(F.xxhash64("id", "t"), n).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    entries = entries.join(few, ["r", "t", "axis"]).select(
        "r", "t", "axis", own("blocks").alias("block"), every("ask_blocks").alias("ask_block"), F.lit(False).alias("asks"),
        "id", "v", "axes")
    wanted = wanted.join(few, ["t", "axis"]).select(
        "r", "t", "axis", every("blocks").alias("block"), own("ask_blocks").alias("ask_block"), F.lit(True).alias("asks"),
        "id", "v", F.col("probed").alias("axes"))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(dtype=bool)
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                             "score": pd.Series(dtype="float64")})
        if asks.all() or not asks.any():
            return none
        q, c = group[asks], group[~asks].sort_values("id")
        t = int(group["t"].iloc[0])
        cid, cv = c["id"].to_numpy(), np.stack(c["v"].to_numpy())
        ids, firsts = np.unique(cid, return_index=True)
        caxes = np.stack(c["axes"].to_numpy()) if t else None
        out = []
        for at in range(0, len(q), 256):
            part = q.iloc[at:at + 256]
            qid = part["id"].to_numpy()
            s = scores(np.stack(part["v"].to_numpy()), cv)
            s[qid[:, None] == cid[None, :]] = -np.inf
            probed = np.stack(part["axes"].to_numpy()).reshape(len(part), tables, -1) if t else None
            for u in range(t):  # shown by an earlier table already
                hit = np.zeros((len(part), 2 * (1 << int(np.ceil(np.log2(d + 1)))) + 2), dtype=bool)
                np.put_along_axis(hit, probed[:, u, :], True, axis=1)
                s[hit[:, caxes[:, u]]] = -np.inf
            s = np.maximum.reduceat(s, firsts, axis=1)  # the best vector of each id
            r, c = largest_of(s, ids, k)
            out.append(pd.DataFrame({"query_id": qid[r], "vec_id": ids[c], "score": s[r, c]}))
        return pd.concat(out, ignore_index=True)

    def answers(groups: DataFrame) -> DataFrame:
        found = groups.groupBy("r", "t", "axis", "block", "ask_block").applyInPandas(
            best, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = cut(answers(entries.unionByName(wanted)))
    n = rows.agg(F.count_distinct("id")).first()[0]
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1))
    short = cut(asked.join(enough, asked.id == enough.query_id, "left_anti").select("id", "v"))
    n_short = short.count()
    if not n_short:
        return found
    # as one bucket that those queries probe; their vectors were not shown before
    blocks, ask_blocks = F.lit(-(-n // block)), F.lit(-(-n_short // asks))
    bucket = [F.lit(0).alias("r"), F.lit(0).alias("t"), F.lit(-1).alias("axis")]
    axes = F.lit(None).cast("array<int>").alias("axes")
    everyone = rows.select(*bucket, F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"),
                           F.explode(F.sequence(F.lit(0), ask_blocks - 1)).alias("ask_block"),
                           F.lit(False).alias("asks"), "id", "v", axes)
    again = short.select(*bucket, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"),
                         F.pmod(F.xxhash64("id"), ask_blocks).cast("int").alias("ask_block"),
                         F.lit(True).alias("asks"), "id", "v", axes)
    exact = answers(everyone.unionByName(again))
    return found.join(short, found.query_id == short.id, "left_anti").unionByName(exact)
