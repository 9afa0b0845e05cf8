"""Hard-negative mining over Hilbert-ordered Parquet blocks with zone maps.

For every anchor the positives are its best-scoring rows of the same label, and the hard negatives of a positive are the
best-scoring rows of other labels whose score lies in a window below the positive's score.  A score is the inner
product of whole-number vectors (each component is ``floor(scale * x)``), so every score is exact.

1. Rows are ordered along a Hilbert curve through all dimensions, and written to Parquet as blocks of ``block`` rows,
   each with the smallest and largest value of every dimension (its zone map), its labels and its smallest id.  Rows
   with equal vectors stand in the order of their ids, so a hot vector is many blocks.  Anchors are cut into chunks
   of ``chunk`` rows in the same way.
2. Interval arithmetic over the zone maps bounds the scores of a block from both sides: each component of the anchor
   meets the end of the block's interval that makes the product largest, or smallest.  Zone maps are read alone (the
   vectors are other columns), in groups, and meet each chunk of anchors in one matrix product.
3. A first round reads, for every window, the ``seeds`` blocks of each group of zone maps with the largest bounds.  The
   k-th best row found is a floor: the second round reads each block whose interval meets the window and whose upper bound
   reaches the floor (on ties only if its ids can come first), so no row that belongs to the answer is left out.
4. Steps 2 and 3 run once for the positives, whose window has no ends, and once for the windows of the negatives.

Chunks and blocks meet by joins on their numbers; what a task holds is a chunk and a block.  The chunks' side of the joins is
salted, so one chunk's blocks are spread over the tasks.  These are merge joins at every size: Spark takes an array for one
element, and a file's compressed size for its rows', so it would send the vectors of all blocks through the driver.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do
vectors whose length is not the most common one (the smaller on ties).  Of rows with one id, the one with the smallest
label, and then the smallest vector, counts.  Ties go to the smaller id.  An anchor without a row of its label has no
positive, and so no row; a positive with a negative score has an empty window.  Scores that do not fit 64 bits raise
ValueError.  Columns other than the three named are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, partitions
from .orcstore import remove, scratch_folder

LOW, HIGH = -(1 << 63), (1 << 63) - 1
BITS = 4  # of a dimension in the Hilbert key
FOUND = "anchor_id long, w int, id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of whole-number points (row, dimension) in a cube of side 2**bits, as bytes that sort along the curve."""
    x = cells.T.astype(np.uint32).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1)).astype(np.uint32)
            x[0] ^= np.where(high, q - 1, 0).astype(np.uint32)
            x[0] ^= swap
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint32)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[d - 1] & q, q - 1, 0).astype(np.uint32)
        q >>= 1
    x ^= flip
    planes = (x[None] >> np.arange(bits - 1, -1, -1)[:, None, None]) & 1  # the highest bit of every dimension first
    return np.packbits(planes.reshape(bits * d, -1).T.astype(np.uint8), axis=1)


def bounds(a: np.ndarray, mins: np.ndarray, maxs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, block) smallest and largest inner product of each anchor with any point of each box."""
    a, mins, maxs = (x.astype(np.result_type(x, np.int64)) for x in (a, mins, maxs))
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ mins.T + down @ maxs.T, up @ maxs.T + down @ mins.T


def best_of(s: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` largest allowed scores of each row, ties to the smaller id."""
    if s.shape[1] > 4 * k and ok.sum() > 8 * k * len(s):
        s = np.where(ok, s, s.min())
        ok = ok & (s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
    r, c = np.nonzero(ok)
    order = np.lexsort((ids[c], -s[r, c], r))
    r, c = r[order], c[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[first], c[first]


def usable(vectors: DataFrame, key: str, vector: str, label: str, scale: float) -> tuple[DataFrame, int, int]:
    """(id, label, q) of the rows that take part, their width and the largest |q|; see the module's defined results.  ``q`` has the
    smallest whole numbers that hold it, as rows of whole blocks and chunks are moved and kept in memory."""
    rows = vectors.select(column(vectors, key).cast("long").alias("id"), column(vectors, label).cast("long").alias("label"),
                          column(vectors, vector).cast("array<double>").alias("v"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) "
                      "AND abs(x) < double('infinity'))")
    far = F.expr("coalesce(array_max(transform(v, x -> abs(x))), 0D)")
    widths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(far).alias("far"))
    top = widths.orderBy(F.desc("n"), "d").first()
    if top is None:
        return rows.select("id", "label", F.expr("transform(v, x -> cast(x AS long))").alias("q")), 0, 0
    d, far = top["d"], abs(top["far"] * scale) + 1
    if far * far * max(1, d) * 100 >= 2.0 ** 63:
        raise ValueError("scores of these vectors do not fit 64 bits")
    kind = "short" if far < 2 ** 15 else "int" if far < 2 ** 31 else "long"
    q = F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast(kind))
    rows = rows.where(F.size("v") == d).select("id", "label", q.alias("q"))
    # ids that occur more than once are settled apart, so the vectors of the others are not grouped
    twice = cut(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    settled = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "q")).alias("r"))
    rows = rows.join(twice, "id", "left_anti").unionByName(settled.select("id", "r.label", "r.q"))
    return rows, d, int(far)


def write_blocks(rows: DataFrame, path: str, size: int, far: int) -> None:
    """Rows (id, label, q) along the Hilbert curve, as Parquet rows of up to ``size`` of them: number, n, ids, labels, q (one
    vector after the other), mins and maxs by dimension, the different labels, least id."""

    def keyed(batches):
        for b in batches:
            if len(b):
                q = np.stack(b["q"].to_numpy()).astype(np.int64)
                cells = ((q + far) * (1 << BITS)) // (2 * far + 1)
                keys = [k.tobytes() for k in hilbert_keys(cells)] if q.shape[1] else [b""] * len(b)
                yield b.assign(h=keys)

    def packed(batches):
        held, number, part = [], 0, 0

        def row(b, n):
            q = np.stack(b["q"].to_numpy())
            return pd.DataFrame([{
                "number": (part << 32) + n, "n": len(b), "ids": b["id"].to_numpy(), "labels": b["label"].to_numpy(), "q": q.ravel(),
                "mins": q.min(axis=0), "maxs": q.max(axis=0), "kinds": np.unique(b["label"]), "least": b["id"].min()}])

        for b in batches:
            if len(b):
                held, part = [pd.concat([*held, b], ignore_index=True)], int(b["part"].iloc[0])
                while len(held[0]) >= size:
                    yield row(held[0].iloc[:size], number)
                    held, number = [held[0].iloc[size:].reset_index(drop=True)], number + 1
        if held and len(held[0]):
            yield row(held[0], number)

    q = rows.schema["q"].dataType.simpleString()
    along = rows.mapInPandas(keyed, f"id long, label long, q {q}, h binary").repartitionByRange("h", "id")
    along = along.sortWithinPartitions("h", "id").select("id", "label", "q", F.spark_partition_id().alias("part"))
    blocks = along.mapInPandas(packed, f"number long, n int, ids array<long>, labels array<long>, q {q}, mins {q}, maxs {q}, "
                                       "kinds array<long>, least long")
    blocks.write.option("parquet.block.size", str(8 << 20)).mode("error").parquet(path)


def _search(blocks: DataFrame, chunks: DataFrame, d: int, n_chunks: int, n_blocks: int, windows: int, same: bool, k: int,
            exact: bool, seeds: int | None, group: int) -> DataFrame:
    """(anchor_id, w, id, score): the best ``k`` of every window among the blocks that are read; ``chunks`` has number, ids,
    labels, q, and for each anchor and window lo, hi, floor score and floor id."""
    kind = np.float64 if exact else np.int64  # products of these sizes are exact in doubles
    spread = partitions(blocks)
    groups, deals = -(-n_blocks // group), min(spread, n_chunks)
    zones = blocks.select(F.pmod(F.xxhash64("number"), F.lit(groups)).alias("g"), F.struct("number", "mins", "maxs", "kinds", "least").alias("z"))
    zones = zones.groupBy("g").agg(F.collect_list("z").alias("z")).select(  # about ``group`` zone maps
        "g", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.expr("transform(z, x -> x.number)").alias("numbers"),
        F.expr("flatten(transform(z, x -> x.mins))").alias("mins"), F.expr("flatten(transform(z, x -> x.maxs))").alias("maxs"),
        F.expr("transform(z, x -> x.kinds)").alias("kinds"), F.expr("transform(z, x -> x.least)").alias("leasts"))
    asking = chunks.withColumn("deal", F.pmod(F.xxhash64("number"), F.lit(deals)).cast("int")).withColumn(
        "g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def state(r):
        n = len(r["ids"])
        return (r["ids"], r["labels"], np.asarray(r["q"], dtype=np.int64).reshape(n, d).astype(kind),
                *[np.asarray(r[c], dtype=np.int64).reshape(n, windows) for c in ("lo", "hi", "floor", "floor_id")])

    def choose(batches):
        for b in batches:
            for r in b.to_dict("records"):
                _, labels, a, lo, hi, floor, floor_id = state(r)
                numbers = r["numbers"]
                mins, maxs = (np.asarray(r[c], dtype=np.int64).reshape(len(numbers), d).astype(kind) for c in ("mins", "maxs"))
                down, up = bounds(a, mins, maxs)
                sizes = np.array([len(x) for x in r["kinds"]])
                which, at = np.unique(np.concatenate(r["kinds"]), return_inverse=True)
                of = np.zeros((len(numbers), len(which)), dtype=bool)
                of[np.repeat(np.arange(len(numbers)), sizes), at] = True
                place = np.searchsorted(which, labels).clip(max=len(which) - 1)
                own = of[:, place].T & (which[place] == labels)[:, None]  # the block holds the anchor's label
                fits = own if same else ~(own & (sizes == 1)[None])
                need = np.zeros((len(a), windows, len(numbers)), dtype=bool)
                for w in range(windows):
                    meets = fits & (up >= lo[:, w, None]) & (down <= hi[:, w, None])
                    if seeds is None:
                        f = floor[:, w, None]
                        meets &= (up > f) | ((up == f) & (np.asarray(r["leasts"])[None] <= floor_id[:, w, None]))
                    elif len(numbers) > seeds:
                        score = np.where(meets, up, -np.inf if exact else LOW)
                        meets &= score >= np.partition(score, len(numbers) - seeds, axis=1)[:, len(numbers) - seeds, None]
                    need[:, w] = meets
                used = np.flatnonzero(need.any(axis=(0, 1)))
                yield pd.DataFrame({"chunk": [r["number"]] * len(used), "block": np.asarray(numbers)[used],
                                    "need": [np.packbits(need[:, :, z]).tobytes() for z in used]})

    pairs = asking.join(zones.hint("merge"), ["g", "deal"]).mapInPandas(choose, "chunk long, block long, need binary")
    salt = F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int").alias("salt")
    given = blocks.select(F.col("number").alias("block"), F.col("ids").alias("block_ids"), F.col("labels").alias("block_labels"),
                          F.col("q").alias("block_q"))
    pairs = pairs.join(given.hint("merge"), "block").select("*", salt)
    many = chunks.withColumnRenamed("number", "chunk").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))

    def scan(batches):
        for b in batches:
            for r in b.to_dict("records"):
                ids, labels, a, lo, hi, floor, floor_id = state(r)
                cid, clabel = r["block_ids"], r["block_labels"]
                c = np.asarray(r["block_q"], dtype=np.int64).reshape(len(cid), d).astype(kind)
                need = np.unpackbits(np.frombuffer(r["need"], dtype=np.uint8))[:len(ids) * windows].reshape(len(ids), windows).astype(bool)
                s = (a @ c.T).astype(np.int64)
                alike = labels[:, None] == clabel[None]
                fits = alike & (ids[:, None] != cid[None]) if same else ~alike
                for w in range(windows):
                    f = floor[:, w, None]
                    ok = fits & need[:, w, None] & (s >= lo[:, w, None]) & (s <= hi[:, w, None])
                    ok &= (s > f) | ((s == f) & (cid[None] <= floor_id[:, w, None]))
                    x, y = best_of(s, ok, cid, k)
                    if len(x):
                        yield pd.DataFrame({"anchor_id": ids[x], "w": w, "id": cid[y], "score": s[x, y]})

    found = pairs.join(many.hint("merge"), ["chunk", "salt"]).mapInPandas(scan, FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _chunks(anchors: DataFrame, state: DataFrame, windows: int) -> DataFrame:
    """Chunk rows: anchors (chunk, id, label, q) with their windows (anchor_id, w, lo, hi, floor, floor_id); where an anchor has no
    such window it is empty."""
    empty = f"struct(1L AS lo, 0L AS hi, {HIGH}L AS floor, 0L AS floor_id)"
    per = state.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(
        F.struct("w", F.struct("lo", "hi", "floor", "floor_id")))).alias("m"))  # ``windows`` entries
    rows = anchors.join(per.hint("merge"), anchors.id == per.anchor_id, "left").withColumn(
        "m", F.expr(f"transform(sequence(0, {windows - 1}), w -> coalesce(try_element_at(m, w), {empty}))"))
    rows = rows.groupBy("chunk").agg(F.collect_list(F.struct("id", "label", "q", "m")).alias("a"))
    flat = lambda c: F.expr(f"flatten(transform(a, x -> transform(x.m, y -> y.{c})))").alias(c)
    return rows.select(F.col("chunk").alias("number"), F.expr("transform(a, x -> x.id)").alias("ids"),
                       F.expr("transform(a, x -> x.label)").alias("labels"), F.expr("flatten(transform(a, x -> x.q))").alias("q"),
                       flat("lo"), flat("hi"), flat("floor"), flat("floor_id"))


def hard_negatives(vectors: DataFrame, is_anchor: Column | None = None, key: str = "vec_id", vector: str = "embedding",
                   label: str = "label", scale: float = 256.0, positives: int = 5, negatives: int = 5, least: int = 80,
                   most: int = 100, block: int = 512, chunk: int = 1024, seeds: int = 2, group: int = 1024) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors satisfy ``is_anchor``, a condition on the column ``id`` (all rows if None).  A negative's score is
    between ``least`` and ``most`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    rows, d, far = usable(vectors, key, vector, label, scale)
    if not far:
        return spark.createDataFrame([], RESULT)
    exact = far * far * max(1, d) < 2 ** 53
    path = scratch_folder(spark)
    write_blocks(rows, f"{path}/blocks", block, far)
    write_blocks(rows if is_anchor is None else rows.where(is_anchor), f"{path}/anchors", chunk, far)
    blocks, packed = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/anchors")
    n_blocks, n_chunks = blocks.count(), packed.count()
    if not n_chunks:
        remove(spark, path)
        return spark.createDataFrame([], RESULT)
    one = F.explode(F.expr(f"transform(ids, (x, i) -> struct(x AS id, labels[i] AS label, slice(q, i * {d} + 1, {d}) AS q))"))
    anchors = packed.select(F.col("number").alias("chunk"), one.alias("a")).select("chunk", "a.*")

    def search(windows: DataFrame, count: int, same: bool, k: int) -> DataFrame:
        run = lambda state, s: _search(blocks, cut(_chunks(anchors, state, count)), d, n_chunks, n_blocks, count, same, k, exact, s, group)
        none = [F.lit(LOW).alias("floor"), F.lit(HIGH).alias("floor_id")]
        first = run(windows.select("anchor_id", "w", "lo", "hi", *none), seeds)
        floors = first.where(F.col("rank") == k).select("anchor_id", "w", F.col("score").alias("floor"), F.col("id").alias("floor_id"))
        state = windows.join(cut(floors), ["anchor_id", "w"], "left").select(
            "anchor_id", "w", "lo", "hi", F.coalesce("floor", none[0]).alias("floor"), F.coalesce("floor_id", none[1]).alias("floor_id"))
        return cut(run(state, None))

    everything = anchors.select(F.col("id").alias("anchor_id"), F.lit(0).alias("w"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"))
    good = search(everything, 1, True, positives).select(
        "anchor_id", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    good = good.withColumns({  # the whole numbers of the window, rounded inwards
        "lo": F.expr(f"({int(least)} * positive_score + pmod(-{int(least)} * positive_score, 100)) div 100"),
        "hi": F.expr(f"({int(most)} * positive_score - pmod({int(most)} * positive_score, 100)) div 100")})
    bad = search(good.select("anchor_id", "w", "lo", "hi"), positives, False, negatives)
    done = bad.select("anchor_id", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    done = cut(done.join(good, ["anchor_id", "w"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    remove(spark, path)
    return done
