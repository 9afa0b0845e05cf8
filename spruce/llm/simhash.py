"""SimHash near-duplicates by segment bit counts.

Fingerprint of a text: A-Z is lowered, words are runs of bytes outside
blank and \\t..\\r, shingles are ``shingle`` words joined by one blank, repeats
included (fewer words: all of them as one shingle; none: fingerprint zero).
A bit of the 64-bit fingerprint is 1 if it is set in over half of the
shingles' XXH64 (seed 42).

Search for fingerprints at ``max_bits`` or fewer differing bits:

1. Equal fingerprints are one point from here on, so copies cost nothing.
2. A fingerprint is embedded as the bit counts of its 32 two-bit segments.
   The Manhattan distance of two embeddings is a lower bound of the bit
   distance.
3. The segments are dealt to ``max_bits + 3`` groups.  Two points within Manhattan
   distance ``max_bits`` have equal counts in at least three groups, so they share a
   cell in at least one of the grids that are spanned by three groups.  The
   range join is an equality join on grid cells, without false misses.
4. The points of a cell are compared in numpy, by Manhattan distance first
   and then by exact bit distance.  A cell passes on one link for each point to the
   smallest point it is connected with in the cell, never all pairs.  A crowded cell is
   dealt to blocks of at most about ``block`` points, and each pair of blocks is a task of
   its own.
5. Links are joined to components over the whole table.

Defined results: null text is the empty text.  A null id never becomes a
component's id unless all ids of the component are null.  Repeated rows and rows with
one id are all returned.  Of the input only the id and the text are used.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, connected_components, cut

SEED = 42
SEGMENTS = 32
EVEN = 0x5555555555555555
#: Shingles that are counted at once; bounds the memory for a very long text.
AT_ONCE = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1:]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), AT_ONCE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in
                           zip(starts[at:at + AT_ONCE].tolist(), ends[at:at + AT_ONCE].tolist())], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, fp(column(docs, text)))


def segment_counts(points: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each count in unary (00, 01 or 11) in the segment's place.

    In unary the bits that differ between two words are the Manhattan distance of the counts.
    """
    m, one = np.uint64(EVEN), np.uint64(1)
    return ((points | points >> one) & m) | ((points & points >> one) & m) << one


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of segment counts."""
    return np.bitwise_count(a ^ b)


def links(points: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """For each point that is connected with a smaller one: (point, smallest point connected with it)."""
    n = len(points)
    counts = segment_counts(points)
    near = manhattan(counts[:, None], counts[None, :]) <= max_bits
    at = np.nonzero(near)
    exact = np.bitwise_count(points[at[0]] ^ points[at[1]]) <= max_bits
    i, j = at[0][exact], at[1][exact]
    label = np.arange(n)
    while True:  # smallest label of the neighbours, then of the label's own label
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.nonzero(label != np.arange(n))[0]
    return list(zip(points[moved].tolist(), points[label[moved]].tolist()))


def grids(max_bits: int) -> list[list[int]]:
    """The segments of each grid."""
    k = max_bits + 3
    groups = [list(range(g, SEGMENTS, k)) for g in range(k)]
    return [sorted(sum(three, [])) for three in combinations(groups, 3)]


def cells(points: DataFrame, max_bits: int) -> DataFrame:
    """(grid cell, point): the cell is the number of the grid and the counts on its segments, as an exact key."""
    keys = []
    for g, segments in enumerate(grids(max_bits)):
        mask = sum(3 << 2 * i for i in segments)
        mask = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(g).alias("g"), F.col("__counts").bitwiseAND(F.lit(mask)).alias("c")))
    half = F.shiftrightunsigned("fp", 1)
    counts = F.col("fp").bitwiseOR(half).bitwiseAND(F.lit(EVEN)).bitwiseOR(
        F.shiftleft(F.col("fp").bitwiseAND(half).bitwiseAND(F.lit(EVEN)), 1))
    rows = points.withColumn("__counts", counts)
    return rows.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.g", "k.c", "fp")


def near_links(points: DataFrame, max_bits: int = 3, block: int = 1024) -> DataFrame:
    """Links (a, b) that connect what is at ``max_bits`` or fewer differing bits; ``points`` has distinct ``fp``."""
    rows = cells(points, max_bits)
    crowd = rows.groupBy("g", "c").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(crowd, ["g", "c"])
    n_blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp", "g"), n_blocks).cast("int")
    rows = rows.select("g", "c", "fp", n_blocks.alias("nb"), own.alias("own"))
    dealt = rows.select("g", "c", "fp", F.explode(F.expr("sequence(0, nb - 1)")).alias("o"), "own")
    sets = (dealt.groupBy("g", "c", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y"))
            .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps"))

    def find(batches):
        for batch in batches:
            out: list[tuple[int, int]] = []
            for fps in batch["fps"]:
                p = np.unique(np.asarray(fps, dtype=np.int64).view(np.uint64))
                if len(p) == 2:
                    if int(p[0] ^ p[1]).bit_count() <= max_bits:
                        out.append((int(p[1]), int(p[0])))
                else:
                    out += links(p, max_bits)
            a = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": a[:, 0], "b": a[:, 1]})

    return sets.mapInPandas(find, "a long, b long").distinct()


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 3,
               max_bits: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of ``docs``."""
    t = F.coalesce(column(docs, text), F.lit(""))
    rows = docs.select(column(docs, key).alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("text_hash"))
    rows = cut(with_fingerprint(rows, "t", shingle).select("doc_id", "text_hash", "fp"))
    points = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = cut(connected_components(near_links(points.select("fp"), max_bits)))
    named = points.join(roots, points.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(ids, "root").select("fp", "component_id", "root")
    return rows.join(of, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row."""
    return components(docs, **options).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the smallest hash of the text.

    Of rows that are equal in both, the one with the smallest hash of all its columns stays.  A null id stays only where
    a component has no other.
    """
    found = components(docs, text=text, key=key, **options)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    each = found.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    stay = each.groupBy("root").agg(F.min(F.struct(place.alias("p"), "n")).alias("s")).select(
        F.col("s.p.doc_id").alias("__id"), F.col("s.p.text_hash").alias("__hash"), F.col("s.n").alias("__n"))
    rows = docs.withColumns({"__k": column(docs, key),
                             "__h": F.xxhash64(F.coalesce(column(docs, text), F.lit("")))})
    kept = rows.join(stay, F.col("__k").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")))
    once = kept.where("__n = 1")
    # few: only rows that stand there more than once are ranked
    cells = F.xxhash64(*[x for c in docs.columns for x in (column(docs, c).isNull(), column(docs, c))
                         if not isinstance(docs.schema[c].dataType, T.MapType)])
    rank = F.row_number().over(Window.partitionBy("__k", "__h").orderBy("__all"))
    more = kept.where("__n > 1").withColumn("__all", cells).withColumn("__rank", rank).where("__rank = 1").drop("__all", "__rank")
    return once.unionByName(more).drop("__k", "__h", "__id", "__hash", "__n")
