"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def column(df: DataFrame, name: str) -> Column:
    """The column of that exact name (dots and blanks in names are plain text)."""
    return df["`" + name.replace("`", "``") + "`"]


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, into the shared ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 0 by 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node reachable.

    Alternating large-star and small-star rounds: each is a map-side combined
    minimum per node and one join on the node, so a node with very many links
    is split by AQE instead of being gathered.  Each round is cut into the
    checkpoint folder; the edges end as stars around the roots.
    """
    e = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    state = None
    for _ in range(max_rounds):
        # large star: every neighbour above the node is tied to the node's smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = big.where("u != v").distinct()
        # small star: every smaller neighbour, and the node, are tied to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = cut(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def small_table(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table from a few rows (one for each part of a table), to be broadcast in place of as many literals in the plan."""
    return F.broadcast(df.sparkSession.createDataFrame(list(rows), schema))
