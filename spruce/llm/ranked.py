"""Ranked lexical search with K2-treaps over the term-document grid.

Documents are cut, where they lie, into shards of bounded size.  Each shard is a grid of its terms (rows, frequent ones
first) and its documents (columns, by their most frequent term and length); a cell holds the impact of the term in the document,

    impact = (10^9 tf) div (1000 tf + 20 m),     m = 50 + (50 n N) div L,

and a document's score for an item is the sum of ``w * impact`` over the item's terms (see :func:`weight`).  The grid is
stored as a compressed quadtree in Parquet: one bit for each quadrant of each node in breadth-first order (the child
of a set bit is found by counting the set bits before it), and for each node the largest impact of its cell, as the
difference to its parent's.

All items of a block descend a shard's tree together.  For a range of documents, each of an item's terms has a node: the
cell of that range on the term's row path.  The sum of ``w`` times the nodes' maxima bounds the score of every document
in the range from above.  Each round, every item opens its ``opened`` best ranges into halves; a range of one
document has the exact score.  Ranges below the item's k-th best score so far, over all shards the task has searched, are
never opened; ranges equal to it are, so that ties are settled by the id.  The results are exact.

The index holds all terms of all documents, and weights come in at the search, so it serves any items.  Items meet
shards in blocks, by a join on the block's number: broadcast if the items' measured size is at most ``broadcast_mb``,
salted by shard otherwise.  A tree has fewer than 2^31 nodes, as a shard's size is bounded.  Trees are written and moved compressed, a few
to a row group, and only the one that a task searches is whole in memory.

Defined results: null text has no terms.  Every row of the documents is a document; equal rows get ranks one after the other.
Ties go to the smaller id, null ids come last.  Rows of items with one id are one item with the terms of all; items
with a null id or without a term that occurs take no part.  Columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, partitions
from .orcstore import remove, scratch_folder

# What a term is, and the letters that are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BYTES_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # the same over lower-cased UTF-8
IN_TERM = bytes(BYTES_TERM.fullmatch(bytes([i]).lower()) is not None for i in range(256))
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
INDEX = ("shard long, ids array<long>, nones array<boolean>, terms array<string>, dfs array<int>, depth int, bits binary, "
         "maxima binary")  # bits and maxima packed
FOUND = "item_id long, doc_id long, none boolean, score long"


def weight(df: Column, n_docs: int) -> Column:
    """floor(1000 * ln((2N + 2) / (2 df + 1))), in doubles."""
    return F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n_docs + 2) / (2.0 * df.cast("double") + 1)))


# ---------------------------------------------------------------- the tree

def _spread(x: np.ndarray) -> np.ndarray:
    """Bits moved to the even places."""
    x = x.astype(np.uint64)
    for s, m in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(s))) & np.uint64(m)
    return x


def build_tree(rows: np.ndarray, cols: np.ndarray, impact: np.ndarray) -> tuple[int, bytes, bytes]:
    """(depth, bits, maxima) of a grid's cells; no cell is given twice."""
    depth = max(int(rows.max(initial=0)), int(cols.max(initial=0))).bit_length()
    code = (_spread(rows) << np.uint64(1)) | _spread(cols)
    order = np.argsort(code)
    code, top = code[order], impact[order].astype(np.int64)
    bits, drops = [], []
    for _ in range(depth):  # from the cells up to the root
        above = code >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
        parent = np.cumsum(np.concatenate(([False], above[1:] != above[:-1])))
        most = np.maximum.reduceat(top, starts)
        level = np.zeros(4 * len(starts), dtype=np.uint8)
        level[4 * parent + (code & np.uint64(3)).astype(np.int64)] = 1
        bits.append(level)
        drops.append(most[parent] - top)
        code, top = above[starts], most
    flat = np.concatenate(bits[::-1]) if bits else np.zeros(0, dtype=np.uint8)
    return depth, np.packbits(flat).tobytes(), np.concatenate([top, *drops[::-1]]).astype("<i4").tobytes()


class Tree:
    """A stored tree: children by counting bits, maxima by node; node -1 is an empty cell."""

    def __init__(self, depth: int, bits: bytes, maxima: bytes):
        self.depth = depth
        self.bytes = np.frombuffer(bits, dtype=np.uint8)
        self.before = np.zeros(len(self.bytes) + 1, dtype=np.int32)
        np.cumsum(POPCOUNT[self.bytes], out=self.before[1:])
        drops = np.frombuffer(maxima, dtype="<i4")
        flat = np.unpackbits(self.bytes).reshape(-1, 4) if len(self.bytes) else np.zeros((0, 4), dtype=np.uint8)
        children = flat.sum(axis=1, dtype=np.uint8)
        self.top = np.zeros(len(drops) + 1, dtype=np.int32)  # the last one, place -1, is an empty cell's
        self.top[0] = drops[0]
        first, last = 0, 1
        for _ in range(depth):  # a level's maxima from its parents'
            n = children[first:last]
            size = int(n.sum(dtype=np.int64))
            self.top[last:last + size] = np.repeat(self.top[first:last], n) - drops[last:last + size]
            first, last = last, last + size

    def child(self, node: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        at = 4 * np.maximum(node, 0).astype(np.int64) + quadrant
        byte, k = self.bytes[at >> 3].astype(np.int64), at & 7
        there = (node >= 0) & ((byte >> (7 - k)) & 1 == 1)
        return np.where(there, 1 + self.before[at >> 3] + POPCOUNT[byte >> (8 - k)], -1).astype(np.int32)


# ---------------------------------------------------------------- the index

def pack(data: bytes) -> bytes:
    """The length and the compressed bytes."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def cells(batches, *names: str):
    """Rows of Arrow batches, text in UTF-8; of few rows at a time there are Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            some = [b.column(n).slice(at, 256) for n in names]
            yield from zip(*[(x.cast(pa.binary()) if pa.types.is_string(x.type) else x).to_pylist() for x in some])


def term_count(data: bytes) -> int:
    """Terms of a text in UTF-8: the bytes of a term that stand at its start or behind a byte of none."""
    x = np.frombuffer(data.translate(IN_TERM), dtype=bool)
    return int(np.count_nonzero(x[1:] > x[:-1])) + int(x[:1].sum())


def corpus_counts(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(N, L): documents with a term, terms of all documents."""

    def count(batches):
        d = n = 0
        for t, in cells(batches, "text"):
            found = term_count(t)
            d, n = d + (found > 0), n + found
        yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int64()), "l": pa.array([n], pa.int64())})

    texts = docs.select(F.coalesce(column(docs, text), F.lit("")).alias("text"))
    row = texts.mapInArrow(count, "d long, l long").agg(F.sum("d").alias("d"), F.sum("l").alias("l")).first()
    return row["d"] or 0, row["l"] or 0


def write_index(docs: DataFrame, path: str, n_docs: int, n_terms: int, text: str = "text", key: str = "doc_id",
                shard_docs: int = 4096, shard_bytes: int = 8 << 20) -> None:
    """One Parquet row for each shard of ``docs``; a shard ends with the document that reaches either limit."""

    def shard(number, held, vocabulary):
        held.sort(key=lambda x: x[2:4])  # alike next to alike: tighter bounds
        cols = np.repeat(np.arange(len(held)), [len(x[4]) for x in held])
        rows, tf = (np.concatenate([x[i] for x in held]).astype(np.int64) for i in (4, 5))
        df = np.bincount(rows, minlength=len(vocabulary))
        order = np.argsort(-df, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        m = np.array([50 + (50 * x[3] * n_docs) // n_terms for x in held], dtype=np.int64)
        depth, bits, maxima = build_tree(place[rows], cols, (10 ** 9 * tf) // (1000 * tf + 20 * m[cols]))
        terms = [t.decode() for t in vocabulary]
        lists = {"ids": ([x[0] for x in held], pa.int64()), "nones": ([x[1] for x in held], pa.bool_()),
                 "terms": ([terms[i] for i in order], pa.string()), "dfs": (df[order].astype(np.int32), pa.int32())}
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([number], pa.int64()), **{n: pa.array([x], pa.list_(of)) for n, (x, of) in lists.items()},
            "depth": pa.array([depth], pa.int32()), "bits": pa.array([pack(bits)], pa.binary()), "maxima": pa.array([pack(maxima)], pa.binary())})

    def shards(batches):
        held, vocabulary, size, number = [], {}, 0, 0
        for i, none, part, data in cells(batches, "id", "none", "part", "text"):
            if tokens := BYTES_TERM.findall(data.lower()):
                counts = Counter(tokens)  # of a text only numbers stay
                rows = np.fromiter((vocabulary.setdefault(x, len(vocabulary)) for x in counts), np.int32, len(counts))
                held.append((i, none, counts.most_common(1)[0][0], len(tokens), rows, np.fromiter(counts.values(), np.int32, len(counts))))
                size += len(data)
                if len(held) >= shard_docs or size >= shard_bytes:
                    yield shard((part << 32) + number, held, vocabulary)
                    held, vocabulary, size, number = [], {}, 0, number + 1
        if held:
            yield shard((part << 32) + number, held, vocabulary)

    k = column(docs, key).cast("long")
    rows = docs.select(F.coalesce(k, F.lit(0)).alias("id"), k.isNull().alias("none"), F.spark_partition_id().alias("part"),
                       column(docs, text).alias("text")).where("text IS NOT NULL")
    # a writer measures what it holds every 100 rows, which would be all shards of a task in one page, and so in the memory of its readers
    checks = {f"parquet.{x}.size.row.check.{y}": "1" for x in ("block", "page") for y in ("min", "max")}
    rows.mapInArrow(shards, INDEX).write.options(compression="zstd", **{"parquet.block.size": str(4 << 20)}, **checks).mode("error").parquet(path)


# ---------------------------------------------------------------- the search

def descend(tree: Tree, rows: np.ndarray, weights: np.ndarray, best: tuple, ids: np.ndarray, nones: np.ndarray, k: int,
            opened: int) -> tuple:
    """The best ``k`` of each item after this shard.  ``rows`` and ``weights`` are (item, term), a row of -1 is no term; ``best`` holds
    flat arrays item, score, none and id, sorted by item and rank."""
    depth = tree.depth

    def ranked(item, score, none, doc):
        order = np.lexsort((doc, none, -score, item))
        item, score, none, doc = item[order], score[order], none[order], doc[order]
        at = np.arange(len(item)) - np.searchsorted(item, item)
        floor = np.ones(len(rows), dtype=np.int64)  # scores above 0 alone
        floor[item[at == k - 1]] = score[at == k - 1]
        keep = at < k
        return (item[keep], score[keep], none[keep], doc[keep]), floor

    def add(best, item, score, col):
        return ranked(np.concatenate([best[0], item]), np.concatenate([best[1], score]),
                      np.concatenate([best[2], nones[col]]), np.concatenate([best[3], ids[col]]))

    best, floor = ranked(*best)
    nodes = np.where(rows >= 0, 0, -1).astype(np.int32)
    bound = (weights * tree.top[nodes]).sum(axis=1)
    item = np.flatnonzero(bound >= floor)
    if depth == 0:  # one term in one document
        return add(best, item, bound[item], np.zeros(len(item), dtype=np.int64))[0]
    nodes, bound = nodes[item], bound[item]
    level, col = np.zeros(len(item), dtype=np.int64), np.zeros(len(item), dtype=np.int64)
    while len(item):
        order = np.lexsort((-bound, item))
        item, bound, level, col, nodes = item[order], bound[order], level[order], col[order], nodes[order]
        now = np.arange(len(item)) - np.searchsorted(item, item) < opened
        of, lev = item[now], level[now]
        high = (np.maximum(rows[of], 0) >> (depth - 1 - lev)[:, None]) & 1
        new = []
        for half in (0, 1):
            child = tree.child(nodes[now], 2 * high + half)
            new.append((of, (weights[of] * tree.top[child]).sum(axis=1), lev + 1, 2 * col[now] + half, child))
        new = [np.concatenate(x) for x in zip(*new)]
        whole = (new[2] == depth) & (new[1] >= floor[new[0]])
        if whole.any():
            best, floor = add(best, new[0][whole], new[1][whole], new[3][whole])
        rest = (new[2] < depth) & (new[1] >= floor[new[0]])
        old = ~now & (bound >= floor[item])
        item, bound, level, col, nodes = (np.concatenate([a[old], b[rest]]) for a, b in zip((item, bound, level, col, nodes), new))
    return best


def search(spark, path: str, items: DataFrame, n_docs: int, k: int = 50, text: str = "text", key: str = "item_id", block: int = 512,
           opened: int = 128, broadcast_mb: float = 16.0) -> DataFrame:
    """(item_id, rank, doc_id, score) over a written index."""
    index = spark.read.parquet(path)
    low = F.translate(column(items, text), UPPER, LOWER)
    wanted = items.select(column(items, key).cast("long").alias("item"), F.explode(F.array_distinct(
        F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))).alias("term")).where("item IS NOT NULL").distinct()
    wanted = cut(wanted)
    counts = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    counts = counts.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    per = cut(wanted.join(counts, "term").select("item", "term", weight(F.col("df"), n_docs).alias("w")).groupBy("item").agg(
        F.collect_list("term").alias("terms"), F.collect_list("w").alias("ws")))
    size = per.agg(F.count("*").alias("n"), F.sum(F.expr("aggregate(terms, 0L, (a, x) -> a + octet_length(x) + 24) + 24")).alias("b")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not size["n"]:
        return empty
    n_blocks = -(-size["n"] // block)
    blocks = per.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks)).cast("int")).groupBy("block").agg(
        F.collect_list(F.struct("item", "terms", "ws")).alias("x")).select(
        "block", F.expr("transform(x, y -> y.item)").alias("items"), F.expr("transform(x, y -> size(y.terms))").alias("sizes"),
        F.expr("flatten(transform(x, y -> y.terms))").alias("asked"), F.expr("flatten(transform(x, y -> y.ws))").alias("ws"))
    names = F.array_join("terms", " ").alias("terms")  # one value in place of as many as there are terms
    shards = index.select("shard", "ids", "nones", names, "depth", "bits", "maxima").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    if size["b"] <= broadcast_mb * 2 ** 20:
        pairs = shards.join(F.broadcast(blocks), "block")
    else:
        spread = partitions(items)
        salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        pairs = shards.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(spread)).cast("int")).join(salted, ["block", "salt"])

    def run(batches):
        best: dict[int, tuple] = {}
        names: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_dict("records"):
                sizes, asked = np.asarray(r["sizes"], dtype=np.int64), r["asked"]
                some = set(asked)
                row_of = {t: i for i, t in enumerate(r["terms"].split(" ")) if t in some}
                found = np.array([row_of.get(t, -1) for t in asked], dtype=np.int64)
                item = np.repeat(np.arange(len(sizes)), sizes)
                there = found >= 0
                item, found, w = item[there], found[there], np.asarray(r["ws"], dtype=np.int64)[there]
                at = np.arange(len(item)) - np.searchsorted(item, item)
                rows = np.full((len(sizes), int(at.max(initial=0)) + 1), -1, dtype=np.int64)
                weights = np.zeros(rows.shape, dtype=np.int64)
                rows[item, at], weights[item, at] = found, w
                none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64))
                n = r["block"]
                names[n] = np.asarray(r["items"])
                best[n] = descend(Tree(r["depth"], unpack(r["bits"]), unpack(r["maxima"])), rows, weights, best.get(n, none),
                                  np.asarray(r["ids"]), np.asarray(r["nones"], dtype=bool), k, opened)
        for n, (item, score, none, doc) in best.items():
            yield pd.DataFrame({"item_id": names[n][item], "doc_id": doc, "none": none, "score": score})

    found = pairs.mapInPandas(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "none", "doc_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("item_id", "rank", F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, text: str = "text", key: str = "doc_id", item_text: str = "text",
           item_key: str = "item_id", **sizes) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0; the index is built and removed."""
    spark = docs.sparkSession
    n_docs, n_terms = corpus_counts(docs, text)
    if not n_docs:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    path = scratch_folder(spark)
    write_index(docs, path, n_docs, n_terms, text, key, **sizes)
    found = cut(search(spark, path, items, n_docs, k, item_text, item_key))
    remove(spark, path)
    return found
