"""Sharding by histogram sort.

Rows are ordered by (hash of the text, id), so rows with equal texts stand next to each
other.  Splitters that cut the order into parts of equal bytes are found by
counting: a pass counts the exact bytes, rows and smallest and largest key below each
of 256 probes in every key range that still holds a splitter (one map-side
combined aggregate over keys and sizes, without texts); running sums pick the range of each splitter, so one row for each comes to the driver.  A range that is light enough (``tolerance``
of a part) or holds one key alone gives its nearer end as the splitter; the others are probed
again, 8 bits of the key finer.  A splitter
falls inside a group of equal texts only where the group is heavier than the tolerance; then the id splits it.
Then the rows are exchanged once, by part.

A shard is a stretch of parts, so a shard is numbered by many tasks: a row's slot
is its place in its part plus the rows in the shard's parts before.

Defined results: size is UTF-8 bytes plus 1 (null text: 1).  A null id comes
before all others.  Rows that are equal in text and id cannot be split and
share a shard.  An empty table gives an empty table.  Input columns named size, shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut, partitions, small_table

STEP = 8
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def splitters(rows: DataFrame, parts: int, tolerance: float = 0.01) -> list[tuple[int, int]]:
    """``parts`` - 1 ascending keys (k1, k2); part i holds the keys from the i-th (1-based) on.

    ``rows`` has long columns k1, k2 (not null, ordered as signed numbers) and
    size.  Each pass returns one row for each splitter still sought.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    if parts < 2 or not total:
        return []
    flip = F.lit(LEAST)  # signed order becomes the order of the bits
    word = {0: F.col("k1").bitwiseXOR(flip), 1: F.col("k2").bitwiseXOR(flip)}
    allowed = tolerance * total / parts
    found: dict[int, int] = {}
    sought = {i: (0, 0) for i in range(1, parts)}  # splitter: prefix of the 128-bit key, bytes before it
    for level in range(16):
        of, shift = divmod(level * STEP, 64)
        # the prefix: one long for the first 64 bits, which joins hold compactly, and another one beyond; of no bits it is 0
        high = F.shiftrightunsigned(word[0], 64 - shift) if of == 0 and shift else (word[0].bitwiseAND(F.lit(0).cast("long")) if of == 0 else word[0])
        low = F.shiftrightunsigned(word[1], 64 - shift) if of and shift else F.lit(0).cast("long")
        prefix_columns = ["high", "low"] if of and shift else ["high"]
        probe = F.shiftrightunsigned(word[of], 64 - shift - STEP).bitwiseAND(F.lit((1 << STEP) - 1))

        def halves(prefix):
            return (_signed(prefix >> shift), prefix & ((1 << shift) - 1)) if of and shift else (_signed(prefix), 0)

        wanted = small_table(rows, [(i, *halves(p), b, total * i / parts) for i, (p, b) in sought.items()],
                             "i int, high long, low long, before long, goal double")
        keyed = rows.select(high.alias("high"), low.alias("low"), probe.alias("probe"), "k1", "k2", "size")
        if level:
            known = sorted({halves(p) for p, _ in sought.values()})
            keyed = keyed.join(small_table(rows, known, "high long, low long").select(*prefix_columns), prefix_columns, "left_semi")
        one = (F.min("k1") == F.max("k1")) & (F.min("k2") == F.max("k2"))
        counted = keyed.groupBy(*prefix_columns, "probe").agg(F.sum("size").alias("bytes"), one.alias("one"))
        upto = F.sum("bytes").over(Window.partitionBy(*prefix_columns).orderBy("probe"))  # 256 rows at most
        held = counted.withColumn("upto", upto).join(wanted.drop("low") if len(prefix_columns) == 1 else wanted, prefix_columns).where(
            "before + upto >= goal AND before + upto - bytes < goal")
        at = {r["i"]: r for r in held.collect()}
        left = {}
        for i, (prefix, before) in sought.items():
            if i not in at:  # rounding put the goal at the very end
                found[i] = (1 << 128) - 1
                continue
            r, goal = at[i], total * i / parts
            before, size = before + r["upto"] - r["bytes"], r["bytes"]
            here = prefix << STEP | r["probe"]
            if size <= allowed or r["one"] or level == 15:
                rest = 128 - STEP * (level + 1)
                up = goal - before > before + size - goal and here + 1 < 1 << 128 - rest
                found[i] = (here + up) << rest
            else:
                left[i] = (here, before)
        sought = left
        if not sought:
            break
    keys = [found[i] for i in range(1, parts)]
    return [((k >> 64) + LEAST, (k & ((1 << 64) - 1)) + LEAST) for k in keys]


def part_of(k1: Column, k2: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending ``bounds`` are at or below the key, by binary search in two constant arrays; the number of
    expressions does not grow with that of the bounds."""
    n = len(bounds)
    b1, b2 = (F.split(F.lit(",".join(str(b[i]) for b in bounds)), ",").cast("array<bigint>") for i in (0, 1))

    def step(low, size):
        at = low + size
        i = F.least(at, F.lit(n)) - 1
        below = (F.get(b1, i) < k1) | ((F.get(b1, i) == k1) & (F.get(b2, i) <= k2))
        return F.when((at <= n) & below, at).otherwise(low)

    sizes = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    return F.aggregate(sizes, F.lit(0), step) if n else F.lit(0)


def sharded(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id", tolerance: float = 0.01) -> DataFrame:
    """``docs`` (all columns) with size, shard and slot; integer ids."""
    t = F.coalesce(column(docs, text), F.lit(""))
    size = F.octet_length(t).cast("long") + 1
    k1, k2 = F.xxhash64(t), F.coalesce(column(docs, key).cast("long"), F.lit(LEAST))
    keys = cut(docs.select(k1.alias("k1"), k2.alias("k2"), size.alias("size")))
    per_shard = -(-partitions(docs) // shards)
    bounds = splitters(keys, shards * per_shard, tolerance)
    # rows of the parts: one row for each part comes to the driver
    counts = {r["part"]: r["n"] for r in keys.groupBy(part_of(F.col("k1"), F.col("k2"), bounds).alias("part"))
              .agg(F.count("*").alias("n")).collect()}
    offsets, at = [], 0
    for p in range(shards * per_shard):
        at = 0 if p % per_shard == 0 else at
        offsets.append(at)
        at += counts.get(p, 0)
    kept = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    rows = docs.select(*[column(docs, c) for c in kept], size.alias("size"), k1.alias("__k1"), k2.alias("__k2"),
                       part_of(k1, k2, bounds).alias("__part"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__k1", "__k2")).cast("long") - 1
    before = F.col("__before")
    rows = rows.join(small_table(docs, list(enumerate(offsets)), "__part int, __before long"), "__part")
    return rows.withColumns({"shard": F.floor(F.col("__part") / F.lit(per_shard)).cast("int"),
                             "slot": place + before}).drop("__k1", "__k2", "__part", "__before")
