"""Document fingerprints by randomised edit embedding.

All texts are walked with the same random bits: at step j the walk emits the
present character and moves on if the bit of (j, character) is 1, else it
stays.  Texts with a small edit distance come into step again soon behind an
edit, so their emitted sequences have a small Hamming distance.

The emitted sequence (about two steps a character) is sampled at shared
places: level l has one place in each 2**l steps, and each place of level
l + 1 is one of two neighbours of level l, drawn by a shared bit.  A text uses
the level at which about 128 to 256 places are left, whatever its
length.  The symbol at a place is an 8-bit hash of the emitted character and the two
before it.  The likeness of two fingerprints is the share of equal symbols, at
the coarser level of the two; places that only the longer one has count as different.

Near duplicates are found by bands: every place of a fingerprint begins a band of
``run`` symbols, so the bands cover the whole text, and a stretch of the walk that two texts
share is enough.  The text is also walked from its end, as a change of length
shifts all that the walk emits behind it, but nothing before it.  Texts that agree in a
band and are near enough in length are verified by the edit distance of the whole texts.

A text is walked in stretches, so memory does not grow with its length
beyond the text itself.

Defined results: null text is the empty text; two empty texts have likeness
1, an empty and another one 0.  Rows with one id come in the order of
the texts' hashes; null ids come last.  A single document is its own next document.
An empty table gives an empty one.  Ids are whole numbers (others are cast to them, or end the job); columns other than
id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, connected_components, cut, partitions, small_table
from .sharding import MOST, part_of, splitters

PERIOD = 4096    # steps after which the walk's bits repeat
CLASSES = 16     # characters share the bits of their class
PLACES = 256     # most places of a fingerprint, about
STRETCH = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: well mixed bits of integers."""
    x = (np.asarray(x).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _walk() -> list[list]:
    """A list for each step (modulo PERIOD): entry c is the list of the step after a character of class c, the last its step."""
    bits = _mix(np.arange(PERIOD * CLASSES)).reshape(PERIOD, CLASSES) & np.uint64(1)
    states: list[list] = [[] for _ in range(PERIOD)]
    after = np.empty((PERIOD, CLASSES), dtype=np.int64)
    for c in range(CLASSES):
        moves = np.nonzero(bits[:, c])[0]
        nxt = moves[np.searchsorted(moves, np.arange(PERIOD)) % len(moves)]
        after[:, c] = (nxt + 1) % PERIOD
    for j in range(PERIOD):
        states[j] += [states[int(x)] for x in after[j]]
        states[j].append(j)
    return states


@cache
def _class_of() -> np.ndarray:
    return (_mix(np.arange(0x110000) + 7) % np.uint64(CLASSES)).astype(np.uint8)


def _places(level: int, first: int, count: int) -> np.ndarray:
    """Steps of the places first .. first + count - 1 of a level."""
    at = np.arange(first, first + count, dtype=np.int64)
    for i in range(level, 0, -1):
        at = 2 * at + (_mix(at * 64 + i) & np.uint64(1)).astype(np.int64)
    return at


def _level(n: int) -> int:
    level = 0
    while (2 * n) >> level > PLACES:
        level += 1
    return level


def embed(codes: np.ndarray, level: int) -> np.ndarray:
    """Symbols of a text (code points) at the places of a level that its walk reaches."""
    out, step, state, taken = [], 0, _walk()[0], 0
    step_of = itemgetter(CLASSES)
    for at in range(0, len(codes), STRETCH):
        part = codes[at:at + STRETCH]
        classes = _class_of()[part].tobytes()
        steps = np.fromiter(map(step_of, accumulate(classes, getitem, initial=state)), dtype=np.int64, count=len(part) + 1)
        moved = (steps[1:] - steps[:-1]) % PERIOD
        moved[moved == 0] = PERIOD
        ends = step + np.cumsum(moved)  # the step behind the last one at each character
        places = _places(level, taken, ((int(ends[-1]) - 1) >> level) + 1 - taken)
        places = places[places < ends[-1]]
        i = np.searchsorted(ends, places, side="right") + at
        grams = codes[i].astype(np.uint64)
        for back, shift in ((1, 21), (2, 42)):
            grams |= np.where(i >= back, codes[np.maximum(i - back, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0)) << np.uint64(shift)
        out.append((_mix(grams) & np.uint64(255)).astype(np.uint8))
        taken += len(places)
        step, state = int(ends[-1]), _walk()[int(steps[-1])]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def fingerprint(text: str | np.ndarray) -> tuple[int, np.ndarray]:
    """(level, symbols)."""
    codes = code_points(text) if isinstance(text, str) else text
    level = _level(len(codes))
    return level, embed(codes, level)


def as_text(fp: tuple[int, np.ndarray]) -> str:
    return f"{fp[0]:02x}{fp[1].tobytes().hex()}"


def from_text(fp: str) -> tuple[int, np.ndarray]:
    data = bytes.fromhex(fp)
    return data[0], np.frombuffer(data[1:], dtype=np.uint8)


def coarser(fp: tuple[int, np.ndarray], level: int) -> np.ndarray:
    """The symbols at a coarser level."""
    at, symbols = fp
    while at < level:
        at += 1
        b = np.arange((len(symbols) + 1) // 2, dtype=np.int64)
        of = 2 * b + (_mix(b * 64 + at) & np.uint64(1)).astype(np.int64)
        symbols = symbols[of[of < len(symbols)]]
    return symbols


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    level = max(a[0], b[0])
    x, y = coarser(a, level), coarser(b, level)
    if not len(x) and not len(y):
        return 1.0 if a[0] == b[0] else 0.0
    n = min(len(x), len(y))
    return float((x[:n] == y[:n]).sum()) / max(len(x), len(y))


def in_order(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows (part, more, doc_id, text), dealt by part and sorted; each part ends with the row that follows it (more is true)."""
    t = F.coalesce(column(docs, text), F.lit(""))
    k = column(docs, key).cast("long")
    rows = docs.select(k.alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("hash"),
                       F.coalesce(k, F.lit(MOST)).alias("k1"), k.isNull().alias("none"))
    keys = cut(rows.select("k1", F.col("hash").alias("k2"), (F.octet_length("text") + 1).cast("long").alias("size"), "none", "doc_id"))
    n = partitions(docs)
    bounds = splitters(keys, n, 0.05)
    rows = rows.withColumn("part", part_of(F.col("k1"), F.col("hash"), bounds))
    # the first key of each part: one row for each part comes to the driver
    first = {r["part"]: r["f"] for r in keys.groupBy(part_of(F.col("k1"), F.col("k2"), bounds).alias("part"))
             .agg(F.min(F.struct("k1", "none", "k2")).alias("f")).collect()}
    filled = sorted(first)
    before = dict(zip(filled, filled[-1:] + filled))  # the first document follows the last one

    firsts = small_table(docs, [(p, *first[p], before[p]) for p in filled], "part int, first_k1 long, first_none boolean, first_hash long, before int")
    rows = rows.join(firsts, "part")
    same = (F.col("k1") == F.col("first_k1")) & (F.col("none") == F.col("first_none")) & (F.col("hash") == F.col("first_hash"))
    to = F.when(same, F.col("before"))
    copies = [F.struct("part", F.lit(False).alias("more")),
              F.when(to.isNotNull(), F.struct(to.alias("part"), F.lit(True).alias("more")))]
    rows = rows.withColumn("to", F.explode(F.filter(F.array(*copies), lambda x: x.isNotNull())))
    rows = rows.select("to.part", "to.more", "none", "doc_id", "hash", "text")
    return rows.repartition(n, "part").sortWithinPartitions("part", "more", "none", "doc_id", "hash")


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each document's fingerprint, that of its text with the second half replaced by the start of the next
    document, and the likeness to that one and to the next document's."""

    def compare(batches):
        held = None  # part, doc_id, code points, fingerprint of the row before
        done_more = None
        for batch in batches:
            out: list[tuple] = []
            for part, more, doc_id, t in zip(*(batch.column(c).to_pylist() for c in ("part", "more", "doc_id", "text"))):
                if more and done_more == part:  # a repeated row with the first key of the next part
                    continue
                codes = code_points(t)
                fp = fingerprint(codes)
                if held is not None and held[0] == part:
                    _, id_, own, own_fp = held
                    half = len(own) // 2
                    edited = np.concatenate([own[: len(own) - half], codes[:half]])
                    efp = fingerprint(edited)
                    sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))
                    out.append((id_, len(own), sha.hexdigest(), as_text(own_fp), as_text(efp),
                                likeness(own_fp, efp), likeness(own_fp, fp)))
                held = None if more else (part, doc_id, codes, fp)
                done_more = part if more else None
            names = [x.split()[0] for x in EDITED.split(", ")]
            kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
            cols = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[x.split()[1]]) for c, x in zip(cols, EDITED.split(", "))], names)

    return in_order(docs, text, key).mapInArrow(compare, EDITED)


def bands_of(codes: np.ndarray, least: float, run: int) -> list[int]:
    """Keys of a text's bands, 64-bit integers: ``run`` symbols from each place of both walks, at the text's own level
    and those of texts up to 1 / ``least`` as long."""
    found = []
    for way, text in enumerate((codes, codes[::-1])):
        fp = fingerprint(text)
        for level in range(fp[0], fp[0] + 1 + math.ceil(math.log2(1 / least))):
            symbols = coarser(fp, level).astype(np.uint64)
            apart = max(1, 4 >> level)  # neighbouring places of low levels show the same characters
            n = len(symbols) - (run - 1) * apart
            if n <= 0:  # too short for a band: one key of what is there
                found.append(hash_of(way, level, -1, np.zeros(1, dtype=np.uint64)))
                continue
            key = np.zeros(n, dtype=np.uint64)
            for j in range(run):
                key = _mix(key ^ symbols[j * apart:j * apart + n])
            found.append(hash_of(way, level, np.arange(n), key))
    return np.unique(np.concatenate(found)).tolist()


def hash_of(way: int, level: int, place: np.ndarray | int, key: np.ndarray) -> np.ndarray:
    at = (np.atleast_1d(place) * 64 + level) * 2 + way
    return _mix(key ^ _mix(at.astype(np.int64))).view(np.int64)


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.8, run: int = 3,
                block: int = 512) -> DataFrame:
    """(doc_id, class_id, n_links): class_id is the smallest id whose text is connected by links of near texts.

    A link joins two different texts that agree in a band and have an edit distance of at most (1 - ``least``) of
    the longer text.  Equal texts are one point.  n_links counts the links of the row's text.
    Near texts whose edits leave no ``run`` symbols in a row at the same places of either walk are not found
    (README: recall by kind of edit).
    """
    t = F.coalesce(column(docs, text), F.lit(""))
    rows = docs.select(column(docs, key).alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("hash"))

    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([bands_of(code_points(x), least, run) for x in texts])

    points = rows.dropDuplicates(["hash"]).select("hash", F.length("text").alias("size"), F.explode(keys("text")).alias("band"))
    entries = cut(points)
    crowd = entries.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    entries = entries.join(crowd, "band")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    entries = entries.withColumns({"nb": blocks, "own": F.pmod(F.xxhash64("hash", "band"), blocks).cast("int")})
    dealt = entries.withColumn("o", F.explode(F.expr("sequence(0, nb - 1)")))
    sets = dealt.groupBy("band", F.least("own", "o").alias("x"), F.greatest("own", "o").alias("y")).agg(
        F.collect_list(F.struct("hash", "size")).alias("members")).where(F.size("members") > 1).select("members")

    def pairs(batches):
        for batch in batches:
            out = []
            for members in batch["members"]:
                known = sorted({(m["hash"], m["size"]) for m in members})
                ids, sizes = (np.array(x, dtype=np.int64) for x in zip(*known))
                for i in range(1, len(known)):  # the edit distance is at least the difference in length
                    near = np.abs(sizes[:i] - sizes[i]) <= np.floor((1 - least) * np.maximum(sizes[:i], sizes[i]) + 1e-9)
                    out += [(known[i][0], x) for x in ids[:i][near].tolist()]
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    found = cut(sets.mapInPandas(pairs, "a long, b long").distinct())
    texts = rows.dropDuplicates(["hash"]).select("hash", "text")
    both = found.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    allowed = F.floor(F.lit(1 - least) * F.greatest(F.length("ta"), F.length("tb")) + F.lit(1e-9)).cast("int")
    both = both.withColumn("allowed", allowed)  # the distance is -1 where it is larger
    links = cut(both.where("levenshtein(ta, tb, allowed) >= 0").select("a", "b"))
    roots = connected_components(links)
    of = rows.groupBy("hash").agg(F.min("doc_id").alias("first")).join(
        roots.withColumnRenamed("node", "hash"), "hash", "left").withColumn("root", F.coalesce("root", "hash"))
    ids = of.groupBy("root").agg(F.min("first").alias("class_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    return rows.select("doc_id", "hash").join(of.join(ids, "root").select("hash", "class_id"), "hash").join(
        degree, "hash", "left").select("doc_id", "class_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
