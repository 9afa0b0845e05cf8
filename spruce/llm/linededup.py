"""Line deduplication by winnowing over line hashes (DataFrame operations only).

A line is deleted if it stands in a run of ``window`` consecutive non-blank
lines that already occurred, at an earlier place (smaller doc_id, or further up in
the same document, not overlapping).  Longer repeated runs are the union of such runs.
So is a line in a shorter run that holds more than ``long_words`` words and already
occurred, in a document of any length; None leaves this rule out.

1. Every window of ``window`` line hashes gives its minimum (the last one on
   ties) as a fingerprint.  What a window selects depends on its lines alone, so any run
   that occurs twice shares a fingerprint at the same place in the run.
2. Fingerprints that occur once are dropped (one map-side combined count).
3. From every place of the others the match is extended both ways: each
   run of ``window`` lines that holds the place is compared with the first
   occurrence of the same run (a map-side combined minimum).  No pairs of occurrences
   are made, so a run that stands in very many documents costs one row each.
   Shorter runs of many words go to that comparison as they are.
4. The lines of the later runs are deleted from the text; the others, and
   blank lines, stay as they are.

Only hashes and places are grouped; texts move once, to the join with the
places to delete.  The work of a document is in proportion to its lines, however many.

Defined results: a document of fewer than ``window`` non-blank lines is one
run of all its lines and is compared with such documents of as many lines, and its
runs of many words with those of all documents.  A word is what stands between white space.
A line
without a visible character (blanks, tabs, carriage returns and the like alone) is blank.  Null text stays null.  Rows with equal id and text are one document
and get the same result.  Null ids come after all others; rows with one id
but different texts come in the order of the texts' hashes.  Lines end at \\n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut

LINES = "split(__t, '\\n', -1)"
VISIBLE = r"[^ \t\n\x0B\f\r]"


def _line_hashes(docs: DataFrame, text: str, key: str, words: bool) -> DataFrame:
    """(id, hash, h, and if asked n): hashes and words of the non-blank lines; one row for each id and text."""
    t = column(docs, text)
    rows = docs.where(t.isNotNull()).select(column(docs, key).alias("id"), F.xxhash64(t).alias("hash"), t.alias("__t"))
    lines = F.filter(F.expr(LINES), lambda x: x.rlike(VISIBLE))
    n = [F.transform(lines, lambda x: F.regexp_count(x, F.lit(VISIBLE + "+"))).alias("n")] if words else []
    rows = rows.select("id", "hash", F.transform(lines, lambda x: F.xxhash64(x)).alias("h"), *n).where(F.size("h") > 0)
    return rows.dropDuplicates(["id", "hash"])


def repeated_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 3,
                  long_words: int | None = 50) -> DataFrame:
    """(id, hash, runs): first and last places (from 0, among the non-blank lines) of the runs to delete."""
    by_words = long_words is not None and window > 1
    rows = cut(_line_hashes(docs, text, key, by_words))
    # the windows' minima, with their places; -place as the last one wins ties
    rows = rows.withColumn("last", F.greatest(F.lit(0), F.size("h") - F.lit(window)))
    minimum = f"array_min(transform(slice(h, i + 1, {window}), (x, j) -> struct(x AS v, -(i + j) AS p)))"
    minima = F.expr(f"transform(array_distinct(transform(sequence(0, last), i -> -{minimum}.p)), p -> struct(h[p] AS v, p))")
    marks = rows.select("id", "hash", F.explode(minima).alias("m")).select("id", "hash", "m.v", "m.p")
    again = cut(marks.groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select("v"))
    places = marks.join(again, "v", "left_semi").groupBy("id", "hash").agg(F.collect_list("p").alias("at"))
    # extend both ways: the runs that hold a matched place
    same = F.expr("a.id <=> b.id AND a.hash = b.hash")
    held = rows.select("id", "hash", "h", "last").alias("a").join(places.alias("b"), same).select(
        "a.id", "a.hash", "a.h", "a.last", "b.at")
    firsts = ("array_distinct(flatten(transform(at, p -> sequence("
              f"greatest(0, least(last, p - {window - 1})), least(last, p)))))")
    runs = F.expr(f"transform({firsts}, i -> struct(i, slice(h, i + 1, {window}) AS run))")
    runs = held.select("id", "hash", F.explode(runs).alias("r")).select("id", "hash", "r.i", "r.run")
    if by_words:  # shorter runs of many words
        starts = (f"filter(sequence(0, greatest(0, size(h) - w)), i -> i + w <= size(h) AND "
                  f"aggregate(slice(n, i + 1, w), 0, (a, x) -> a + x) > {int(long_words)})")
        long = F.expr(f"flatten(transform(sequence(1, {window - 1}), w -> transform({starts}, "
                      "i -> struct(i, slice(h, i + 1, w) AS run))))")
        runs = runs.unionByName(rows.select("id", "hash", F.explode(long).alias("r")).select("id", "hash", "r.i", "r.run"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "i")
    # cut, so that the joins below have an exchange on either side and Spark can split a hot run's rows
    first = cut(runs.groupBy("run").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1").select("run", "f"))
    later = runs.join(first, "run").where(
        ~(F.col("id").eqNullSafe(F.col("f.id")) & (F.col("hash") == F.col("f.hash")))
        | (F.col("i") >= F.col("f.i") + F.size("run")))
    ends = F.struct("i", (F.col("i") + F.size("run") - F.lit(1)).alias("last"))
    return later.groupBy("id", "hash").agg(F.collect_list(ends).alias("runs"))


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 3,
                counts: bool = False, long_words: int | None = 50) -> DataFrame:
    """``docs`` with the later repeated runs deleted from the text; ``counts`` adds n_lines and n_deleted."""
    t = column(docs, text)
    rows = docs.withColumns({"__t": t, "__k": column(docs, key), "__h": F.xxhash64(t)})
    found = repeated_runs(docs, text, key, window, long_words).select(
        F.col("id").alias("__id"), F.col("hash").alias("__hash"), F.col("runs").alias("__runs"))
    rows = rows.join(found, F.col("__k").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    # of the lines: text, and place among the non-blank lines (null if blank)
    gone = F.expr("array_distinct(flatten(transform(coalesce(__runs, array()), r -> sequence(r.i, r.last))))")
    rows = rows.withColumn("__gone", gone)
    full = F.filter(F.transform(F.expr(LINES), lambda x, i: F.when(x.rlike(VISIBLE), i).otherwise(-1)), lambda i: i >= 0)
    rows = rows.withColumn("__full", full)  # line numbers of the non-blank lines
    rows = rows.withColumn("__drop", F.expr("transform(__gone, i -> __full[cast(i as int)])"))
    # the lambda's variable holds the lines and the places, so both are computed once for a text
    stay = "array_join(transform(array_except(sequence(0, size(s.l) - 1), s.d), i -> s.l[i]), '\\n')"
    stay = f"transform(array(struct({LINES} AS l, __drop AS d)), s -> {stay})[0]"
    rows = rows.withColumn(text, F.expr(f"CASE WHEN size(__drop) > 0 THEN {stay} ELSE __t END"))
    if counts:
        rows = rows.withColumns({"n_lines": F.when(F.col("__t").isNull(), 0).otherwise(F.size(F.expr(LINES))),
                                 "n_deleted": F.when(F.col("__t").isNull(), 0).otherwise(F.size("__drop"))})
    return rows.drop("__t", "__k", "__h", "__id", "__hash", "__runs", "__gone", "__full", "__drop")
