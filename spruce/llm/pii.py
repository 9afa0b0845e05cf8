"""Personal data and the words that give it away (DataFrame operations only).

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers, found leftmost first and without
overlaps within a kind; a match that fails its test (parts over 255, Luhn, number of digits) is dropped.  Their values are the
protected entities.  A word that stands near an entity again and again and hardly anywhere else gives the entity
away even where it is blanked out, and is generalised or removed:

1. The context of an entity in a document is the set of words within ``window`` characters of its mentions there.
   Documents that give an entity the same context are counted, not listed, so copies cost one row.
2. An entity's information content is ``IC(e) = -ln p(e)``, and what a word tells of it is the pointwise mutual
   information ``PMI(t; e) = ln p(t, e) / (p(t) p(e))``, with p by documents: p(t, e) from contexts, p(t) from all
   words of all documents.  The disclosure ``PMI / IC`` is 1 if the word never stands without the entity.
3. A word whose disclosure of an entity reaches ``remove_at`` is removed from the documents that hold the entity, one that
   reaches ``generalise_at`` is generalised there to the kind of word it is.  The estimate needs ``support``
   different contexts that hold both, so what only copies of one passage say is no evidence.  Documents without a
   protected entity stay as they are.

Places are found by splitting a text at its matches: the pieces' lengths are summed up over one row for each match.  The
patterns are written so that Java's matcher takes time in proportion to the text (no rescans of a run, no recursion); they find what
the plain ones in ``PATTERNS`` find.

Defined results: null text is empty and has no spans; it stays null.  Every row is a document in the counts; rows equal in id and text get
equal results.  Words are runs of at least three letters (of any script) and are compared in lower case; in texts without
blanks the word at the border of a context is left out.  A word that overlaps a base span is not reported, as it goes with
it.  Overlapping base spans are replaced as one, under the first one's name.  All other columns come back as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut

# Kinds of spans in their order, and the patterns of the base kinds.
KINDS = ["email", "ip", "card", "phone", "general", "removed"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The same matches in linear time: a run is entered at its start, or where the last match ended.
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What every valid match holds; texts without it are not searched for the kind.
HOLDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{M}]{3,}"
BYTE = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"
SPAN = "array<struct<kind: int, `start`: int, `end`: int>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a text of digits holds."""
    def add(total, i):
        x = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: Column, m: Column) -> Column:
    n = F.length(_digits(m))
    return (F.when(kind == 0, True)
            .when(kind == 1, F.forall(F.split(m, r"\.", -1), lambda p: p.rlike(BYTE)))
            .when(kind == 2, F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False))
            .otherwise(n.between(9, 15)))


def _found(text: Column, pattern: Column, *more, window: int = 0) -> Column:
    """Array of the matches in order: i, gap (characters since the match before), m, and with ``window`` the context on either side."""
    def matches(s):
        def one(i):
            p = s["p"]
            sides = [F.right(p[i], F.lit(window + 1)).alias("lc"), F.left(p[i + 1], F.lit(window + 1)).alias("rc")] if window else []
            return F.struct(*more, i.alias("i"), F.length(p[i]).alias("gap"), s["f"][i].alias("m"), *sides)
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(s["f"])), lambda i: i < F.size(s["f"])), one)
    # the lambda's variable holds pieces and matches, so both are made once for a text
    held = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("f"))
    return F.transform(F.array(held), matches)[0]


def base_matches(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 160) -> DataFrame:
    """(id, hash, copies, kind, start, end, m, lc, rc): the valid base spans of each different (id, text)."""
    t = column(docs, text)
    rows = docs.select(column(docs, key).alias("id"), F.xxhash64(t).alias("hash"), t.alias("text"))
    none = F.array().cast("array<struct<kind: int, i: int, gap: int, m: string, lc: string, rc: string>>")
    kinds = [F.when(F.col("text").rlike(HOLDS[k]), _found(F.col("text"), F.lit(LINEAR[k]), F.lit(n).alias("kind"), window=window)).otherwise(none)
             for n, k in enumerate(PATTERNS)]
    found = rows.select("id", "hash", F.explode(F.concat(*kinds)).alias("r")).select("id", "hash", "r.*")
    found = found.repartition("id", "hash", "kind").groupBy(*found.columns).agg(F.count("*").alias("copies"))
    size = F.length("m")
    end = F.sum(F.col("gap") + size).over(Window.partitionBy("id", "hash", "kind").orderBy("i"))
    found = found.withColumn("end", end.cast("int")).where(valid(F.col("kind"), F.col("m")))
    return found.select("id", "hash", "copies", "kind", (F.col("end") - size).alias("start"), "end", "m", "lc", "rc")


def _words(side: Column, window: int, left: bool) -> Column:
    """Words of a context's side in lower case: without what its border cuts, and what holds a digit or an @."""
    border = r"^[^ \t\r\n]+" if left else r"[^ \t\r\n]+$"
    whole = F.when(F.length(side) > window, F.regexp_replace(side, border, "")).otherwise(side)
    clean = F.regexp_replace(whole, r"[^ \t\r\n]*[@0-9][^ \t\r\n]*", " ")
    return F.transform(F.regexp_extract_all(clean, F.lit(WORD), F.lit(0)), lambda x: F.lower(x))


def entity(kind: Column, m: Column) -> Column:
    """The protected value: letters in lower case, digits alone in card and phone numbers."""
    return F.concat(kind.cast("string"), F.lit(":"), F.when(kind < 2, F.lower(m)).otherwise(_digits(m)))


def disclosing(docs: DataFrame, base: DataFrame, text: str = "text", window: int = 160, support: int = 3,
               generalise_at: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """((e, term, disclosure), (id, hash, e)): the words that give an entity away, and the entities of each document."""
    words = F.concat(_words(F.col("lc"), window, True), _words(F.col("rc"), window, False))
    mentions = base.select("id", "hash", "copies", entity(F.col("kind"), F.col("m")).alias("e"), words.alias("words"))
    context = F.array_sort(F.array_distinct(F.flatten(F.collect_list("words"))))
    held = cut(mentions.groupBy("id", "hash", "copies", "e").agg(context.alias("words")))
    contexts = held.groupBy("e", "words").agg(F.sum("copies").alias("docs"))
    seen = contexts.groupBy("e").agg(F.sum("docs").alias("df_e"), F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    both = contexts.select("e", "docs", F.explode("words").alias("term")).groupBy("e", "term").agg(
        F.sum("docs").alias("co"), F.count("*").alias("contexts")).where(F.col("contexts") >= support)
    both = cut(both.join(seen.select("e", "df_e"), "e"))
    t = column(docs, text)
    n = docs.where(t.isNotNull()).count()
    every = docs.select(F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda x: F.lower(x)))).alias("term"))
    df = every.groupBy("term").agg(F.count("*").alias("df_t")).join(both.select("term").distinct(), "term", "left_semi")
    ic = F.ln(F.lit(float(n))) - F.ln("df_e")
    pmi = F.ln("co") + F.ln(F.lit(float(n))) - F.ln("df_t") - F.ln("df_e")
    tells = both.join(df, "term").where(F.col("df_e") < n).select("e", "term", (pmi / ic).alias("disclosure"))
    return tells.where(F.col("disclosure") >= generalise_at), held.select("id", "hash", "e")


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = 160, support: int = 3,
         generalise_at: float = 0.9, remove_at: float = 0.98) -> DataFrame:
    """(id, hash, kind, start, end): all spans of each different (id, text); kind is a place in ``KINDS``, ends are exclusive."""
    base = cut(base_matches(docs, text, key, window))
    tells, held = disclosing(docs, base, text, window, support, generalise_at)
    told = cut(held.join(tells, "e").groupBy("id", "hash", "term").agg(F.max("disclosure").alias("disclosure")))
    # each document's own words as one pattern; a word is letters alone, so it needs no quoting
    wanted = told.groupBy("id", "hash").agg(F.concat(F.lit(r"(?<![\p{L}\p{M}])(?iu:"), F.array_join(F.array_sort(F.collect_set("term")), "|"),
                                                     F.lit(r")(?![\p{L}\p{M}])")).alias("pattern"))
    t = column(docs, text)
    rows = docs.where(t.rlike("|".join(HOLDS.values()))).select(column(docs, key).alias("__id"), F.xxhash64(t).alias("__hash"), t.alias("text"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("hash") == F.col("__hash")))
    rows = rows.select("id", "hash", F.explode(_found(F.col("text"), F.col("pattern"))).alias("r")).select("id", "hash", "r.*").distinct()
    end = F.sum(F.col("gap") + F.length("m")).over(Window.partitionBy("id", "hash").orderBy("i")).cast("int")
    rows = rows.withColumn("end", end).select("id", "hash", F.lower("m").alias("term"), (F.col("end") - F.length("m")).alias("start"), "end")
    same = F.expr("a.id <=> b.id AND a.hash = b.hash AND a.term = b.term")
    rows = rows.alias("a").join(told.alias("b"), same).select(
        "a.id", "a.hash", F.when(F.col("disclosure") >= remove_at, 5).otherwise(4).alias("kind"), "start", "end")
    # words that overlap a base span go: by the furthest end before, and the nearest start behind
    spans = base.select("id", "hash", "kind", "start", "end").unionByName(rows)
    is_base = F.col("kind") < len(PATTERNS)
    place = Window.partitionBy("id", "hash").orderBy("start", "kind")
    before = F.max(F.when(is_base, F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(is_base, F.col("start"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    spans = spans.withColumns({"before": before, "behind": behind})
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.coalesce("behind", F.col("end")) >= F.col("end"))
    return spans.where(is_base | free).select("id", "hash", "kind", "start", "end")


def sanitised(docs: DataFrame, text: str = "text", key: str = "doc_id", spans: str = "spans", **options) -> DataFrame:
    """``docs`` with the text sanitised and a column ``spans``: an array of kind (a place in ``KINDS``), start and end, by kind and start."""
    found = cut(find(docs, text, key, **options))
    each = Window.partitionBy("id", "hash").orderBy("start", "kind")
    reach = F.max("end").over(each.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("first", (F.coalesce(reach, F.lit(-1)) <= F.col("start")).cast("int"))
    parts = parts.withColumn("part", F.sum("first").over(each))
    parts = parts.groupBy("id", "hash", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                                    F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    parts = parts.groupBy("id", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("__parts"))
    all_ = found.groupBy("id", "hash").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("__spans"))
    per = all_.join(parts, all_.id.eqNullSafe(parts.id) & (all_.hash == parts.hash)).select(
        all_.id.alias("__id"), all_.hash.alias("__hash"), "__spans", "__parts")
    t = column(docs, text)
    rows = docs.withColumns({"__t": t, "__k": column(docs, key), "__h": F.xxhash64(t)})
    rows = rows.join(per, F.col("__k").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in PATTERNS])

    def put(x, i):
        """What stands between the part before and this one, and what takes this one's place."""
        last = F.when(i > 0, F.col("__parts")[i - 1]["end"]).otherwise(0)
        word = F.substring("__t", x["start"] + 1, x["end"] - x["start"])
        kind_of_word = F.when(F.upper(word) == word, "[WORD]").when(F.initcap(word) == word, "[Word]").otherwise("[word]")
        return F.concat(F.substring("__t", last + 1, x["start"] - last), F.when(x["kind"] == KINDS.index("removed"), "").when(
            x["kind"] == KINDS.index("general"), kind_of_word).otherwise(F.try_element_at(names, x["kind"] + 1)))

    rest = F.expr("substring(__t, element_at(__parts, -1).end + 1)")
    rows = rows.withColumns({text: F.when(F.size("__parts") > 0, F.concat(F.array_join(F.transform("__parts", put), ""), rest)).otherwise(F.col("__t")),
                             spans: F.coalesce("__spans", F.array().cast(SPAN))})
    return rows.drop("__t", "__k", "__h", "__id", "__hash", "__spans", "__parts")


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
