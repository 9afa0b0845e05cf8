"""Registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, editprint, hardneg, langid, linededup, mixing, orcstore, pii, quality, ranked, sharding, simhash
from .common import cut, held_out

RANKS = "byte_bpe_50k.tiktoken"
WORDS = "word_bpe_49k.json"
END_ID = 2


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, max_bits=3)


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("tokens", F.octet_length("text").cast("long") + 1)
    mixed = mixing.mix(docs.select("doc_id", "source", "tokens"), tokens="tokens", target_entropy=0.9, max_repeats=4.0)
    return mixed.select("doc_id", "source", "epoch", "tokens", "start", "source_budget", "mix_key")


def op4_cross_polytope_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, whole=0)


def op5_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.edited_fingerprints(_read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.learn(docs, where=~held_out(F.col("doc_id")))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = linededup.dedup_lines(docs, counts=True)
    return found.select("doc_id", "n_lines", "n_deleted", F.length("text").alias("n_chars_left"),
                        F.sha2("text", 256).alias("text_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))  # before the exchange, which then needs no text
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", crc.alias("text_crc32"))
    return sharding.sharded(docs, shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = orcstore.scratch_folder(spark)
    orcstore.write_ids(_read(spark, sf_dir, "documents"), path, public_tokenizers.path(WORDS), END_ID)
    done = cut(orcstore.digests(spark, path))  # then the files are not needed any more
    orcstore.remove(spark, path)
    return done


def op11_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.sanitised(docs)
    of = lambda n: F.filter("spans", lambda s: s["kind"] == n)
    base = F.filter("spans", lambda s: s["kind"] < len(pii.PATTERNS))
    return done.select("doc_id", *[F.size(of(n)).cast("long").alias(f"n_{k}") for n, k in enumerate(pii.PATTERNS)],
                       F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"),
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("sanitised_sha256"))


def op12_k2_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=50)


def op13_hilbert_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_simhash_near_dedup, op3_temperature_mixing, op4_cross_polytope_knn,
                            op5_edit_fingerprints, op6_language_id, op7_line_dedup, op8_byte_bpe, op9_histogram_shards,
                            op10_orc_token_ids, op11_pii_disclosure, op12_k2_ranked_search, op13_hilbert_hard_negatives, pipeline)}

MIX_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, strlen(text) + 1 AS tokens FROM documents),
s AS (
  SELECT source, sum(tokens)::BIGINT AS total, count(*) AS n FROM d GROUP BY source),
sh AS (
  SELECT *, total::DOUBLE / (SELECT sum(total) FROM s)::DOUBLE AS p FROM s),
low AS (  -- largest exponent with enough entropy
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT step, lo, hi, mid,
               ln((SELECT sum(pow(p, mid)) FROM sh))
               - mid * (SELECT sum(pow(p, mid) * ln(p)) FROM sh) / (SELECT sum(pow(p, mid)) FROM sh)
               >= 0.9 * ln((SELECT count(*) FROM sh)) AS ok
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM low) WHERE step < 24)),
high AS (  -- smallest exponent within the repetition limit
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END
  FROM (SELECT step, lo, hi, mid, pow((SELECT max(p) / min(p) FROM sh), 1 - mid) > 4.0 AS over
        FROM (SELECT *, (lo + hi) / 2 AS mid FROM high) WHERE step < 24)),
ex0 AS (
  SELECT CASE WHEN -(SELECT sum(p * ln(p)) FROM sh) >= 0.9 * ln((SELECT count(*) FROM sh)) THEN 1.0::DOUBLE
              ELSE (SELECT lo FROM low WHERE step = 24) END AS t),
ex AS (
  SELECT CASE WHEN pow((SELECT max(p) / min(p) FROM sh), 1 - t) > 4.0 THEN (SELECT hi FROM high WHERE step = 24)
              ELSE t END AS t FROM ex0),
z AS (
  SELECT t, sum(pow(p, t)) AS z, max(pow(p, 1 - t)) AS gap FROM sh, ex GROUP BY t),
plan AS (
  SELECT source, total, ceil(n / 8192.0)::BIGINT AS blocks,
         greatest(total, round(pow(p, t) / z * ((SELECT sum(total) FROM s)::DOUBLE * z * gap))::BIGINT) AS source_budget
  FROM sh, z),
e AS (
  SELECT d.doc_id, source, tokens, total, source_budget, unnest(range(0, (source_budget - 1) // total + 1)) AS epoch,
         ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT % blocks AS block
  FROM d JOIN plan USING (source)),
b AS (
  SELECT source, epoch, block, sum(tokens) AS block_tokens FROM e GROUP BY ALL),
bb AS (
  SELECT source, epoch, block, sum(block_tokens) OVER (
           PARTITION BY source, epoch ORDER BY md5('mix:' || epoch || ':block:' || block)) - block_tokens AS before
  FROM b),
pl AS (
  SELECT e.*, epoch * total + before + sum(tokens) OVER (
           PARTITION BY source, epoch, block ORDER BY md5('mix:' || epoch || ':' || doc_id), doc_id::VARCHAR
           ROWS UNBOUNDED PRECEDING) - tokens AS start
  FROM e JOIN bb USING (source, epoch, block))
SELECT doc_id, source, epoch::INTEGER AS epoch, tokens::BIGINT AS tokens, start::BIGINT AS start,
       source_budget::BIGINT AS source_budget, start::DOUBLE / source_budget::DOUBLE AS mix_key
FROM pl WHERE start < source_budget
"""

LINES_SQL = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
f AS (  -- the lines that hold a visible character, numbered from 0
  SELECT doc_id, ln, line, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n
  FROM l WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')),
g AS (
  SELECT doc_id, i, n, words, line AS l1, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3, lead(words, 1) OVER d AS words2
  FROM f WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
r AS (  -- runs of three lines (or all of a shorter document), and shorter ones of over 50 words
  SELECT doc_id, i, 3 AS w, concat_ws(chr(10), l1, l2, l3) AS run FROM g WHERE i + 3 <= n
  UNION SELECT doc_id, i, n, concat_ws(chr(10), l1, CASE WHEN n = 2 THEN l2 END) FROM g WHERE n < 3 AND i = 0
  UNION SELECT doc_id, i, 1, l1 FROM g WHERE words > 50
  UNION SELECT doc_id, i, 2, concat_ws(chr(10), l1, l2) FROM g WHERE i + 2 <= n AND words + words2 > 50),
q AS (
  SELECT doc_id, i, w, min((doc_id, i)) OVER (PARTITION BY run, w) AS first FROM r),
x AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + w)) AS i FROM q
  WHERE doc_id <> first[1] OR i >= first[2] + w),
k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.ln) AS left_text
  FROM l LEFT JOIN f ON l.doc_id = f.doc_id AND l.ln = f.ln LEFT JOIN x ON f.doc_id = x.doc_id AND f.i = x.i
  WHERE x.i IS NULL GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id)
SELECT documents.doc_id, len(string_split(text, chr(10)))::INTEGER AS n_lines, coalesce(c.n, 0)::INTEGER AS n_deleted,
       length(coalesce(left_text, ''))::INTEGER AS n_chars_left, sha256(coalesce(left_text, '')) AS text_sha256
FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id LEFT JOIN c ON documents.doc_id = c.doc_id
"""

PII_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, copies
  FROM (SELECT doc_id, text, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY doc_id, text)),
k(ord, kind, rx) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (1, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  (2, 'card', '[0-9](?:[\x20-]?[0-9])+'), (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
m AS (
  SELECT rid, copies, ord, generate_subscripts(f, 1) AS i, unnest(f) AS m, p
  FROM (SELECT rid, copies, ord, string_split_regex(text, rx) AS p, regexp_extract_all(text, rx) AS f FROM d, k)),
s AS (
  SELECT rid, copies, ord, m, right(p[i], 161) AS lc, left(p[i + 1], 161) AS rc, regexp_replace(m, '[^0-9]', '', 'g') AS digits,
         sum(length(p[i]) + length(m)) OVER (PARTITION BY rid, ord ORDER BY i) AS stop
  FROM m),
b AS (  -- valid base spans
  SELECT *, stop - length(m) AS start, ord || ':' || CASE WHEN ord < 2 THEN lower(m) ELSE digits END AS e FROM s
  WHERE CASE ord WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda x: NOT regexp_full_match(x, '0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])'))) = 0
    WHEN 2 THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN digits[-i]::INTEGER ELSE digits[-i]::INTEGER * 2 - CASE WHEN digits[-i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(digits) BETWEEN 9 AND 15 END),
side AS (  -- contexts without what their border cuts
  SELECT rid, copies, e, CASE WHEN length(lc) > 160 THEN regexp_replace(lc, '^[^ \t\r\n]+', '') ELSE lc END AS lc,
         CASE WHEN length(rc) > 160 THEN regexp_replace(rc, '[^ \t\r\n]+$', '') ELSE rc END AS rc FROM b),
mention AS (
  SELECT rid, copies, e, regexp_extract_all(regexp_replace(lc, '[^ \t\r\n]*[@0-9][^ \t\r\n]*', ' ', 'g') || ' '
         || regexp_replace(rc, '[^ \t\r\n]*[@0-9][^ \t\r\n]*', ' ', 'g'), '[\p{L}\p{M}]{3,}') AS words FROM side),
held AS (
  SELECT rid, copies, e, list_sort(list_distinct(list_transform(flatten(list(words)), lambda x: lower(x)))) AS words
  FROM mention GROUP BY rid, copies, e),
ctx AS (SELECT e, words, sum(copies) AS docs FROM held GROUP BY e, words),
seen AS (SELECT e, sum(docs) AS df_e FROM ctx GROUP BY e HAVING count(*) >= 3),
co AS (
  SELECT e, term, sum(docs) AS co FROM (SELECT e, docs, unnest(words) AS term FROM ctx) GROUP BY e, term HAVING count(*) >= 3),
df AS (
  SELECT term, count(*) AS df_t FROM (
    SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '[\p{L}\p{M}]{3,}'), lambda x: lower(x)))) AS term
    FROM documents WHERE text IS NOT NULL) GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM documents WHERE text IS NOT NULL),
tells AS (
  SELECT e, term, (ln(co) + ln(n) - ln(df_t) - ln(df_e)) / (ln(n) - ln(df_e)) AS disclosure
  FROM co JOIN seen USING (e) JOIN df USING (term), n WHERE df_e < n),
told AS (
  SELECT rid, term, max(disclosure) AS disclosure FROM held JOIN tells USING (e) WHERE disclosure >= 0.9 GROUP BY rid, term),
w AS (
  SELECT rid, p, generate_subscripts(f, 1) AS i, unnest(f) AS m
  FROM (SELECT rid, string_split_regex(text, '[\p{L}\p{M}]{3,}') AS p, regexp_extract_all(text, '[\p{L}\p{M}]{3,}') AS f
        FROM d WHERE rid IN (SELECT rid FROM told))),
ws AS (
  SELECT rid, lower(m) AS term, length(m) AS size, sum(length(p[i]) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS stop FROM w),
extra AS (
  SELECT ws.rid, CASE WHEN disclosure >= 0.98 THEN 5 ELSE 4 END AS ord, stop - size AS start, stop FROM ws JOIN told USING (rid, term)),
spans AS (
  SELECT rid, ord, start, stop FROM b
  UNION ALL
  SELECT * FROM extra x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = x.rid AND b.start < x.stop AND x.start < b.stop)),
per AS (
  SELECT rid, count(*) FILTER (WHERE ord = 0) AS n_email, count(*) FILTER (WHERE ord = 1) AS n_ip, count(*) FILTER (WHERE ord = 2) AS n_card,
         count(*) FILTER (WHERE ord = 3) AS n_phone,
         string_agg(['email', 'ip', 'card', 'phone'][ord + 1] || ':' || start || ':' || stop, ',' ORDER BY ord, start) FILTER (WHERE ord < 4) AS base,
         string_agg(['email', 'ip', 'card', 'phone', 'general', 'removed'][ord + 1] || ':' || start || ':' || stop, ',' ORDER BY ord, start) AS spans
  FROM spans GROUP BY rid),
cuts AS (  -- overlapping spans are replaced as one, under the first one's name
  SELECT rid, part, min(start) AS start, max(stop) AS stop, arg_min(ord, (start, ord)) AS ord FROM (
    SELECT *, sum(CASE WHEN coalesce(reach, -1) <= start THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY start, ord) AS part FROM (
      SELECT *, max(stop) OVER (PARTITION BY rid ORDER BY start, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans))
  GROUP BY rid, part),
put AS (
  SELECT rid, string_agg(substring(text, (lag_stop + 1)::BIGINT, (start - lag_stop)::BIGINT) || CASE
           WHEN ord < 4 THEN ['[EMAIL]', '[IP]', '[CARD]', '[PHONE]'][ord + 1] WHEN ord = 5 THEN ''
           WHEN word = upper(word) THEN '[WORD]' WHEN word = upper(word[1]) || lower(word[2:]) THEN '[Word]' ELSE '[word]' END,
           '' ORDER BY start) || substring(any_value(text), (max(stop) + 1)::BIGINT) AS text
  FROM (SELECT rid, text, start, stop, ord, substring(text, (start + 1)::BIGINT, (stop - start)::BIGINT) AS word,
               lag(stop, 1, 0) OVER (PARTITION BY rid ORDER BY start) AS lag_stop FROM cuts JOIN d USING (rid))
  GROUP BY rid)
SELECT o.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(coalesce(put.text, o.text, '')) AS sanitised_sha256
FROM documents o LEFT JOIN d ON o.doc_id = d.doc_id AND o.text = d.text LEFT JOIN per ON d.rid = per.rid LEFT JOIN put ON d.rid = put.rid
"""

RANKED_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS docs, sum(len(terms)) AS total FROM d),
m AS (
  SELECT doc_id, terms, 50 + (50 * len(terms) * docs) // total::BIGINT AS m FROM d, s),
tf AS (
  SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(terms) AS term FROM m) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, s),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
r AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 50
"""

NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
u AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM e),
odd AS (SELECT DISTINCT vec_id FROM u WHERE x IS NULL OR isnan(x) OR isinf(x)),
c AS (
  SELECT vec_id, label, i, floor(256 * x)::BIGINT AS q FROM u WHERE vec_id NOT IN (SELECT vec_id FROM odd)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, sum(a.q * b.q)::BIGINT AS score
  FROM c a JOIN c b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY ALL),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same
       AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

SQL: dict[str, str] = {"op3_temperature_mixing": MIX_SQL, "op7_line_dedup": LINES_SQL,
                       "op11_pii_disclosure": PII_SQL, "op12_k2_ranked_search": RANKED_SQL, "op13_hilbert_hard_negatives": NEGATIVES_SQL}
