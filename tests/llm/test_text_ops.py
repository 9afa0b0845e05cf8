"""Language ID, byte BPE, line dedup, SimHash and the quality rules against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from spruce.llm import bpe, langid, linededup, quality, simhash
from spruce.llm.common import connected_components, held_out

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---------------------------------------------------------------- byte BPE

def test_bpe_equals_the_library(reference):
    ours = bpe.tokenizer(RANKS, public_tokenizers.PATTERN)
    random.seed(1)
    texts = ["", "a" * 5000, "ab" * 4000, "日本語" * 300, "it's  12345 <|endoftext|>\n\n x", "the" * 9000]
    texts += ["".join(random.choice("aetherin solngAB'12é\n") for _ in range(random.randint(1, 80))) for _ in range(400)]
    for t in texts:
        assert ours.encode(t) == reference.encode_ordinary(t)
        assert ours.decode(ours.encode(t)) == t.encode()


def test_bpe_long_text_in_stretches(reference, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    t = "some longer text, cut match by match " * 20
    ours = bpe.ByteBPE(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
    assert ours.encode(t) == reference.encode_ordinary(t)


def test_kept_results_are_bounded():
    kept = bpe.Kept(str.upper, longest=3, most=2)
    assert [kept[x] for x in ("a", "b", "c", "long", "a")] == ["A", "B", "C", "LONG", "A"]
    assert len(kept) <= 2 and len(kept.old) <= 2


def test_bpe_frame(odd, none, reference):
    done = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN)
    assert set(odd.columns) < set(done.columns)
    for r in done.collect():
        t = r.text or ""
        ids = reference.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    both = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both.collect())
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


# ---------------------------------------------------------------- language ID

def brute_phrases(symbols, sample):
    """Greedy longest matches of a list in another, stretch by stretch."""
    text = bytes(sample)
    count = 0
    for at in range(0, len(symbols), langid.STRETCH):
        part = bytes(symbols[at:at + langid.STRETCH])
        i = 0
        while i < len(part):
            n = 1
            while i + n < len(part) and part[i:i + n + 1] in text:
                n += 1
            i += n
            count += 1
    return count


def test_phrases_equal_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "STRETCH", 50)
    samples = {"a": "abracadabra banana " * 3, "b": "the quick brown fox jumps over the lazy dog"}
    model = langid.LanguageModel(samples)
    texts = ["banana brown", "the the the ban", "zzz abr", "a", "quick " * 40]
    got = model.phrases([model._joined(model.symbol_of[langid._code_points(t)]) for t in texts])
    for row, t in zip(got, texts):
        s = model._joined(model.symbol_of[langid._code_points(t)]).tolist()
        for j, k in enumerate(model.langs):
            own = model._joined(model.symbol_of[langid._code_points(samples[k])]).tolist()
            assert row[j] == brute_phrases(s, own)


def test_language_frame(spark, odd, none):
    model = langid.learn(odd)
    assert model.langs == ["de", "en", "ja"]
    rows = langid.identify(odd, model).collect()
    for r in rows:
        letters = r.text is not None and any(ch.isalpha() for ch in r.text)
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert "score" in odd.columns and len(rows) == odd.count()  # the clashing column is replaced
    empty = langid.learn(none)
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.learn(docs, where=~held_out(F.col("doc_id")))
    rows = langid.identify(docs.where(held_out(F.col("doc_id"))), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


# ---------------------------------------------------------------- line dedup

def brute_lines(rows, window):
    """rows: (id, text) in order; the text of each without later repeated runs."""
    seen, out = {}, []
    for d, (_, text) in enumerate(rows):
        if text is None:
            out.append(None)
            continue
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
        own = [lines[i] for i in full]
        gone = set()
        for i in range(max(0, len(own) - window) + 1 if own else 0):
            run = tuple(own[i:i + window])
            d0, i0 = seen.setdefault(run, (d, i))
            if d0 != d or i >= i0 + window:
                gone.update(full[i:i + len(run)])
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_line_dedup_equals_brute_force(spark, window):
    random.seed(window)
    rows = [(i, "\n".join(random.choice(["a", "b", "c", "", " ", "d e", "f"]) for _ in range(random.randint(0, 14))))
            for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df, window=window).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_lines(rows, window)))


def test_line_dedup_frame(odd, none):
    done = linededup.dedup_lines(odd, counts=True)
    assert done.columns == [*odd.columns, "n_lines", "n_deleted"]
    rows = done.collect()
    assert len(rows) == odd.count()
    of = {(r.doc_id, r.source): r for r in rows}
    assert of[1, "a"].n_deleted == 0 and of[2, "a"].n_deleted == 4 and of[2, "a"].text == ""
    assert sum(r.doc_id == 2 and r.n_deleted == 4 for r in rows) == 2  # repeated rows are one document
    assert of[4, None].text is None and of[7, "c"].text == "a\n\n\nb\r\nc" and of[8, "a"].text == " \n \n"
    assert linededup.dedup_lines(none).count() == 0


def test_lines_without_a_visible_character_stay(spark):
    rows = [(0, "a\r\nb\r\n\r\n\t\r\n\r\nc\r"), (1, "x\r\n\r\n\t\r\n\r\na\r\nb\r\nc\r\nd"), (2, "\r\n\r\n\r\n\r"), (3, "\r\n\r\n\r\n\r")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert got == {**dict(rows), 1: "x\r\n\r\n\t\r\n\r\nd"}


# ---------------------------------------------------------------- SimHash

def brute_fingerprint(text, n=3):
    words = bytes(text, "utf-8").lower().split() if text else []
    if not words:
        return 0
    grams = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, bits):
    label = {p: p for p in points}
    todo = True
    while todo:
        todo = False
        for p in points:
            low = min(label[q] for q in points if (p ^ q).bit_count() <= bits)
            if low < label[p]:
                label[p], todo = low, True
    return label


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 4)
    for t in ("", None, "A b", "one two three", "One  two\tthree\x0bfour " * 9, "é É ü \x1c x y z"):
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("block", [1024, 5])
def test_links_connect_what_is_near(spark, block):
    rng = np.random.default_rng(0)
    points = []
    for base in rng.integers(0, 2 ** 63, 40, dtype=np.uint64):
        x = int(base)
        for _ in range(6):
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(b)
            points.append(x)
    points = sorted(set(points))
    signed = {p: p - (1 << 64) if p >> 63 else p for p in points}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    found = connected_components(simhash.near_links(df, 3, block)).collect()
    root = {r.node: r.root for r in found}
    want = brute_components(points, 3)
    classes = {}
    for p in points:
        classes.setdefault(want[p], set()).add(root.get(signed[p], signed[p]))
    assert all(len(v) == 1 for v in classes.values()) and len({min(v) for v in classes.values()}) == len(classes)


def test_counts_are_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2 ** 63, (2, 1000), dtype=np.uint64)
    low = simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b))
    assert (low <= np.bitwise_count(a ^ b)).all()
    digits = lambda x: [bin(int(x) >> 2 * s & 3).count("1") for s in range(32)]
    assert all(sum(abs(p - q) for p, q in zip(digits(x), digits(y))) == d for x, y, d in zip(a[:50], b[:50], low))


def test_near_duplicates_frame(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    label = brute_components(sorted({brute_fingerprint(t) for _, t in texts}), 3)
    least = {}
    for i, t in texts:
        root = label[brute_fingerprint(t)]
        least[root] = min((x for x in (least.get(root), i) if x is not None), default=None)
    want = sorted(((i, f"{brute_fingerprint(t):016x}", least[label[brute_fingerprint(t)]]) for i, t in texts), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == want
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(label.values()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


# ---------------------------------------------------------------- quality rules

def test_tree_paths():
    text = """Forest
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 2 <= 1.0)
      Predict: 0.0
     Else (feature 2 > 1.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    assert quality.tree_paths(text) == {((0, "<=", 0.5),), ((0, "<=", 0.5), (2, "<=", 1.0)), ((0, "<=", 0.5), (2, ">", 1.0)),
                                        ((0, ">", 0.5),)}
    assert quality.tightest(((0, "<=", 0.5), (0, "<=", 0.2), (0, ">", 0.1))) == ((0, "<=", 0.2), (0, ">", 0.1))


def test_rules_equal_python(spark):
    e = quality.RuleEnsemble([((0, "<=", 1.0), (1, ">", 2.0)), ((1, "<=", 2.0),)], [1.5, -2.0], 0.25)
    rows = spark.createDataFrame([([0.0, 3.0],), ([2.0, 3.0],), ([0.0, 2.0],)], "stats array<double>")
    got = [r[0] for r in rows.select(e.column(F.col("stats"))).collect()]
    assert got == pytest.approx([1 / (1 + np.exp(-z)) for z in (1.75, 0.25, -1.75)])


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.quality(spark.read.parquet(f"{d}/documents.parquet"), labels).collect()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    tested = [r for r in rows if r.held_out and r.doc_id in marks]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == marks[r.doc_id] for r in tested]) > 0.95


def test_quality_frame(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, None), (6, 0), (9, 5), (None, 1)], "doc_id long, quality int")
    rows = quality.quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert {r.score for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}
    zeros = spark.createDataFrame([(i, 0) for i in (1, 2, 3, 7)], "doc_id long, quality int")
    assert {r.predicted for r in quality.quality(odd, zeros).collect()} == {0}
    assert quality.quality(none, labels).count() == 0
