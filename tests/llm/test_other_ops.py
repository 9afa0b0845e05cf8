"""Mixing, nearest neighbours, edit fingerprints, sharding and ORC ids against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spruce.llm import ann, editprint, mixing, orcstore, sharding

WORDS = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- mixing

def mixture(spark, sizes):
    rows = [(i, s, f"{'w' * (5 + i % 7)}") for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(k, s, t) for k, (_, s, t) in enumerate(rows)], "doc_id long, source string, text string")


def test_mixing_weights_and_limits(spark):
    docs = mixture(spark, {"a": 600, "b": 100, "c": 20})
    out = mixing.mix(docs, target_entropy=0.8, max_repeats=8.0, block_rows=64).collect()
    total = {s: sum(6 + i % 7 for i in range(n)) for s, n in {"a": 600, "b": 100, "c": 20}.items()}
    given = {s: sum(r.tokens for r in out if r.source == s) for s in "abc"}
    q = [given[s] / sum(given.values()) for s in "abc"]
    assert -sum(x * math.log(x) for x in q) / math.log(3) == pytest.approx(0.8, abs=0.02)
    assert {r.doc_id for r in out} == set(range(720))
    for s in "abc":
        rows = sorted((r for r in out if r.source == s), key=lambda r: r.start)
        assert [r.start for r in rows] == [0, *np.cumsum([r.tokens for r in rows])[:-1]]  # gapless places
        copies = [sum(r.doc_id == d for r in rows) for d in {r.doc_id for r in rows}]
        assert max(copies) - min(copies) <= 1 and max(copies) <= 8
        assert rows[-1].start < rows[0].source_budget <= rows[-1].start + rows[-1].tokens
    limited = mixing.mix(docs, target_entropy=1.0, max_repeats=2.0).collect()
    assert max(sum(r.tokens for r in limited if r.source == s) / total[s] for s in "abc") <= 2.0 + 13 / total["c"]


def test_mixing_budget(spark):
    docs = mixture(spark, {"a": 300, "b": 30})
    out = mixing.mix(docs, target_entropy=0.9, max_repeats=4.0, budget=1000).collect()
    assert sum(r.tokens for r in out) == pytest.approx(1000, abs=26)
    with pytest.raises(ValueError):
        mixing.mix(docs, max_repeats=1.0, budget=10 ** 6)


def test_mixing_does_not_depend_on_partitions(spark):
    docs = mixture(spark, {"a": 200, "b": 20})
    one = sorted(map(tuple, mixing.mix(docs.coalesce(1), block_rows=16).collect()))
    assert one == sorted(map(tuple, mixing.mix(docs.repartition(9), block_rows=16).collect()))


def test_mixing_frame(odd, none):
    out = mixing.mix(odd)
    assert out.columns[:len(odd.columns)] == odd.columns and out.where("epoch = 0").count() == odd.count()
    assert mixing.mix(none).count() == 0 and mixing.mix(none).columns == out.columns


# ---------------------------------------------------------------- nearest neighbours

def brute_nearest(rows, k):
    out = {}
    for qi, q in rows:
        if qi % 20 == 0:
            got = {}
            for i, v in rows:
                if i != qi:
                    s = 0.0
                    for a, b in zip(q, v):
                        s += a * b
                    got[i] = max(got.get(i, -math.inf), s)
            out[qi] = sorted(got.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v)), 0) for i, v in rows],
                                 "vec_id long, embedding array<double>, label int")


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1)))]
    rows += [(1500 + i, rows[i][1]) for i in range(10)]  # ties
    want = brute_nearest([(i, v.tolist()) for i, v in rows], 20)
    got: dict = {}
    for r in ann.nearest(vectors(spark, rows), ann.F.col("id") % 20 == 0, block=300).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    found = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, 21))
        assert [(x[1], x[2]) for x in mine] == sorted(((x[1], x[2]) for x in mine), key=lambda x: (-x[1], x[0]))
        found += len({x[1] for x in mine} & {i for i, _ in best})
    assert found >= 0.9 * 20 * len(want)


def test_nearest_all_probes_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)] + [(60, [0.0] * 5)]
    rows += [(61, None), (62, []), (63, [float("nan")] + [1.0] * 4), (64, [float("inf")] + [1.0] * 4), (65, [1.0, 2.0])]
    df = vectors(spark, rows).union(vectors(spark, rows[:3]))  # repeated rows
    want = brute_nearest(rows[:60], 20)
    got: dict = {}
    for r in ann.nearest(df, ann.F.col("id") % 20 == 0, tables=2, probes=16, block=7, asks=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == want


def test_nearest_few_or_none(spark):
    assert ann.nearest(vectors(spark, [(0, None)])).count() == 0
    assert ann.nearest(vectors(spark, [(0, [1.0]), (None, [2.0])])).count() == 0
    rows = ann.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])]), ann.F.col("id") == 0, probes=8).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1, 0.5), (2, 2, 0.5)]


def test_nearest_short_answers_are_completed(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(50)]
    want = brute_nearest(rows, 30)
    got: dict = {}
    for r in ann.nearest(vectors(spark, rows), ann.F.col("id") % 20 == 0, k=30, tables=1, probes=1, block=7, asks=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == want
    assert len(ann.nearest(vectors(spark, rows[:9]), ann.F.col("id") == 0, tables=1, probes=1).collect()) == 8


def test_pseudo_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(7, 13))
    turned = ann.rotated(x, 3, 7)
    assert turned.shape == (3, 7, 16) and np.allclose((turned ** 2).sum(-1), (x ** 2).sum(-1))


# ---------------------------------------------------------------- edit fingerprints

def brute_embed(codes, level):
    """The walk, step by step."""
    walk, classes = editprint._walk(), editprint._class_of()
    emitted, j, step = [], 0, 0
    for i, cp in enumerate(codes):
        to = walk[j][int(classes[cp])][editprint.CLASSES]
        stay = (to - j) % editprint.PERIOD or editprint.PERIOD
        emitted += [i] * stay
        j, step = to, step + stay
    out = []
    for b in range((len(emitted) >> level) + 1):
        p = int(editprint._places(level, b, 1)[0])
        if p < len(emitted):
            out.append(emitted[p])
    return out


def test_embedding_equals_the_walk(monkeypatch):
    text = "".join(random.Random(4).choice("abcd é日") for _ in range(1500))
    codes = editprint.code_points(text)
    whole = [editprint.embed(codes, level) for level in (0, 3, 4)]
    for level, symbols in zip((0, 3, 4), whole):
        places = brute_embed(codes, level)
        assert len(symbols) == len(places)
        grams = {}
        for i, s in zip(places, symbols.tolist()):
            assert grams.setdefault(text[max(0, i - 2):i + 1], s) == s
    monkeypatch.setattr(editprint, "STRETCH", 97)
    assert all((editprint.embed(codes, level) == x).all() for level, x in zip((0, 3, 4), whole))
    fine, coarse = (3, whole[1]), (4, whole[2])
    assert (editprint.coarser(fine, 4) == coarse[1]).all()


def test_likeness():
    a = "the walk of the text goes on and on " * 30
    fp = editprint.fingerprint
    assert editprint.likeness(fp(a), fp(a)) == 1.0 and editprint.likeness(fp(""), fp("")) == 1.0
    assert editprint.likeness(fp(""), fp(a)) == 0.0
    b = a[:500] + "X" + a[501:]
    c = "".join(random.Random(1).choice("qwertzuiop ") for _ in range(len(a)))
    assert editprint.likeness(fp(a), fp(b)) > 0.5 > editprint.likeness(fp(a), fp(c))
    again = editprint.from_text(editprint.as_text(fp(a)))
    assert again[0] == fp(a)[0] and (again[1] == fp(a)[1]).all()


def test_edited_fingerprints_frame(spark, odd, none):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    out = editprint.edited_fingerprints(odd).collect()
    assert len(out) == odd.count()
    own = {r.doc_id: r for r in out if r.doc_id in (1, 3, 5, 6, 7)}
    nxt = {1: order[[x[0] for x in order].index(2)][1], 3: "", 5: [t for i, t in rows if i == 6][0], 7: " \n \n"}
    for i, following in nxt.items():
        t = [x for k, x in rows if k == i][0]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        assert own[i].n_chars == len(t) and own[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert own[i].fingerprint == editprint.as_text(editprint.fingerprint(t))
        assert own[i].near_next == editprint.likeness(editprint.fingerprint(t), editprint.fingerprint(following))
    assert editprint.edited_fingerprints(none).count() == 0
    one = editprint.edited_fingerprints(odd.where("doc_id = 6")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_edited_order_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i * 3, f"text number {i} " * (i % 9)) for i in range(200)], "doc_id long, text string")
    texts = [f"text number {i} " * (i % 9) for i in range(200)]
    rows = {r.doc_id: r for r in editprint.edited_fingerprints(docs.repartition(11)).collect()}
    for i, t in enumerate(texts):
        half = len(t) // 2
        edited = t[:len(t) - half] + texts[(i + 1) % 200][:half]
        assert rows[3 * i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_near_groups(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    rows = []
    for i, b in enumerate(base):
        rows += [(10 * i, b), (10 * i + 1, b), (10 * i + 2, b[:350] + "z" + b[351:])]
    rows += [(99, None), (100, "")]
    out = {r.doc_id: (r.class_id, r.n_links) for r in editprint.near_groups(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        assert [out[10 * i + j][0] for j in range(3)] == [10 * i] * 3
        assert out[10 * i] == (10 * i, 1)
    assert out[99] == out[100] == (99, 0)


# ---------------------------------------------------------------- sharding

def test_splitters_are_near_equal(spark):
    rng = random.Random(3)
    rows = [(rng.getrandbits(64) - (1 << 63), i, rng.randint(1, 50)) for i in range(4000)]
    rows += [(777, i, 40) for i in range(2000)]  # one hot key, split by the second part
    df = spark.createDataFrame(rows, "k1 long, k2 long, size long")
    bounds = sharding.splitters(df, 12, 0.01)
    assert bounds == sorted(bounds) and len(bounds) == 11
    parts = [0] * 12
    for a, b, s in rows:
        parts[sum((a, b) >= x for x in bounds)] += s
    mean = sum(parts) / 12
    assert max(abs(x - mean) for x in parts) <= 0.03 * mean
    got = {r.p: r.s for r in df.groupBy(sharding.part_of(ann.F.col("k1"), ann.F.col("k2"), bounds).alias("p")).agg(
        ann.F.sum("size").alias("s")).collect()}
    assert got == {i: x for i, x in enumerate(parts)}


def test_sharded_frame(spark, odd, none):
    docs = odd.unionByName(odd)
    out = sharding.sharded(docs, 4)
    rows = out.collect()
    assert len(rows) == docs.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r["size"] == len((r.text or "").encode()) + 1 for r in rows)
    assert sharding.sharded(none, 4).count() == 0


# ---------------------------------------------------------------- ORC ids

def test_word_ids_equal_the_library():
    words, whole = orcstore.encoder(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    texts = ["", "it's 'same x'same don'T a_b a-b 12%x é! Ⅷ. naïve…! <|endoftext|> hi<|startoftext|>",
             "Σ! ΑΣ ΑΣ. İ! 'll'x", "\x1c a\x85b\xa0c \x00 z", "日本。語!", "H̱! Å."]
    texts += ["".join(rng.choice("ab'sTé!?- \n12_…́²Σ.<|>tllre") for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    got = words.encode([t.encode() for t in texts])
    for t, x in zip(texts, got):
        assert np.frombuffer(x, "<i4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_written_ids(spark, odd, none, tmp_path):
    path = str(tmp_path / "ids")
    orcstore.write_ids(odd, path, WORDS, 2)
    whole = Tokenizer.from_file(WORDS)
    got = orcstore.digests(spark, path).collect()
    assert len(got) == odd.count()
    at = 0
    known = {}
    for r in odd.collect():
        known.setdefault(r.doc_id, set()).add(tuple(whole.encode(r.text or "", add_special_tokens=False).ids + [2]))
    for r in sorted(got, key=lambda r: r.start):
        crc = {zlib.crc32(np.array(x, "<u4").tobytes()): len(x) for x in known[r.doc_id]}
        assert r.start == at and crc[r.ids_crc32] == r.n_tokens
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is None, x or 0))
    assert orcstore.read_ids(spark, path, [6, 7]).count() == 2
    orcstore.write_ids(none, str(tmp_path / "none"), WORDS, 2)
    assert orcstore.digests(spark, str(tmp_path / "none")).count() == 0


def test_word_parts_are_looked_up_once(monkeypatch):
    class Seen(dict):
        looked = 0

        def get(self, p):
            self.looked += 1
            return super().get(p)

    monkeypatch.setattr(orcstore, "MOST_KEPT", 40)
    rng = random.Random(9)
    words = orcstore.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    pieces = ["ab", "Ça", "été", "×", "÷x", "it's", "end.", "(Ü)", "12", "́", "日本", "<|endoftext|>", " ", "\n", "é."] + [f"w{chr(97 + i)}" for i in range(26)]
    texts = ["", " ", "a", "É!"] + ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(30))) for _ in range(300)]
    data = [t.encode() for t in texts]
    whole = [words.whole(t) for t in data]
    for _ in range(2):  # the second time from both generations
        assert words.encode(data) == whole
    words.parts = Seen(words.parts)
    monkeypatch.setattr(orcstore, "MOST_KEPT", 10 ** 6)
    words.encode(data)
    held = [p for p in map(words.cut, data) if p]
    assert sum(map(len, held)) <= words.parts.looked <= sum(map(len, held)) + sum(p not in words.old for x in held for p in x) + 600
