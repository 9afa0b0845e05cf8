"""What the operators left out before: each test fails on the code of the round before."""

import random

import numpy as np
import pytest

import corpus_pipeline
from spruce.llm import ann, editprint, langid, linededup


def brute_long(rows, window, words):
    """As brute_lines, with shorter runs of more than ``words`` words too."""
    seen, out = {}, []
    for d, (_, text) in enumerate(rows):
        lines = text.split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
        own = [lines[i] for i in full]
        spans = {(i, min(window, len(own))) for i in range(max(0, len(own) - window) + 1 if own else 0)}
        spans |= {(i, w) for w in range(1, window) for i in range(len(own) - w + 1)
                  if sum(len(x.split()) for x in own[i:i + w]) > words}
        gone = set()
        for i, w in sorted(spans):
            d0, i0 = seen.setdefault(tuple(own[i:i + w]), (d, i))
            if d0 != d or i >= i0 + w:
                gone.update(full[i:i + w])
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_long_line_is_found_in_any_document(spark):
    long, own = " ".join(f"w{i}" for i in range(51)), [f"own line {i}" for i in range(9)]
    half = long.rsplit(" ", 20)[0]
    rows = [(0, "\n".join([own[0], long, own[1], own[2], half, half + " x", own[3]])), (1, long), (2, f"{own[4]}\n{long}\nshort"),
            (3, f"{half}\n{half} x"), (4, long.rsplit(" ", 1)[0]), (5, f"short\n{long.rsplit(' ', 1)[0]}")]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: rows[0][1], 1: "", 2: f"{own[4]}\nshort", 3: "", 4: rows[4][1], 5: rows[5][1]}


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_long_runs_equal_brute_force(spark, window):
    random.seed(window)
    rows = [(i, "\n".join(random.choice(["a", "b b", "c c c c", "", " ", "d d d\td d", "e e"]) for _ in range(random.randint(0, 9))))
            for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(df, window=window, long_words=4).collect()}
    assert got == dict(zip([r[0] for r in rows], brute_long(rows, window, 4)))


# ---------------------------------------------------------------- near groups

def edited_rows(edits):
    """Twelve texts of 300 to 2,000 characters, each followed by its edited forms: (id, text), ten ids for a text."""
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    rows = []
    for b in range(12):
        t = some(rng.randint(300, 2000))
        rows += [(10 * b, t), *((10 * b + 1 + j, f(t, rng, some)) for j, f in enumerate(edits))]
    return rows


def lost(spark, rows):
    """Ids whose text is not in the class of the text that it was made from."""
    out = editprint.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.class_id // 10 == r.doc_id // 10 for r in out)
    return sorted(r.doc_id for r in out if r.class_id % 10)


def test_near_groups_with_another_front(spark):
    rows = edited_rows([lambda t, rng, some: some(len(t) // 6) + t[len(t) // 6:],       # as long
                        lambda t, rng, some: some(len(t) // 9) + t[len(t) // 6:],       # shorter
                        lambda t, rng, some: some(len(t) // 6) + t])                    # shifted
    assert lost(spark, rows) == []


def test_near_groups_with_spread_edits(spark):
    def spread(t, rng, some):
        return "".join(rng.choice(["", c + some(1), some(1)]) if rng.random() < 0.1 else c for c in t)

    assert len(lost(spark, edited_rows([spread] * 3))) <= 1  # of 36


def test_near_groups_at_the_threshold(spark):
    rows = [(0, "abcdefghij"), (1, "abcdefghXY"), (2, "abcdefgWXY"), (3, "klmno"), (4, "klmnX")]
    out = {r.doc_id: (r.class_id, r.n_links) for r in editprint.near_groups(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {0: (0, 1), 1: (0, 2), 2: (0, 1), 3: (3, 1), 4: (3, 1)}


# ---------------------------------------------------------------- language ID

def scripts():
    """Words of five scripts, 36 letters each, with equal word lengths in all."""
    rng = random.Random(2)
    out = {}
    for name, first in (("a", 0x0430), ("b", 0x0561), ("c", 0x05D0), ("hi", 0x0905), ("ta", 0x0C05), ("zh", 0x4E00)):
        letters = [ch for ch in map(chr, range(first, first + 200)) if ch.isalpha() and ch == ch.lower()][:26 if name == "c" else 36]
        words = ["".join(rng.choice(letters) for _ in range(3 + j % 4)) for j in range(40)]
        out[name] = lambda n, words=words: " ".join(rng.choices(words, k=n))
    return out


def test_rare_scripts_are_told_apart():
    of = scripts()
    model = langid.LanguageModel({k: f(1500 if len(k) == 1 else 300) for k, f in of.items()})
    names = [k for k in of for _ in range(10)]
    langs, scores = model.predict([of[k](30) for k in names])
    assert langs == names and min(scores) > 0.99


def test_phrases_do_not_depend_on_the_table_width():
    of = scripts()
    samples = {k: f(60) for k, f in of.items()}
    texts = [f(20) + "ß" + f(5) for f in of.values()] + ["".join(f(2) for f in of.values())]
    counts = []
    for dense in (3, 64, 1000):
        model = langid.LanguageModel(samples, dense)
        counts.append(model.phrases([model._joined(model.symbol_of[langid._code_points(t)]) for t in texts]).tolist())
    assert counts[0] == counts[1] == counts[2]


# ---------------------------------------------------------------- nearest neighbours

@pytest.mark.parametrize("norms", ["outliers", "lognormal"])
def test_nearest_recall_on_skewed_norms(spark, norms):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(5000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v *= (np.where(np.arange(5000) % 250 == 7, 100.0, 1.0) if norms == "outliers" else rng.lognormal(0, 1, 5000))[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, ann.F.col("id") % 100 == 0, block=500).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = []
    for q in range(0, 5000, 100):
        s = v @ v[q]
        s[q] = -np.inf
        share.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(share) > 0.98 and min(share) >= 0.85


def test_nearest_does_not_depend_on_the_number_of_rows(spark):
    rng = np.random.default_rng(8)
    near = rng.normal(size=(500, 32))
    near /= np.linalg.norm(near, axis=1)[:, None]
    far = rng.normal(size=(6000, 32)) * 1e-4  # no query's, and in no answer
    rows = [(i, x.tolist()) for i, x in enumerate(near)]
    more = rows + [(1001 + 2 * i, x.tolist()) for i, x in enumerate(far)]
    got = [sorted(map(tuple, ann.nearest(spark.createDataFrame(r, "vec_id long, embedding array<double>"), ann.F.col("id") % 20 == 0, whole=0).collect()))
           for r in (rows, more)]
    assert len(got[0]) == 500 and got[0] == got[1]


def test_nearest_with_norms_beyond_the_doubles(spark):
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(6, [1e200, 0.0]), (7, [1e-200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (2, 100):
        got = {r["rank"]: r.vec_id for r in ann.nearest(df, ann.F.col("id") == 5, k=3, probes=8, block=block).collect()}
        assert got == {1: 6, 2: 4, 3: 3}


# ---------------------------------------------------------------- mixing stage

def test_mixing_stage_keeps_columns_of_its_own_names(spark):
    rows = [(i, f"text {i}", "ab"[i % 5 == 0], i, f"e{i}", [i], None, 0.5 * i, {"k": i}) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens long, epoch string, start array<long>, "
                                       "source_budget int, mix_key double, `a.row` map<string, long>")
    for table in (docs, docs.limit(0)):
        mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, table, "")
        assert mixed.schema.simpleString() == docs.schema.simpleString()
        assert {r.doc_id: tuple(r) for r in mixed.collect()} == {r.doc_id: tuple(r) for r in table.collect()}
