"""op12 against brute force: many small shards, ties, odd rows, the tree by itself."""

import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from spruce.llm import ranked


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k):
    held = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, t in held:
            m = 50 + (50 * len(t) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10 ** 9 * t.count(x)) // (1000 * t.count(x) + 20 * m))
                    for x in words if x in t)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_docs,opened,broadcast_mb", [(1, 4, 16), (7, 1, 0), (7, 64, 0), (4096, 16, 16)])
def test_equals_brute_force(spark, shard_docs, opened, broadcast_mb, monkeypatch):
    rng = random.Random(shard_docs)
    words = [f"w{i}" for i in range(40)] + ["Über", "ÜBER", "日本", "A1", "a1"]
    some = lambda n: " ".join(rng.choice(words[:rng.randint(2, 45)]) for _ in range(n))
    docs = [(i, some(rng.randint(0, 30))) for i in range(120)] + [(i, "w1 w2 w3") for i in range(200, 230)]
    items = [(i, some(rng.randint(1, 9))) for i in range(9)] + [(3, "w1 w39"), (50, "nowhere"), (51, "")]
    one = lambda rows, names: spark.createDataFrame(rows, names).repartition(3)
    d, q = one(docs, "doc_id long, text string"), one(items, "item_id long, text string")
    found = ranked.search
    monkeypatch.setattr(ranked, "search", lambda *a: found(*a, block=4, opened=opened, broadcast_mb=broadcast_mb))
    got = ranked.ranked(d, q, k=7, shard_docs=shard_docs, shard_bytes=1 << 20)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 7)


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "The cat", 5, "x"), (2, None, 5, "x"), (None, "cat", 1, ""), (3, "schlief 日本語のテキスト x", 1, "y"),
                                   (4, "word1 of2", 1, "z"), (4, "the end", 1, "z")], "item_id long, text string, doc_id long, score string")
    got = ranked.ranked(odd, items, k=50)
    want = brute([(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert sorted(map(tuple, got.collect()), key=str) == want and {x[0] for x in want} == {1, 3, 4}
    for d, q in ((none, items), (odd, items.limit(0)), (odd.where("doc_id = 3 OR text IS NULL"), items)):
        empty = ranked.ranked(d, q)
        assert empty.collect() == [] and empty.schema.simpleString() == got.schema.simpleString()


def test_tree_holds_its_cells():
    rng = np.random.default_rng(1)
    cells = np.unique(rng.integers(0, (37, 90), (300, 2)), axis=0)
    value = rng.integers(0, 10 ** 6, len(cells))
    tree = ranked.Tree(*ranked.build_tree(cells[:, 0], cells[:, 1], value))
    for r, c in [*map(tuple, cells), (36, 91), (120, 3)]:
        node, bounds = np.array([0]), [tree.top[0]]
        for level in range(tree.depth):
            k = tree.depth - 1 - level
            node = tree.child(node, np.array([2 * ((r >> k) & 1) + ((c >> k) & 1)]))
            bounds.append(tree.top[node[0]])
        at = np.flatnonzero((cells[:, 0] == r) & (cells[:, 1] == c))
        assert bounds[-1] == (value[at[0]] if len(at) else 0) and bounds == sorted(bounds, reverse=True)


def test_terms_are_counted_as_the_pattern_finds_them(spark, odd):
    rng = random.Random(4)
    texts = ["".join(rng.choice("aZ09 /:@[`{\x7f\x00é日🙂\n\u0080_") for _ in range(rng.randrange(12))) for _ in range(3000)]
    assert [ranked.term_count(t.encode()) for t in texts] == [len(re.findall(ranked.TERM, t)) for t in texts]
    found = [len(re.findall(ranked.TERM, r.text or "")) for r in odd.collect()]
    for df in (odd, odd.limit(0)):
        want = (sum(x > 0 for x in found), sum(found)) if df is odd else (0, 0)
        assert ranked.corpus_counts(df) == want


def test_a_written_index_holds_few_shards_at_a_time(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.randrange(16 ** 6):x}" for _ in range(rng.randrange(4000, 12000))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    n, total = ranked.corpus_counts(docs)
    ranked.write_index(docs, str(tmp_path / "i"), n, total, shard_docs=10)
    file, = (tmp_path / "i").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 15 and meta.num_row_groups > 1
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 8 << 20
    sizes = [(len(r.bits) + len(r.maxima), len(ranked.unpack(r.bits)) + len(ranked.unpack(r.maxima))) for r in spark.read.parquet(str(file)).collect()]
    assert all(2 * held < whole for held, whole in sizes)
