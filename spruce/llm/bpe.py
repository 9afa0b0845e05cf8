"""Byte-level BPE encoding and decoding over a rank file.

A text is cut by the vocabulary's pattern; each match is encoded by itself.
The pairs of a match wait in buckets, one for each merge rank; a bucket holds
the places of its pairs in the linked list of parts.  Which ranks have a
bucket is kept in a bitmap of two levels, so the lowest rank is found by
two find-first-set steps whatever the number of waiting pairs.  A merge
leaves stale entries in the buckets; they are skipped when they come up.  A
match of n bytes costs O(n log n) at most, however long it is.

Short matches are kept in a bounded table with their ids, as text repeats.

Defined results: null text is the empty text (no ids; hash of the empty
string).  Rows equal in text get equal results, each row its own; an empty table gives an
empty one; input columns with the names of the three added ones are replaced.  Text that came with lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from heapq import heappop, heappush
from itertools import islice

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

LONGEST_KEPT = 64
MOST_KEPT = 300_000
BIT = [1 << i for i in range(512)]
#: A text of more characters is cut by the pattern match by match, not into one list.
LONG_TEXT = 1 << 20


class Kept(dict):
    """Results of ``make`` by short key, filled on demand.

    Two generations of ``most`` entries: when the young one is full it becomes the
    old one, and what is asked for again moves over, so frequent keys stay.
    """

    def __init__(self, make, longest: int = LONGEST_KEPT, most: int = MOST_KEPT) -> None:
        super().__init__()
        self.make, self.longest, self.most, self.old = make, longest, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > self.longest:
                return got
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class ByteBPE:
    """Encoder and decoder; the bitmap has two levels of 512 bits a word, for ranks below 2 ** 18."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        if max(ranks.values(), default=0) >= 1 << 18:
            raise ValueError("ranks must be below 2 ** 18")
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.bytes_of_decimal = {str(v): k for k, v in ranks.items()}
        self.split = regex.compile(pattern)
        self.low = [0] * 512
        self.kept = Kept(lambda piece: " ".join(map(str, self.merge(piece.encode()))))

    def merge(self, data: bytes) -> list[int]:
        """Ids of one match."""
        rank_of = self.ranks.get
        whole = rank_of(data)
        if whole is not None:
            return [whole]
        n = len(data)
        end = list(range(1, n + 1))   # where the part that starts here ends
        before = list(range(-1, n))   # start of the part before
        pair = [-1] * n               # rank of the pair that starts here; -1: none, or the part has been merged away
        top, low, bit = 0, self.low, BIT
        buckets: dict[int, list[int]] = {}  # waiting places by rank, a heap each
        for i in range(n - 1):
            r = rank_of(data[i:i + 2])
            if r is not None:
                pair[i] = r
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    b = r >> 9
                    low[b] |= bit[r & 511]
                    top |= bit[b]
        while top:
            # find first set, level by level
            b = (top & -top).bit_length() - 1
            w = low[b]
            rank = b << 9 | ((w & -w).bit_length() - 1)
            bucket = buckets[rank]
            i = heappop(bucket) if len(bucket) > 1 else bucket.pop()
            if not bucket:
                del buckets[rank]
                low[b] = w = w & (w - 1)
                if not w:
                    top &= top - 1
            if pair[i] != rank:
                continue  # a stale entry
            j = end[i]
            end[i] = k = end[j]
            pair[i] = pair[j] = -1
            h = before[i]
            if k < n:
                before[k] = i
                fresh = ((i, end[k]), (h, k)) if h >= 0 else ((i, end[k]),)
            elif h >= 0:
                fresh = ((h, k),)
            else:
                break  # one part is left
            for i, k in fresh:
                r = rank_of(data[i:k])
                if r is None:
                    pair[i] = -1
                    continue
                pair[i] = r
                if r in buckets:
                    heappush(buckets[r], i)
                else:
                    buckets[r] = [i]
                    b = r >> 9
                    low[b] |= bit[r & 511]
                    top |= bit[b]
        if top:  # left early
            for r in buckets:
                low[r >> 9] = 0
        ids, i = [], 0
        while i < n:
            k = end[i]
            ids.append(rank_of(data[i:k]))
            i = k
        return ids

    def _stretches(self, text: str):
        """The ids of a text in decimal, joined by blanks, in stretches of bounded size."""
        if len(text) <= LONG_TEXT:
            if text:
                yield " ".join(map(self.kept.__getitem__, self.split.findall(text)))
            return
        matches = self.split.finditer(text)
        while part := " ".join([self.kept[m.group()] for m in islice(matches, 1 << 16)]):
            yield part

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self._stretches(text) for i in part.split(" ")]

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, sha256 of the ids in decimal joined by blanks, sha256 of the decoded bytes)."""
        n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
        for part in self._stretches(text):
            if n:
                ids_hash.update(b" ")
            ids_hash.update(part.encode())
            ids = part.split(" ")
            bytes_hash.update(b"".join(map(self.bytes_of_decimal.__getitem__, ids)))
            n += len(ids)
        return n, ids_hash.hexdigest(), bytes_hash.hexdigest()

    def decode(self, ids) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


@cache
def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One for each Python worker; ``path`` must be readable on every executor."""
    return ByteBPE(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text as ``out``, an array of int."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        bpe = tokenizer(path, pattern)
        return pd.Series([bpe.encode(t or "") for t in texts])

    return docs.withColumn(out, ids(column(docs, text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that ``ids`` stand for as ``out``; null ids give null."""

    @F.pandas_udf("binary")
    def decoded(rows: pd.Series) -> pd.Series:
        bpe = tokenizer(path, pattern)
        return pd.Series([None if r is None else bpe.decode(int(x) for x in r) for r in rows])

    return docs.withColumn(out, decoded(column(docs, ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, encoded and decoded in one pass of the text."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        bpe = tokenizer(path, pattern)
        return pd.DataFrame([bpe.digest(t or "") for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    got = docs.withColumn("__digests", digests(column(docs, text)))
    return got.withColumns({n: F.col("__digests." + n) for n in names}).drop("__digests")
