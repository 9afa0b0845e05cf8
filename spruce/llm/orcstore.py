"""Token ids in ORC files.

Documents are cut into ranges of ascending id of about equal bytes (see
sharding.splitters), tokenized in their range and written as ORC, one folder
for each range, rows in ascending order of the id.  ORC stores the
ids run-length encoded in stripes; a row index and Bloom filters on the
document id let a reader skip stripes and row groups, and stripes can be
read in parallel.

Text is cut at ASCII white space before the tokenizers library sees it: the vocabularies
in question drop white space and never join across it, so the ids are those
of the whole text, and the ids of a word that comes again are taken from a
bounded table.  For a tokenizer that keeps white space set ``by_word=False``.

Defined results: null text is the empty text (the end id alone).  Null ids
come last; rows with one id are ordered by the hash of the text.  Ids are whole numbers (others are cast to them, or end the job);
columns other than id and text are not read, whatever their names.  An empty
table writes an empty folder, which reads as no rows.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from functools import cache
from string import ascii_letters, ascii_uppercase, punctuation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import column, cut, partitions, small_table
from .sharding import MOST, part_of, splitters

#: Parts of texts that are kept in each of two generations.
MOST_KEPT = 600_000
LETTER, PUNCTUATION = (bytes(i in x.encode() for i in range(256)) for x in (ascii_letters, punctuation))
LATIN = bytes(0x80 <= i < 0xC0 and i not in (0x97, 0xB7) for i in range(256))  # behind byte C3: Latin-1's letters, not the signs of multiplication and division
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
SCHEMA = "doc_id long, none boolean, hash long, ids array<int>, part int"


class WordEncoder:
    """Ids of texts by the tokenizers library, as bytes of little-endian 32-bit integers.

    Texts are cut into parts at ASCII white space, and where an ASCII or Latin-1 letter stands before ASCII
    punctuation: the vocabularies in question never join across either.  The ids of the parts
    are kept in a bounded table of two generations; a vocabulary for which a few probes show otherwise gets whole texts.  New parts of letters alone are one
    token group each; they go to the library as one text, and the ends of words in its ids
    tell them apart.  ASCII capitals are folded first if the vocabulary folds them and no
    combining mark could join them.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.array([bool(suffix) and x.endswith(suffix) for x in names])
        self.folds = all(self.whole(c.encode()) == self.whole(c.lower().encode()) for c in ascii_uppercase)
        self.parts: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        # a vocabulary that keeps white space, or joins across a cut, gets whole texts
        tries = [b"ab cd  ef\ngh", b"ab, cd! (ef) g-h i's", b" ab ", b"caf\xc3\xa9, ab."]
        self.splits = all(b"".join(map(self.whole, self.cut(x) or [x])) == self.whole(x) for x in tries)

    def whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
        return np.array(ids, dtype="<i4").tobytes()

    def cut(self, data: bytes) -> list[bytes] | None:
        """The parts of a text in UTF-8; None if a special token's text stands in it."""
        if any(x in data for x in self.special):
            return None
        if self.folds and b"\xcc" not in data and b"\xcd" not in data:
            data = data.lower()
        x = np.frombuffer(data, dtype=np.uint8)
        if len(x) < 2:
            return data.split()
        letter, punctuation = (np.frombuffer(data.translate(t), dtype=bool) for t in (LETTER, PUNCTUATION))
        if b"\xc3" in data:
            letter = letter.copy()
            letter[1:] |= (x[:-1] == 0xC3) & np.frombuffer(data.translate(LATIN), dtype=bool)[1:]
        at = np.flatnonzero(letter[:-1] & punctuation[1:])
        return np.insert(x, at + 1, 32).tobytes().split()

    def _learn(self, parts: set[bytes]) -> None:
        new = []
        for p in parts:
            if (got := self.old.get(p)) is not None:
                self.parts[p] = got
            elif LETTERS(p):
                new.append(p)
            else:
                self.parts[p] = self.whole(p)
        if not new:
            return
        text = b" ".join(new).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<i4")
        ends = np.nonzero(self.ends[ids])[0]
        if len(ends) == len(new):
            data, at = ids.tobytes(), 0
            for p, e in zip(new, (4 * (ends + 1)).tolist()):
                self.parts[p] = data[at:e]
                at = e
        else:  # a vocabulary without marks for the ends of words
            for p in new:
                self.parts[p] = self.whole(p)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text in UTF-8."""
        out: list[bytes] = []
        for first in range(0, len(texts), 128):
            if len(self.parts) > MOST_KEPT:
                self.parts, self.old = {}, self.parts
            some = texts[first:first + 128]
            cut_up = [self.cut(t) if self.splits else None for t in some]
            known = self.parts.get
            ids = [x and list(map(known, x)) for x in cut_up]
            missing = [[at for at, i in enumerate(y) if i is None] if y else [] for y in ids]
            self._learn({x[at] for x, places in zip(cut_up, missing) for at in places})
            for t, x, y, places in zip(some, cut_up, ids, missing):
                for at in places:
                    y[at] = known(x[at])
                out.append(self.whole(t) if y is None else b"".join(y))
        return out


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenized(rows: DataFrame, path: str, end_id: int | None, by_word: bool = True) -> DataFrame:
    """``rows`` (doc_id, none, hash, text, part) with ids in place of the text."""

    def encode(batches):
        words = encoder(path)
        end = b"" if end_id is None else np.array([end_id], dtype="<i4").tobytes()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found = [x + end for x in (words.encode(texts) if by_word else map(words.whole, texts))]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("none"), batch.column("hash"), ids, batch.column("part")],
                ["doc_id", "none", "hash", "ids", "part"])

    return rows.mapInArrow(encode, SCHEMA)


def write_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = None, text: str = "text",
              key: str = "doc_id", by_word: bool = True, stripe_mb: int = 64, row_index_stride: int = 10_000) -> None:
    """Write doc_id and ids of ``docs`` to the folder ``out``; ids are whole numbers."""
    t = F.coalesce(column(docs, text), F.lit(""))
    k = column(docs, key).cast("long")
    rows = docs.select(k.alias("doc_id"), k.isNull().alias("none"), F.xxhash64(t).alias("hash"), t.alias("text"))
    order = F.coalesce("doc_id", F.lit(MOST))
    keys = cut(rows.select(order.alias("k1"), F.col("hash").alias("k2"), (F.octet_length("text") + 1).cast("long").alias("size")))
    n = partitions(docs)
    bounds = splitters(keys, n, 0.05)
    rows = rows.withColumn("part", part_of(order, F.col("hash"), bounds))
    rows = rows.repartition(n, "part").sortWithinPartitions("part", "none", "doc_id", "hash")
    (tokenized(rows, tokenizer, end_id, by_word).write.partitionBy("part").format("orc")
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(row_index_stride))
     .option("orc.stripe.size", str(stripe_mb << 20)).option("compression", "lz4").mode("error").save(out))


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id and ids (and none, hash, part) of a written folder; some documents are found by index and Bloom filter."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every written document, read from the files."""

    def read(batches):
        for batch in batches:
            ids = batch.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("none"), batch.column("hash"), batch.column("part"),
                 pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "none", "hash", "part", "n_tokens", "ids_crc32"])

    rows = cut(read_ids(spark, path).mapInArrow(
        read, "doc_id long, none boolean, hash long, part int, n_tokens long, ids_crc32 long"))
    # one row for each part comes to the driver
    sums = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, at = [], 0
    for p in sorted(sums):
        before.append((p, at))
        at += sums[p]
    over = Window.partitionBy("part").orderBy("none", "doc_id", "hash").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(small_table(rows, before, "part int, before long"), "part")
    return rows.select("doc_id", (F.sum("n_tokens").over(over) - F.col("n_tokens") + F.col("before")).alias("start"),
                       "n_tokens", "ids_crc32")


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark)}/spruce-ids-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
