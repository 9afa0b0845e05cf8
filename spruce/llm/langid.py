"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a sample of labelled
text.  A text is parsed against each automaton: from the current place the
longest match in the language's sample is one phrase, then the parse goes
on behind it.  A phrase costs log2(sample length) bits (it is a pointer into the sample), so
``phrases * log2(n) / length`` estimates the cross entropy; the language that
needs the fewest bits wins, ties go to the smaller name.

Case is folded, every run of non-letters is one separator.  Every letter that occurs in a
sample is a symbol of its own, whatever the scripts; only letters that are in no sample are one symbol.  A text is parsed
whole, in stretches of ``STRETCH`` symbols that each start a new phrase, so
that numpy steps many stretches through the automata side by side and a very
long text costs no more a character than a short one.

Defined results: null text, or text without a letter: ``und``, score 0.
Without any labelled text every row is ``und``; an empty table gives an empty one.  Repeated rows get equal
results.  An input column that has the name of an output column is replaced.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

STRETCH = 1024
SYMBOLS_AT_ONCE = 1 << 20


@cache
def _letters() -> np.ndarray:
    """For each code point the code point of its lower case letter, 0 if it is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            out[cp] = ord(ch.lower()[0])
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class SuffixAutomaton:
    """Suffix automaton over a sequence of small integers; ``next`` holds a dict for each state."""

    def __init__(self, symbols) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur


class LanguageModel:
    """The automata of all languages in one transition table.

    An entry is ``2 * (row offset of the next state) + 1`` if a new phrase
    starts with this symbol, without the 1 if the phrase goes on.

    The table has ``dense`` columns: the separator, the most frequent letters, and one that says
    that the symbol is another.  Transitions of the other letters are a sorted list of
    ``row offset * others + letter``; ``dense`` sets speed and memory, not what is found.
    """

    def __init__(self, samples: dict[str, str], dense: int = 64) -> None:
        letters = _letters()
        texts = {k: letters[_code_points(v)] for k, v in sorted(samples.items())}
        texts = {k: v for k, v in texts.items() if v.any()}
        self.langs = list(texts)
        counts: dict[int, int] = {}
        for t in texts.values():
            for cp, n in zip(*np.unique(t[t > 0], return_counts=True)):
                counts[int(cp)] = counts.get(int(cp), 0) + int(n)
        ranked = sorted(counts, key=lambda cp: (-counts[cp], cp))  # symbols 1, 2, ...; the last is a letter of no sample
        self.size = min(len(ranked), dense - 2) + 2
        self.others = len(ranked) + 2 - self.size + 1
        symbol = np.full(0x110000, len(ranked) + 1, dtype=np.uint32)
        symbol[0] = 0
        symbol[ranked] = np.arange(1, len(ranked) + 1)
        self.symbol_of = symbol[letters]
        if len(ranked) + 1 < 2 ** 16:
            self.symbol_of = self.symbol_of.astype(np.uint8 if len(ranked) + 1 < 2 ** 8 else np.uint16)
        tables, self.roots, self.bits, states = [], [], [], 0
        rare: dict[int, int] = {}
        rare_starts = []
        for t in texts.values():
            symbols = self._joined(self.symbol_of[t])
            sa = SuffixAutomaton(symbols.tolist())
            start = np.full(self.size, 2 * states * self.size + 1, dtype=np.int64)
            rare_start = np.full(self.others, 2 * states * self.size + 1, dtype=np.int64)
            for c, s in sa.next[0].items():
                if c < self.size - 1:
                    start[c] = 2 * (states + s) * self.size + 1
                else:
                    rare_start[c - self.size + 1] = 2 * (states + s) * self.size + 1
            table = np.tile(start, (len(sa.next), 1))
            for s, out in enumerate(sa.next[1:], 1):
                for c, to in out.items():
                    if c < self.size - 1:
                        table[s, c] = 2 * (states + to) * self.size
                    else:
                        rare[(states + s) * self.size * self.others + c - self.size + 1] = 2 * (states + to) * self.size
            tables.append(table.ravel())
            rare_starts.append(rare_start)
            self.roots.append(states * self.size)
            self.bits.append(float(np.log2(max(2, len(symbols)))))
            states += len(sa.next)
        self.rare_starts = np.array(rare_starts)
        self.rare_keys = np.array(sorted(rare), dtype=np.int64)
        self.rare_to = np.array([rare[x] for x in self.rare_keys.tolist()], dtype=np.int64)
        self.table = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int64)
        if 2 * states * self.size < 2 ** 31:
            self.table = self.table.astype(np.int32)

    @staticmethod
    def _joined(symbols: np.ndarray) -> np.ndarray:
        """Runs of the separator become one."""
        if not len(symbols):
            return symbols
        keep = np.ones(len(symbols), dtype=bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        return symbols[keep]

    def phrases(self, symbols: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        total = np.zeros((len(symbols), len(self.langs)), dtype=np.int64)
        flat = np.concatenate([*symbols, np.zeros(1, dtype=np.uint8)])
        beyond = np.maximum(flat.astype(np.int32) - (self.size - 1), -1)  # among the other letters, -1 if not one
        some = bool((beyond >= 0).any())
        flat = np.minimum(flat, self.size - 1)
        start, owner, length, at = [], [], [], 0
        for i, s in enumerate(symbols):
            n = -(-len(s) // STRETCH)
            start.append(at + STRETCH * np.arange(n))
            owner.append(np.full(n, i))
            length.append(np.minimum(STRETCH, len(s) - STRETCH * np.arange(n)))
            at += len(s)
        start, owner, length = map(np.concatenate, (start, owner, length))
        order = np.argsort(-length, kind="stable")
        start, owner, length = start[order], owner[order], length[order]
        state = np.repeat(np.array(self.roots, dtype=np.int64)[:, None], len(start), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        active = np.searchsorted(-length, -np.arange(STRETCH), side="left")  # stretches longer than t
        for t in range(int(length[0]) if len(length) else 0):
            k = active[t]
            got = self.table[state[:, :k] + flat[start[:k] + t]]
            if some:
                rare = beyond[start[:k] + t]
                at = np.nonzero(rare >= 0)[0]
                got[:, at] = self._rare(state[:, at], rare[at])
            count[:, :k] += got & 1
            state[:, :k] = got >> 1
        for j in range(len(self.langs)):
            total[:, j] = np.bincount(owner, weights=count[j], minlength=len(symbols))
        return total

    def _rare(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Entries of states (languages, texts) for letters beyond the table's columns."""
        to = self.rare_starts[:, letter]
        if len(self.rare_keys):
            keys = state * self.others + letter
            i = np.minimum(np.searchsorted(self.rare_keys, keys), len(self.rare_keys) - 1)
            to = np.where(self.rare_keys[i] == keys, self.rare_to[i], to)
        return to

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is the winner's share of 2 ** -bits."""
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        places, symbols, held = [], [], 0

        def flush() -> None:
            if not places:
                return
            cost = self.phrases(symbols) * np.array(self.bits)
            best = cost.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(cost.min(axis=1, keepdims=True) - cost, -1000)).sum(axis=1)
            for i, b, p in zip(places, best, share):
                langs[i], scores[i] = self.langs[b], p
            places.clear()
            symbols.clear()

        for i, text in enumerate(texts):
            if text is None:
                continue
            s = self.symbol_of[_code_points(text)]
            if not s.any():
                continue
            s = self._joined(s)
            places.append(i)
            symbols.append(s)
            held += len(s)
            if held >= SYMBOLS_AT_ONCE:
                flush()
                held = 0
        flush()
        return langs, scores


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          where: Column | None = None, sample_chars: int = 24_000, piece_chars: int = 400) -> LanguageModel:
    """Fit on about ``sample_chars`` characters for each value of ``lang``.

    The sample is bounded: pieces of ``piece_chars`` characters, each from a
    place in a document drawn by the hash of its id and text, so the same rows are
    drawn whatever the partitioning, and rows equal in both are one.  A hash threshold for each language,
    from one count of the labelled rows, keeps the rows that are ranked few.
    The model grows with the number of languages alone; its letters are all that occur in the sample.
    """
    rows = docs.where(column(docs, lang).isNotNull() & column(docs, text).isNotNull())
    rows = rows.where(where) if where is not None else rows
    t, k = column(rows, text), column(rows, key)
    rows = rows.select(column(rows, lang).cast("string").alias("lang"), t.alias("t"),
                       F.length(t).alias("n"), F.xxhash64(k, F.lit("lang"), t).alias("h"))
    usable = F.least(F.col("n"), F.lit(piece_chars))
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(usable).alias("n")).collect()}
    if not have:
        return LanguageModel({})
    keep = F.lit(False)
    for name, n in sorted(have.items()):
        share = min(1.0, 1.5 * sample_chars / n) if n else 0.0
        keep = keep | ((F.col("lang") == F.lit(name)) & (F.shiftrightunsigned("h", 16) < F.lit(int(share * (1 << 48)) + 1)))
    at = (F.abs(F.xxhash64(F.col("h"))) % F.greatest(F.lit(1), F.col("n") - F.lit(piece_chars))).cast("int") + 1
    drawn = rows.where(keep & (F.col("n") > 0)).select("lang", "h", F.substring(F.col("t"), at, F.lit(piece_chars)).alias("piece"))
    drawn = drawn.groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    samples: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["h"], r["piece"])):  # bounded by sample_chars a language
        if size.get(r["lang"], 0) < sample_chars:
            samples.setdefault(r["lang"], []).append(r["piece"])
            size[r["lang"]] = size.get(r["lang"], 0) + len(r["piece"])
    return LanguageModel({k: "\n".join(v) for k, v in samples.items()})


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by learn()'s sample

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    found = docs.withColumn("__found", predict(column(docs, text)))
    return found.withColumns({"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found")
