"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts and benchmark items become sequences of words (lower-cased ASCII
letters, digits and all characters beyond ASCII).  A pattern is a window of
``window`` consecutive words of an item (an item of fewer words, but not
none, is one pattern).  Patterns of one length m share a shift table over
blocks of two words: the distance from a block's last place in any pattern to
the pattern's end, m - 1 where no pattern has the block.  A text is cut into
stretches of m - 1 possible ends; each stretch jumps by its shifts, all
stretches of a batch at once in numpy, and most leave after one look.  Where
the shift is 0, buckets keyed by a hash of the last words name the patterns
to try, and word-by-word comparison confirms them.

Words are compared by ids of the benchmark's vocabulary, so the search is
exact.  The benchmark is split by item into blocks of at most
``BLOCK_WORDS`` words (an item of more is a block of its own); each block is
collected and broadcast by itself, and every document meets every block.

Results: a null or empty text has no words and no hits; null and empty items
match nothing; items with one id count once; a null id is named ``null``.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from factlens.llm.common import Shared, struct_udf, without

WINDOW = 10
BLOCK_WORDS = 2_000_000
TRY_ROWS = 1 << 16
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class ShiftSearch:
    """Shift table and buckets for patterns of one length (rows of word ids)."""

    def __init__(self, patterns: np.ndarray, n_words: int):
        self.patterns, self.m = patterns, patterns.shape[1]
        self.base = np.int64(n_words + 1)
        self.block = min(2, self.m)
        self.tail = min(4, self.m)
        n, m, b = len(patterns), self.m, self.block
        blocks = np.concatenate([self._key(patterns[:, e - b:e]) for e in range(b, m + 1)])
        shifts = np.concatenate([np.full(n, m - e) for e in range(b, m + 1)])
        order = np.lexsort((shifts, blocks))
        self.blocks, first = np.unique(blocks[order], return_index=True)
        self.shifts = shifts[order][first]
        self.most = m - b + 1
        ends = self._tail(patterns[:, m - self.tail:])
        self.order = np.argsort(ends, kind="stable")
        self.tails, self.start, self.count = np.unique(ends[self.order], return_index=True, return_counts=True)

    def _key(self, words: np.ndarray) -> np.ndarray:
        return words[:, 0].astype(np.int64) * self.base + words[:, -1]

    def _tail(self, words: np.ndarray) -> np.ndarray:
        h = np.zeros(len(words), np.uint64)
        for k in range(words.shape[1]):
            h = (h ^ words[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def shift(self, seq: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Shift of the block that ends at each place (inclusive)."""
        out = np.full(len(end), self.most)
        first, last = seq[end - self.block + 1], seq[end]
        known = np.flatnonzero((first >= 0) & (last >= 0))
        if known.size:
            keys = first[known].astype(np.int64) * self.base + last[known]
            at = np.minimum(np.searchsorted(self.blocks, keys), len(self.blocks) - 1)
            hit = self.blocks[at] == keys
            out[known[hit]] = self.shifts[at[hit]]
        return out

    def find(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence; -1 in ``seq`` matches nothing."""
        if len(seq) < self.m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        end = np.arange(self.m - 1, len(seq), self.most)
        stop = np.minimum(end + self.most, len(seq))
        zero = []
        while end.size:
            s = self.shift(seq, end)
            zero.append(end[s == 0])
            end = end + np.maximum(s, 1)
            on = end < stop
            end, stop = end[on], stop[on]
        end = np.concatenate(zero)
        return self._confirm(seq, end)

    def _confirm(self, seq: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not end.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys = self._tail(seq[end[:, None] + np.arange(1 - self.tail, 1)])
        at = np.minimum(np.searchsorted(self.tails, keys), len(self.tails) - 1)
        there = self.tails[at] == keys
        end, at = end[there], at[there]
        starts, found = [], []
        total = np.cumsum(self.count[at])
        cuts = np.searchsorted(total, np.arange(0, total[-1] if total.size else 0, TRY_ROWS), side="right")
        cuts = np.append(cuts, len(at))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            n = self.count[at[a:b]]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pattern = self.order[np.repeat(self.start[at[a:b]], n) + nth]
            begin = np.repeat(end[a:b], n) - self.m + 1
            same = np.ones(len(begin), bool)
            for k in range(self.m):
                rest = np.flatnonzero(same)
                same[rest] = seq[begin[rest] + k] == self.patterns[pattern[rest], k]
            starts.append(begin[same])
            found.append(pattern[same])
        return (np.concatenate(starts), np.concatenate(found)) if starts else (np.empty(0, np.int64),) * 2


class ItemBlock:
    """Patterns of a block of items, and which items hold each of them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set[str]]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                part = tuple(ids[k:k + window])
                by_length.setdefault(len(part), {}).setdefault(part, set()).add(name)
        self.searches = []
        for m, patterns in sorted(by_length.items()):
            rows = np.array(list(patterns), np.int32).reshape(-1, m)
            self.searches.append((m, ShiftSearch(rows, len(self.vocabulary)), [sorted(x) for x in patterns.values()]))

    def scan(self, docs: list[list[bytes]], hit: np.ndarray, offsets: np.ndarray, items: list[set]) -> None:
        """Marks hit words in ``hit`` (documents one after another, a gap word
        after each) and adds the ids of the items found to ``items``."""
        get = self.vocabulary.get
        seq = np.full(len(hit), -1, np.int32)
        for words, at in zip(docs, offsets.tolist(), strict=True):
            seq[at:at + len(words)] = [get(w, -1) for w in words]
        for m, search, names in self.searches:
            start, pattern = search.find(seq)
            for k in range(m):
                hit[start + k] = True
            doc = np.searchsorted(offsets, start, side="right") - 1
            for d, p in set(zip(doc.tolist(), pattern.tolist(), strict=True)):
                items[d].update(names[p])


def _block(sent: tuple[bytes, int]) -> ItemBlock:
    """A block's tables; a worker keeps one block at a time."""
    return ItemBlock(pickle.loads(sent[0]), sent[1])


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int):
    """Lists of (id, text) of bounded size, one after another.  Items are put
    into hashed groups by their number of characters over the bound; a group
    that is still too large is cut by position when it arrives."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"),
                        F.col(text).alias("text")).filter(F.length("text") > 0)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = 1 + int(chars // block_words)
    grouped = rows.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(groups)))
    for g in range(groups):
        part, size = [], 0
        for r in grouped.filter(F.col("g") == g).select("id", "text").distinct().toLocalIterator():
            if part and size + len(r["text"]) > 4 * block_words:
                yield part
                part, size = [], 0
            part.append((r["id"], r["text"]))
            size += len(r["text"])
        if part:
            yield part


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (array of (start, end): maximal runs
    of hit words, end exclusive), ``n_hit`` and ``items`` (ids as strings of
    the items with an occurring window, sorted)."""
    blocks = item_blocks(items, item_id, item_text, block_words)
    shared = [Shared(docs.sparkSession, (pickle.dumps(b), window)) for b in blocks]
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([StructField("n_words", LongType()), StructField("hits", ArrayType(span)),
                         StructField("n_hit", LongType()), StructField("items", ArrayType(StringType()))])

    def make():
        def run(texts):
            split = [words_of(t) for t in texts]
            size = np.array([len(w) for w in split], np.int64)
            offsets = np.cumsum(size + 1) - size - 1
            hit = np.zeros(int((size + 1).sum()), bool)
            found: list[set] = [set() for _ in texts]
            for s in shared:
                s.build(_block).scan(split, hit, offsets, found)
            edge = np.diff(hit.astype(np.int8), prepend=0, append=0)
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            hits: list[list] = [[] for _ in texts]
            n_hit = [0] * len(texts)
            owner = np.searchsorted(offsets, begin, side="right") - 1
            for d, a, b in zip(owner.tolist(), (begin - offsets[owner]).tolist(), (end - offsets[owner]).tolist(), strict=True):
                hits[d].append({"start": a, "end": b})
                n_hit[d] += b - a
            return [size.tolist(), hits, n_hit, [sorted(x) for x in found]]
        return run

    done = docs.withColumn("_wm", struct_udf(schema, make)(F.col(text)))
    names = [f.name for f in schema.fields]
    return without(done, *names).select("*", *[f"_wm.{n}" for n in names]).drop("_wm")
