"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q, of at least ``min_length``
words and two periods, that no neighbouring word extends.  At each dyadic
scale s = 4, 8, 16, ... a synchronising set is selected by hashes: place i is
in it if, of the hashes of the s-word strings that start at i ... i+s, the
least is that at i or at i+s; strings of a period of at most s/3 don't count.
Equal contexts of 2s words are in or out alike, and any 3s-1 words without a
place have a period of at most s/3.  So a run of a period q in [3s-1, 6s-1)
either has two places at distance q with equal contexts, whose pair proposes
the period, or its first period lies in a highly periodic region, a run of a
smaller period known from an earlier scale: then the run goes over the joint
of two such regions of one period p and one root, and its period is one of
those that the joint allows (equal modulo p).  Periods under 11, which no
scale supplies, come from comparing words at each such distance.  A proposed
pair is extended both ways by hashes of prefixes, and what this finds is
compared word by word before it is reported.

Contexts are compared by 64-bit hashes, which can only propose too much.  Texts
go through in slices of bounded size: each task holds some numbers for each
word of a slice, a long text alone in its slice.  Pairs are at most
18 a place, and the allowed periods of a joint are the runs that go over it.

Results: a null text has no words and no runs.  Words that repeat in a run
after its first period are left out of ``collapsed``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from factlens.llm.common import struct_udf, without

MIN_LENGTH = 12
DIRECT = 10  # periods compared directly; the first scale, 4, supplies 11 and more
WORD = r"[^\x20\x09-\x0D]+"
_NONE = np.uint64(2**64 - 1)
_PRIMES, _BASES = (2147483647, 2147483629), (1103515245, 1664525)
RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])
SCHEMA = StructType([StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)),
                     StructField("collapsed", StringType())])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _longer(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of strings of 2 * size words from those of size words."""
    return _mix(hashes[:-size] * np.uint64(0x9E3779B97F4A7C15) + _mix(hashes[size:] + np.uint64(size)))


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values: prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    full = np.full(rows * width, _NONE)
    full[:len(x)] = x
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


class _Prefixes:
    """Polynomial hashes of prefixes modulo two primes: equality of any two strings."""

    def __init__(self, ids: np.ndarray):
        self.n, self.sums, self.powers = len(ids), [], []
        values = _mix(ids.astype(np.uint64) + np.uint64(1))
        for prime, base in zip(_PRIMES, _BASES, strict=True):
            p = np.uint64(prime)
            power = np.ones(1, np.uint64)
            step = base
            while len(power) <= self.n:
                power = np.concatenate([power, power * np.uint64(step) % p])
                step = step * step % prime
            power = power[:self.n + 1]
            total = np.zeros(self.n + 1, np.uint64)
            total[1:] = np.cumsum(values % p * power[:-1] % p)  # below 2^31 each, so 2^33 words fit
            self.sums.append(total % p)
            self.powers.append(power)

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` words from a equal those from b (a < b)."""
        same = np.ones(len(a), bool)
        for prime, total, power in zip(_PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(prime)
            left = (total[a + size] + p - total[a]) % p * power[b - a] % p
            same &= left == (total[b + size] + p - total[b]) % p
        return same

    def extend(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of equal words from (a, b) on and before (a, b)."""
        right = self._most(np.zeros(len(a), np.int64), self.n - b, lambda m: self.equal(a, b, m))
        return right, self._most(np.zeros(len(a), np.int64), a.copy(), lambda m: self.equal(a - m, b - m, m))

    @staticmethod
    def _most(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = holds(mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low


def _direct(ids: np.ndarray) -> np.ndarray:
    """(start, end, period) of runs of periods up to ``DIRECT``, of any length."""
    found = []
    for q in range(1, min(DIRECT, len(ids) // 2) + 1):
        breaks = np.flatnonzero(ids[:-q] != ids[q:])
        edges = np.concatenate([[-1], breaks, [len(ids) - q]])
        start, stop = edges[:-1] + 1, edges[1:]
        long = stop - start >= q
        found.append(np.stack([start[long], stop[long] + q, np.full(long.sum(), q)], 1))
    return _smallest(np.concatenate(found)) if found else np.empty((0, 3), np.int64)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row for each stretch, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def _joints(ids: np.ndarray, runs: np.ndarray, known: _Prefixes, least: int, low: int, high: int) -> np.ndarray:
    """(a, b, sure): pairs of places at the distances in [low, high) that the
    joints of two regions (runs of at least ``least`` words) of one period and
    root allow; ``sure`` words from them on are equal."""
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    out = []
    one, two = runs[:-1], runs[1:]
    for (r1, f1, p), (r2, f2, _) in zip(*(x[(one[:, 2] == two[:, 2]) & (one[:, 1] >= two[:, 0])].tolist() for x in (one, two)), strict=True):
        turn = r2 + np.arange(p)
        root = np.full(p, f1 - p)
        same = np.flatnonzero((root == turn) | known.equal(np.minimum(root, turn), np.maximum(root, turn), np.full(p, p)))
        same = [t for t in turn[same[:1]].tolist() if (ids[f1 - p:f1] == ids[t:t + p]).all()]
        if not same:
            continue
        q = np.arange(low + (same[0] - (f1 - p) - low) % p, min(high, min(f1 - r1, f2 - r2) + 1), p)
        a = np.maximum(r1, r2 - q)
        sure = np.minimum(f1, f2 - q) - a
        fits = sure >= q
        out.append(np.stack([a[fits], a[fits] + q[fits], sure[fits]], 1))
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """(start, end, period) of all runs of a word sequence, by start and period."""
    n = len(ids)
    if n < 2:
        return np.empty((0, 3), np.int64)
    runs, known, size = _direct(ids), None, 1
    hashes = _mix(ids.astype(np.uint64))
    while 3 * size - 1 <= n // 2:
        if size >= 4:
            low, high = 3 * size - 1, 6 * size - 1
            regions = runs[(runs[:, 2] <= size // 3) & (runs[:, 1] - runs[:, 0] >= size)]
            own = hashes
            if len(regions):
                mark = np.zeros(len(own) + 1, np.int64)
                np.add.at(mark, regions[:, 0], 1)
                np.add.at(mark, regions[:, 1] - size + 1, -1)
                own = np.where(np.cumsum(mark[:-1]) > 0, _NONE, own)
            least = _window_min(own, size + 1)[:n - 2 * size + 1]
            places = np.flatnonzero((least != _NONE) & ((least == own[:len(least)]) | (least == own[size:size + len(least)])))
            context = _longer(hashes, size)[places]
            order = np.lexsort((places, context))
            places, context = places[order], context[order]
            pairs, k = [], 1
            while (near := np.flatnonzero((context[k:] == context[:-k]) & (places[k:] - places[:-k] < high))).size:
                near = near[places[near + k] - places[near] >= low]
                pairs.append(np.stack([places[near], places[near + k], np.zeros(len(near), np.int64)], 1))
                k += 1
            again = (context[1:] == context[:-1]).any()
            if len(regions):
                known = known or _Prefixes(ids)
                pairs.append(_joints(ids, regions, known, low, low, high))
            pairs = np.concatenate(pairs) if pairs else np.empty((0, 3), np.int64)
            if len(pairs):
                known = known or _Prefixes(ids)
                a, b = pairs[:, 0], pairs[:, 1]
                right, left = known.extend(a, b)
                keep = right + left >= b - a
                more = np.stack([a - left, b + right, b - a, a, pairs[:, 2]], 1)[keep]
                runs = _smallest(np.concatenate([runs, _checked(ids, more)]))
            # a run of a longer period repeats a context here, or goes over a joint of regions
            if not again and not ((runs[:, 2] <= size // 3) & (runs[:, 1] - runs[:, 0] >= high)).any():
                break
        hashes = _longer(hashes, size)
        size *= 2
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(min_length, 2 * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _checked(ids: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Runs whose words do repeat, from (start, end, period, a, sure): the words
    but ``sure`` ones from a on are compared; a run found too long by equal
    hashes of unequal words is cut where they differ."""
    runs = runs[np.lexsort((-runs[:, 4], *runs[:, 2::-1].T))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    out = []
    for s, e, q, a, sure in runs[new].tolist():
        parts = (s, min(a, e - q)), (min(a + sure, e - q), e - q)
        edges = [s - 1, *(x + int(i) for x, y in parts for i in np.flatnonzero(ids[x:y] != ids[x + q:y + q])), e - q]
        out += [(x + 1, y + q, q) for x, y in zip(edges[:-1], edges[1:], strict=True) if y - x - 1 >= q]
    return np.array(out, np.int64).reshape(-1, 3)


def _analyse(texts: list[str | None], min_length: int) -> list:
    """Columns n_words, runs and collapsed for a slice of texts: their word
    numbers are put into one array, a number of its own after each text."""
    split_words = re.compile(WORD).findall
    split = [split_words(t) if t else [] for t in texts]
    counts = [len(w) for w in split]
    number: dict[str, int] = {}
    ids = np.empty(sum(counts) + len(split), np.int64)
    starts, at = [], 0
    for k, words in enumerate(split):
        starts.append(at)
        ids[at:at + len(words)] = [number.setdefault(w, len(number)) for w in words]
        at += len(words)
        ids[at] = -1 - k
        at += 1
    runs = find_runs(ids, min_length)
    owner = np.searchsorted(starts, runs[:, 0], side="right") - 1
    drop = np.zeros(len(ids) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 1], -1)
    kept = np.cumsum(drop) == 0
    bounds = np.searchsorted(owner, np.arange(len(split) + 1))
    collapsed = []
    for k, words in enumerate(split):
        if bounds[k] < bounds[k + 1]:
            words = [words[i] for i in np.flatnonzero(kept[starts[k]:starts[k] + len(words)])]
        collapsed.append(" ".join(words))
    begin = runs[:, 0] - np.asarray(starts, np.int64)[owner] if len(runs) else runs[:, 0]
    values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (begin, runs[:, 1] - runs[:, 0], runs[:, 2])],
                                        ["start", "length", "period"])
    return [counts, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values), collapsed]


def periodic_runs(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length, period in words, by
    start and period) and ``collapsed`` (the words that are left, one blank
    between them)."""
    def make():
        return lambda texts: _analyse(texts, min_length)

    done = docs.withColumn("_runs", struct_udf(SCHEMA, make)(F.col(text)))
    return without(done, *SCHEMA.names).select("*", *[f"_runs.{n}" for n in SCHEMA.names]).drop("_runs")
