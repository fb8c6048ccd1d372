"""Secret scans: fixed patterns, and novelty by dictionary-primed zstandard.

Patterns (leftmost, not overlapping per kind; spans are whole matches):
assignments of a value of 6 or more characters to a password, secret, token
or key; access key ids of 20 or more; hexadecimal strings of 24 or more.

Novelty: tokens (strings of token characters) are cut at the sensitive words
in them; a candidate is a part of any length that starts at most ``REACH`` characters behind a
sensitive word or ends as near before one.  Its marginal size is what it adds to the compressed size of the text
around it, under a zstandard dictionary made of the corpus's identifiers and
of sensitive names; a candidate that adds ``NOVEL`` bytes or more a character
(of ``MIN_TOKEN`` characters, if it has fewer) is reported as kind ``novel``
unless it overlaps a pattern's span.  The dictionary holds the ``n_names``
identifiers (letters and underscores, 10 to 40 characters) that are most
frequent over all documents, ties by name.

Results: a null or empty text has no spans.  Offsets are code points, end
exclusive; spans are sorted by start, then kind in the order of ``KINDS``.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from factlens.llm.common import Shared, slices, struct_udf, without

# fixed values: the kinds, their patterns and the least length of a match (of group 2 for assign)
KINDS = ["assign", "access", "hex", "novel"]
NAMES = ["password", "passwd", "secret", "token", "api_?key"]
SENSITIVE = ["password", "passwd", "secret", "token", "api_key", "apikey", "credential", "bearer", "authorization", "private key", "access key"]

_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in NAMES)
ASSIGN = re.compile(rf"""({_EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
HEX = re.compile("[0-9a-f]{24,}")
TOKEN = re.compile("[A-Za-z0-9+/_.=-]+")
NAME = re.compile("[A-Za-z_]{10,}")
SENSITIVE_WORD = re.compile("|".join(SENSITIVE), re.IGNORECASE | re.ASCII)
MIN_TOKEN, REACH, AROUND, NOVEL, N_NAMES = 16, 48, 160, 0.6, 4096
NAME_CHARS, COUNTED = 40, 200_000


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


class Novelty:
    """Marginal compressed sizes under one dictionary."""

    def __init__(self, names: list[str]):
        words = " ".join([*reversed(names), *SENSITIVE]).encode()  # the most frequent last: nearest
        sample = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sample.precompute_compress(level=3)
        self.packer = zstandard.ZstdCompressor(dict_data=sample, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.packer.compress(text.encode()))

    def added(self, text: str, start: int, end: int) -> float:
        """Compressed bytes that text[start:end] adds, for each of its characters."""
        before, after = text[max(0, start - AROUND):start], text[end:end + AROUND]
        return (self.size(before + text[start:end] + after) - self.size(before + after)) / (end - start)

    def spans(self, text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        words = [m.span() for m in SENSITIVE_WORD.finditer(text)]
        if not words:
            return []
        starts, ends = [a for a, _ in words], [b for _, b in words]
        taken: list[list[int]] = []  # the patterns' spans, united
        for x, _, y in sorted(known):
            if taken and x < taken[-1][1]:
                taken[-1][1] = max(taken[-1][1], y)
            else:
                taken.append([x, y])
        firsts, out = [x for x, _ in taken], []
        for m in TOKEN.finditer(text):
            lo, hi = m.span()
            cuts = words[bisect.bisect_right(ends, lo):bisect.bisect_left(starts, hi)]
            for a, b in zip([lo, *(y for _, y in cuts)], [*(x for x, _ in cuts), hi], strict=True):
                if a >= b:
                    continue
                k, j = bisect.bisect_right(ends, a) - 1, bisect.bisect_left(starts, b)  # the nearest words
                if (k < 0 or ends[k] + REACH < a) and (j == len(starts) or b + REACH < starts[j]):
                    continue
                i = bisect.bisect_left(firsts, b) - 1
                if (i < 0 or taken[i][1] <= a) and self.added(text, a, b) * (b - a) >= NOVEL * max(b - a, MIN_TOKEN):
                    out.append((a, 3, b))
        return out


def identifiers(docs: DataFrame, text: str = "text", n_names: int = N_NAMES) -> list[str]:
    """The most frequent identifiers of all documents, at most ``n_names``."""

    def batch_of(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["name", "n"])

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for part in slices(batch.column(0)):
                for t in part.to_pylist():
                    if t:
                        counts.update(NAME.findall(t))
                if len(counts) > COUNTED:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    rows = docs.select(F.col(text)).mapInArrow(count, "name string, n long").filter(F.length("name") <= NAME_CHARS)
    top = rows.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(n_names)
    return [r["name"] for r in top.collect()]


def scan(docs: DataFrame, text: str = "text", n_names: int = N_NAMES) -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end)."""
    shared = Shared(docs.sparkSession, identifiers(docs, text, n_names))
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([StructField("spans", ArrayType(span))])

    def make():
        novelty = shared.build(Novelty)

        def one(t):
            if not t:
                return []
            known = pattern_spans(t)
            return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(known + novelty.spans(t, known))]

        return lambda texts: [[one(t) for t in texts]]

    done = docs.withColumn("_scan", struct_udf(schema, make)(F.col(text)))
    return without(done, "spans").select("*", "_scan.spans").drop("_scan")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
