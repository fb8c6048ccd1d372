"""Removal of repeated strings of bytes by prefix-free parsing.

Every byte goes that is covered by a string of ``length`` bytes which starts
anywhere else too (in any document, its own included); overlaps count, and
strings are judged on the input.  Strings never cross documents.

Method.  A rolling hash over ``GRAM`` bytes sets triggers: a place is one
where it is the leftmost least among the ``gap`` places from some place on.
Triggers depend on the bytes nearby only, so equal strings are parsed alike,
and each place belongs to the first such trigger behind it.  A phrase is a
trigger with the places lo..hi that belong to it; its core is what all their
strings share (``length - gap + 1`` bytes from the trigger), its context all
that they cover.  The distinct contexts are the dictionary, the phrases of
the corpus the parse:

1. phrases whose core occurs once have no repeated string;
2. phrases whose whole context occurs again: all their strings are repeated,
   for all of highly repetitive text is settled here, phrase by phrase;
3. what is left are the ends of copies.  Of each distinct context one phrase
   is taken, and its suffixes are compared within the core's group by what
   lies left and right of the core: the strings are sorted, and those with a
   neighbour of equal ``length`` bytes are repeated.

So the order of the corpus's suffixes is only made as far as equal strings of
``length`` bytes need it: groups of neighbours in the suffix array whose
common prefix is that long.  Strings are compared by 128 bits of hashes.  A
core with over ``CROWD`` contexts doesn't go to one task: its strings become
rows that are counted and joined back.  The phrases of a context that occurs
very often (periodic text) are dealt to many tasks, about a ``DEALS``-th of all
phrases to each.

Documents without a repeat are told from the others by a bit table of fixed
size, so their texts aren't shuffled.

Results: a null text counts as empty.  Rows that share id and text get equal
results (each is a copy of the other).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from factlens.llm.common import slices, written

LENGTH = 400
GAP = 128
GRAM = 16
CHUNK = 1 << 19
CROWD = 4096
DEALS = 4096
TABLE_BITS = 1 << 22
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Rolling:
    """Polynomial hashes modulo 2^64 of the substrings of texts of up to ``size`` bytes."""

    def __init__(self, base: np.uint64, size: int):
        with np.errstate(over="ignore"):
            self.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, base)]), dtype=np.uint64)
            self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, _inverse(base))]), dtype=np.uint64)

    def sums(self, text: np.ndarray) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.up[:len(text)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (sums[stop] - sums[start]) * self.down[start]


def phrases(h: np.ndarray, n: int, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigger, lo, hi): the places 0..n-1 dealt to the leftmost least of
    ``h`` among the ``gap`` places from each."""
    low, span = h, 1
    while span * 2 <= gap:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[gap - span:gap - span + n])
    lo = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    hi = np.append(lo[1:], n) - 1
    trigger = lo + (h[lo[:, None] + np.arange(gap)] == low[lo][:, None]).argmax(1)
    tied = np.flatnonzero(trigger < hi)
    if tied.size:
        more = []
        for k in tied.tolist():
            a, b = int(lo[k]), int(hi[k])
            at = np.flatnonzero(h[a:b + gap] == low[a]) + a
            at = at[:np.searchsorted(at, b) + 1]
            start = np.concatenate([[a], at[:-1] + 1])
            more.append((at, start, np.minimum(at, b)))
        keep = np.ones(len(lo), bool)
        keep[tied] = False
        trigger, lo, hi = (np.concatenate([x[keep], *[m[i] for m in more]]) for i, x in enumerate((trigger, lo, hi)))
    return trigger, lo, hi


class Parser:
    """Phrases of texts for one ``length`` and ``gap``."""

    def __init__(self, length: int, gap: int):
        self.length, self.gap, self.core = length, gap, length - gap + 1
        self.rolling = [Rolling(b, CHUNK + length) for b in _BASES]

    def parse(self, text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """(core, context, trigger, lo, hi) for stretches of ``text``."""
        raw = np.frombuffer(text, np.uint8)
        for at in range(0, len(raw) - self.length + 1, CHUNK):
            part = raw[at:at + CHUNK + self.length - 1]
            one, two = self.rolling
            a, b = one.sums(part), two.sums(part)
            h = (a[GRAM:] - a[:-GRAM]) * one.down[:len(part) - GRAM + 1] * _MIX
            trigger, lo, hi = phrases(h, len(part) - self.length + 1, self.gap)
            core = one.of(a, trigger, trigger + self.core).view(np.int64)
            context = two.of(b, lo, hi + self.length).view(np.int64)
            yield core, context, trigger + at, lo + at, hi + at

    def suffixes(self, trigger, lo, hi, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, ...]:
        """(phrase, place, left hash, right hash) of the strings of phrases,
        given the bytes left and right of their cores."""
        n = hi - lo + 1
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        out = []
        ahead = trigger[row] - place
        for parts, base, begin, stop in (
                (left, 0, place - lo[row], (trigger - lo)[row]), (right, 1, np.zeros(len(row), np.int64), self.gap - 1 - ahead)):
            size = np.array([len(x) for x in parts], np.int64)
            start = (np.cumsum(size) - size)[row]
            raw = np.frombuffer(b"".join(parts), np.uint8)
            r = Rolling(_BASES[base], len(raw)) if len(raw) > CHUNK + self.length else self.rolling[base]
            sums = r.sums(raw)
            out.append(r.of(sums, start + begin, start + stop).view(np.int64))
        return row, place, *out


def _phrases_of(docs: DataFrame, length: int, gap: int, only_core: bool) -> DataFrame:
    kinds = dict(docs.dtypes)
    own = f"doc_id {kinds['doc_id']}, h int, "

    def run(batches):
        parser = Parser(length, gap)
        for batch in batches:
            for part in slices(batch.column(2), 1 << 20):
                at = part.offset - batch.column(2).offset
                rows, found = [], []
                for k, t in enumerate(part.to_pylist()):
                    for x in parser.parse(t.encode()):
                        rows.append(np.full(len(x[0]), at + k))
                        found.append(x)
                if not found:
                    continue
                cols = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                if only_core:
                    yield pa.RecordBatch.from_arrays(cols[:1], ["core"])
                else:
                    of = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *cols],
                                                     ["doc_id", "h", "core", "context", "t", "lo", "hi"])

    return docs.mapInArrow(run, "core long" if only_core else own + "core long, context long, t long, lo long, hi long")


def _told_apart(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` with ``maybe``: false where (doc_id, h) isn't in ``keys``, by a
    bit table of TABLE_BITS bits (so many / 64 rows at most)."""
    bit = F.pmod(F.xxhash64("doc_id", "h"), F.lit(TABLE_BITS))
    words = keys.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("_word")) \
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("_bits"))
    rows = docs.withColumn("_b", bit).withColumn("_word", F.shiftright("_b", 6)).join(F.broadcast(words), "_word", "left")
    own = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_b").bitwiseAND(F.lit(63)).cast("int"))
    return rows.withColumn("maybe", F.coalesce(F.col("_bits").bitwiseAND(own) != 0, F.lit(False))).drop("_b", "_word", "_bits")


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["_doc"]) & (a["h"] == b["_h"])


def _by_doc(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.groupBy(F.col("doc_id").alias("_doc"), F.col("h").alias("_h")).agg(F.collect_list(F.struct(*cols)).alias("parts"))


def _of_classes(parse: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """The phrases of ``parse``, ``total`` in all, whose core and context are in
    ``classes`` (with their number n).  A class of over a DEALS-th of all goes
    to several tasks; there are fewer than DEALS such classes."""
    key, share = ["core", "context"], total // DEALS + 1
    classes = classes.select(*key, F.expr(f"n div {share} + 1").alias("deals"))
    deal = F.pmod(F.xxhash64("doc_id", "h", "t"), F.coalesce("deals", F.lit(1).cast("bigint")))
    dealt = parse.join(F.broadcast(classes.filter("deals > 1")), key, "left").withColumn("deal", deal)
    every = classes.select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("deals") - 1)).alias("deal"))
    return dealt.join(every, [*key, "deal"], "left_semi")


def repeated_strings(docs: DataFrame, length: int = LENGTH, gap: int = GAP, crowd: int = CROWD) -> DataFrame:
    """(doc_id, h, a, b): stretches of bytes that repeated strings cover, for
    ``docs`` with doc_id, h (a hash of the text) and text (not null)."""
    if gap + GRAM > length:
        raise ValueError("length has to reach over gap and a gram")
    docs = docs.select("doc_id", "h", "text")
    cores = _phrases_of(docs, length, gap, True).groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
    cores = written(cores, "cores")  # a join of two plain exchanges can be split where a core is hot
    parse = written(_phrases_of(docs, length, gap, False).join(cores, "core", "left_semi"), "parse")
    one = F.min(F.struct("doc_id", "h", "t", "lo", "hi")).alias("one")
    dictionary = written(parse.groupBy("core", "context").agg(F.count(F.lit(1)).alias("n"), one), "dictionary")
    whole = _of_classes(parse, dictionary.filter("n > 1"), parse.count()) \
        .select("doc_id", "h", F.col("lo").alias("a"), (F.col("hi") + length).alias("b"))
    shared = dictionary.groupBy("core").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    ends = written(dictionary.join(shared, "core").select("core", "n", "m", "one.*"), "ends")

    kinds = dict(docs.dtypes)
    some = _by_doc(ends, "core", "n", "m", "t", "lo", "hi")
    near = _told_apart(docs, ends.select("doc_id", "h").distinct()).filter("maybe").drop("maybe")
    near = near.join(some, _same_doc(near, some)).select("doc_id", "h", "text", "parts")
    core = length - gap + 1

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"].encode()
                yield pa.RecordBatch.from_pylist([
                    {"doc_id": row["doc_id"], "h": row["h"], **p, "l": text[p["lo"]:p["t"]], "r": text[p["t"] + core:p["hi"] + length]}
                    for p in row["parts"]], schema)

    schema = pa.schema([("doc_id", _arrow(docs, "doc_id")), ("h", pa.int32()), *((c, pa.int64()) for c in ("core", "n", "m", "t", "lo", "hi")),
                        ("l", pa.binary()), ("r", pa.binary())])
    own = f"doc_id {kinds['doc_id']}, h int, "
    sides = written(near.mapInArrow(cut, own + "core long, n long, m long, t long, lo long, hi long, l binary, r binary"), "sides")

    def arrays(table):
        t, lo, hi = (table.column(c).to_numpy() for c in ("t", "lo", "hi"))
        return t, lo, hi, table.column("l").to_pylist(), table.column("r").to_pylist()

    def compare(table, parser):
        if not table.num_rows:
            return
        t, lo, hi, left, right = arrays(table)
        row, place, lh, rh = parser.suffixes(t, lo, hi, left, right)
        with np.errstate(over="ignore"):
            key = (lh.view(np.uint64) ^ (table.column("core").to_numpy().view(np.uint64)[row] * _MIX)) * _BASES[0] + (t[row] - place).astype(np.uint64)
        order = np.lexsort((rh, key))
        same = (key[order][1:] == key[order][:-1]) & (rh[order][1:] == rh[order][:-1])
        again = np.zeros(len(row), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        again &= table.column("n").to_numpy()[row] == 1
        at = np.flatnonzero(again)
        if at.size:
            begin = np.concatenate([[True], (row[at][1:] != row[at][:-1]) | (place[at][1:] != place[at][:-1] + 1)])
            last = np.append(np.flatnonzero(begin)[1:], len(at)) - 1
            of, a, b = row[at][begin], place[at][begin], place[at][last] + length
            yield pa.RecordBatch.from_arrays([table.column("doc_id").take(of).combine_chunks(), table.column("h").take(of).combine_chunks(),
                                              pa.array(a), pa.array(b)], ["doc_id", "h", "a", "b"])

    def few(batches):
        parser, held, size = Parser(length, gap), [], 0
        for batch in batches:  # sorted by core
            held.append(batch)
            size += batch.num_rows
            last = batch.column("core")[-1].as_py()
            if size >= 2 * crowd and held[0].column("core")[0].as_py() != last:
                table = pa.Table.from_batches(held)
                cut_at = int(np.searchsorted(table.column("core").to_numpy(), last))
                yield from compare(table.slice(0, cut_at), parser)
                held = table.slice(cut_at).to_batches()
                size = sum(b.num_rows for b in held)
        if held:
            yield from compare(pa.Table.from_batches(held), parser)

    def rows_of(batches):
        parser = Parser(length, gap)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                table = pa.Table.from_batches([batch.slice(start, 2048)])
                t, lo, hi, left, right = arrays(table)
                row, place, lh, rh = parser.suffixes(t, lo, hi, left, right)
                cols = [table.column(c).take(row).combine_chunks() for c in ("doc_id", "h", "core", "n")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(t[row] - place), pa.array(place), pa.array(lh), pa.array(rh)],
                                                 ["doc_id", "h", "core", "n", "d", "place", "lh", "rh"])

    part = sides.filter(F.col("m") <= crowd).repartition("core").sortWithinPartitions("core").mapInArrow(few, own + "a long, b long")
    rows = sides.filter(F.col("m") > crowd).mapInArrow(rows_of, own + "core long, n long, d long, place long, lh long, rh long")
    key = ["core", "d", "lh", "rh"]
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    crowded = rows.filter("n = 1").join(twice, key, "left_semi") \
        .select("doc_id", "h", F.col("place").alias("a"), (F.col("place") + length).alias("b"))
    return whole.unionByName(part).unionByName(crowded)


def _arrow(df: DataFrame, col: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[col].dataType)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gap: int = GAP,
                   crowd: int = CROWD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, ``spans`` (array of
    (start, end): maximal removed runs of bytes), n_removed and ``kept`` (binary)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.hash(whole).alias("h"), whole.alias("text"))
    found = written(repeated_strings(rows, length, gap, crowd), "repeats")
    some = _by_doc(found, "a", "b")
    told = _told_apart(rows, found.select("doc_id", "h").distinct())
    near = told.filter("maybe")
    near = near.join(some, _same_doc(near, some), "left").select("doc_id", "text", "parts")
    every = near.unionByName(told.filter("not maybe").select("doc_id", "text", F.lit(None).cast(near.schema["parts"].dataType).alias("parts")))
    span = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))
    schema = StructType([StructField("spans", span), StructField("n_removed", LongType()), StructField("kept", BinaryType())])

    def merge(texts: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for t, p in zip(texts.to_pylist(), parts, strict=True):
            raw = t.encode()
            ab = np.array([(x["a"], x["b"]) for x in p.as_py()], np.int64)
            ab = ab[np.argsort(ab[:, 0])]
            reach = np.maximum.accumulate(ab[:, 1])
            first = np.concatenate([[True], ab[1:, 0] > reach[:-1]])
            start, end = ab[first, 0], reach[np.append(np.flatnonzero(first)[1:], len(ab)) - 1]
            kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
            out.append({"spans": [{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)],
                        "n_removed": len(raw) - len(kept), "kept": kept})
        from pyspark.sql.pandas.types import to_arrow_type
        return pa.array(out, to_arrow_type(schema))

    cut = F.arrow_udf(merge, schema, F.ArrowUDFType.SCALAR)
    hit = every.filter(F.col("parts").isNotNull()).withColumn("_cut", cut("text", "parts"))
    clean = every.filter(F.col("parts").isNull())
    size = F.octet_length("text").cast("bigint").alias("n_bytes")
    return hit.select("doc_id", size, "_cut.spans", "_cut.n_removed", "_cut.kept").unionByName(
        clean.select("doc_id", size, F.array().cast(span).alias("spans"), F.lit(0).cast("bigint").alias("n_removed"),
                     F.encode("text", "UTF-8").alias("kept")))
