"""Line dedup: later copies of repeated runs of lines are deleted.

A line is deleted if it lies in a run of consecutive lines of its document,
of at least ``min_chars`` characters (each line counts one more for its end)
or of at least ``min_words`` words, that also occurs at an earlier place.  A
word is a Han, Hiragana or Katakana character, or a run of other characters
between blanks and CJK punctuation.  Places are ordered by (doc_id, line);
an occurrence may overlap its copy.

Method: suffixes of the documents' line-id sequences are ranked by distributed
prefix doubling: the class of the first 2^k lines of a suffix is named from
the classes of its two halves, and only suffixes whose class occurs twice go
on to the next k.  The classes are the nested intervals of the suffix array in
which neighbours share 2^k lines.  The interval for a common prefix of any m
lines is named by the classes of the prefix's first and last 2^k lines
(2^k <= m), which overlap.  For each suffix, m is the least number of lines
that reaches ``min_chars`` (and the least that reaches ``min_words``, where
words are so short that it can come first), likewise backwards from each line; every line of a
maximal repeated run that is long enough lies in such a prefix, so overlapping
ones unite to the maximal runs.  The array is kept by classes and not as one
sorted list: no order between different lines is needed.

Only DataFrame functions are used.  Counts are aggregated before they are
shuffled and joined back by plain equi-joins, which adaptive execution splits
when one line holds much of the corpus.  Lines are compared by two
independent 64-bit hashes.

Results: null texts stay null, an empty text is one empty line, and a text
that loses all its lines becomes null.  Rows that repeat both id and text are
one document and get one result; among rows that share an id with different
texts, equal line numbers are equal places, so neither is a copy of the other.
A null id comes before all others; ids that aren't whole numbers are ordered
as their type orders them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from factlens.llm.common import without, written
from factlens.llm.running import running_totals

MIN_CHARS, MIN_WORDS = 200, 50
_CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_WORD = rf"[{_CJK}]|[^\s{_CJK}\u3000-\u303F\uFF01\uFF0C\uFF0E\uFF1A\uFF1B\uFF1F]+"
# for lines without a character from U+2E80 on, where the first of these scripts begins
_LOW_WORD, _HIGH = r"[^\s\u2E80-\x{10FFFF}]+", r"[\u2E80-\x{10FFFF}]"
_DOC = ["_id", "_h"]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.withColumn("_h", F.xxhash64(text))
    if isinstance(docs.schema[doc_id].dataType, IntegralType):
        return rows.withColumn("_id", F.col(doc_id).cast("decimal(20,0)"))
    # ids of another type (texts, say) are numbered in their own order
    ids = docs.select(F.col(doc_id).alias("_own")).filter(F.col(doc_id).isNotNull()).distinct()
    numbered = written(running_totals(ids, [], [F.asc("_own")], {"_id": F.lit(1)}), "ids")
    return rows.join(numbered.select("_own", F.col("_id").cast("decimal(20,0)").alias("_id")), F.col(doc_id) == F.col("_own"), "left").drop("_own")


def _words(line: Column) -> Column:
    """Number of words of a line; the scripts are looked up only where a line
    has characters that can be of one."""
    return F.when(line.rlike(_HIGH), F.regexp_count(line, F.lit(_WORD))).otherwise(F.regexp_count(line, F.lit(_LOW_WORD)))


def _at(doc: Column, pos: Column) -> Column:
    """One number that orders places by document and line (a null id first)."""
    first = F.coalesce(doc, F.lit("-9223372036854775809").cast("decimal(20,0)"))
    return (first * F.lit(1 << 31).cast("decimal(10,0)") + pos.cast("decimal(10,0)")).cast("decimal(38,0)")


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) if n == "_id" else left[n] == right[n] for n in names])


def _twice(rows: DataFrame, *names: str) -> DataFrame:
    """The rows whose class occurs more than once.  The classes are written
    first: a join of two plain exchanges can be split where a class is hot."""
    classes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    return rows.join(written(classes, "twice"), list(names), "left_semi")


def _runs(lines: DataFrame, min_chars: int, min_words: int) -> DataFrame:
    """(_id, _h, start, m): for each line the shortest run from it, and the
    shortest run up to it, with ``min_chars`` characters, within stretches of
    repeated lines; likewise with ``min_words`` words, in stretches with a line
    that reaches more of ``min_words`` than of ``min_chars`` (without one, no
    run has the words before the characters)."""
    by_pos = Window.partitionBy(*_DOC).orderBy("pos")
    stretch = lines.select(*_DOC, "pos", "size", "words", (F.col("pos") - F.row_number().over(by_pos)).alias("g"))
    part = Window.partitionBy(*_DOC, "g")
    wordy = F.max(F.col("words") * min_chars > F.col("size") * min_words).over(part)
    stretch = written(stretch.withColumn("wordy", wordy), "stretches")
    out = []
    for rows, size, least in ((stretch, "size", min_chars), (stretch.filter("wordy"), "words", min_words)):
        spans = rows.withColumn("end", F.sum(size).over(part.orderBy("pos"))).withColumn("off", F.col("end") - F.col(size))
        # points before queries at equal values; the last point seen is the nearest
        # (of lines without words, at one value, the one that makes the shorter run)
        for point, query, order in (("end", F.col("off") + least, F.desc), ("off", F.col("end") - least, F.asc)):
            both = spans.select(*_DOC, "g", F.col("pos"), F.inline(F.array(
                F.struct(F.col(point).alias("v"), F.lit(0).alias("q")), F.struct(query.alias("v"), F.lit(1).alias("q")))))
            near = F.last(F.when(F.col("q") == 0, F.col("pos")), ignorenulls=True).over(
                part.orderBy(order("v"), "q", order("pos")).rowsBetween(Window.unboundedPreceding, 0))
            found = both.withColumn("to", near).filter((F.col("q") == 1) & F.col("to").isNotNull())
            out.append(found.select(*_DOC, F.least("pos", "to").alias("start"), (F.abs(F.col("to") - F.col("pos")) + 1).alias("m")))
    return reduce(DataFrame.union, out).distinct()


def _double(level: DataFrame, span: int) -> DataFrame:
    """Classes of 2 * span lines from the classes of span lines."""
    ahead = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(span, span)
    pairs = level.withColumn("a2", F.first("a").over(ahead)).withColumn("b2", F.first("b").over(ahead)) \
        .filter(F.col("a2").isNotNull())
    return _twice(pairs.select(*_DOC, "pos", F.xxhash64("a", "a2").alias("a"), F.xxhash64("b", "b2").alias("b")), "a", "b")


def copied_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                 min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _h, pos): the lines (from 0) to delete."""
    line = F.col("line")
    lines = written(_keyed(docs.select(doc_id, text), doc_id, text).filter(F.col(text).isNotNull())
                    .select(*_DOC, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
                    .select(*_DOC, "pos", F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"),
                            (F.length(line) + 1).alias("size"),
                            _words(line).alias("words")).distinct(), "lines")
    lines = written(_twice(lines, "a", "b"), "repeated")
    runs = written(_runs(lines, min_chars, min_words), "runs")
    longest = runs.agg(F.max("m")).first()[0] or 0
    level, levels, span = lines.select(*_DOC, "pos", "a", "b"), [], 1
    while span <= longest:
        levels.append(level.withColumn("span", F.lit(span)))
        if 2 * span <= longest:
            level = written(_double(level, span), "classes")
        span *= 2
    if not levels:
        return runs.select(*_DOC, F.col("start").alias("pos")).limit(0)
    classes = reduce(DataFrame.unionByName, levels)
    head = classes.select("_id", "_h", F.col("pos").alias("start"), "span", F.col("a").alias("a1"), F.col("b").alias("b1"))
    tail = classes.select("_id", "_h", F.col("pos").alias("tail"), "span", F.col("a").alias("a2"), F.col("b").alias("b2"))
    r = runs.withColumn("span", F.pow(F.lit(2), F.length(F.bin("m")) - 1).cast("int")) \
        .withColumn("tail", F.col("start") + F.col("m") - F.col("span"))
    # never broadcast: runs and classes unpack to many times the size of their files (134 MB of 6)
    r = r.hint("merge").join(head, _same(r, head, "_id", "_h", "start", "span")) \
        .select(r["_id"], r["_h"], r["start"], r["m"], r["span"], r["tail"], "a1", "b1")
    r = r.hint("merge").join(tail, _same(r, tail, "_id", "_h", "tail", "span")) \
        .select(r["_id"], r["_h"], r["start"], r["m"], "a1", "b1", "a2", "b2", _at(r["_id"], r["start"]).alias("at"))
    r = written(r, "named")
    names = ["m", "a1", "b1", "a2", "b2"]
    first = r.groupBy(*names).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    copies = r.join(written(first, "first"), names).filter(F.col("at") > F.col("first"))
    return copies.select(*_DOC, F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("pos")).distinct()


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines deleted from ``text``, and ``n_lines`` (before)
    and ``n_removed``."""
    gone = copied_lines(docs, doc_id, text, min_chars, min_words).groupBy(*_DOC).agg(F.collect_list("pos").alias("_gone"))
    gone = gone.select(F.col("_id").alias("_gid"), F.col("_h").alias("_gh"), "_gone")
    rows = _keyed(without(docs, "n_lines", "n_removed"), doc_id, text)
    all_rows = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_h") == F.col("_gh")), "left")
    split = F.split(F.col(text), "\n")
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("bigint")
    removed = F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_gone"))
    left = F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    new_text = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left)
    cols = [new_text.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in rows.columns if c not in _DOC]
    return all_rows.select(*cols, n.alias("n_lines"), removed.alias("n_removed"))
