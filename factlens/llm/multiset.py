"""Document fingerprints by a homomorphic multiset hash.

A text is a multiset of paragraphs (its lines).  Each paragraph is hashed to
a wide vector and a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo a power of two, so neither order nor grouping
matters: inserting a paragraph adds its vector and deleting one subtracts it.

Lanes: 8 of 32 bits, the words of the paragraph's SHA-256 (equality); 128 of
16 bits, which for each clause of the paragraph (a piece between line ends,
full stops and commas, blanks around it cut) count the bits set in its MD5; and one
of 32 bits with the number of clauses.  From the counts and the number follow
the sums of +-1 signs, whose cosine estimates the share of clauses that two
texts have in common: the likeness.  The counts are summed in lanes of 32 bits,
two to a 64-bit word, which no string's clauses can fill; the fingerprint has
their lower 16 bits, four to a word.

Only DataFrame functions are used; no shuffle but a sum of one row for each
task and document.

Results: a null text counts as empty; an empty text is one empty paragraph
without clauses.  Texts with equal multisets of paragraphs have equal
fingerprints.  Equal fingerprints have likeness 1; else a text without
clauses has likeness 0 to any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.llm.common import written

EQUAL_LANES, WORDS = 8, 32
SUMS = 2 * WORDS
CLAUSE_ENDS = "[.,\\n]"
_PICK = 0x0001000100010001
_PICK_WIDE, _LOW = 0x0000000100000001, 0x0000FFFF0000FFFF
_VECTOR = [f"e{k}" for k in range(EQUAL_LANES)] + [f"w{k}" for k in range(SUMS)] + ["n"]


def _number(digits: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digits, start, length), 16, 10).cast("bigint")


def vectors(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each ``keys`` (no two rows of ``texts`` alike in them): the
    lanes' sums over the paragraphs of ``text`` (null: empty)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    pieces = F.concat(F.transform(F.split(whole, "\n"), lambda p: F.struct(F.lit(True).alias("whole"), p.alias("t"))),
                      F.transform(F.split(whole, CLAUSE_ENDS), lambda c: F.struct(F.lit(False).alias("whole"), F.trim(c).alias("t"))))
    rows = texts.select(*keys, F.inline(pieces)).filter(F.col("whole") | (F.col("t") != "")) \
        .select(*keys, "whole", F.when(F.col("whole"), F.sha2("t", 256)).otherwise(F.md5("t")).alias("x"))
    half = [F.shiftleft(_number(F.col("x"), 16 * k + 1, 8), 32).bitwiseOR(_number(F.col("x"), 16 * k + 9, 8)) for k in range(2)]
    numbers = [F.when(F.col("whole"), _number(F.col("x"), 8 * k + 1, 8)).otherwise(0).alias(f"e{k}") for k in range(EQUAL_LANES)]
    numbers += [F.when(F.col("whole"), F.lit(0)).otherwise(h).alias(f"h{k}") for k, h in enumerate(half)]
    rows = rows.select(*keys, *numbers, F.when(F.col("whole"), 0).otherwise(1).alias("n"))
    return rows.groupBy(*keys).agg(
        *[F.sum(f"e{k}").bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"e{k}") for k in range(EQUAL_LANES)],
        *[F.sum(F.shiftrightunsigned(f"h{k // 32}", k % 32).bitwiseAND(F.lit(_PICK_WIDE))).alias(f"w{k}") for k in range(SUMS)],
        F.sum("n").alias("n"))


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``vectors`` in half the space: the 32-bit words two to a number, the
    counts' lower 16 bits four to a number, and ``over``, the counts' upper 16
    bits (two numbers for each of those, lanes 0 and 2, then 1 and 3), null
    where all are 0."""
    pairs = [F.shiftleft(F.col(f"e{2 * k}"), 32).bitwiseOR(F.col(f"e{2 * k + 1}")).alias(f"p{k}") for k in range(EQUAL_LANES // 2)]
    at = [32 * (k // 16) + k % 16 for k in range(WORDS)]
    high = [F.shiftrightunsigned(f"w{j}", 16).bitwiseAND(F.lit(_LOW)) for j in range(SUMS)]
    over = F.array(*[h for k in at for h in (high[k], high[k + 16])])
    some = reduce(lambda a, b: a.bitwiseOR(b), high) != 0
    low = [F.col(f"w{k}").bitwiseAND(F.lit(_LOW)).bitwiseOR(F.shiftleft(F.col(f"w{k + 16}").bitwiseAND(F.lit(_LOW)), 16)).alias(f"c{j}")
           for j, k in enumerate(at)]
    return rows.select(*keys, *pairs, *low, "n", F.when(some, over).alias("over"))


def packed_digest(lanes: str) -> Column:
    """``digest`` of a struct of ``packed`` lanes; signs in the packed order."""
    v = F.col(lanes)
    digits = F.lower(F.concat(*[F.lpad(F.hex(v[f"p{k}"]), 16, "0") for k in range(EQUAL_LANES // 2)],
                              *[F.lpad(F.hex(v[f"c{k}"]), 16, "0") for k in range(WORDS)], F.lpad(F.hex(v["n"]), 8, "0")))
    over = F.coalesce(v["over"], F.array_repeat(F.lit(0).cast("bigint"), SUMS))
    # (word of counts, upper bits of its lanes 0 and 2, of its lanes 1 and 3)
    words = F.array(*[F.struct(v[f"c{k}"].alias("c"), F.get(over, F.lit(2 * k)).alias("a"), F.get(over, F.lit(2 * k + 1)).alias("b"))
                      for k in range(WORDS)])

    def count(w, k):
        high = F.shiftrightunsigned(w["a"] if k % 2 == 0 else w["b"], 32 * (k // 2)).bitwiseAND(F.lit(0xFFFF))
        return F.shiftrightunsigned(w["c"], 16 * k).bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(high, 16)

    counts = F.flatten(F.transform(words, lambda w: F.array(*[count(w, k) for k in range(4)])))
    return F.struct(digits.alias("fingerprint"), F.transform(counts, lambda c: c * 2 - v["n"]).alias("signs"))


def fingerprint(v: Column) -> Column:
    """The lanes (fields of ``v``) as hexadecimal digits."""
    def word(k: int) -> Column:  # four counts modulo 2^16
        at = 32 * (k // 16) + k % 16
        return v[f"w{at}"].bitwiseAND(F.lit(_LOW)).bitwiseOR(F.shiftleft(v[f"w{at + 16}"].bitwiseAND(F.lit(_LOW)), 16))

    return F.lower(F.concat(*[F.lpad(F.hex(v[f"e{k}"]), 8, "0") for k in range(EQUAL_LANES)],
                            *[F.lpad(F.hex(word(k)), 16, "0") for k in range(WORDS)], F.lpad(F.hex(v["n"]), 8, "0")))


def signs(v: Column) -> Column:
    """Sums of signs: the number of set bits less that of unset bits, for 128 bits."""
    words = F.array(*[v[f"w{k}"] for k in range(SUMS)])
    counts = F.flatten(F.transform(words, lambda w: F.array(*[F.shiftrightunsigned(w, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(2)])))
    return F.transform(counts, lambda c: c * 2 - v["n"])


def digest(lanes: str) -> Column:
    """Struct of fingerprint and signs of a struct of lanes."""
    v = F.col(lanes)
    return F.struct(fingerprint(v).alias("fingerprint"), signs(v).alias("signs"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def likeness(a: str, b: str) -> Column:
    """Likeness (0 to 1) of two fingerprints, given as ``digest`` structs."""
    x, y = F.col(a), F.col(b)
    size = F.sqrt(_dot(x["signs"], x["signs"]) * _dot(y["signs"], y["signs"]))
    cosine = F.when(size > 0, F.greatest(F.lit(0.0), _dot(x["signs"], y["signs"]) / size)).otherwise(0.0)
    return F.when(x["fingerprint"] == y["fingerprint"], 1.0).otherwise(F.least(F.lit(1.0), cosine))


def successors(ids: DataFrame, key: str) -> DataFrame:
    """(key, next): for each value the next larger one, for the largest the
    smallest (nulls first).  Values are sorted into ranges and written; the
    ranges' first values, one row for each range, close the gaps."""
    ranges = written(ids.select(key).distinct().repartitionByRange(F.asc_nulls_first(key)).select(
        key, F.spark_partition_id().alias("part")), "ranges")
    order = Window.partitionBy("part").orderBy(F.asc_nulls_first(key))
    inner = ranges.withColumn("_next", F.lead(F.struct(key)).over(order))
    firsts = ranges.groupBy("part").agg(F.min(F.struct(F.col(key).isNotNull().alias("o"), F.col(key).alias("k"))).alias("first"))
    every = Window.orderBy("part")
    firsts = firsts.withColumn("after", F.coalesce(F.lead("first").over(every), F.first("first").over(
        every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))).select("part", F.col("after.k").alias("after"))
    return inner.join(firsts, "part").select(
        key, F.when(F.col("_next").isNull(), F.col("after")).otherwise(F.col(f"_next.{key}")).alias("next"))


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of ``docs``: doc_id, n_chars, the edited text (the last
    quarter of the characters replaced by the first as many of the next
    document, by id), and ``own``, ``edited_digest`` and ``next_digest``.

    Rows that share an id are told apart by a number in the order of their
    texts' hashes; all have the first row of the next id as their next
    document.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    key = F.struct(F.col(doc_id).alias("id"))  # equal for two null ids, so plain equi-joins do
    order = Window.partitionBy("k").orderBy("h")
    # one exchange of the texts by key serves both joins and the sums: the window
    # isn't limited to rn = 1 and the joins have the key alone
    rows = docs.select(key.alias("k"), F.xxhash64(whole).alias("h"), whole.alias("text")).withColumn("rn", F.row_number().over(order))
    chars = docs.select(key.alias("k"), F.xxhash64(whole).alias("h"), F.length(whole).alias("n")).withColumn("rn", F.row_number().over(order))
    nexts = successors(docs.select(F.col(doc_id).alias("id")), "id").select(
        F.struct("id").alias("k"), F.struct(F.col("next").alias("id")).alias("next"))
    wanted = chars.join(nexts, "k").select("next", F.col("k").alias("to"), F.col("rn").alias("to_rn"), F.floor(F.col("n") / 4).cast("int").alias("size"))
    given = rows.filter(F.greatest(F.col("rn"), F.lit(1)) == 1).join(wanted, F.col("k") == F.col("next")) \
        .select("to", "to_rn", "next", "size", F.substring("text", F.lit(1), F.col("size")).alias("given"))
    both = rows.join(given, (F.col("k") == F.col("to")) & (F.col("rn") - F.col("to_rn") == 0)) \
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("size")), "given"))
    kinds = F.inline(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text")),
                             F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text"))))
    keys = ["k", "rn", "next", "is_edited", "n_chars", "edited_sha256"]
    texts = both.select("k", "rn", "next", F.length("text").cast("bigint").alias("n_chars"),
                        F.sha2("edited", 256).alias("edited_sha256"), "text", "edited") \
        .select("k", "rn", "next", "n_chars", "edited_sha256", kinds)
    found = written(packed(vectors(texts, keys, "text"), keys), "vectors")
    lanes = F.struct(*[c for c in found.columns if c not in keys]).alias("v")
    own = found.filter(~F.col("is_edited")).select("k", "rn", "next", "n_chars", "edited_sha256", lanes)
    edited = found.filter("is_edited").select(F.col("k").alias("_k"), F.col("rn").alias("_rn"), lanes)
    after = own.filter(F.col("rn") == 1).select(F.col("k").alias("_next"), "v")
    all_three = own.withColumnRenamed("v", "own") \
        .join(edited.withColumnRenamed("v", "edited_digest"), (F.col("k") == F.col("_k")) & (F.col("rn") == F.col("_rn"))) \
        .join(after.withColumnRenamed("v", "next_digest"), F.col("next") == F.col("_next"))
    return all_three.select(F.col("k.id").alias("doc_id"), "n_chars", "edited_sha256",
                            *[packed_digest(c).alias(c) for c in ("own", "edited_digest", "next_digest")])
