"""Prompt construction with in-context examples.

For each example, ``min(k, pool size)`` pool examples are drawn uniformly
*with replacement* from the same relation, excluding every example of the
example's own subject (as the reference does), and written before the
example's own prompt.

Drawing without a quadratic join: the pool of a relation is numbered
0..n-1 ordered by (subj, uuid), so a subject's rows form one contiguous run
[lo, lo + own).  A draw u in [0, n - own) then maps to pool row
u + (u >= lo ? own : 0), an equi-join on (rel, idx).  Work is O(rows * k).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions.hashing import h32
from factlens.operators.indexing import group_index, spread_work
from factlens.session import bounded_broadcast, ensure_checkpoint_dir

MASK = "[MASK]"
MAX_RELATIONS = 100_000
# fixed values: symbolic priming formats and their short names in run paths
PRIMING_FORMATS = {"{} -> {}": "rarr", "{} => {}": "Rarr", "({}; {})": "par"}


def format_pair(template: str, a: Column, b: Column) -> Column:
    """``template.format(a, b)`` for a template with exactly two ``{}``."""
    parts = template.split("{}")
    if len(parts) != 3:
        raise ValueError("the template requires exactly two '{}'")
    return F.concat(F.lit(parts[0]), a, F.lit(parts[1]), b, F.lit(parts[2]))


def slots(count: Column) -> Column:
    """Array 0..count-1 (empty when count <= 0; sequence(0, -1) counts down)."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def index_pool(pool: DataFrame) -> DataFrame:
    """Number each relation's pool 0..n-1 by (subj, uuid); add n per relation and
    the subject run (lo, own)."""
    idx = group_index(pool, ["rel"], ["subj", "uuid"])
    sizes = bounded_broadcast(idx.groupBy("rel").agg(F.count(F.lit(1)).alias("n")), MAX_RELATIONS)
    runs = idx.groupBy("rel", "subj").agg(F.min("idx").alias("lo"), F.count(F.lit(1)).alias("own"))
    # the numbered pool is read twice (draw bounds, row lookup): checkpoint it to
    # the shared folder so it is computed once and survives executor loss
    ensure_checkpoint_dir(pool.sparkSession)
    return idx.join(sizes, "rel").join(runs, ["rel", "subj"]).checkpoint()


def draw_random(examples: DataFrame, k: int, seed: int, index: DataFrame | None = None) -> DataFrame:
    """Draws ``(uuid, rel, subj, y, j, idx)``: slot j of an example points to
    pool row idx of its relation.  ``index`` is a precomputed
    ``index_pool(examples)`` (e.g. a stored table shared by several runs)."""
    ix = index if index is not None else index_pool(examples)
    m = F.col("n") - F.col("own")
    rows = spread_work(ix.select("uuid", "rel", "subj", "y", "lo", "own", m.alias("m"), "idx"), ix.count(), "idx")
    d = rows.select("uuid", "rel", "subj", "y", "lo", "own", "m",
                  F.explode(slots(F.least(F.lit(k), F.col("m")))).alias("j"))
    u = F.pmod(h32("uuid", "y", F.lit(seed), "j"), F.col("m"))
    return d.select("uuid", "rel", "subj", "y", "j",
                    (u + F.when(u >= F.col("lo"), F.col("own")).otherwise(0)).alias("idx")), ix


def draw_from_pool(examples: DataFrame, index: DataFrame, k: int, seed: int) -> DataFrame:
    """``draw_random`` for examples that need not be in the pool: ``index`` is
    ``index_pool`` of the pool, an example's own subject is left out where the
    pool has it, and an example of a relation without a pool draws nothing."""
    sizes = index.groupBy("rel").agg(F.max("n").alias("n"))
    runs = index.groupBy("rel", "subj").agg(F.min("lo").alias("lo"), F.max("own").alias("own"))
    none = F.lit(0).cast("bigint")
    e = examples.select("uuid", "rel", "subj").join(bounded_broadcast(sizes, MAX_RELATIONS), "rel").join(runs, ["rel", "subj"], "left") \
        .withColumns({"lo": F.coalesce("lo", none), "own": F.coalesce("own", none)}).withColumn("m", F.col("n") - F.col("own"))
    d = e.withColumn("j", F.explode(slots(F.least(F.lit(k), F.col("m")))))
    u = F.pmod(h32("uuid", F.lit(seed), "j"), F.col("m"))
    return d.select("uuid", "rel", "subj", "j", (u + F.when(u >= F.col("lo"), F.col("own")).otherwise(0)).alias("idx"))


def pick_answer(answers: Column, seed: int, *ident) -> Column:
    """One answer of a list, chosen by hash (a plain string passes through)."""
    n = F.size(answers)
    return F.element_at(answers, (F.pmod(h32(*ident, F.lit(seed)), n) + 1).cast("int"))


def assemble(examples: DataFrame, lines: DataFrame, last_line: Column, key: str = "uuid") -> DataFrame:
    """Join drawn lines (key, j, line) in slot order, then the example's own line."""
    g = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("j", "line"))).alias("_l"),
                               F.count(F.lit(1)).alias("n_primes"))
    j = examples.join(g, key, "left")
    body = F.array_join(F.col("_l.line"), "\n")
    primed = F.when(F.col("_l").isNull(), last_line).otherwise(F.concat(body, F.lit("\n"), last_line))
    return j.withColumn("x_primed", primed).withColumn(
        "n_primes", F.coalesce(F.col("n_primes"), F.lit(0)).cast("bigint")).drop("_l")


def nl_line(x: Column, y: Column) -> Column:
    """A pool example as a statement: its mask replaced by its answer."""
    return F.when(F.instr(x, MASK) > 0, F.replace(x, F.lit(MASK), y)).otherwise(
        F.raise_error(F.concat(F.lit("no mask in pool example: "), x)))


def prime_random(examples: DataFrame, k: int, seed: int, priming: str = "nl",
                 index: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:
    """``x_primed`` for every example, pool = same relation, other subjects.

    The pool is the examples themselves, or ``pool`` where only some of them
    (or others) may be drawn: e.g. rows without an allowed answer are primed
    but never drawn.

    ``priming`` is 'nl' (natural-language statements, then the own prompt)
    or a two-slot format such as '{} -> {}' (pairs, then subject -> [MASK]
    and a trailing newline).  ``y`` may be a string or an array of answers.
    """
    if pool is None:
        draws, ix = draw_random(examples, k, seed, index)
    else:
        ix = index if index is not None else index_pool(pool)
        draws = draw_from_pool(examples, ix, k, seed)
    numbered = ix.select("rel", "idx", F.col("subj").alias("p_subj"), F.col("y").alias("p_y"),
                     F.col("x").alias("p_x"), F.col("uuid").alias("p_uuid"))
    j = draws.join(numbered, ["rel", "idx"])
    if priming == "nl":
        line = nl_line(F.col("p_x"), F.col("p_y"))
        last = F.col("x")
    else:
        ans = F.col("p_y")
        if dict(examples.dtypes).get("y", "string").startswith("array"):
            ans = pick_answer(F.col("p_y"), seed, "uuid", "j")
        line = format_pair(priming, F.col("p_subj"), ans)
        last = F.concat(format_pair(priming, F.col("subj"), F.lit(MASK)), F.lit("\n"))
    lines = j.select("uuid", "j", line.alias("line"))
    return assemble(examples, lines, last)


def prime_from_pool(examples: DataFrame, pool_subjects: DataFrame, k: int, seed: int,
                    priming: str = "nl") -> DataFrame:
    """Priming from a per-subject pool (close examples).

    ``pool_subjects`` has ``rel, subj, cand, pos``; the pool of (rel, subj)
    is every example of its candidate subjects other than itself, in
    (pos, y, uuid) order.  A draw u in [0, pool size) is located with the
    running totals of the (few) candidate subjects, then fetched from the
    candidate's own numbered examples: no pool is ever materialised, so a
    candidate with very many examples costs nothing extra.
    """
    ex = examples.select("rel", "subj", "uuid", "x", "y")
    sub_idx = group_index(ex, ["rel", "subj"], ["y", "uuid"], "sidx")
    counts = ex.groupBy("rel", F.col("subj").alias("cand")).agg(F.count(F.lit(1)).alias("c"))
    ps = pool_subjects.filter(F.col("cand") != F.col("subj")).join(counts, ["rel", "cand"])
    w = Window.partitionBy("rel", "subj").orderBy("pos", "cand").rowsBetween(Window.unboundedPreceding, -1)
    ps = ps.withColumn("off", F.coalesce(F.sum("c").over(w), F.lit(0)))
    sizes = ps.groupBy("rel", "subj").agg(F.sum("c").alias("m"))
    e = examples.join(sizes, ["rel", "subj"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    d = e.select("uuid", "rel", "subj", "y", "m", F.explode(slots(F.least(F.lit(k), F.col("m")))).alias("j"))
    d = d.withColumn("u", F.pmod(h32("uuid", "y", F.lit(seed), "j"), F.col("m")))
    located = d.join(ps.select("rel", "subj", "cand", "off", "c"), ["rel", "subj"]) \
        .filter((F.col("u") >= F.col("off")) & (F.col("u") < F.col("off") + F.col("c"))) \
        .withColumn("sidx", F.col("u") - F.col("off"))
    cand = sub_idx.select("rel", F.col("subj").alias("cand"), "sidx",
                          F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    j = located.join(cand, ["rel", "cand", "sidx"])
    if priming == "nl":
        line, last = nl_line(F.col("p_x"), F.col("p_y")), F.col("x")
    else:
        line = format_pair(priming, F.col("cand"), F.col("p_y"))
        last = F.concat(format_pair(priming, F.col("subj"), F.lit(MASK)), F.lit("\n"))
    return assemble(examples, j.select("uuid", "j", line.alias("line")), last)
