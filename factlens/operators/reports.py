"""Reports over run summaries: results table, facet series, gains, contrasts,
category comparison.  Inputs are summary-sized (grid x slices), outputs are
small tables; the only driver-side step is rendering a bounded table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.operators.bootstrap import mean_band
from factlens.operators.runs import adjust_p1

# fixed values: results-table rows (corpus, relation slice)
TABLE_ROWS = [
    ("Google_RE", "place-of-birth"), ("Google_RE", "date-of-birth"), ("Google_RE", "place-of-death"),
    ("Google_RE", "total"),
    ("TREx", "1-1"), ("TREx", "N-1"), ("TREx", "N-M"), ("TREx", "total"),
    ("ConceptNet", "total"),
]
# fixed values: results-table columns, baselines first:
# (label, model, num_examples, use_close_examples, only seed, constant values by (corpus, slice))
TABLE_COLUMNS = [
    ("Bb", "bert-base-cased", 0, False, 0, None),
    ("Bl", "bert-large-cased", 0, False, 0, None),
    ("Al", "albert-xxlarge-v2", 0, True, 0, None),
    ("Bb$_{opt}$", None, None, None, None, {("Google_RE", "total"): 0.104, ("TREx", "total"): 0.396}),
    ("Bl$_{opt}$", None, None, None, None, {("Google_RE", "total"): 0.113, ("TREx", "total"): 0.439}),
    ("Bb$^3$", "bert-base-cased", 3, False, None, None),
    ("Bb$^{10}$", "bert-base-cased", 10, False, None, None),
    ("Bb$^{10}_{ce}$", "bert-base-cased", 10, True, None, None),
    ("Bl$^{3}$", "bert-large-cased", 3, False, None, None),
    ("Bl$^{10}$", "bert-large-cased", 10, False, None, None),
    ("Bl$^{10}_{ce}$", "bert-large-cased", 10, True, None, None),
    ("Al$^{10}_{ce}$", "albert-xxlarge-v2", 10, True, None, None),
]
SHADE_TOP = 1.6

CELL_SCHEMA = ("row_idx bigint, corpus string, slice string, data_label string, col_idx bigint, label string, "
               "model string, num_examples bigint, use_close_examples boolean, only_seed bigint, const double")


def table_cells() -> list[tuple]:
    cells = []
    for ri, (corpus, sl) in enumerate(TABLE_ROWS):
        data_label = corpus if sl == "total" else f"{corpus}_{sl}"
        for ci, (label, model, k, ce, seed, const) in enumerate(TABLE_COLUMNS):
            c = None if const is None else const.get((corpus, sl))
            cells.append((ri, corpus, sl, data_label, ci, label, model, k, ce, seed, c))
    return cells


def results_table(spark: SparkSession, summary: DataFrame, metric: str = "p_at_1") -> DataFrame:
    """Long form of the paper's results table: one row per (table row, column)
    with the mean over seeds, the sample std (NULL for a single run), whether
    it is the row's best value and its shade in [min positive, 1.6 * max]."""
    cells = F.broadcast(spark.createDataFrame(table_cells(), CELL_SCHEMA))
    s = summary.filter(F.col("priming_type") == "nl").select(
        F.col("data").alias("data_label"), "model", "num_examples", "use_close_examples",
        "random_seed", F.col(metric).alias("v"))
    j = s.join(cells.filter(F.col("model").isNotNull()), ["data_label", "model", "num_examples", "use_close_examples"])
    j = j.filter(F.col("only_seed").isNull() | (F.col("only_seed") == F.col("random_seed")))
    agg = j.groupBy("row_idx", "col_idx").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"),
                                             F.count("v").alias("n_runs"))
    full = cells.join(agg, ["row_idx", "col_idx"], "left")
    value = F.coalesce(F.col("const"), F.col("mean"))
    full = full.select("row_idx", "corpus", "slice", "col_idx", "label", value.alias("value"),
                       F.when(F.col("n_runs") > 1, F.col("sd")).alias("std"),
                       F.coalesce(F.col("n_runs"), F.lit(0)).cast("bigint").alias("n_runs"))
    w = Window.partitionBy("row_idx")
    mx = F.max("value").over(w)
    mn = F.min(F.when(F.col("value") > 0, F.col("value"))).over(w)
    return full.withColumn("is_best", F.coalesce(F.col("value") == mx, F.lit(False))) \
               .withColumn("shade", (F.col("value") - mn) / (F.lit(SHADE_TOP) * mx - mn))


def render_results_table(cells: DataFrame) -> str:
    """LaTeX rendering of the (at most 9 x 12 cell) results table: the one
    place where rows are collected, and their number is fixed."""
    rows = sorted(cells.collect(), key=lambda r: (r.row_idx, r.col_idx))
    by_row: dict[int, list] = {}
    for r in rows:
        by_row.setdefault(r.row_idx, []).append(r)
    lines = []
    for ri, rs in sorted(by_row.items()):
        vals = []
        for r in rs:
            if r.value is None:
                vals.append("-")
                continue
            v = f"{r.value * 100:.1f}"
            if r.is_best:
                v = f"\\textbf{{{v}}}"
            if r.std is not None and r.std > 0:
                v += f" $_{{\\pm {r.std * 100:.1f}}}$"
            vals.append(v)
        lines.append(f"{rs[0].corpus} & {rs[0].slice} & " + " & ".join(vals) + " \\\\")
    header = "Corpus & Relation & " + " & ".join(c[0] for c in TABLE_COLUMNS) + " \\\\"
    return "\n".join([header] + lines)


FACET = ["data", "priming_type", "use_close_examples"]


def facet_series(summary: DataFrame, metric: str = "p_at_1") -> DataFrame:
    """Line series per facet (data x priming x pool mode) and model over the
    number of examples: mean, sample std and count over seeds; the model's
    baseline (the k = 0 run with the smallest seed); the model's first x and
    the facet's last x.  Facets in which no model has a baseline are dropped."""
    s = _scored(summary, metric)
    first = F.min_by(F.when(F.col("num_examples") == 0, F.col("v")), F.when(F.col("num_examples") == 0, F.col("random_seed")))
    series = s.groupBy(*FACET, "model", "num_examples").agg(
        F.avg("v").alias("mean_p1"), F.stddev_samp("v").alias("std_p1"), F.count(F.lit(1)).alias("n_runs"), first.alias("_base"))
    # a facet's series are a few rows of the grid
    facet, line = Window.partitionBy(*FACET), Window.partitionBy(*FACET, "model")
    out = series.withColumn("x_max", F.max("num_examples").over(facet)).withColumn("_any", F.max(F.col("num_examples") == 0).over(facet)) \
        .withColumn("x_min", F.min("num_examples").over(line)).withColumn("baseline_p1", F.max("_base").over(line))
    return out.filter("_any").drop("_any", "_base")


def _scored(summary: DataFrame, metric: str) -> DataFrame:
    return adjust_p1(summary).withColumn("v", F.col("p_at_1_adj") if metric == "p_at_1" else F.col(metric))


def facet_bands(summary: DataFrame, metric: str = "p_at_1", replicates: int = 200) -> DataFrame:
    """The intervals of ``facet_series``' means over seeds, by bootstrap."""
    run = F.concat_ws("|", *FACET, "model", "num_examples", "random_seed")
    return mean_band(_scored(summary, metric), [*FACET, "model", "num_examples"], "v", run, replicates)


def relation_gains(rel_metrics: DataFrame, relations: DataFrame, ks: tuple[int, ...] = (0, 1, 3, 10),
                   metric: str = "p_at_1", rank_digits: int = 9) -> DataFrame:
    """Per relation: metric gain of k examples over none, for each k > 0,
    ranked by the gain of the largest k (descending; gains equal to
    ``rank_digits`` decimals tie and fall back to the relation id)."""
    piv = rel_metrics.groupBy("rel").pivot("num_examples", list(ks)).agg(F.first(metric))
    base = F.col(str(ks[0]))
    out = piv.select("rel", *[(F.col(str(k)) - base).alias(f"gain_{k}") for k in ks[1:]])
    disp = F.replace(F.replace(F.col("template"), F.lit("[X]"), F.lit("[s]")), F.lit("[Y]"), F.lit("[o]"))
    out = out.join(relations.select("rel", disp.alias("template")), "rel", "left")
    last = f"gain_{ks[-1]}"
    # ranking a relation-level table (bounded by the relation catalogue)
    w = Window.orderBy(F.round(F.col(last), rank_digits).desc_nulls_last(), F.col("rel"))
    return out.withColumn("gain_rank", F.row_number().over(w).cast("bigint"))


def gains_lines(gains: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """'rel & template & g1 & g3 & g10 \\\\' lines (values x100, one decimal)."""
    fmt = "%s & %s" + " & %.1f" * len(ks) + " \\\\"
    return gains.select("gain_rank", F.format_string(fmt, "rel", "template",
                        *[F.col(f"gain_{k}") * 100 for k in ks]).alias("line"))


def contrast(rows: DataFrame, run: Column) -> DataFrame:
    """Examples where the answer is not in the first run's top 3, exactly at
    rank 2 in the second run and at rank 1 in the third and fourth
    (case-sensitive).  ``rows`` are (uuid, y, preds, probs), ``run`` gives each
    its run's number (0 to 3; null: none of them); one row for each uuid and
    run, aligned on uuid by one aggregate."""
    of = [F.when(F.col("_run") == i, F.struct("preds", "probs")) for i in range(4)]
    j = rows.withColumn("_run", run).filter(F.col("_run").isNotNull()).groupBy("uuid").agg(
        F.max(F.when(F.col("_run") == 0, F.col("y"))).alias("y"), *[F.max(x).alias(f"_{i}") for i, x in enumerate(of)])
    j = reduce(DataFrame.filter, [F.col(f"_{i}").isNotNull() for i in range(4)], j)
    j = j.select("uuid", "y", *[c for i in range(4) for c in (F.col(f"_{i}.preds").alias(f"p{i}"), F.col(f"_{i}.probs").alias(f"q{i}"))])
    cond = (~F.coalesce(F.array_contains(F.slice("p0", 1, 3), F.col("y")), F.lit(False))) \
        & (F.array_position("p1", F.col("y")) == 2) & (F.array_position("p2", F.col("y")) == 1) \
        & (F.array_position("p3", F.col("y")) == 1)
    return j.filter(cond)


# fixed values: GloVe hits per BATS category (P@1 = hits / 667)
GLOVE_HITS = [
    ("I01", 558), ("I02", 416), ("I03", 469), ("I04", 385), ("I05", 458),
    ("I06", 468), ("I07", 343), ("I08", 308), ("I09", 312), ("I10", 312),
    ("D01", 5), ("D02", 170), ("D03", 165), ("D04", 41), ("D05", 58),
    ("D06", 127), ("D07", 28), ("D08", 25), ("D09", 71), ("D10", 75),
    ("L01", 45), ("L02", 31), ("L03", 39), ("L04", 41), ("L05", 22),
    ("L06", 21), ("L07", 78), ("L08", 97), ("L09", 142), ("L10", 245),
    ("E01", 652), ("E02", 211), ("E03", 333), ("E04", 225), ("E05", 250),
    ("E06", 9), ("E07", 12), ("E08", 6), ("E09", 141), ("E10", 290),
]
CATEGORY_ORDER = ["I", "D", "L", "E"]


def category_compare(model_rows: DataFrame, names: DataFrame, solvable: DataFrame, share_model: str,
                     baseline: DataFrame) -> DataFrame:
    """Per-category P@1 of a model next to the GloVe baseline (category,
    p_at_1: ``read_baseline_counts``), with the category's full name, its
    solvable share (kept for ``share_model`` only, 0 for the others) and the
    custom I, D, L, E order."""
    glove = baseline.select("category", F.lit("GloVe").alias("model"), "p_at_1")
    rows = model_rows.select("category", "model", "p_at_1").unionByName(glove)
    j = rows.join(names, "category", "left").join(solvable, "category", "left")
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.substring("category", 1, 1))
    return j.select("category", F.coalesce("name", "category").alias("name"), "model", "p_at_1",
                    F.when(F.col("model") == share_model, F.coalesce(F.col("share"), F.lit(0.0)))
                     .otherwise(F.lit(0.0)).alias("solvable_share"),
                    order.cast("bigint").alias("order_idx"))


# fixed values: display names of models, priming formats and metrics
MODEL_LABELS = {"bert-base-cased": "bert-base", "bert-large-cased": "bert-large", "bert-base-uncased": "bert-base",
                "bert-large-uncased": "bert-large", "albert-xxlarge-v2": "albert-xxlarge"}
PRIMING_LABELS = {"nl": "NL Template", "Rarr": "[s] => [o]", "rarr": "[s] -> [o]", "par": "([s]; [o])"}
METRIC_LABELS = {"p_at_1": "P@1", "mrr": "MRR", "target_likelihood": "Avg. Probability"}


def display_label(c, mapping: dict, unknown: str = "keep"):
    """Map names to display labels: unknown names stay as they are
    (``unknown='keep'``, legends) or become '' (``unknown='empty'``, titles)."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    fallback = c if unknown == "keep" else F.lit("")
    return F.coalesce(F.element_at(m, c), fallback)
