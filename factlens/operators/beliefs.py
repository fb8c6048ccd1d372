"""Object -> location beliefs from logs of attempts.

The reference keeps a pandas object x container matrix per episode and
updates it one step at a time.  Here every step is a relation over tables:
the grid is a join of a scene's objects and containers, priors are column
arithmetic, choices are grouped arg-max / inverse-CDF draws, and the
update is a closed form over the attempt log (see ``update``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlens.functions.hashing import TWO_POW_32, h32
from factlens.operators.nearest import nearest_texts
from factlens.operators.priming import format_pair, slots
from factlens.session import bounded_broadcast

OBJECT_TYPES = ["o", "f"]
CONTAINER_TYPES = ["c", "s"]
PRIOR_FLOOR = 0.0001
MAX_CATALOGUE = 1_000_000
# fixed values: priming templates by name
TEMPLATES = {"arrow": "{} -> {}", "semicolon": "{}; {}", "nl": "{} belongs to {}"}

# fixed value: the example of a scene for which the catalogue has none
FALLBACK_PAIR = ("butter", "fridge")

CATALOGUE_TYPE = "map<string, struct<type: string, locations: array<string>>>"


def read_catalogue(spark: SparkSession, json_text: str, types=OBJECT_TYPES) -> DataFrame:
    """Object catalogue from its JSON text (name -> {type, locations}),
    keeping the given types: (name, type, locations)."""
    df = spark.range(1).select(F.explode(F.from_json(F.lit(json_text), CATALOGUE_TYPE)).alias("name", "v"))
    return df.select("name", F.col("v.type").alias("type"), F.col("v.locations").alias("locations")) \
             .filter(F.col("type").isin(*types))


def entities(scene_facts: DataFrame, types: list[str]) -> DataFrame:
    """Distinct (scene, name, type) over the typed arguments of all facts."""
    a = scene_facts.select("scene", F.explode("facts").alias("f")) \
                   .select("scene", F.explode("f.arguments").alias("a"))
    return a.select("scene", F.col("a.name").alias("name"), F.col("a.type").alias("type")) \
            .filter(F.col("type").isin(*types)).distinct()


def grid(objects: DataFrame, containers: DataFrame) -> DataFrame:
    """(scene, obj, container) for every object and container of a scene:
    the belief matrix itself, so its size is the output size."""
    return objects.select("scene", F.col("name").alias("obj")).join(
        containers.select("scene", F.col("name").alias("container")), "scene")


def uniform_prior(g: DataFrame) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy("scene", "obj"))
    return g.withColumn("p", F.lit(1.0) / n)


def scored_prior(scores: DataFrame) -> DataFrame:
    """Scorer probabilities plus a small floor, not renormalised (as the
    reference); ``p_norm`` is the row-normalised view used for choices."""
    p = F.col("score") + F.lit(PRIOR_FLOOR)
    return scores.withColumn("p", p).withColumn(
        "p_norm", F.col("p") / F.sum("p").over(Window.partitionBy("scene", "obj")))


def greedy_choice(prior: DataFrame) -> DataFrame:
    """Arg-max container per (scene, obj); ties go to the smaller name."""
    return prior.groupBy("scene", "obj").agg(
        F.min_by("container", F.struct(-F.col("p"), F.col("container"))).alias("greedy"))


def sampled_choice(prior: DataFrame, seed: int) -> DataFrame:
    """Container drawn with probability p / sum(p): inverse CDF over the
    containers in name order against a hash-uniform number."""
    w = Window.partitionBy("scene", "obj").orderBy("container")
    tot = F.sum("p").over(Window.partitionBy("scene", "obj"))
    c = prior.withColumn("_cum", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)) / tot) \
             .withColumn("_u", h32(F.lit("choice"), "scene", "obj", F.lit(seed)) / F.lit(TWO_POW_32))
    return c.filter(F.col("_cum") > F.col("_u")).groupBy("scene", "obj").agg(
        F.min_by("container", "_cum").alias("sampled"))


def attempt_outcomes(attempts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds ``success``: the container is one of the object's known
    locations; an object missing from the catalogue counts as a success."""
    cat = bounded_broadcast(catalogue.select(F.col("name").alias("obj"), "locations"), MAX_CATALOGUE)
    j = attempts.join(cat, "obj", "left")
    return j.withColumn("success", F.coalesce(F.array_contains("locations", F.col("container")), F.lit(True))) \
            .drop("locations")


def update(prior: DataFrame, outcomes: DataFrame, order: list[str]) -> DataFrame:
    """Beliefs after all attempts, in closed form.

    Success depends only on (obj, container), and zeroing a cell then
    renormalising commutes, so per (scene, obj): any success -> one-hot at
    the latest successful container; otherwise every tried container is
    zeroed and the row divided by what remains (NULL when nothing remains);
    no attempt -> the prior unchanged.  One grouped aggregate and one
    window over a (bounded) row of the matrix; no step-by-step replay.
    """
    key = F.struct(*[F.col(c) for c in order])
    cell = outcomes.groupBy("scene", "obj", "container").agg(
        F.lit(True).alias("tried"), F.max(F.when(F.col("success"), key)).alias("_last_ok"))
    best = cell.filter(F.col("_last_ok").isNotNull()).groupBy("scene", "obj").agg(
        F.max_by("container", "_last_ok").alias("_stored_in"))
    j = prior.join(cell.select("scene", "obj", "container", "tried"), ["scene", "obj", "container"], "left") \
             .join(best, ["scene", "obj"], "left")
    w = Window.partitionBy("scene", "obj")
    remaining = F.sum(F.when(F.col("tried").isNull(), F.col("p")).otherwise(F.lit(0.0))).over(w)
    any_tried = F.max(F.col("tried").isNotNull().cast("int")).over(w) == 1
    p = (F.when(F.col("_stored_in").isNotNull(),
                F.when(F.col("container") == F.col("_stored_in"), F.lit(1.0)).otherwise(F.lit(0.0)))
          .when(any_tried, F.when(remaining > 0, F.when(F.col("tried").isNull(), F.col("p") / remaining)
                                  .otherwise(F.lit(0.0))))
          .otherwise(F.col("p")))
    state = F.when(F.col("_stored_in").isNotNull(), F.lit("stored")).when(any_tried, F.lit("updated")) \
             .otherwise(F.lit("prior"))
    return j.select("scene", "obj", "container", p.alias("p"), state.alias("state"))


def adaptive_priming(scene_objects: DataFrame, scene_containers: DataFrame, catalogue: DataFrame,
                     n: int, template: str, seed: int, max_lines: int = 100,
                     fallback: tuple[str, str] = FALLBACK_PAIR) -> DataFrame:
    """Per (scene, obj): a prompt of ``min(n, N)`` (object -> location)
    examples drawn with replacement, in random order, then the object's own
    open line.  Examples come from catalogue objects absent from the scene
    whose locations meet the scene's containers, each with one such
    location chosen at random; where there is none (N = 0), ``fallback`` is the
    one example.  N is bounded by the catalogue."""
    cat = bounded_broadcast(catalogue.select(F.col("name").alias("pobj"), "locations"), MAX_CATALOGUE)
    # every scene meets every catalogue object through its containers: join on
    # location, so only catalogue objects that can be placed in the scene appear
    locs = cat.select("pobj", F.explode("locations").alias("container"))
    cand = scene_containers.select("scene", F.col("name").alias("container")).join(locs, "container")
    cand = cand.join(scene_objects.select("scene", F.col("name").alias("pobj")), ["scene", "pobj"], "left_anti")
    options = cand.groupBy("scene", "pobj").agg(F.array_sort(F.collect_set("container")).alias("opts"))
    pick = F.element_at("opts", (F.pmod(h32(F.lit("loc"), "scene", "pobj", F.lit(seed)), F.size("opts")) + 1).cast("int"))
    pool = options.select("scene", "pobj", pick.alias("ploc"))
    pool = pool.withColumn("idx", F.row_number().over(Window.partitionBy("scene").orderBy("pobj")) - 1)
    sizes = pool.groupBy("scene").agg(F.count(F.lit(1)).alias("N"))
    objs = scene_objects.select("scene", F.col("name").alias("obj")).join(sizes, "scene", "left") \
        .withColumn("N", F.coalesce("N", F.lit(0)))
    d = objs.select("scene", "obj", "N", F.explode(slots(F.least(F.lit(n), F.col("N")))).alias("j"))
    d = d.withColumn("idx", F.pmod(h32(F.lit("draw"), "scene", "obj", "j", F.lit(seed)), F.col("N"))) \
         .withColumn("perm", h32(F.lit("perm"), "scene", "obj", "j", F.lit(seed)))
    lines = d.join(pool, ["scene", "idx"]).select("scene", "obj", "j", "perm",
                                                  format_pair(template, F.col("pobj"), F.col("ploc")).alias("line"))
    g = lines.groupBy("scene", "obj").agg(F.slice(F.array_sort(F.collect_list(F.struct("perm", "j", "line"))), 1,
                                                  max_lines).alias("_l"))
    last = F.trim(format_pair(template, F.col("obj"), F.lit("")))
    out = objs.join(g, ["scene", "obj"], "left")
    other = F.array(format_pair(template, *[F.lit(x) for x in fallback])) if n > 0 else F.array().cast("array<string>")
    lines = F.coalesce(F.col("_l.line"), other)
    return out.select("scene", "obj", F.size(lines).cast("bigint").alias("n_examples"),
                      F.array_join(F.concat(lines, F.array(last)), "\n").alias("prompt"))


def nearest_name(held: DataFrame, names: DataFrame, **options) -> DataFrame:
    """For each held item (scene, item_id, held): the scene name at the
    smallest edit distance, ties to the smaller name.  Each distinct text of a
    scene is looked up once, see ``nearest_texts``."""
    near = nearest_texts(held.select("scene", F.col("held").alias("text")), names, **options) \
        .select("scene", F.col("text").alias("held"), F.col("name").alias("nearest"), F.col("dist").alias("distance"))
    return held.select("scene", "item_id", "held").distinct().join(near, ["scene", "held"]) \
        .select("scene", "item_id", "held", "nearest", "distance")


def location_from_description(description: Column) -> Column:
    """First line of a room description, '=- ' stripped, lower-cased."""
    return F.lower(F.btrim(F.split_part(description, F.lit("\n"), F.lit(1)), F.lit("=- ")))
