"""Probe inputs derived from the parquet tables.

The reference reads knowledge triples from LAMA/BATS files that are not
shipped; these builders derive triples of the same shape from the test
tables so that every query reads the given tables and grows with them.

facts(rel, subj, obj, uuid):
  located_in  N-1  nation name  -> region name
  segment     N-1  customer     -> market segment
  brand       N-1  part name+key-> brand
  supplies    N-M  supplier     -> brand of a part it shipped, one fact per
                   raw lineitem row (duplicates on purpose)
  region_no   1-1  region name  -> 'R' + region key
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.hashing import TWO_POW_32, h32
from factlens.operators.datasets import load_examples
from factlens.operators.examples import TASK_ROWS, known_answers
from factlens.session import bounded_broadcast
from factlens.sources.tables import table

DATASET = "TREx"      # summary label of the typed-relation facts (1-1 / N-1 / N-M slices)
BATS_DATASET = "BATS"  # summary label of the multi-answer categories

# fixed values: relation metadata (relation, template, type)
RELATIONS = [
    ("located_in", "[X] is located in [Y] .", "N-1"),
    ("segment", "[X] works in the [Y] segment .", "N-1"),
    ("brand", "[X] is made by [Y] .", "N-1"),
    ("supplies", "[X] supplies [Y] products .", "N-M"),
    ("region_no", "[X] has the region code [Y] .", "1-1"),
]
MAX_CANDIDATES = 5_000_000
TYPICAL_CANDIDATES = 20  # candidates per example, for sizing partitions only


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "rel string, template string, type string")


def raw_facts(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    customer, part = table(spark, d, "customer"), table(spark, d, "part")
    supplier, lineitem = table(spark, d, "supplier"), table(spark, d, "lineitem")

    def key(prefix, *cols):
        return F.concat_ws("_", F.lit(prefix), *[F.col(c).cast("string") for c in cols]).alias("uuid")

    located = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("located_in").alias("rel"), F.col("n_name").alias("subj"),
        F.col("r_name").alias("obj"), key("located_in", "n_nationkey"))
    segment = customer.select(F.lit("segment").alias("rel"), F.col("c_name").alias("subj"),
                              F.col("c_mktsegment").alias("obj"), key("segment", "c_custkey"))
    brand = part.select(F.lit("brand").alias("rel"),
                        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("subj"),
                        F.col("p_brand").alias("obj"), key("brand", "p_partkey"))
    li = lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    supplies = (li.join(supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
                  .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
                  .select(F.lit("supplies").alias("rel"), F.col("s_name").alias("subj"),
                          F.col("p_brand").alias("obj"),
                          key("supplies", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    region_no = region.select(F.lit("region_no").alias("rel"), F.col("r_name").alias("subj"),
                              F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("obj"),
                              key("region_no", "r_regionkey"))
    return reduce(DataFrame.unionByName, [located, segment, brand, supplies, region_no])


def vocab(spark: SparkSession, d: str, facts: DataFrame | None = None) -> DataFrame:
    """Answer vocabulary: the distinct objects, minus one in five by hash so
    that some answers are out of vocabulary."""
    f = facts if facts is not None else raw_facts(spark, d)
    return f.select(F.col("obj").alias("token")).filter(F.pmod(h32(F.col("obj")), F.lit(5)) != 0).distinct()


def candidate_counts(facts: DataFrame) -> DataFrame:
    """(rel, token, cnt): every object of a relation with its raw frequency."""
    return facts.groupBy("rel", F.col("obj").alias("token")).agg(F.count(F.lit(1)).alias("cnt"))


def count_scorer_logits(examples: DataFrame, facts: DataFrame) -> DataFrame:
    """Stand-in for a masked LM: every object of the example's relation is a
    candidate, logit = ln(1 + frequency) + noise in [0, 1), where the noise
    is h(uuid) XOR h(token) / 2^32: each side is hashed once (per example,
    per candidate) and combined per row with one integer operation.

    The candidate table is bounded by the object domain of each relation and
    is broadcast after a size check, so the example side never shuffles.
    """
    cands = bounded_broadcast(candidate_counts(facts).withColumn("_ht", h32(F.col("token"))), MAX_CANDIDATES)
    # spread by uuid first: candidates multiply the rows, and the uuid
    # partitioning is the one the per-example top-k window needs anyway
    from factlens.operators.runs import spread
    e = spread(examples.select("uuid", "rel"), TYPICAL_CANDIDATES, "uuid").withColumn("_he", h32(F.col("uuid")))
    j = e.join(cands, "rel")
    noise = F.col("_he").bitwiseXOR(F.col("_ht")) / F.lit(TWO_POW_32)
    return j.select("uuid", "token", (F.log(F.lit(1.0) + F.col("cnt")) + noise).alias("logit"))


# fixed values: BATS category initials (inflection, derivation, lexicography, encyclopedia)
BATS_INITIALS = ["I", "D", "L", "E"]
MAX_NATIONS = 100_000


def bats_raw(spark: SparkSession, d: str) -> DataFrame:
    """BATS-shaped multi-answer rows: a supplier and every brand it shipped
    (odd part keys give the lower-cased brand), category named
    like a BATS file from the supplier's nation."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    sup = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = bounded_broadcast(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), MAX_NATIONS)
    j = (li.join(part, F.col("l_partkey") == F.col("p_partkey"))
           .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
           .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))
    ans = F.when(F.pmod(F.col("l_partkey"), F.lit(2)) == 0, F.col("p_brand")).otherwise(F.lower("p_brand"))
    cat = bats_category_code(F.col("n_regionkey"), F.col("n_nationkey"))
    # the distinct answers first, by an aggregate of bounded tasks: a set of strings is collected by sorting what a task reads
    shipped = j.select(cat.alias("rel"), F.col("s_name").alias("subj"), ans.alias("answer"))
    tasks = max(1, math.ceil(li.count() / TASK_ROWS))
    if tasks > 1:
        shipped = shipped.repartition(tasks, "rel", "subj", "answer").distinct().repartition(tasks, "rel", "subj")
    g = shipped.groupBy("rel", "subj").agg(F.array_sort(F.collect_set("answer")).alias("answers"))
    return g.withColumn("uuid", F.concat_ws("_", "rel", "subj")).withColumn("x", F.col("subj"))


def bats_examples(spark: SparkSession, d: str, vocab_df: DataFrame | None = None) -> DataFrame:
    """Answers kept when in the vocabulary or its lower-cased copy (the answer
    itself is not lower-cased); a row stays even if no answer is left.
    Adds ``y`` (kept answers, in list order) and ``solvable``."""
    return known_answers(bats_raw(spark, d), vocab_df if vocab_df is not None else vocab(spark, d))


def part_examples(spark: SparkSession, d: str, vocab_df: DataFrame) -> DataFrame:
    """Rows of the shape of ``bats_examples`` whose one answer may be out of
    vocabulary: a part and its brand, category by the part's size."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    allowed = vocab_df.select("token").union(vocab_df.select(F.lower("token").alias("token"))).distinct()
    j = part.join(bounded_broadcast(allowed, MAX_CANDIDATES), F.col("p_brand") == F.col("token"), "left")
    y = F.when(F.col("token").isNotNull(), F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    rows = j.select(F.concat(F.lit("S"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("rel"),
                    F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("subj"), y.alias("y"))
    return rows.select(F.concat_ws("_", "rel", "subj").alias("uuid"), "rel", "subj", "y", (F.size("y") > 0).alias("solvable"))


# fixed values: Google-RE style relations and their cloze sentences
GRE_TEMPLATES = [
    ("place_of_birth", "{} was born in [MASK]."),
    ("date_of_birth", "{} (born [MASK])."),
    ("place_of_death", "{} died in [MASK]."),
]


def gre_facts(spark: SparkSession, d: str) -> DataFrame:
    """Google-RE shaped facts: a customer, a path-like predicate, an object."""
    cust = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = bounded_broadcast(table(spark, d, "nation").select("n_nationkey", "n_name"), MAX_NATIONS)
    j = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    names = F.array(*[F.lit(r) for r, _ in GRE_TEMPLATES])
    pred = F.concat(F.lit("/people/person/"),
                    F.element_at(names, (F.pmod(F.col("c_custkey"), F.lit(3)) + 1).cast("int")))
    return j.select(F.concat(F.lit("gre_"), F.col("c_custkey").cast("string")).alias("uuid"),
                    pred.alias("pred"), F.col("c_name").alias("subj"),
                    F.when(pred.endswith("date_of_birth"),
                           (F.lit(1900) + F.pmod(F.col("c_custkey"), F.lit(100))).cast("string"))
                     .otherwise(F.col("n_name")).alias("obj"))


# fixed values: ConceptNet style predicates
CONCEPTNET_PREDICATES = ["IsA", "HasProperty", "MadeOf"]


def conceptnet_raw(spark: SparkSession, d: str) -> DataFrame:
    """ConceptNet shaped rows: a part, a predicate by its size, its type, and
    two masked sentences."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_size")
    sub = F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))
    names = F.array(*[F.lit(p) for p in CONCEPTNET_PREDICATES])
    return part.select(F.concat(F.lit("cn_"), F.col("p_partkey").cast("string")).alias("uuid"),
                       F.element_at(names, (F.pmod(F.col("p_size"), F.lit(3)) + 1).cast("int")).alias("pred"), sub.alias("sub"),
                       F.col("p_type").alias("obj_label"),
                       F.array(F.concat(F.lit("The "), sub, F.lit(" is sold .")),
                               F.concat(F.lit("It is of the kind [MASK] ."))).alias("masked_sentences"))


def lama_rows(spark: SparkSession, d: str, data: str) -> DataFrame:
    """All probe rows (uuid, rel, subj, y, x) of a dataset without relation
    metadata, by its own normaliser."""
    if data == "Google_RE":
        raw = gre_facts(spark, d).select("uuid", "pred", F.col("subj").alias("sub_label"), F.col("obj").alias("obj_label"))
    else:
        raw = conceptnet_raw(spark, d).withColumn("sub_label", F.lit(None).cast("string"))
    return load_examples(data, raw)


def bats_category_code(regionkey: F.Column, nationkey: F.Column) -> F.Column:
    return F.concat(F.element_at(F.array(*[F.lit(x) for x in BATS_INITIALS]),
                                 (F.pmod(regionkey, F.lit(4)) + 1).cast("int")),
                    F.lpad(nationkey.cast("string"), 2, "0"))


def bats_category_names(spark: SparkSession, d: str) -> DataFrame:
    """Full category names, as a BATS directory listing would give them."""
    n = table(spark, d, "nation")
    code = bats_category_code(F.col("n_regionkey"), F.col("n_nationkey"))
    return n.select(code.alias("category"), F.concat_ws(" ", code, F.col("n_name")).alias("name"))
