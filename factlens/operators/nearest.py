"""Nearest names by edit distance without comparing all pairs.

A name within r edits of a text shares one of its r + 1 segments with it, at a
place moved by at most r (pigeonhole).  So for a radius r the names' segments
are an index: texts are cut at all places that a segment of a name of length
within r of theirs may have, and an equi-join on (scene, length, segment
number, segment) yields every name within r edits, each verified by a banded
distance.  A text with a candidate within r is done, since no name outside the
candidates is as near; the others go on with a wider radius.  Beyond the last
radius, and in scenes of few names, texts meet all names of their scene.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.store import persisted

RADII = (1, 2, 4)
FEW_NAMES = 64


def _segment(length: Column, i: Column, r: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a name of ``length`` in r + 1 segments."""
    short, longer = F.floor(length / (r + 1)).cast("int"), (length % (r + 1)).cast("int")
    before = F.greatest(F.lit(0), i - (r + 1 - longer))
    return i * short + before, short + (i >= (r + 1 - longer)).cast("int")


def _nearest_of(pairs: DataFrame, dist: Column) -> DataFrame:
    found = pairs.withColumn("dist", dist).filter(F.col("dist") >= 0)
    return found.groupBy("scene", "text").agg(F.min(F.struct("dist", "name")).alias("_b")) \
        .select("scene", "text", "_b.name", "_b.dist")


def within(texts: DataFrame, names: DataFrame, r: int) -> DataFrame:
    """(scene, text, name, dist): each text's nearest name if it is within r
    edits (ties to the smaller name).  Both frames without repeated rows."""
    segments = F.explode(F.sequence(F.lit(0), F.lit(r)))
    size = F.length("name")
    indexed = names.select("scene", "name", size.alias("L"), segments.alias("i")).filter(F.col("L") > r)
    start, length = _segment(F.col("L"), F.col("i"), r)
    indexed = indexed.select("scene", "L", "i", F.substring("name", start + 1, length).alias("seg"), "name")
    m = F.length("text")
    probes = texts.select("scene", "text", m.alias("m")).filter(F.col("m") >= 1) \
        .withColumn("L", F.explode(F.sequence(F.greatest(F.lit(r + 1), F.col("m") - r), F.greatest(F.lit(r + 1), F.col("m") + r)))) \
        .withColumn("i", segments).withColumn("at", start).withColumn("len", length)
    low, high = F.greatest(F.lit(0), F.col("at") - r), F.least(F.col("m") - F.col("len"), F.col("at") + r)
    probes = probes.filter(low <= high).withColumn("s", F.explode(F.sequence(low, high))) \
        .select("scene", "text", "L", "i", F.substring("text", F.col("s") + 1, F.col("len")).alias("seg")).distinct()
    near = probes.join(indexed, ["scene", "L", "i", "seg"]).select("scene", "text", "name")
    # names of at most r characters have no segments: they meet the texts of at most 2 r
    short = names.filter(size <= r).join(texts.filter(m <= 2 * r), "scene").select("scene", "text", "name")
    return _nearest_of(near.unionByName(short), F.levenshtein("name", "text", r))


def nearest_texts(texts: DataFrame, names: DataFrame, radii: tuple[int, ...] = RADII, few: int = FEW_NAMES) -> DataFrame:
    """(scene, text, name, dist): for each distinct (scene, text) the name of
    its scene at the smallest edit distance, ties to the smaller name.  A
    scene without names has no rows."""
    texts = texts.select("scene", "text").distinct()
    names = names.select("scene", "name").distinct()
    crowded = names.groupBy("scene").count().filter(F.col("count") > few).select("scene")
    many = persisted(names.join(crowded, "scene", "left_semi"), "crowded")
    if many.isEmpty():
        return _nearest_of(texts.join(names, "scene"), F.levenshtein("name", "text"))
    left = persisted(texts.join(crowded, "scene", "left_semi"), "texts")
    done = []
    for r in radii:
        found = persisted(within(left, many, r), "near")
        done.append(found)
        left = persisted(left.join(found.select("scene", "text"), ["scene", "text"], "left_anti"), "left")
        if left.isEmpty():
            break
    others = texts.join(crowded, "scene", "left_anti").join(names, "scene").select("scene", "text", "name")
    far = left.join(many, "scene").select("scene", "text", "name")
    rest = _nearest_of(others.unionByName(far), F.levenshtein("name", "text"))
    return reduce(DataFrame.unionByName, done, rest)
