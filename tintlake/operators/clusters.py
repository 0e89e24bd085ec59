"""Clusters of occurrences: counts, exact groups, near neighbours, scales, reports.

An occurrence has file, ord, line, selector, property, raw_value, full_value, category and media_query; (file, ord) is a
total order that settles every tie. A cluster is one (category, normalized value); its occurrences are not nested in it but
found by joining on the key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintlake.functions.color import delta_e76, lab_of, parse_color
from tintlake.functions.values import CATEGORIES, let, normalize_string, parse_rem, stable_id, trim
from tintlake.operators.composites import composite_tokens, normalize_words
from tintlake.operators.cut import cut

COLOR_DELTA_E = 2.0
SPACING_TOLERANCE = 0.01


def normalized_key(category: Column, raw: Column) -> Column:
    text = F.when(category.isin("font-family", "typography"), normalize_string(raw)).otherwise(trim(raw))
    # a colour is a composite of one word, so the expression reads colours in one place only
    words = F.when(category == "color", F.array(F.struct(trim(raw).alias("raw"), F.lit("color").alias("kind")))).otherwise(composite_tokens(raw))
    return F.when(category.isin("color", "shadow", "border", "transition"), normalize_words(words)).otherwise(text)


def with_keys(occurrences: DataFrame) -> DataFrame:
    """Adds cluster_key and value. Keys are worked out once for each distinct spelling, not for each row."""
    spelled = occurrences.withColumn("value", trim(F.col("raw_value")))
    keys = spelled.select("category", "value").distinct().withColumn("cluster_key", normalized_key(F.col("category"), F.col("value")))
    return spelled.join(keys, ["category", "value"])


def spellings(occurrences: DataFrame) -> DataFrame:
    """category, cluster_key, value, n, first (place of the first), by spelling: what clusters are made of.

    The rows are summed by spelling before any key is worked out, so the expensive expressions run on distinct values."""
    counted = occurrences.groupBy("category", trim(F.col("raw_value")).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "ord")).alias("first"))
    return counted.withColumn("cluster_key", normalized_key(F.col("category"), F.col("value")))


def clusters(occurrences: DataFrame, least: float = 1) -> DataFrame:
    """category, cluster_key, canonical_value (commonest spelling, then the first seen), n, members (in order of first use), first, below_threshold."""
    floor = math.floor(least) if math.isfinite(least) and least >= 1 else 1
    return (
        spellings(occurrences)
        .groupBy("category", "cluster_key")
        .agg(F.min(F.struct((-F.col("n")).alias("less"), "first", "value"))["value"].alias("canonical_value"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("first", "value")))["value"].alias("members"), F.min("first").alias("first"))
        .withColumn("below_threshold", F.col("n") < floor)
        .withColumn("cluster_id", stable_id(F.col("category"), F.col("canonical_value")))
    )


def file_counts(occurrences: DataFrame) -> DataFrame:
    """Files that each cluster is used in."""
    seen = occurrences.select("category", "file", trim(F.col("raw_value")).alias("value")).distinct()
    return seen.withColumn("cluster_key", normalized_key(F.col("category"), F.col("value"))).groupBy("category", "cluster_key").agg(F.count_distinct("file").alias("files"))


def report(occurrences: DataFrame) -> DataFrame:
    """category, total, distinct_values: every category has a row."""
    spark = occurrences.sparkSession
    every = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counted = occurrences.groupBy("category", trim(F.col("raw_value")).alias("value")).agg(F.count(F.lit(1)).alias("n")).groupBy("category").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_values"))
    return every.join(counted, "category", "left").na.fill(0, ["total", "distinct_values"])


def totals(occurrences: DataFrame) -> DataFrame:
    return occurrences.agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("occurrences"))


def near_pairs(points: DataFrame, axes: list[str], reach: float, distance: Column, left: str = "a", right: str = "b") -> DataFrame:
    """Pairs of points within reach: each point meets those of its own and the neighbouring cells of a grid of that size.

    points: id, rank and the axes (doubles). distance: over columns named <axis>_a and <axis>_b. Pairs have rank_a < rank_b.
    Only one side is copied to neighbours, so the join is an equality on the cell.
    """
    if reach <= 0:
        return points.sparkSession.createDataFrame([], f"{left} string, {right} string, distance double")
    cells = [F.floor(F.col(x) / reach).alias(f"cell_{x}") for x in axes]
    one = points.select(*[F.col(c).alias(f"{c}_a") for c in ("id", "rank", *axes)], *cells)
    two = points.select(*[F.col(c).alias(f"{c}_b") for c in ("id", "rank", *axes)], *cells)
    for x in axes:
        around = F.explode(F.array(*(F.col(f"cell_{x}") + d for d in (-1, 0, 1))))
        two = two.withColumn(f"cell_{x}", around)
    pairs = one.join(two, [f"cell_{x}" for x in axes]).where("rank_a < rank_b").withColumn("distance", distance)
    return pairs.where((F.col("distance") > 0) & (F.col("distance") <= reach)).select(F.col("id_a").alias(left), F.col("id_b").alias(right), "distance")


def color_neighbors(groups: DataFrame, reach: float = COLOR_DELTA_E) -> DataFrame:
    """a, b, distance: pairs of colour clusters by id that are near but not equal."""
    lab = lab_of(parse_color(F.col("canonical_value")))
    points = groups.where("category = 'color'").select(F.col("cluster_id").alias("id"), F.col("first").alias("rank"), lab.alias("lab")).where("lab.l is not null").select("id", "rank", "lab.l", "lab.a", "lab.b")
    points = cut(points)
    sides = [F.struct(*(F.col(f"{x}_{s}").alias(x) for x in "lab")) for s in "ab"]
    return near_pairs(points, ["l", "a", "b"], reach, delta_e76(*sides))


def spacing_neighbors(groups: DataFrame, reach: float = SPACING_TOLERANCE) -> DataFrame:
    """a, b, distance (rem): pairs of spacing and radius clusters, also across the two."""
    points = groups.where("category in ('spacing', 'radius')").select(F.col("cluster_id").alias("id"), F.col("first").alias("rank"), parse_rem(F.col("canonical_value")).alias("rem")).where("rem is not null")
    return near_pairs(points, ["rem"], reach, F.abs(F.col("rem_a") - F.col("rem_b")))


def flagged(groups: DataFrame, color_reach: float = COLOR_DELTA_E, spacing_reach: float = SPACING_TOLERANCE) -> DataFrame:
    """The clusters with requires_approval, confidence and related (ids of near neighbours, sorted)."""
    groups = cut(groups)
    colors = color_neighbors(groups, color_reach).withColumn("confidence", 1 - F.col("distance") / (color_reach * 2))
    lengths = spacing_neighbors(groups, spacing_reach).withColumn("confidence", F.lit(0.9))
    pairs = colors.unionByName(lengths)
    ends = pairs.select(F.col("a").alias("cluster_id"), F.col("b").alias("other"), "confidence").union(pairs.select("b", "a", "confidence"))
    by_id = ends.groupBy("cluster_id").agg(F.min("confidence").alias("confidence"), F.sort_array(F.collect_set("other")).alias("related"))
    out = groups.join(by_id, "cluster_id", "left")
    return out.withColumn("requires_approval", F.col("related").isNotNull()).withColumn("confidence", F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0)))).withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def spacing_scale(groups: DataFrame) -> DataFrame:
    """step_rem, matched, values_n of the step that most spacing values are near a multiple of; empty if there is no scale."""
    rem = groups.where("category = 'spacing'").select(parse_rem(F.col("canonical_value")).alias("v")).where("v is not null")
    sums = [F.sum(F.when((F.expr(f"v % {s}D") < 0.02) | (F.lit(s) - F.expr(f"v % {s}D") < 0.02), 1).otherwise(0)).alias("matched") for s in (0.25, 0.5, 0.125)]
    one = rem.agg(F.count(F.lit(1)).alias("values_n"), *(c.alias(f"m{i}") for i, c in enumerate(sums)))
    steps = F.array(*(F.struct(F.col(f"m{i}").alias("matched"), F.lit(-i).alias("order"), F.lit(s).alias("step_rem")) for i, s in enumerate((0.25, 0.5, 0.125))))
    best = one.select("values_n", F.array_max(steps).alias("best")).select("best.step_rem", "best.matched", "values_n")
    return best.where((F.col("values_n") >= 3) & (F.col("matched") >= F.col("values_n") * 0.6))


def nearest_reference(values: DataFrame, palette: list[tuple[str, str, str]], value_col: str = "value") -> DataFrame:
    """The nearest palette colour of each value: reference, source, hex, delta_e (two decimals), used_for_name.

    The palette (name, source, hex) is searched in order. The best distance is kept rounded to two decimals, and later
    colours are held against that, so the order counts. Nothing beyond 6 is a match; up to 3 it gives the name.
    """
    spark = values.sparkSession
    swatches = spark.createDataFrame([(i, *p) for i, p in enumerate(palette)], "i int, name string, source string, hex string")
    # the palette's colours are worked out once; it is as small as the list that was given
    rows = sorted(swatches.withColumn("lab", lab_of(parse_color(F.col("hex")))).collect(), key=lambda r: r.i)
    entries = F.array(*(F.struct(F.lit(r.name).alias("name"), F.lit(r.source).alias("source"), F.lit(r.hex).alias("hex"), F.lit(r.lab.l).alias("l"), F.lit(r.lab.a).alias("a"), F.lit(r.lab.b).alias("b")) for r in rows))
    start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("hex"), F.lit(math.inf).alias("best"), F.lit(math.inf).alias("raw"))

    def searched(lab: Column) -> Column:
        def step(acc: Column, e: Column) -> Column:
            found = lambda d: F.struct(e["name"].alias("name"), e["source"].alias("source"), e["hex"].alias("hex"), (F.floor(d * 100 + 0.5) / 100).alias("best"), d.alias("raw"))
            return let(delta_e76(lab, e), lambda d: F.when(d < acc["best"], found(d)).otherwise(acc))

        return F.aggregate(entries, start, step)

    # what is no colour keeps the infinite distance. A filter on a generated column stays above the generator: on a plain
    # column it is pushed below the distinct, and the search runs for each row
    match = let(lab_of(parse_color(F.col("value"))), searched)
    found = values.select(F.col(value_col).alias("value")).distinct().select("value", F.explode(F.array(match)).alias("m"))
    return found.where("m.best <= 6").select("value", F.col("m.name").alias("reference"), "m.source", "m.hex", F.col("m.best").alias("delta_e"), (F.col("m.raw") <= 3).alias("used_for_name"))
