"""Rare values that are probably typing errors of common or standard ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintlake.functions.values import js_number, numeric_amount, numeric_kind, trim
from tintlake.operators.cut import cut

# Standard amounts, and how near counts as near.
BREAKPOINTS = (576, 768, 992, 1024, 1280, 1440, 1536)
FONT_SIZES = (12, 14, 16, 18, 20, 24, 32, 36, 48)
LINE_HEIGHTS = (1, 1.25, 1.4, 1.5, 1.75, 2)


def tolerance(category: Column, kind: Column) -> Column:
    return F.when(category == "breakpoint", 10.0).when(category == "font-size", 2.0).when(kind == "unitless", 0.1).otherwise(2.0)


def standards(category: Column, kind: Column) -> Column:
    def doubles(values) -> Column:
        return F.array(*(F.lit(float(v)) for v in values))

    return F.when(category == "breakpoint", doubles(BREAKPOINTS)).when(category == "font-size", doubles(FONT_SIZES)).when(kind == "unitless", doubles(LINE_HEIGHTS)).otherwise(doubles(int(v * 1.5 + 0.5) for v in FONT_SIZES))


def value_groups(occurrences: DataFrame) -> DataFrame:
    """category, kind, amount, display (as first seen), n, first."""
    rows = occurrences.where("category in ('breakpoint', 'font-size', 'line-height')")
    counted = rows.groupBy("category", trim(F.col("raw_value")).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "ord")).alias("first"))
    counted = counted.withColumn("kind", numeric_kind(F.col("value"))).withColumn("amount", numeric_amount(F.col("value"))).where("kind is not null")
    return counted.groupBy("category", "kind", "amount").agg(F.min(F.struct("first", "value"))["value"].alias("display"), F.sum("n").alias("n"), F.min("first").alias("first"))


def typos(occurrences: DataFrame) -> DataFrame:
    """category, suspect_value, suspect_count, likely_intended, likely_count, distance, reason."""
    groups = cut(value_groups(occurrences).withColumn("tol", tolerance(F.col("category"), F.col("kind"))))  # distinct values, used four times
    # a range join on cells as wide as the tolerance: two values that are near lie in the same or neighbouring cells
    cell = F.floor(F.col("amount") / F.col("tol"))
    one = groups.withColumn("cell", cell)
    two = groups.select("category", "kind", *(F.col(c).alias(f"o_{c}") for c in ("amount", "display", "n", "first")), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = one.join(two, ["category", "kind", "cell"]).withColumn("distance", F.abs(F.col("amount") - F.col("o_amount"))).where("distance > 0 and distance <= tol")
    # responsive overrides: the same selector has a near value under another media query
    # of each selector's media queries the least and greatest tell whether two sets hold different ones; amounts are read once for each spelling
    rows = occurrences.where("category in ('breakpoint', 'font-size', 'line-height')").withColumn("media", F.coalesce("media_query", F.lit("")))
    rows = rows.groupBy("category", "raw_value", "selector").agg(F.min("media").alias("lo"), F.max("media").alias("hi"))
    spelled = rows.select("category", "raw_value", numeric_kind(F.col("raw_value")).alias("kind"), numeric_amount(F.col("raw_value")).alias("amount"), trim(F.col("selector")).alias("selector"), "lo", "hi").where("kind is not null")
    media = spelled.groupBy("category", "kind", "amount", "selector").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    left = near.select("category", "kind", "amount", "o_amount").distinct().join(media, ["category", "kind", "amount"])
    right = media.select("category", "kind", F.col("amount").alias("o_amount"), "selector", F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"))
    override = left.join(right, ["category", "kind", "o_amount", "selector"]).where("lo <> o_lo or hi <> o_hi or lo <> hi").select("category", "kind", "amount").distinct()
    best = near.groupBy("category", "kind", "amount").agg(F.min(F.struct((-F.col("o_n")).alias("less"), "distance", F.col("o_first").alias("o_first"), F.col("o_display").alias("display"))).alias("best"))
    plain = groups.join(override, ["category", "kind", "amount"], "left_anti").join(best, ["category", "kind", "amount"], "left")
    around = F.filter(F.transform(standards(F.col("category"), F.col("kind")), lambda s, i: F.struct(F.abs(F.col("amount") - s).alias("d"), i.alias("i"), s.alias("s"))), lambda x: (x["d"] > 0) & (x["d"] <= F.col("tol")))
    plain = plain.withColumn("standard", F.array_min(around))
    known = groups.select("category", "kind", F.col("amount").alias("s_amount"), F.col("display").alias("s_display"), F.col("n").alias("s_n"))
    plain = plain.join(known, (plain["category"] == known["category"]) & (plain["kind"] == known["kind"]) & (F.col("standard.s") == F.col("s_amount")), "left").drop(known["category"]).drop(known["kind"])
    rare, common = F.col("n") <= 2, -F.col("best.less")
    frequent = F.coalesce(rare & (common >= 3) & (common >= F.col("n") * 3), F.lit(False))
    standard = F.col("standard").isNotNull() & rare
    unit = F.when(F.col("kind") == "unitless", "").otherwise("px")
    out = plain.where(frequent | standard).select(
        "category",
        F.col("display").alias("suspect_value"),
        F.col("n").alias("suspect_count"),
        F.when(frequent, F.col("best.display")).otherwise(F.coalesce("s_display", F.concat(js_number(F.col("standard.s")), unit))).alias("likely_intended"),
        F.when(frequent, common).otherwise(F.coalesce("s_n", F.lit(0))).cast("long").alias("likely_count"),
        (F.floor(F.when(frequent, F.col("best.distance")).otherwise(F.col("standard.d")) * 1000 + 0.5) / 1000).alias("distance"),
        F.when(frequent & standard, "both").when(frequent, "frequency").otherwise("standard-value").alias("reason"),
    )
    return out.dropDuplicates(["category", "suspect_value", "likely_intended"])
