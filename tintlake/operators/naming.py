"""Names for clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tintlake.functions.names import name_case, property_role, rule_name, semantic_name
from tintlake.functions.palette import PALETTE
from tintlake.functions.values import trim
from tintlake.operators.clusters import nearest_reference, normalized_key


def semantic_votes(occurrences: DataFrame) -> DataFrame:
    """category, cluster_key, semantic_name: the commonest name by role (the first seen on ties); none where a value has several property roles."""
    counted = occurrences.groupBy("category", trim(F.col("raw_value")).alias("value"), "property", "selector").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "ord")).alias("first"))
    rows = counted.withColumn("cluster_key", normalized_key(F.col("category"), F.col("value"))).withColumn("role", property_role(F.col("property"))).withColumn("name", semantic_name(F.col("category"), F.col("property"), F.col("selector")))
    named = rows.groupBy("category", "cluster_key", "name").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.min("role").alias("low"), F.max("role").alias("high"))
    best = F.min(F.when(F.col("name").isNotNull(), F.struct((-F.col("n")).alias("less"), "first", "name")))
    out = named.groupBy("category", "cluster_key").agg(F.min("low").alias("low"), F.max("high").alias("high"), best.alias("best"))
    return out.where("low = high and best is not null").select("category", "cluster_key", F.col("best.name").alias("semantic_name"))


def palette_names(groups: DataFrame, palette: list[tuple[str, str, str]] = PALETTE) -> DataFrame:
    """value and name of the clusters' colours that are near enough to one of the palette to take its name."""
    found = nearest_reference(groups.where("category = 'color'"), palette, "canonical_value")
    return found.where("used_for_name").select("value", F.concat(F.lit("color-"), "reference").alias("name"))


def name_clusters(groups: DataFrame, votes: DataFrame | None = None, palette_names: DataFrame | None = None, prefix: str = "", case: str = "kebab") -> DataFrame:
    """The clusters that reach the threshold, with base and name. The nth user of a base by falling count gets -altN.

    palette_names: value and reference name of colours that a palette names. Ranks are within a base name, so a common base
    is ranked by its clusters, which are distinct values, not by rows.
    """
    rows = groups.where(~F.col("below_threshold"))
    base = rule_name(F.col("category"), F.col("canonical_value"))
    if palette_names is not None:
        rows = rows.join(palette_names.select(F.col("value").alias("canonical_value"), F.col("name").alias("palette_name")), "canonical_value", "left")
        base = F.when(F.col("category") == "color", F.coalesce("palette_name", base)).otherwise(base)
    if votes is not None:
        rows = rows.join(votes, ["category", "cluster_key"], "left")
        base = F.coalesce("semantic_name", base)
    rows = rows.withColumn("base", F.concat(F.lit(f"{prefix}-"), base) if prefix else base)
    nth = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("n"), "first"))
    raw = F.when(nth == 1, F.col("base")).otherwise(F.concat("base", F.lit("-alt"), nth.cast("string")))
    return rows.withColumn("name", name_case(raw, case))


def tokens(groups: DataFrame, files: DataFrame, votes: DataFrame | None = None, **options) -> DataFrame:
    """cluster_id, name, category, value, occurrence_count, file_count, semantic_name."""
    named = name_clusters(groups, votes, **options).join(files, ["category", "cluster_key"])
    semantic = F.col("semantic_name") if votes is not None else F.lit(None).cast("string")
    return named.select("cluster_id", "name", "category", F.col("canonical_value").alias("value"), F.col("n").alias("occurrence_count"), F.col("files").alias("file_count"), semantic.alias("semantic_name"))
