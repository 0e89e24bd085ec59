"""Groups of clusters that a person should look at together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.functions.color import parse_color, to_hex
from tintlake.operators.cut import cut

def review_groups(groups: DataFrame) -> DataFrame:
    """cluster_id, group_id (the least id it reaches through pending neighbours): labels spread and jump until none changes.

    Every round is checkpointed where the session has a folder for it, so plans stay short and lost executors do no harm."""
    pending = cut(groups.where("requires_approval and not below_threshold").select("cluster_id", "related"))
    edges = pending.select("cluster_id", F.explode("related").alias("other")).join(pending.select(F.col("cluster_id").alias("other")), "other")
    edges = cut(edges.select("cluster_id", "other").union(edges.select("other", "cluster_id")).distinct())
    labels = cut(pending.select("cluster_id", F.col("cluster_id").alias("group_id")))
    while True:  # labels only fall, so they come to rest
        seen = edges.join(labels.withColumnRenamed("cluster_id", "other"), "other").groupBy("cluster_id").agg(F.min("group_id").alias("near"))
        stepped = labels.join(seen, "cluster_id", "left").select("cluster_id", F.least("group_id", F.coalesce("near", "group_id")).alias("step"), "group_id")
        jumps = labels.select(F.col("cluster_id").alias("step"), F.col("group_id").alias("jump"))
        after = cut(stepped.join(jumps, "step").select("cluster_id", F.least("step", "jump").alias("group_id"), (F.least("step", "jump") != F.col("group_id")).alias("moved")))
        labels = after.select("cluster_id", "group_id")
        if after.where("moved").isEmpty():
            return labels


def review_cards(groups: DataFrame, named: DataFrame | None = None, hints: DataFrame | None = None, lock: DataFrame | None = None) -> DataFrame:
    """kind, group_id, label: the worklist of cluster groups, palette names, values below the threshold and shadow parts.

    named: cluster_id and reference of tokens a palette named. hints: file, line, column, property, layers, shape, color.
    """
    members = groups.select("cluster_id", "canonical_value")
    listed = review_groups(groups).join(members, "cluster_id").groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_list("cluster_id")), "+").alias("ids"), F.array_join(F.sort_array(F.collect_list("canonical_value")), ", ").alias("label"))
    out = listed.select(F.lit("cluster-group").alias("kind"), F.col("ids").alias("group_id"), "label")
    low = groups.where("below_threshold").select(F.lit("below-threshold").alias("kind"), F.concat(F.lit("pending:"), "cluster_id").alias("group_id"), F.col("canonical_value").alias("label"))
    out = out.unionByName(low)
    if named is not None:
        rows = named if lock is None else named.join(lock.where("renamed_from is not null").select(F.col("id").alias("cluster_id")), "cluster_id", "left_anti")
        out = out.unionByName(rows.select(F.lit("reference-name").alias("kind"), F.concat(F.lit("ref:"), "cluster_id").alias("group_id"), F.concat(F.lit("closely matches "), "reference").alias("label")))
    if hints is not None:
        place = F.concat_ws(":", F.lit("comp"), "file", "line", "column", "property")
        rows = hints.withColumn("group_id", place).dropDuplicates(["group_id"])
        out = out.unionByName(rows.select(F.lit("composite-component").alias("kind"), "group_id", F.concat_ws(" ", "shape", F.coalesce(to_hex(parse_color(F.col("color"))), "color")).alias("label")))
    return out
