"""The lock: tokens persisted by an id that hangs on category and value alone."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.functions.color import color_key
from tintlake.functions.names import rule_name
from tintlake.functions.values import stable_id

ENTRY = "id string, category string, name string, value string, created_at string, merged_with string, renamed_from string, kept_separate_from array<string>"
RX_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")


def assign_ids(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("cluster_id", stable_id(F.col("category"), F.col("value")))


def create(tokens: DataFrame, now: str) -> DataFrame:
    rows = assign_ids(tokens)
    return rows.select(F.col("cluster_id").alias("id"), "category", "name", "value", F.lit(now).alias("created_at"), F.lit(None).cast("string").alias("merged_with"), F.lit(None).cast("string").alias("renamed_from"), F.lit(None).cast("array<string>").alias("kept_separate_from"))


def diff(tokens: DataFrame, lock: DataFrame) -> DataFrame:
    """id, change (added, removed, renamed, unchanged, kept), locked_name, fresh_name. A merged entry whose value is gone is kept."""
    fresh = assign_ids(tokens).select(F.col("cluster_id").alias("id"), F.col("name").alias("fresh_name"))
    locked = lock.select("id", F.col("name").alias("locked_name"), "merged_with")
    both = fresh.join(locked, "id", "full_outer")
    change = F.when(F.col("locked_name").isNull(), "added").when(F.col("fresh_name").isNull() & F.col("merged_with").isNotNull(), "kept").when(F.col("fresh_name").isNull(), "removed").when(F.col("fresh_name") != F.col("locked_name"), "renamed").otherwise("unchanged")
    return both.select("id", change.alias("change"), "locked_name", "fresh_name")


def merged_lock(tokens: DataFrame, lock: DataFrame, now: str) -> DataFrame:
    """Locked entries that are still there or record a merge, then the new ones."""
    fresh = create(tokens, now)
    alive = lock.join(fresh.select("id"), "id", "left_semi")
    kept = lock.where("merged_with is not null").join(fresh.select("id"), "id", "left_anti")
    return alive.unionByName(kept).unionByName(fresh.join(lock.select("id"), "id", "left_anti"))


def resolved_tokens(tokens: DataFrame, lock: DataFrame) -> DataFrame:
    """Tokens under their locked names, merged ones folded into their targets: counts are summed, files are the most of any.

    Merges are taken in the order of the lock (by category and value), as chains hang on it; they are a person's decisions,
    so they go to the driver.
    """
    rows = assign_ids(tokens)
    names = lock.select(F.col("id").alias("cluster_id"), F.col("name").alias("locked_name"))
    rows = rows.join(names, "cluster_id", "left").withColumn("name", F.coalesce("locked_name", "name")).drop("locked_name")
    root = roots(lock)
    if not root:
        return rows
    spark = tokens.sparkSession
    mapped = spark.createDataFrame([(a, b) for a, b in sorted(root.items())], "cluster_id string, target string")
    joined = rows.join(F.broadcast(mapped), "cluster_id", "left")
    # a source whose target is no token goes without a trace
    ids = joined.where("target is null").select(F.col("cluster_id").alias("target"))
    extra = joined.where("target is not null").join(ids, "target", "left_semi").groupBy("target").agg(F.sum("occurrence_count").alias("more"), F.max("file_count").alias("most"))
    out = joined.where("target is null").drop("target").join(extra.withColumnRenamed("target", "cluster_id"), "cluster_id", "left")
    return out.withColumn("occurrence_count", F.col("occurrence_count") + F.coalesce("more", F.lit(0))).withColumn("file_count", F.greatest("file_count", F.coalesce("most", F.lit(0)))).select(*rows.columns)


def roots(lock: DataFrame) -> dict[str, str]:
    """Where each merged id ends, merges taken one after another: a later merge doesn't move what was folded before into a source already gone.

    Merges are decisions that a person made one by one, so they fit on the driver; each is looked at a few times only.
    """
    out: dict[str, str] = {}
    folded: dict[str, list[str]] = {}  # by target: the ids that end there
    for r in lock.where("merged_with is not null").select("id", "merged_with", "category", "value").orderBy("category", "value", "id").toLocalIterator():
        if r.id in out:
            continue
        moved = [r.id, *folded.pop(r.id, [])]
        for i in moved:
            out[i] = r.merged_with
        folded.setdefault(r.merged_with, []).extend(moved)
    return out


def resolved_clusters(groups: DataFrame, lock: DataFrame) -> DataFrame:
    """Flagged clusters after a person's decisions: merged ones are folded into their targets, related ids follow merges, and
    pairs that were merged or kept separate no longer ask for approval. A merge whose source or target is no cluster says nothing."""
    rows = groups.select("cluster_id", "category", "cluster_key", "canonical_value", "n", "members", "first", "below_threshold", "requires_approval", "confidence", "related")
    ids = rows.select("cluster_id")
    merges = lock.where("merged_with is not null and merged_with <> id").select(F.col("id").alias("cluster_id"), F.col("merged_with").alias("target"))
    merges = merges.join(ids, "cluster_id", "left_semi").join(ids.withColumnRenamed("cluster_id", "target"), "target", "left_semi").select("cluster_id", "target")
    ends = roots(merges.select(F.col("cluster_id").alias("id"), F.col("target").alias("merged_with"), F.lit("").alias("category"), F.col("cluster_id").alias("value")))
    spark = groups.sparkSession
    where = F.broadcast(spark.createDataFrame(sorted(ends.items()), "cluster_id string, target string"))  # a row for each decision
    rows = rows.join(where, "cluster_id", "left").withColumn("home", F.coalesce("target", "cluster_id"))
    own = F.col("target").isNull()
    folded = rows.groupBy("home").agg(
        F.sum("n").alias("n"),
        F.array_distinct(F.flatten(F.sort_array(F.collect_list(F.struct((~own).alias("later"), "first", "members")))["members"])).alias("members"),
        *(F.max(F.when(own, F.col(c))).alias(c) for c in ("category", "cluster_key", "canonical_value", "below_threshold", "requires_approval", "confidence")),
        F.flatten(F.collect_list("related")).alias("related"),
    )
    known = folded.select(F.col("home").alias("cluster_id"), "category", "cluster_key", "canonical_value", "n", "members", "below_threshold", "requires_approval", "confidence")
    pairs = folded.select(F.col("home").alias("cluster_id"), F.explode("related").alias("other")).join(where.select(F.col("cluster_id").alias("other"), F.col("target").alias("moved")), "other", "left")
    pairs = pairs.select("cluster_id", F.coalesce("moved", "other").alias("other")).where("cluster_id <> other").distinct().join(ids.withColumnRenamed("cluster_id", "other"), "other", "left_semi")
    apart = lock.where("kept_separate_from is not null").select(F.col("id").alias("cluster_id"), F.explode("kept_separate_from").alias("other"))
    apart = apart.union(apart.select("other", "cluster_id")).distinct()
    left = pairs.join(apart, ["cluster_id", "other"], "left_anti").groupBy("cluster_id").agg(F.sort_array(F.collect_set("other")).alias("related"))
    out = known.join(left, "cluster_id", "left").withColumn("settled", F.col("requires_approval") & F.col("related").isNull())
    out = out.withColumn("confidence", F.when(F.col("settled"), 1.0).otherwise(F.col("confidence")))
    return out.withColumn("requires_approval", F.col("requires_approval") & ~F.col("settled")).withColumn("related", F.coalesce("related", F.array().cast("array<string>"))).drop("settled")


def alias(aliases: DataFrame, name: str, semantic: str) -> DataFrame:
    """User aliases (name, alias) with one more; a later one for the same token replaces it."""
    semantic = re.sub(r"^--+", "", semantic).strip()
    if not RX_NAME.fullmatch(semantic):
        raise ValueError(f"not a token name: {semantic!r}")
    own = aliases.sparkSession.createDataFrame([(name, semantic)], "name string, alias string")
    return aliases.where(F.col("name") != name).select("name", "alias").union(own)


def with_aliases(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tokens whose semantic_name is the user's alias, where there is one."""
    return tokens.join(aliases.select("name", F.col("alias").alias("__alias")), "name", "left").withColumn("semantic_name", F.coalesce("__alias", "semantic_name")).drop("__alias").select(*tokens.columns)


def lookup(values: DataFrame, lock: DataFrame) -> DataFrame:
    """category, raw_value, name: the locked name of a value, by id, else of a colour by its key; by rule where the lock has none. locked says which."""
    wanted = values.select("category", "raw_value").distinct().withColumn("id", stable_id(F.col("category"), F.col("raw_value"))).withColumn("key", F.when(F.col("category") == "color", color_key(F.col("raw_value"))))
    by_id = lock.select("id", F.col("name").alias("by_id"))
    by_key = lock.where("category = 'color'").withColumn("key", color_key(F.col("value"))).where("key is not null").groupBy("key").agg(F.min_by("name", "id").alias("by_key"))
    found = wanted.join(by_id, "id", "left").join(by_key, "key", "left").withColumn("own", F.coalesce("by_id", "by_key"))
    return found.select("category", "raw_value", F.coalesce("own", rule_name(F.col("category"), F.col("raw_value"))).alias("name"), F.col("own").isNotNull().alias("locked"))


def rename(lock: DataFrame, entry_id: str, name: str) -> DataFrame:
    """Sets a name; the first old name stays on record."""
    name = re.sub(r"^--+", "", name).strip()
    if not RX_NAME.fullmatch(name):
        raise ValueError(f"not a token name: {name!r}")
    if lock.where(F.col("id") == entry_id).isEmpty():
        raise KeyError(entry_id)
    own = F.col("id") == entry_id
    return lock.withColumn("renamed_from", F.when(own, F.coalesce("renamed_from", "name")).otherwise(F.col("renamed_from"))).withColumn("name", F.when(own, F.lit(name)).otherwise(F.col("name")))


@dataclass
class Decision:
    merged_with: str | None = None
    kept_separate_from: list[str] = field(default_factory=list)
    renamed_from: str | None = None
    name: str | None = None


def decide(decisions: dict[str, Decision], message: dict) -> dict[str, Decision]:
    """The decisions after a reviewer's message (merge, keep-separate, rename). One that says nothing changes nothing."""
    out = {k: Decision(d.merged_with, list(d.kept_separate_from), d.renamed_from, d.name) for k, d in decisions.items()}
    kind = message.get("type")
    if kind == "merge":
        source, target = message.get("source_id"), message.get("target_id")
        if source and target and source != target:
            d = out.setdefault(source, Decision())
            d.merged_with, d.kept_separate_from = target, [x for x in d.kept_separate_from if x != target]
    elif kind == "keep-separate":
        ids = list(dict.fromkeys(i for i in message.get("cluster_ids", []) if i))
        for i in ids if len(ids) > 1 else ():
            d = out.setdefault(i, Decision())
            d.kept_separate_from = list(dict.fromkeys([*d.kept_separate_from, *(x for x in ids if x != i)]))
            d.merged_with = None if d.merged_with in ids else d.merged_with
    elif kind == "rename":
        name = re.sub(r"^--+", "", message["name"]).strip()
        if not RX_NAME.fullmatch(name):
            raise ValueError(f"not a token name: {message['name']!r}")
        d = out.setdefault(message["id"], Decision())
        d.name, d.renamed_from = name, message.get("previous_name") or d.renamed_from or name
    return out


def apply_decisions(lock: DataFrame, decisions: dict[str, Decision], tokens: DataFrame | None = None, now: str = "") -> DataFrame:
    """Writes decisions onto the lock: they replace earlier merges and separations, but keep the first old name."""
    spark = lock.sparkSession
    rows = [(i, d.merged_with, d.kept_separate_from or None, d.renamed_from, d.name) for i, d in decisions.items()]
    own = spark.createDataFrame(rows, "id string, d_merged string, d_kept array<string>, d_from string, d_name string")
    if tokens is not None:
        lock = lock.unionByName(create(tokens, now).join(lock.select("id"), "id", "left_anti").join(own.select("id"), "id", "left_semi"))
    joined = lock.join(own.withColumn("decided", F.lit(True)), "id", "left")
    hit = F.col("decided").isNotNull()
    return joined.select("id", "category", F.coalesce("d_name", "name").alias("name"), "value", "created_at", F.when(hit, F.col("d_merged")).otherwise(F.col("merged_with")).alias("merged_with"), F.coalesce("d_from", "renamed_from").alias("renamed_from"), F.when(hit, F.col("d_kept")).otherwise(F.col("kept_separate_from")).alias("kept_separate_from"))
