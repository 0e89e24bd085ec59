"""The driver's queries over the style operators. The occurrences are derived from lineitem (see synth)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tintlake import synth
from tintlake.functions import color, names, values
from tintlake.operators import clusters, composites, lock, naming, review, rewriting, sinks, themes, typos
from tintlake.operators.cut import cut
from tintlake.oracle import ORACLE_SQL
from tintlake.sources import stylesheet

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(view: str | None = None) -> Callable[[Callable[..., DataFrame]], Query]:
    """Registers a function of the occurrences of a view (or of (spark, sf_dir)) under its name."""

    def register(f: Callable[..., DataFrame]) -> Query:
        run = f if view is None else lambda spark, sf_dir: f(synth.occurrences(spark, sf_dir, view))
        QUERIES[f.__name__] = run
        return run

    return register


def rounded(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


@query("occ_color")
def report_summary(occ: DataFrame) -> DataFrame:
    return clusters.report(occ)


@query("occ_color")
def report_totals(occ: DataFrame) -> DataFrame:
    return clusters.totals(occ)


@query("occ_color")
def exact_cluster(occ: DataFrame) -> DataFrame:
    return clusters.clusters(occ).select("category", "cluster_key", "n")


@query("occ_color")
def canonical_value(occ: DataFrame) -> DataFrame:
    return clusters.clusters(occ).select("cluster_key", "canonical_value")


@query("occ_color")
def member_values(occ: DataFrame) -> DataFrame:
    return clusters.clusters(occ).select("cluster_key", F.array_join("members", ",").alias("members"))


@query("occ_color")
def min_occurrence_gate(occ: DataFrame) -> DataFrame:
    return clusters.clusters(occ, least=30.7).groupBy("below_threshold").agg(F.count(F.lit(1)).alias("clusters_n"), F.sum("n").alias("n"))


@query("occ_color")
def cluster_file_count(occ: DataFrame) -> DataFrame:
    return clusters.file_counts(occ)


@query("occ_color")
def normalize_color_key(occ: DataFrame) -> DataFrame:
    return occ.select("raw_value").distinct().select("raw_value", color.color_key(F.col("raw_value")).alias("color_key"))


@query("occ_color")
def parse_hex(occ: DataFrame) -> DataFrame:
    return occ.select("raw_value").distinct().select("raw_value", color.parse_hex(F.col("raw_value")).alias("c")).select("raw_value", "c.r", "c.g", "c.b", "c.a")


@query("occ_color")
def to_lab(occ: DataFrame) -> DataFrame:
    lab = occ.select(F.lower("raw_value").alias("value")).distinct().select("value", color.lab_of(color.parse_color(F.col("value"))).alias("lab"))
    return lab.select("value", *(F.round(F.col(f"lab.{k}"), 6).alias(f"lab_{k}") for k in "lab"))


@query("occ_color")
def relative_luminance(occ: DataFrame) -> DataFrame:
    return occ.select(F.lower("raw_value").alias("value")).distinct().select("value", F.round(color.luminance(color.parse_color(F.col("value"))), 6).alias("luminance"))


@query("occ_color")
def hue_lightness_name(occ: DataFrame) -> DataFrame:
    return occ.select(F.lower("raw_value").alias("value")).distinct().select("value", color.generic_color_name(F.col("value")).alias("name"))


@query("occ_color")
def color_neighbors(occ: DataFrame) -> DataFrame:
    groups = cut(clusters.clusters(occ))
    pairs = clusters.color_neighbors(groups)
    keys = groups.select("cluster_id", "cluster_key")
    pairs = pairs.join(keys.toDF("a", "ka"), "a").join(keys.toDF("b", "kb"), "b")
    return pairs.select(F.least("ka", "kb").alias("value_a"), F.greatest("ka", "kb").alias("value_b"), rounded("distance"))


@query("occ_color")
def color_flags(occ: DataFrame) -> DataFrame:
    out = clusters.flagged(clusters.clusters(occ))
    return out.select("cluster_key", "requires_approval", rounded("confidence"), F.size("related").cast("long").alias("related_n"))


@query("occ_length")
def spacing_neighbors(occ: DataFrame) -> DataFrame:
    groups = cut(clusters.clusters(occ))
    pairs = clusters.spacing_neighbors(groups)
    keys = groups.select("cluster_id", F.concat_ws("::", "category", "canonical_value").alias("k"))
    pairs = pairs.join(keys.toDF("a", "ka"), "a").join(keys.toDF("b", "kb"), "b")
    return pairs.select(F.least("ka", "kb").alias("value_a"), F.greatest("ka", "kb").alias("value_b"), rounded("distance"))


@query("occ_length")
def spacing_scale(occ: DataFrame) -> DataFrame:
    return clusters.spacing_scale(clusters.clusters(occ))


@query("occ_length")
def link_related_ids(occ: DataFrame) -> DataFrame:
    return clusters.flagged(clusters.clusters(occ)).where("requires_approval").select("category", "canonical_value", "confidence", F.array_join("related", ",").alias("related"))


@query("occ_length")
def workspace_counts(occ: DataFrame) -> DataFrame:
    return occ.groupBy("category", F.lower(values.trim(F.col("raw_value"))).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("occ_length")
def stable_id(occ: DataFrame) -> DataFrame:
    return occ.select("category", "raw_value").distinct().select("category", "raw_value", values.stable_id(F.col("category"), F.col("raw_value")).alias("id"))


@query("occ_length")
def split_css_number(occ: DataFrame) -> DataFrame:
    v = F.col("raw_value")
    return occ.select("raw_value").distinct().select("raw_value", values.number_of(v).alias("amount"), values.unit_of(v).alias("unit"), values.parse_rem(v).alias("rem"), values.numeric_kind(v).alias("kind"), values.numeric_amount(v).alias("pixels"))


@query("occ_length")
def match_length(occ: DataFrame) -> DataFrame:
    found = occ.select("full_value").distinct().select("full_value", F.posexplode(values.matches(F.col("full_value"), values.RX_LENGTH)).alias("place", "literal"))
    return found.select("full_value", F.col("place").cast("long").alias("place"), "literal")


@query("occ_shadow")
def match_color(occ: DataFrame) -> DataFrame:
    found = occ.select("full_value").distinct().select("full_value", F.posexplode(values.matches(F.col("full_value"), values.RX_COLOR)).alias("place", "literal"))
    return found.select("full_value", F.col("place").cast("long").alias("place"), "literal")


@query()
def classify_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the property of every view."""
    made = [synth.occurrences(spark, sf_dir, v).select("property") for v in ("occ_color", "occ_length", "occ_fontsize", "occ_shadow", "occ_font")]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out.groupBy("property").agg(F.count(F.lit(1)).alias("n")).withColumn("category", values.classify_property(F.col("property")))


@query()
def drop_layout_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("%")).alias("value"))
    return lineitem.where(~values.is_layout_percentage(F.col("value"))).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query()
def escape_hatch_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 10000).cast("string").alias("value"))
    return orders.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(values.is_escape_hatch(F.col("value")))


@query("occ_length")
def name_category(occ: DataFrame) -> DataFrame:
    return occ.select("category", "raw_value").distinct().select("category", "raw_value", names.rule_name(F.col("category"), F.col("raw_value")).alias("name"))


@query("occ_length")
def name_case(occ: DataFrame) -> DataFrame:
    base = occ.select(names.rule_name(F.col("category"), F.col("raw_value")).alias("name")).distinct()
    return base.select("name", *(names.name_case(F.col("name"), c).alias(c) for c in ("camel", "pascal", "snake")))


@query("occ_color")
def semantic_vote(occ: DataFrame) -> DataFrame:
    return naming.semantic_votes(occ)


@query("occ_color")
def name_collisions(occ: DataFrame) -> DataFrame:
    return naming.name_clusters(clusters.clusters(occ)).select("cluster_key", "name")


@query("occ_fontsize")
def typo_groups(occ: DataFrame) -> DataFrame:
    return typos.value_groups(occ).select("category", "kind", "amount", "display", "n")


@query("occ_fontsize")
def typo_detect(occ: DataFrame) -> DataFrame:
    return typos.typos(occ)


@query("occ_theme")
def theme_pairs(occ: DataFrame) -> DataFrame:
    return themes.theme_pairs(occ)


def _contrast(kind: str) -> Callable[[DataFrame], DataFrame]:
    return lambda occ: themes.check_contrast(occ, (kind,))


for _kind, _name in (("same-selector", "contrast_same"), ("ancestor", "contrast_ancestor"), ("document", "contrast_document"), ("inherited", "contrast_inherited")):
    QUERIES[_name] = lambda spark, sf_dir, f=_contrast(_kind): f(synth.occurrences(spark, sf_dir, "occ_contrast"))


@query("occ_contrast")
def contrast_summary(occ: DataFrame) -> DataFrame:
    found = themes.check_contrast(occ)
    return found.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("pairing") == "same-selector").alias("same_selector"), F.count_if(F.col("pairing") == "ancestor").alias("ancestor"), F.count_if(~F.col("passes_aa")).alias("failing_aa"))


@query("occ_length")
def rewrite_safety(occ: DataFrame) -> DataFrame:
    reason = rewriting.skip_reason(F.col("property"), F.col("raw_value"), F.col("full_value"))
    return occ.select("raw_value", "full_value", "property").distinct().select("raw_value", "full_value", F.coalesce(reason, F.lit("safe")).alias("safety"))


def _tokens(occ: DataFrame) -> DataFrame:
    return cut(naming.tokens(cut(clusters.clusters(occ)), clusters.file_counts(occ)))


@query("occ_color")
def build_plan(occ: DataFrame) -> DataFrame:
    """Only some values have tokens, so the lower-case and rule-name ways are taken too."""
    plan = rewriting.build_plan(occ, _tokens(occ.where("line % 3 = 0")))
    return plan.groupBy("raw_value", "token_name", "replacement", "safe").agg(F.count(F.lit(1)).alias("n"))


@query("occ_length")
def plan_counts(occ: DataFrame) -> DataFrame:
    return rewriting.plan_counts(rewriting.build_plan(occ, _tokens(occ)))


@query("occ_length")
def edit_running_shift(occ: DataFrame) -> DataFrame:
    edits = occ.select("file", (F.col("ord") * 40).alias("start"), (F.col("ord") * 40 + F.length("raw_value")).alias("end"), F.lit("var(--space)").alias("replacement"))
    return rewriting.edit_shift(edits)


@query("occ_color")
def lock_diff(occ: DataFrame) -> DataFrame:
    """The lock has other names for some clusters, lacks some, and has some that are gone or merged."""
    tokens = _tokens(occ)
    gone = tokens.select("category", F.concat(F.col("value"), F.lit("-old")).alias("value"), "name").where("substr(value, 2, 1) in ('0', '1')")
    kept = tokens.where("substr(value, 2, 1) not in ('2', '3')").select("category", "value", F.when(F.substring("value", 2, 1) == "4", F.concat(F.lit("locked-"), "name")).otherwise(F.col("name")).alias("name"))
    entries = lock.create(kept.unionByName(gone), "").withColumn("merged_with", F.when(F.col("value").like("#0%-old"), F.lit("x")))
    return lock.diff(tokens, entries)


@query("occ_color")
def merge_tokens(occ: DataFrame) -> DataFrame:
    """Every colour that begins with 1 is merged into the one that begins with 0 and goes on alike."""
    tokens = _tokens(occ)
    target = F.concat(F.lit("#0"), F.substring("value", 3, 5))
    entries = lock.create(tokens, "").withColumn("merged_with", F.when(F.substring("value", 2, 1) == "1", values.stable_id(F.col("category"), target)))
    return lock.resolved_tokens(tokens, entries).select("cluster_id", "value", "occurrence_count", "file_count")


@query("occ_color")
def review_groups(occ: DataFrame) -> DataFrame:
    return review.review_groups(clusters.flagged(clusters.clusters(occ)))


@query("occ_shadow")
def expand_composites(occ: DataFrame) -> DataFrame:
    out = composites.expand_shadows(occ)
    return out.groupBy("category", "raw_value", F.coalesce("role", F.lit("kept")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("occ_shadow")
def shadow_parts(occ: DataFrame) -> DataFrame:
    found = occ.where("property = 'box-shadow'").select("full_value").distinct().withColumn("p", composites.shadow_parts(F.col("full_value")))
    return found.select("full_value", *(F.col("p")[k].alias(k) for k in ("offsetX", "offsetY", "blur", "color", "layers")))


@query("occ_font")
def extract_typography(occ: DataFrame) -> DataFrame:
    return composites.typography(occ).select("file", "selector", "block", "line", F.col("raw_value").alias("typography"))


@query()
def css_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stylesheet.occurrences(synth.sheets(spark, sf_dir), "l_orderkey", "contents")
    return found.select(F.col("file").cast("long").alias("l_orderkey"), "line", "column", "selector", "property", "raw_value", "category")


@query()
def rename_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = synth.sheets(spark, sf_dir).withColumn("contents", F.replace(F.col("contents"), F.lit("padding: 4px"), F.lit("padding: var(--space-4) $space-4")))
    return rewriting.rename_references(sheets, "space-4", "gap-s").groupBy("references").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("contents")).alias("chars"))


@query("occ_color")
def sort_tokens(occ: DataFrame) -> DataFrame:
    """Ranks in the orders of the written files: by count, by name."""
    tokens = _tokens(occ)
    by_count, by_name = Window.partitionBy("category").orderBy(F.desc("occurrence_count"), "name"), Window.partitionBy("category").orderBy("name")
    return tokens.select("name", F.row_number().over(by_count).cast("long").alias("by_count"), F.row_number().over(by_name).cast("long").alias("by_name"))


@query("occ_color")
def sink_css(occ: DataFrame) -> DataFrame:
    return sinks.css_lines(_tokens(occ)).select("category", "name", "line")


@query("occ_color")
def sink_dtcg(occ: DataFrame) -> DataFrame:
    return sinks.dtcg_values(_tokens(occ)).select("category", "name", "json")


@query()
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = synth.occurrences(spark, sf_dir, "occ_color").unionByName(synth.occurrences(spark, sf_dir, "occ_fontsize"))
    return both.groupBy("file", "category").agg(F.count(F.lit(1)).alias("n"))


@query("occ_contrast")
def dedupe_findings(occ: DataFrame) -> DataFrame:
    """The first occurrence of each (file, selector, property, value)."""
    first = occ.groupBy("file", "selector", "property", "raw_value").agg(F.min(F.struct("ord", "line")).alias("x"))
    return first.select("file", "selector", "property", "raw_value", "x.ord", "x.line")


@query("occ_color")
def nearest_reference(occ: DataFrame) -> DataFrame:
    found = clusters.nearest_reference(occ.select(F.lower("raw_value").alias("value")), sinks.CSS_COLORS)
    return found.select("value", "reference", "delta_e", "used_for_name")


def _color(c: str):
    return color.parse_color(F.col(c))


def _channels(name: str):
    return [F.round(F.col(name)[k], 6).alias(k) for k in "rgba"]


@query("occ_css_color")
def color_functions(occ: DataFrame) -> DataFrame:
    return occ.select("raw_value").distinct().select("raw_value", _color("raw_value").alias("c")).select("raw_value", *_channels("c"))


@query("occ_lab")
def color_lab_functions(occ: DataFrame) -> DataFrame:
    return occ.select("raw_value").distinct().select("raw_value", _color("raw_value").alias("c")).select("raw_value", *(F.round(F.col("c")[k], 4).alias(k) for k in "rgb"))


@query("occ_css_color")
def color_key_spellings(occ: DataFrame) -> DataFrame:
    return clusters.clusters(occ.where("raw_value rlike '^(?i)(#|rgb)'")).select("cluster_key", "n")


@query("occ_css_color")
def composite_over(occ: DataFrame) -> DataFrame:
    """Every colour over a fixed one, and its contrast with that."""
    back = color.rgb(*(F.lit(float(x)) for x in (0x33, 0x66, 0x99, 1)))
    parsed = cut(occ.select("raw_value").distinct().select("raw_value", _color("raw_value").alias("c")))
    rows = parsed.select("raw_value", color.over(F.col("c"), back).alias("c"), F.round(color.contrast(F.col("c"), back), 6).alias("ratio"))
    return rows.select("raw_value", *_channels("c"), "ratio")


@query("occ_color")
def to_hsl(occ: DataFrame) -> DataFrame:
    rows = occ.select(F.lower("raw_value").alias("value")).distinct().select("value", color.to_hsl(_color("value")).alias("c"))
    return rows.select("value", *(F.round(F.col("c")[k], 6).alias(k) for k in "hsl"))


@query("occ_color")
def to_hex(occ: DataFrame) -> DataFrame:
    return occ.select("raw_value").distinct().select("raw_value", color.to_hex(_color("raw_value")).alias("hex"))


@query("occ_composite")
def tokenize_composite(occ: DataFrame) -> DataFrame:
    found = occ.select("raw_value").distinct().select("raw_value", F.posexplode(composites.composite_tokens(F.col("raw_value"))).alias("place", "t"))
    return found.select("raw_value", F.col("place").cast("long").alias("place"), "t.raw", "t.kind")


@query("occ_composite")
def normalize_composite(occ: DataFrame) -> DataFrame:
    return clusters.clusters(occ).select("category", "cluster_key", "n", F.size("members").cast("long").alias("members_n"))


@query("occ_composite")
def parse_border(occ: DataFrame) -> DataFrame:
    found = occ.where("category = 'border'").select("raw_value").distinct().withColumn("p", composites.border_parts(F.col("raw_value")))
    return found.select("raw_value", *(F.col("p")[k].alias(k) for k in ("width", "style", "color")))


@query("occ_composite")
def parse_transition(occ: DataFrame) -> DataFrame:
    found = occ.where("category = 'transition'").select("raw_value").distinct().withColumn("p", composites.transition_parts(F.col("raw_value")))
    return found.select("raw_value", *(F.col("p")[k].alias(k) for k in ("duration", "delay", "timingFunction", "layers")))


@query("occ_composite")
def rx_time_easing(occ: DataFrame) -> DataFrame:
    v = F.col("raw_value")
    return occ.where("category = 'transition'").select("raw_value").distinct().select("raw_value", F.array_join(values.matches(v, values.RX_TIME), "|").alias("times"), F.array_join(values.matches(F.lower(v), values.RX_EASING), "|").alias("easings"))


@query()
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("concat(' \"', p_name, '\" (', p_brand, ') -- ', p_type, '! ') as text").distinct()
    return part.select("text", values.slug(F.col("text")).alias("slug"), values.normalize_string(F.col("text")).alias("normalized"))


@query()
def sink_dtcg_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dtcg_values(synth.literal_tokens(spark, sf_dir)).select("name", "dtcg_type", "json")


@query()
def sink_studio_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.studio_values(synth.literal_tokens(spark, sf_dir).where("category in ('border', 'typography', 'shadow', 'spacing')")).select("name", F.from_json("json", "map<string,string>").alias("m"), "json").select("name", F.coalesce(F.array_join(F.sort_array(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"), "json").alias("studio"))


@query()
def sink_stylesheet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = synth.literal_tokens(spark, sf_dir)
    return sinks.css_lines(tokens).select("name", "line").unionByName(sinks.css_lines(tokens, scss=True).select("name", "line"))


@query()
def rule_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every kind of value by rule."""
    return synth.literal_tokens(spark, sf_dir).select("category", "value").distinct().select("category", "value", names.rule_name(F.col("category"), F.col("value")).alias("name"))


@query("occ_color")
def merged_lock(occ: DataFrame) -> DataFrame:
    tokens = _tokens(occ)
    gone = tokens.select("category", F.concat(F.col("value"), F.lit("-old")).alias("value"), "name").where("substr(value, 2, 1) in ('0', '1')")
    kept = tokens.where("substr(value, 2, 1) not in ('2', '3')").select("category", "value", F.concat(F.lit("locked-"), "name").alias("name"))
    entries = lock.create(kept.unionByName(gone), "before").withColumn("merged_with", F.when(F.col("value").like("#0%-old"), F.lit("x")))
    return lock.merged_lock(tokens, entries, "now").select("id", "name", "value", "created_at", "merged_with")


@query("occ_color")
def merge_clusters(occ: DataFrame) -> DataFrame:
    """Every colour that begins with 1 is merged into the one that begins with 0 and goes on alike."""
    groups = cut(clusters.flagged(clusters.clusters(occ)))
    entries = lock.create(groups.select("category", F.col("canonical_value").alias("value"), F.col("cluster_key").alias("name")), "")
    target = F.concat(F.lit("#0"), F.substring("value", 3, 5))
    entries = entries.withColumn("merged_with", F.when(F.substring("value", 2, 1) == "1", values.stable_id(F.col("category"), target)))
    return lock.resolved_clusters(groups, entries).select("cluster_id", "n", F.size("members").cast("long").alias("members_n"))


@query("occ_color")
def lock_lookup(occ: DataFrame) -> DataFrame:
    """Names of upper-case spellings under a lock that holds some of the colours."""
    entries = lock.create(_tokens(occ), "").where("substr(value, 3, 1) < '8'")
    found = lock.lookup(occ.select("category", F.upper("raw_value").alias("raw_value")), entries)
    return found.select("raw_value", F.when(F.col("locked"), F.col("name")).alias("locked_name"), "locked")


@query("occ_color")
def alias_lookup(occ: DataFrame) -> DataFrame:
    """Aliases of tokens: the user's, else none; two tokens want the same one and the first by name has it."""
    tokens = _tokens(occ)
    given = tokens.select("name", F.when(F.col("value").startswith("#0"), "brand").otherwise(F.concat(F.lit("my-"), "name")).alias("alias")).where("value not like '#2%'")
    return sinks.with_alias(lock.with_aliases(tokens, given)).select("name", "alias")


@query("occ_color")
def plan_items(occ: DataFrame) -> DataFrame:
    return rewriting.build_plan(occ, _tokens(occ)).select("item_id", "line", "accepted", "assisted")


@query("occ_color")
def review_cards(occ: DataFrame) -> DataFrame:
    groups = clusters.flagged(clusters.clusters(occ, least=30))
    return review.review_cards(cut(groups)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("label")).alias("chars"))
