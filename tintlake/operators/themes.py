"""Light and dark pairs, and contrast of foregrounds with backgrounds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintlake.functions.color import contrast, parse_color
from tintlake.functions.values import trim
from tintlake.operators.cut import cut

# What marks a dark selector, unless others are given.
DARK = ("[data-theme=dark]", '[data-theme="dark"]', "[data-mode=dark]", "[data-color-mode=dark]", "[data-bs-theme=dark]", ".dark", ".dark-mode", ".theme-dark", ".night", ".prefers-dark", "prefers-color-scheme: dark")
NEARBY = 80
FOREGROUND, BACKGROUND = ("color",), ("background-color", "background")
DOCUMENT = ("html", "body", ":root", "(root)")


def _marker(text: str) -> str:
    """A marker as a regular expression: what stands between slashes is one, with its flags behind; anything else is meant literally."""
    if given := re.fullmatch(r"/(.+)/([a-z]*)", text, re.S):
        return ("(?i)" if "i" in given[2] else "") + given[1]
    end = r"(?![\w-])" if text.startswith(".") else ""  # a class name goes on to its end
    return f"(?i){re.escape(text)}{end}"


def marker_patterns(markers: tuple[str, ...] = DARK) -> list[str]:
    """The markers' expressions, longer markers first, as a short one may be part of a long one."""
    wanted = [m.strip() for m in markers or DARK]
    return [_marker(m) for m in sorted(filter(None, wanted), key=lambda m: -len(m))]


def is_dark(selector: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= selector.rlike(p)
    return out


def base_selector(selector: Column, patterns: list[str]) -> Column:
    """Without the first place of each marker."""
    for p in patterns:
        flags, body = ("(?i)", p[4:]) if p.startswith("(?i)") else ("", p)
        selector = trim(F.regexp_replace(selector, rf"{flags}^([\s\S]*?)(?:{body})", "$1"))
    selector = trim(F.regexp_replace(selector, r"\s+", " "))
    return F.when(selector == "", "(root)").otherwise(selector)


def theme_pairs(occurrences: DataFrame, markers: tuple[str, ...] = DARK) -> DataFrame:
    """For each dark colour the light one of the same property and selector: nearest by line within 80 lines of its file, else by line anywhere.

    Light rows are many where a selector is hot, so a dark row doesn't meet all of them: of the same file and line they are
    one (the first), and the nearest line is found by merging both kinds in line order, once by file and once over all.
    """
    patterns = marker_patterns(markers)
    rows = occurrences.where("category = 'color'").select("file", "ord", "line", "selector", "property", trim(F.col("raw_value")).alias("value"))
    kinds = rows.select("selector").distinct().withColumn("dark", is_dark(F.col("selector"), patterns)).withColumn("base", base_selector(F.col("selector"), patterns))
    rows = rows.join(kinds, "selector")
    light, dark = rows.where("not dark"), rows.where("dark")
    group = ["property", "base"]
    counts = light.groupBy(*group).agg(F.count(F.lit(1)).alias("candidates"))
    dark = dark.join(counts, group).select(*group, "file", "ord", "line", "value", "candidates")

    def nearest(by: list[str], name: str, most: int | None) -> DataFrame:
        """The place and value of the nearest light row, the earlier place on ties."""
        place = F.struct("file", "ord", "value")
        points = light.groupBy(*by, "line").agg(F.min(place).alias("light"))
        asked = dark.select(*by, "line").distinct().select("*", F.lit(None).cast(points.schema["light"].dataType).alias("light"))
        both = points.unionByName(asked)
        mark = F.when(F.col("light").isNotNull(), F.struct("line", "light"))
        order = Window.partitionBy(*by).orderBy("line")
        both = both.withColumn("before", F.last(mark, True).over(order.rangeBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(mark, True).over(order.rangeBetween(0, Window.unboundedFollowing)))
        options = F.filter(F.array("before", "after"), lambda x: x.isNotNull())
        best = F.array_min(F.transform(options, lambda x: F.struct(F.abs(x["line"] - F.col("line")).alias("d"), x["light"].alias("light"))))
        out = both.where("light is null").select(*by, "line", best.alias(name))
        return out.where(F.col(name)["d"] <= most) if most is not None else out

    own = nearest([*group, "file"], "near", NEARBY)
    out = dark.join(own, [*group, "file", "line"], "left").join(nearest(group, "far", None), [*group, "line"], "left")
    out = out.withColumn("m", F.coalesce("near", "far")["light"]).where("m.value <> value")
    return out.select("property", F.col("base").alias("base_selector"), F.col("m.value").alias("light_value"), F.col("value").alias("dark_value"), F.col("m.file").alias("light_file"), F.col("m.ord").alias("light_ord"), F.col("file").alias("dark_file"), F.col("ord").alias("dark_ord"), F.when(F.col("candidates") == 1, "high").otherwise("low").alias("confidence"), F.col("candidates").alias("candidate_count"))


def ancestors(selector: Column) -> Column:
    """The prefixes of a selector that may be its ancestors: what stands before a space, >, __ or --."""
    s = trim(selector)
    ends = F.transform(F.sequence(F.lit(2), F.length(s)), lambda i: F.when(s.substr(i, F.lit(1)).isin(" ", ">") | s.substr(i, F.lit(2)).isin("__", "--"), trim(s.substr(F.lit(1), i - 1))))
    return F.when(F.length(s) >= 2, F.array_distinct(F.filter(ends, lambda x: x.isNotNull() & (x != "") & (x != s)))).otherwise(F.array().cast("array<string>"))


def _rows(occurrences: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """Colour rows of the properties. Findings are of the first row of equal file, selector and value, so only that stays."""
    rows = occurrences.where((F.col("category") == "color") & F.col("property").isin(*properties))
    return rows.groupBy("file", "selector", trim(F.col("raw_value")).alias("value")).agg(F.min(F.struct("ord", "line")).alias("at")).select("file", "selector", "value", "at.ord", "at.line")


def _first(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file", "selector").agg(F.min(F.struct("ord", "line", "value")).alias("x")).select("file", "selector", "x.*")


def _named(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select("file", *(F.col(c).alias(f"{prefix}_{c}") for c in ("selector", "value", "ord", "line")))


def contrast_pairs(occurrences: DataFrame) -> dict[str, DataFrame]:
    """Pairs by kind: same-selector, ancestor, document, inherited. Each has file, fg_* and bg_*."""
    fg, bg = _rows(occurrences, FOREGROUND), _rows(occurrences, BACKGROUND)
    own = _named(_first(bg), "bg").withColumnRenamed("bg_selector", "selector")
    same = _named(_first(fg), "fg").withColumn("selector", F.col("fg_selector")).join(own, ["file", "selector"]).withColumnRenamed("selector", "bg_selector")
    lonely = fg.join(bg.select("file", "selector").distinct(), ["file", "selector"], "left_anti")
    # an equality on each prefix instead of a test of every pair
    up = lonely.select("selector").distinct().select("selector", F.explode(ancestors(F.col("selector"))).alias("parent"))
    backs = _named(bg, "bg").withColumn("parent", trim(F.col("bg_selector")))
    ancestor = _named(lonely, "fg").join(up.withColumnRenamed("selector", "fg_selector"), "fg_selector").join(backs, ["file", "parent"]).drop("parent")
    left = _named(lonely, "fg").join(ancestor.select("file", "fg_selector").distinct(), ["file", "fg_selector"], "left_anti")
    document = left.join(_named(bg, "bg").where(F.lower(trim(F.col("bg_selector"))).isin(*DOCUMENT)), "file")
    alone = _first(bg.join(fg.select("file", "selector").distinct(), ["file", "selector"], "left_anti"))
    down = alone.select("selector").distinct().select(F.col("selector").alias("bg_selector"), F.explode(ancestors(F.col("selector"))).alias("parent"))
    inherited = _named(alone, "bg").join(down, "bg_selector").join(_named(fg, "fg").withColumn("parent", trim(F.col("fg_selector"))), ["file", "parent"]).drop("parent")
    return {"same-selector": same, "ancestor": ancestor, "document": document, "inherited": inherited}


def findings(pairs: DataFrame) -> DataFrame:
    """selector, file, line, foreground, background, ratio (two decimals), passes_aa, passes_aaa, pairing: the first pair of each.

    Ratios are worked out once for each pair of values, whatever the number of places."""
    first = cut(pairs.groupBy("file", "fg_selector", "fg_value", "bg_value", "pairing").agg(F.min(F.struct("fg_ord", "fg_line"))["fg_line"].alias("line")))
    colors = first.select("fg_value", "bg_value").distinct().withColumn("raw", contrast(parse_color(F.col("fg_value")), parse_color(F.col("bg_value")))).where("raw is not null")
    out = first.join(colors, ["fg_value", "bg_value"])
    return out.select(F.col("fg_selector").alias("selector"), "file", "line", F.col("fg_value").alias("foreground"), F.col("bg_value").alias("background"), (F.floor(F.col("raw") * 100 + 0.5) / 100).alias("ratio"), (F.col("raw") >= 4.5).alias("passes_aa"), (F.col("raw") >= 7).alias("passes_aaa"), "pairing")


def check_contrast(occurrences: DataFrame, kinds: tuple[str, ...] = ("same-selector", "ancestor", "document", "inherited")) -> DataFrame:
    pairs = contrast_pairs(occurrences)
    made = [pairs[k].select("file", "fg_selector", "fg_value", "bg_value", "fg_ord", "fg_line").withColumn("pairing", F.lit(k)) for k in kinds]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return findings(out)
