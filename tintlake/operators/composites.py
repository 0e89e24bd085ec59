"""Values of several parts: shadows, borders, transitions, typography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintlake.functions.color import color_key
from tintlake.functions.values import RX_COLOR, RX_EASING, RX_LENGTH, RX_TIME, layers, let, matches, number_of, trim, unit_of

# Fixed values.
BORDER_STYLES = ("none", "hidden", "dotted", "dashed", "solid", "double", "groove", "ridge", "inset", "outset")
FONT_PARTS = {"font-family": "fontFamily", "font-size": "fontSize", "font-weight": "fontWeight", "line-height": "lineHeight", "letter-spacing": "letterSpacing"}
PARTS = "map<string,string>"
_FUNCTION = r"(?:rgba?|hsla?|oklch|oklab|lab|lch|hwb|color)\([^)]*\)"


#: What stands between brackets, to a depth of three; a bracket that never closes reaches the end.
_INSIDE = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\)?+)*+\)?+)*+\)?+"
#: A word of a value: a string, a hex colour, a number with its unit, a name or a function with its brackets.
RX_TOKEN = rf"""\"[^\"]*+\"?+|'[^']*+'?+|#[0-9a-fA-F]*+|[-+.](?=[0-9.])[0-9.]++[a-zA-Z%]*+|[0-9][0-9.]*+[a-zA-Z%]*+|[a-zA-Z_-][a-zA-Z0-9_-]*+(?:{_INSIDE})?+"""


def composite_tokens(v: Column) -> Column:
    """The words of a value outside brackets, each with its kind: length, color, keyword, function or string."""

    def kind(t: Column) -> Column:
        numeric = t.rlike("^(?:[-+.][0-9.]|[0-9])")
        sized = (t == "0") | (number_of(t).isNotNull() & (unit_of(t) != ""))
        return (
            F.when(t.rlike("^[\"']"), "string")
            .when(numeric, F.when(sized, "length").otherwise("keyword"))
            .when(t.startswith("#"), F.when(t.rlike("^#(?:[0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"), "color").otherwise("keyword"))
            .when(t.rlike(r"^(?i)(?:rgba?|hsla?|hwb|lab|lch|oklab|oklch|color)\("), "color")
            .when(t.contains("("), "function")
            .otherwise("keyword")
        )

    return F.transform(matches(trim(v), RX_TOKEN), lambda t: F.struct(t.alias("raw"), kind(t).alias("kind")))


def normalize_words(words: Column) -> Column:
    """Words with their kinds by meaning: colours by key, zero without a unit, names in lower case, functions and strings as they are."""

    def plain(t: Column) -> Column:
        raw, kind = t["raw"], t["kind"]
        return (
            F.when(kind == "color", F.coalesce(color_key(raw), F.lower(raw)))
            .when(kind == "length", F.when(number_of(raw) == 0, "0").otherwise(F.lower(raw)))
            .when(kind == "keyword", F.lower(raw))
            .otherwise(raw)
        )

    return F.array_join(F.transform(words, plain), " ")


def normalize_composite(v: Column) -> Column:
    return normalize_words(composite_tokens(v))


def composite_parts(category: Column, v: Column) -> Column:
    """The parts of a shadow, border, transition or typography value; null if it is none or not plain."""
    fonts = F.transform(F.filter(F.split(v, r";\s*"), lambda x: x.contains(":")), lambda x: F.struct(trim(F.split(x, ":", 2)[0]).alias("key"), trim(F.split(x, ":", 2)[1]).alias("value")))
    typography = F.when(F.size(fonts) > 0, F.map_from_entries(fonts))
    return F.when(category == "shadow", shadow_parts(v)).when(category == "border", border_parts(v)).when(category == "transition", transition_parts(v)).when(category == "typography", typography)


def _parts(**named: Column) -> Column:
    """A map without the parts that are null."""
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in named.items())), lambda e: e["value"].isNotNull())
    return F.map_from_entries(pairs)


def _unsafe(v: Column) -> Column:
    low = F.lower(v)
    return (v == "") | (low == "none") | low.contains("var(") | low.contains("calc(")


def shadow_layer(v: Column) -> Column:
    """offsetX, offsetY, color and what else a layer has; null unless it is one colour, two to four lengths and perhaps inset."""

    def kinds(words: Column) -> Column:
        colors = F.filter(words, lambda w: w.rlike(rf"(?i)^{_FUNCTION}$") | w.rlike("^#(?:[0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"))
        lengths = F.filter(words, lambda w: w.rlike(r"^(?:0|[-+]?(?:\d+\.?\d*|\.\d+)[a-zA-Z%]+)$"))
        return F.struct(colors.alias("colors"), lengths.alias("lengths"), F.size(F.filter(words, lambda w: F.lower(w) == "inset")).alias("inset"), F.size(words).alias("n"))

    def made(x: Column) -> Column:
        ok = (F.size(x["colors"]) == 1) & F.size(x["lengths"]).between(2, 4) & (x["n"] == F.size(x["colors"]) + F.size(x["lengths"]) + x["inset"])
        at = [F.get(x["lengths"], F.lit(i)) for i in range(4)]
        return F.when(ok, _parts(offsetX=at[0], offsetY=at[1], color=F.get(x["colors"], F.lit(0)), blur=at[2], spread=at[3], inset=F.when(x["inset"] > 0, "true")))

    words = F.filter(matches(v, _FUNCTION + r"|#[0-9a-fA-F]+|[^\s,]+"), lambda w: w != "")
    return F.when(~_unsafe(v), let(let(words, kinds), made))


def _layered(v: Column, one) -> Column:
    def made(x: Column) -> Column:
        good = (F.size(x["own"]) > 0) & F.forall(x["parsed"], lambda p: p.isNotNull())
        return F.when(good & (F.size(x["own"]) == 1), F.get(x["parsed"], F.lit(0))).when(good, _parts(layers=F.size(x["own"]), value=trim(v)))

    return let(let(layers(v), lambda own: F.struct(own.alias("own"), F.transform(own, one).alias("parsed"))), made)


def shadow_parts(v: Column) -> Column:
    return _layered(v, shadow_layer)


def shadow_shape(parts: Column) -> Column:
    sizes = F.array_join(F.filter(F.array(parts["offsetX"], parts["offsetY"], parts["blur"], parts["spread"]), lambda x: x.isNotNull()), " ")
    return F.concat(F.when(parts["inset"] == "true", "inset ").otherwise(""), sizes)


def border_parts(v: Column) -> Column:
    v = trim(v)
    colors = matches(v, RX_COLOR)
    rest = F.regexp_replace(v, RX_COLOR, " ")
    lengths = matches(rest, RX_LENGTH)
    style = F.get(F.filter(F.transform(F.split(rest, r"\s+"), F.lower), lambda w: w.isin(*BORDER_STYLES)), F.lit(0))
    ok = ~_unsafe(v) & (F.size(layers(v)) == 1) & (F.size(colors) == 1) & (F.size(lengths) == 1) & style.isNotNull()
    return F.when(ok, _parts(width=lengths[0], style=style, color=colors[0]))


def transition_layer(v: Column) -> Column:
    times, easings = matches(v, RX_TIME), matches(v, RX_EASING)
    rest = F.regexp_replace(F.regexp_replace(v, RX_EASING, " "), RX_TIME, " ")
    ok = ~_unsafe(v) & F.size(times).between(1, 2) & (F.size(easings) <= 1) & ~rest.rlike(r"\w+\s*\(")
    return F.when(ok, _parts(duration=times[0], delay=F.coalesce(F.get(times, F.lit(1)), F.lit("0s")), timingFunction=F.coalesce(F.get(easings, F.lit(0)), F.lit("ease"))))


def transition_parts(v: Column) -> Column:
    return _layered(v, transition_layer)


def typography_text(parts: Column) -> Column:
    """Parts in fixed order."""
    return F.array_join(F.filter(F.array(*(F.when(parts[k].isNotNull() & (parts[k] != ""), F.concat(F.lit(f"{k}: "), parts[k])) for k in FONT_PARTS.values())), lambda x: x.isNotNull()), "; ")


def font_shorthand(parts: Column) -> Column:
    size = F.when(parts["lineHeight"].isNotNull(), F.concat(parts["fontSize"], F.lit("/"), parts["lineHeight"])).otherwise(parts["fontSize"])
    return F.when(parts["fontSize"].isNotNull() & parts["fontFamily"].isNotNull(), F.concat_ws(" ", parts["fontWeight"], size, parts["fontFamily"]))


def typography(occurrences: DataFrame) -> DataFrame:
    """One row for each block (file, selector, block) with two or more font longhands; the last of each counts."""
    rows = occurrences.where(F.col("property").isin(*FONT_PARTS) & F.col("category").isin(*FONT_PARTS))
    last = rows.groupBy("file", "selector", "block", "property").agg(F.max(F.struct("ord", "raw_value"))["raw_value"].alias("raw_value"), F.min(F.struct("ord", "line", "column", "media_query")).alias("first"))
    key = F.create_map(*(x for k, v in FONT_PARTS.items() for x in (F.lit(k), F.lit(v))))[F.col("property")]
    made = last.groupBy("file", "selector", "block").agg(F.map_from_entries(F.collect_list(F.struct(key, F.col("raw_value")))).alias("parts"), F.min("first").alias("first")).where(F.size("parts") >= 2)
    return made.select("file", "selector", "block", "first.line", "first.column", "first.media_query", typography_text(F.col("parts")).alias("raw_value"), "parts")


def expand_shadows(occurrences: DataFrame) -> DataFrame:
    """Component mode: of each shadow declaration a row for the shape and one for the colour of every layer; its other rows go."""
    place = ["file", "line", "column", "property"]
    shadows = occurrences.where(F.col("property").isin("box-shadow", "text-shadow"))
    first = shadows.groupBy(*place).agg(F.min(F.struct("ord", "selector", "full_value", "media_query")).alias("x")).select(*place, "x.*")
    own = layers(F.col("full_value"))
    parsed = first.withColumn("layers", F.transform(own, shadow_layer))
    parsed = parsed.where((F.size(own) > 0) & F.forall("layers", lambda x: x.isNotNull()))
    rows = parsed.select("*", F.size("layers").alias("of"), F.posexplode("layers").alias("layer", "parts"))
    both = F.array(F.struct(F.lit("shadow").alias("category"), shadow_shape(F.col("parts")).alias("raw_value"), F.lit("shadow-shape").alias("role")), F.struct(F.lit("color").alias("category"), F.col("parts")["color"].alias("raw_value"), F.lit("shadow-color").alias("role")))
    extra = rows.select(*place, "ord", "selector", "full_value", "media_query", "layer", "of", F.explode(both).alias("e")).select(*place, "ord", "selector", "full_value", "media_query", "e.category", "e.raw_value", "e.role", "layer", "of")
    kept = occurrences.join(parsed.select(*place), place, "left_anti")
    return kept.select(*place, "ord", "selector", "full_value", "media_query", "category", "raw_value", F.lit(None).cast("string").alias("role"), F.lit(None).cast("int").alias("layer"), F.lit(None).cast("int").alias("of")).unionByName(extra)
