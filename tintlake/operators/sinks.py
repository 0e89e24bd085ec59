"""Token files and reports. A row becomes a line where the data are; only finished small files come to the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintlake.functions.color import parse_color
from tintlake.functions.values import CATEGORIES, js_number, let, number_of, trim, unit_of
from tintlake.operators.composites import composite_parts, composite_tokens, font_shorthand

# Keyword colours of CSS, as a palette in the order of names.
CSS_COLORS = [(n, "css", h) for n, h in (line.split() for line in """aqua #00ffff
black #000000
blue #0000ff
fuchsia #ff00ff
gray #808080
green #008000
lime #00ff00
maroon #800000
navy #000080
olive #808000
orange #ffa500
purple #800080
red #ff0000
silver #c0c0c0
teal #008080
white #ffffff
yellow #ffff00""".splitlines())]

# Types of the design-token format by category, and curves of easing keywords.
DTCG_TYPES = {"color": "color", "spacing": "dimension", "radius": "dimension", "font-family": "fontFamily", "font-size": "dimension", "font-weight": "fontWeight", "line-height": "number", "letter-spacing": "dimension", "shadow": "shadow", "z-index": "number", "breakpoint": "dimension", "transition": "transition", "opacity": "number", "border": "border", "typography": "typography"}
BEZIERS = {"linear": [0, 0, 1, 1], "ease": [0.25, 0.1, 0.25, 1], "ease-in": [0.42, 0, 1, 1], "ease-out": [0, 0, 0.58, 1], "ease-in-out": [0.42, 0, 0.58, 1]}


def with_alias(tokens: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Adds alias: a given one, else the semantic name; none that is a token's name, and each only once in a category (by name)."""
    rows = tokens
    if aliases is not None:
        rows = rows.join(aliases.select("name", F.col("alias").alias("given")), "name", "left")
        candidate = F.coalesce("given", "semantic_name")
    else:
        candidate = F.col("semantic_name")
    rows = rows.withColumn("candidate", F.when(candidate != F.col("name"), candidate))
    taken = tokens.select("category", F.col("name").alias("candidate"), F.lit(True).alias("taken")).distinct()
    nth = F.row_number().over(Window.partitionBy("category", "candidate").orderBy("name"))
    rows = rows.join(taken, ["category", "candidate"], "left").withColumn("nth", F.when(F.col("candidate").isNotNull(), nth))
    return rows.withColumn("alias", F.when(F.col("taken").isNull() & (F.col("nth") == 1), F.col("candidate"))).drop("candidate", "taken", "nth", "given")


def css_lines(tokens: DataFrame, scss: bool = False) -> DataFrame:
    """Tokens with the line that declares each. Typography becomes a font shorthand; without size and family it has no line."""
    use = F.concat(F.lit("used "), F.col("occurrence_count").cast("string"), F.lit("x across "), F.col("file_count").cast("string"), F.lit(" file(s)"))
    shown = F.when(F.col("category") == "typography", let(composite_parts(F.col("category"), F.col("value")), font_shorthand)).otherwise(F.col("value"))
    rows = tokens.withColumn("shown", shown).where("shown is not null")
    if scss:
        line = F.concat(F.lit("$"), "name", F.lit(": "), "shown", F.lit("; // "), use)
    else:
        line = F.concat(F.lit("  --"), "name", F.lit(": "), "shown", F.lit("; /* "), use, F.lit(" */"))
    return rows.withColumn("line", line).drop("shown")


def token_file(tokens: DataFrame, category: str, scss: bool = False) -> str:
    """One category's file, by name. Tokens are distinct design values, so a file is small."""
    rows = with_alias(css_lines(tokens.where(F.col("category") == category), scss))
    rows = rows.select("line", "name", "alias").orderBy(F.expr("collate(name, 'UNICODE')")).toLocalIterator()
    lines = []
    for r in rows:
        lines.append(r.line)
        if r.alias:
            lines.append(f"${r.alias}: ${r.name};" if scss else f"  --{r.alias}: var(--{r.name});")
    if not lines:
        return ""
    note = f"{category} tokens: generated by a scan, which writes over changes made here."
    return "\n".join([f"// {note}", *lines, ""] if scss else [f"/* {note} */", ":root {", *lines, "}", ""])


def index_file(categories: list[str]) -> str:
    return "".join(f'@import "./{c}.css";\n' for c in CATEGORIES if c in categories)


def _quoted(v: Column) -> Column:
    whole = F.to_json(F.struct(v.alias("x")))
    return whole.substr(F.lit(6), F.length(whole) - 6)


def _object(**fields: Column) -> Column:
    """JSON text of named values that are JSON text; those that are null are left out."""
    parts = F.filter(F.array(*(F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items())), lambda x: x.isNotNull())
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _dimension(v: Column) -> Column:
    """Amount and unit; the text where it is neither a length nor 0."""
    amount, unit = F.regexp_extract(trim(v), r"^(-?\d*\.?\d+)([a-zA-Z%]+)$", 1), F.regexp_extract(trim(v), r"^(-?\d*\.?\d+)([a-zA-Z%]+)$", 2)
    zero = _object(value=F.lit("0"), unit=F.lit('"px"'))
    known = _object(value=js_number(amount.try_cast("double")), unit=_quoted(F.when(unit == "em", "rem").otherwise(unit)))
    return F.when(trim(v) == "0", zero).when(amount != "", known).otherwise(_quoted(v))


def _number(v: Column) -> Column:
    return F.when(trim(v).rlike(r"^-?(?:\d+|\d*\.\d+)$"), js_number(trim(v).try_cast("double"))).otherwise(_quoted(trim(v)))


def _duration(v: Column) -> Column:
    amount = F.regexp_extract(trim(v), r"^(?i)(-?\d*\.?\d+)(ms|s)$", 1)
    return F.when(amount != "", _object(value=js_number(amount.try_cast("double")), unit=_quoted(F.lower(unit_of(v)))))


def _timing(v: Column) -> Column:
    """Four numbers of a curve; the text where it is none."""
    curve = F.lit(None).cast("string")
    for name, points in BEZIERS.items():
        curve = F.when(F.lower(trim(v)) == name, json.dumps(points, separators=(",", ":"))).otherwise(curve)
    own = F.regexp_extract_all(F.regexp_extract(F.lower(trim(v)), r"^cubic-bezier\(([-\d.,\s]+)\)$", 1), F.lit(r"[-\d.]+"), F.lit(0))
    bezier = F.when(F.size(own) == 4, F.concat(F.lit("["), F.array_join(F.transform(own, lambda x: js_number(x.try_cast("double"))), ","), F.lit("]")))
    return F.coalesce(curve, bezier, _quoted(trim(v)))


def _family(v: Column) -> Column:
    names = F.filter(F.transform(F.split(v, ","), lambda x: F.regexp_replace(trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")
    return F.to_json(names)


def _color(v: Column) -> Column:
    """Channels in thousandths and alpha; the text where it is no colour."""

    def made(c: Column) -> Column:
        third = [F.floor(c[k] / 255 * 1000 + 0.5) / 1000 for k in "rgb"]
        return F.when(c.isNotNull(), F.to_json(F.struct(F.lit("srgb").alias("colorSpace"), F.array(*third).alias("components"), c["a"].alias("alpha"))))

    return F.coalesce(let(parse_color(v), made), _quoted(trim(v)))


def _line_height(v: Column) -> Column:
    return F.when(trim(v).rlike(r"^-?\d*\.?\d+$"), js_number(trim(v).try_cast("double"))).otherwise(_dimension(trim(v)))


def _composite(category: Column, p: Column) -> Column:
    layered = F.when(p["layers"].isNotNull(), _quoted(p["value"]))
    shadow = _object(color=_color(p["color"]), offsetX=_dimension(p["offsetX"]), offsetY=_dimension(p["offsetY"]), blur=_dimension(F.coalesce(p["blur"], F.lit("0"))), spread=_dimension(F.coalesce(p["spread"], F.lit("0"))), inset=F.when(p["inset"] == "true", "true"))
    border = _object(color=_color(p["color"]), width=_dimension(p["width"]), style=_quoted(p["style"]))
    transition = _object(duration=_duration(p["duration"]), delay=_duration(p["delay"]), timingFunction=_timing(p["timingFunction"]))
    own = {"fontFamily": _family, "fontSize": _dimension, "fontWeight": _number, "lineHeight": _line_height, "letterSpacing": _dimension}
    typography = _object(**{k: F.when(p[k].isNotNull(), f(p[k])) for k, f in own.items()})
    return F.when(category == "border", border).when(category == "typography", typography).otherwise(F.coalesce(layered, F.when(category == "shadow", shadow).otherwise(transition)))


def _single_timing(v: Column) -> Column:
    """A transition of one word: a time or a curve alone has no parts."""
    return F.size(composite_tokens(v)) == 1


def _token_parts() -> Column:
    """The parts of a token whose value has any."""
    v, category = F.col("value"), F.col("category")
    return F.when(~((category == "transition") & _single_timing(v)), composite_parts(category, v))


def dtcg_values(tokens: DataFrame) -> DataFrame:
    """Tokens with their $type (dtcg_type) and $value as JSON text, heterogeneous by category; composites are structured."""
    v = trim(F.col("value"))
    category = F.col("category")
    value = (
        F.when(category == "color", _color(v))
        .when(category.isin("spacing", "radius", "font-size", "letter-spacing", "breakpoint", "shadow"), _dimension(v))
        .when(category.isin("font-weight", "z-index"), _number(v))
        .when(category == "line-height", _line_height(v))
        .when(category == "opacity", F.when(v.endswith("%"), js_number(number_of(v) / 100)).otherwise(_number(v)))
        .when(category == "transition", F.coalesce(_duration(v), _timing(v)))
        .when(category == "font-family", _family(v))
        .otherwise(_quoted(v))
    )
    kinds = F.create_map(*(F.lit(x) for pair in DTCG_TYPES.items() for x in pair))
    kind = (
        F.when(category.isin("shadow"), "dimension")
        .when(category == "transition", F.when(_duration(v).isNotNull(), "duration").otherwise("cubicBezier"))
        .when(category == "font-weight", "fontWeight")
        .when(category == "line-height", F.when(v.rlike(r"^-?\d*\.?\d+$"), "number").otherwise("dimension"))
        .otherwise(F.coalesce(kinds[category], F.lit("other")))
    )
    rows = tokens.withColumn("__parts", _token_parts())
    whole = F.col("__parts").isNotNull()
    return rows.withColumn("json", F.when(whole, _composite(category, F.col("__parts"))).otherwise(value)).withColumn("dtcg_type", F.when(whole, category).otherwise(kind)).drop("__parts")


def group_key(name: Column, category: Column) -> Column:
    """The name without its category in front."""
    return F.when(name.startswith(F.concat(category, F.lit("-"))), name.substr(F.length(category) + 2, F.length(name))).otherwise(name)


def dtcg(tokens: DataFrame) -> dict:
    """The whole token document. Of equal names the last counts."""
    out: dict = {}
    for r in dtcg_values(tokens).withColumn("key", group_key(F.col("name"), F.col("category"))).orderBy("category", "name").toLocalIterator():
        out.setdefault(r.category, {})[r.key] = {"$type": r.dtcg_type, "$value": json.loads(r.json), "$description": f"used {r.occurrence_count}x across {r.file_count} file(s)"}
    return out


def studio_values(tokens: DataFrame) -> DataFrame:
    """Tokens with their value as JSON text: text, or named texts for composites."""

    def made(p: Column) -> Column:
        shadow = F.create_map(*(x for k, v in {"color": p["color"], "x": p["offsetX"], "y": p["offsetY"], "blur": F.coalesce(p["blur"], F.lit("0")), "spread": F.coalesce(p["spread"], F.lit("0")), "type": F.when(p["inset"] == "true", "innerShadow").otherwise("dropShadow")}.items() for x in (F.lit(k), v)))
        return F.when(p.isNull() | p["layers"].isNotNull(), _quoted(F.col("value"))).when(F.col("category") == "shadow", F.to_json(shadow)).otherwise(F.to_json(p))

    return tokens.withColumn("json", let(_token_parts(), made))


def studio(tokens: DataFrame) -> dict:
    """A flat set of named values with their kinds."""
    kinds = DTCG_TYPES | {"spacing": "spacing", "radius": "borderRadius", "font-family": "fontFamilies", "font-size": "fontSizes", "font-weight": "fontWeights", "line-height": "lineHeights", "letter-spacing": "letterSpacing", "shadow": "boxShadow", "opacity": "opacity", "breakpoint": "sizing", "z-index": "other", "transition": "other"}
    return {r.name: {"value": json.loads(r.json), "type": kinds.get(r.category, "other")} for r in studio_values(tokens).select("name", "category", "json").orderBy("name").toLocalIterator()}


def stylelint(categories: list[str]) -> dict:
    """A strict-value rule for the categories that have tokens."""
    props = {"color": ["/color$/", "fill", "stroke"], "spacing": ["/^margin/", "/^padding/", "gap"], "radius": ["border-radius"], "font-size": ["font-size"], "font-weight": ["font-weight"], "line-height": ["line-height"], "font-family": ["font-family"], "z-index": ["z-index"], "shadow": ["box-shadow"]}
    wanted = [p for c in CATEGORIES if c in categories for p in props.get(c, ())]
    return {"plugins": ["stylelint-declaration-strict-value"], "rules": {"scale-unlimited/declaration-strict-value": [wanted, {"ignoreValues": ["inherit", "initial", "transparent", "currentColor", "unset", "0", "auto"]}]}}


def markdown(title: str, rows: DataFrame, columns: list[str]) -> str:
    head = f"## {title}\n\n| {' | '.join(columns)} |\n|{' --- |' * len(columns)}\n"
    return head + "".join("| " + " | ".join(str(r[c]).replace("|", "\\|") for c in columns) + " |\n" for r in rows.select(*columns).toLocalIterator())


def write(folder: str, files: dict[str, str]) -> list[str]:
    """Writes small text files and says which."""
    out = []
    for name, text in files.items():
        if text:
            path = Path(folder, name)
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text, encoding="utf-8")
            out.append(str(path))
    return out
