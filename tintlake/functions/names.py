"""Names of design tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tintlake.functions.color import generic_color_name
from tintlake.functions.values import js_number, layers, matches, numeric_amount, numeric_kind, slug, trim, unit_of

# Fixed value: selectors that say nothing about a value's role.
RX_GENERIC = r"(?i)^(html|body|div|span|p|a|i|b|em|strong|ul|ol|li|section|article|main|header|footer|nav|button|input|img|svg|\*|root|x|\(root\)|\(class\)|\(css-in-js\)|\(inline-style\))$"


def name_case(name: Column, case: str = "kebab") -> Column:
    if case == "kebab":
        return name
    parts = F.filter(F.split(name, "-"), lambda p: p != "")
    if case == "snake":
        made = F.array_join(parts, "_")
    else:
        title = F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p))))
        made = F.array_join(title, "")
        if case == "camel":
            made = F.concat(parts[0], F.array_join(F.slice(title, 2, F.greatest(F.size(title), F.lit(1))), ""))
    return F.when(F.size(parts) == 0, name).otherwise(made)


def property_role(prop: Column) -> Column:
    p = F.lower(trim(prop))
    return (
        F.when(p.isin("background", "background-color", "bg"), "background")
        .when(p.isin("color", "text"), "text")
        .when(p.isin("border-color", "outline-color", "border"), "border")
        .when(p.isin("fill", "stroke"), p)
        .when((p == "margin") | p.startswith("margin-") | (p == "m"), "margin")
        .when((p == "padding") | p.startswith("padding-") | (p == "p"), "padding")
        .when(p.isin("gap", "row-gap", "column-gap"), "gap")
    )


def selector_role(selector: Column) -> Column:
    last = F.element_at(F.split(trim(F.split(trim(selector), ",")[0]), r"\s+"), -1)
    word = F.regexp_extract(F.regexp_replace(last, "^:+", ""), r"^[.#]?([a-zA-Z][\w-]*)", 1)
    word = F.regexp_replace(F.regexp_replace(word, "__", "-"), "--", "-")
    return F.when((F.length(word) >= 2) & ~word.rlike(RX_GENERIC), slug(word))


def semantic_name(category: Column, prop: Column, selector: Column) -> Column:
    prefix = F.when(category == "spacing", "space").otherwise(category)
    return F.concat(prefix, F.lit("-"), property_role(prop), F.lit("-"), selector_role(selector))


def _layered(kind: str, value: Column) -> Column:
    own = layers(value)
    sizes = F.filter(F.transform(matches(F.regexp_replace(value, r"\([^)]*\)", ""), r"[-+.]?\d[\d.]*[a-zA-Z%]+"), slug), lambda s: ~s.isin("0", "0px", ""))
    text = F.when(F.size(sizes) > 0, F.array_join(sizes, "-")).otherwise(F.substring(slug(value), 1, 32))
    return F.when(F.size(own) > 1, F.concat(F.lit(f"{kind}-"), F.size(own).cast("string"), F.lit("-layer"))).otherwise(F.concat(F.lit(f"{kind}-"), text))


def rule_name(category: Column, value: Column) -> Column:
    """A name from the value alone; colours by hue and lightness."""
    px = F.when(numeric_kind(value) == "px", js_number(numeric_amount(value)))

    def sized(prefix: str) -> Column:
        return F.concat(F.lit(prefix), F.coalesce(px, slug(value)))

    size = F.regexp_extract(value, r"(?i)fontSize:\s*([^;]+)", 1)
    timing = (
        F.when(F.size(layers(value)) > 1, _layered("transition", value))
        .when(F.lower(unit_of(value)).isin("ms", "s"), F.concat(F.lit("duration-"), slug(value)))
        .when(trim(value).rlike("(?i)^(?:ease(?:-in)?(?:-out)?|linear|step-(?:start|end)|cubic-bezier)"), F.concat(F.lit("easing-"), slug(value)))
        .otherwise(F.concat(F.lit("transition-"), slug(value)))
    )
    return (
        F.when(category == "color", generic_color_name(value))
        .when(category == "spacing", sized("space-"))
        .when(category.isin("radius", "font-size", "letter-spacing", "breakpoint"), F.concat(category, F.lit("-"), F.coalesce(px, slug(value))))
        .when(category.isin("line-height", "font-weight", "border", "opacity", "z-index"), F.concat(category, F.lit("-"), slug(value)))
        .when(category == "font-family", F.concat(F.lit("font-family-"), slug(F.split(value, ",")[0])))
        .when(category == "shadow", _layered("shadow", value))
        .when(category == "typography", F.concat(F.lit("typography-"), F.when(size != "", slug(size)).otherwise(F.substring(slug(value), 1, 24))))
        .when(category == "transition", timing)
        .otherwise(F.concat(F.lit("token-"), slug(value)))
    )
