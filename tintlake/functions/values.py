"""Values of style declarations: numbers with units, literals, categories, ids."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories in the order reports list them, properties by category, patterns of literals.
CATEGORIES = ("color", "spacing", "radius", "font-family", "font-size", "font-weight", "line-height", "letter-spacing", "shadow", "z-index", "breakpoint", "transition", "opacity", "border", "typography")
PROPERTIES = {
    "spacing": """margin margin-top margin-right margin-bottom margin-left padding padding-top padding-right padding-bottom padding-left gap row-gap
        column-gap top right bottom left width height min-width min-height max-width max-height border-width border-top-width border-right-width
        border-bottom-width border-left-width outline-width flex-basis""",
    "font-family": "font-family font",
    "font-size": "font-size",
    "font-weight": "font-weight",
    "line-height": "line-height",
    "letter-spacing": "letter-spacing",
    "radius": "border-radius border-top-left-radius border-top-right-radius border-bottom-left-radius border-bottom-right-radius",
    "shadow": "box-shadow text-shadow",
    "z-index": "z-index",
    "transition": "transition transition-duration transition-delay transition-timing-function animation animation-duration animation-timing-function",
    "opacity": "opacity fill-opacity stroke-opacity",
    "border": "border border-top border-right border-bottom border-left",
}
RX_COLOR = r"#(?:[0-9a-fA-F]{3,8})\b|(?:rgba?|hsla?|oklch|oklab|lab|lch|hwb|color)\([^)]*\)"
RX_LENGTH = r"-?\d*\.?\d+(?:px|rem|em|%|vh|vw|ch|ex|pt|pc|in|cm|mm|fr)"
RX_TIME = r"-?\d*\.?\d+(?:ms|s)\b"
RX_EASING = r"cubic-bezier\([^)]*\)|steps\([^)]*\)|linear\([^)]*\)|\bease-in-out\b|\bease-in\b|\bease-out\b|\bease\b|\blinear\b|\bstep-start\b|\bstep-end\b"
RX_BREAKPOINT = r"(min-width|max-width|min-height|max-height)\s*:\s*(-?\d*\.?\d+(?:px|em|rem))"
RX_INTEGER = r"^-?\d+$"
RX_OPACITY = r"^(?:0(?:\.\d+)?|1(?:\.0+)?|\.\d+|\d{1,3}%)$"
RX_NUMBER = r"^(-?(?:\d+\.?\d*|\.\d+))([\s\S]*)$"

_SPACE = r"[\s ﻿]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def trim(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, rf"^{_SPACE}|{_SPACE}$", "")


def normalize_string(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim(c), "['\"]", ""), _SPACE, " ")


def classify_property(prop: Column) -> Column:
    pairs = chain.from_iterable((F.lit(p), F.lit(category)) for category, names in PROPERTIES.items() for p in names.split())
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(trim(prop))), F.lit("unknown"))


def number_of(c: Column) -> Column:
    """The amount a value begins with, as a double; null if it begins with none."""
    return F.regexp_extract(trim(c), RX_NUMBER, 1).try_cast("double")


def unit_of(c: Column) -> Column:
    """What follows the amount; empty if there is no amount."""
    return F.regexp_extract(trim(c), RX_NUMBER, 2)


def parse_rem(c: Column) -> Column:
    unit, amount = F.lower(unit_of(c)), number_of(c)
    return F.when(unit.isin("rem", "em"), amount).when(unit == "px", amount / 16.0)


def numeric_kind(c: Column) -> Column:
    unit = unit_of(c)
    return F.when(number_of(c).isNull(), None).when(unit == "", "unitless").when(F.lower(unit).isin("px", "rem", "em"), "px")


def numeric_amount(c: Column) -> Column:
    """In pixels, or as it is where there is no unit."""
    unit, amount = F.lower(unit_of(c)), number_of(c)
    return F.when(unit.isin("", "px"), amount).when(unit.isin("rem", "em"), amount * 16.0)


def is_layout_percentage(c: Column) -> Column:
    return (unit_of(c) == "%") & number_of(c).isin(0.0, 50.0, 100.0)


def is_escape_hatch(c: Column) -> Column:
    return trim(c).rlike("^9{3,}$")


def js_number(c: Column) -> Column:
    """A double as text without a needless fraction or exponent."""
    plain = F.call_function("format_number", c, F.lit("0.################"))
    return F.when(plain == "-0", "0").otherwise(plain)


def round_half_up(c: Column, digits: int = 0) -> Column:
    """Rounds halves up, also below zero."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(trim(c)), "[\"']", ""), "[^a-z0-9]+", "-"), "^-|-$", "")


def stable_id(category: Column, value: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of category::value, in 8 hex digits."""
    text = F.concat(category, F.lit("::"), value)
    # two bytes a unit, big-endian; a long holds every product
    raw = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(4)), lambda i: F.conv(raw.substr(i, F.lit(4)), 16, 10).cast("long"))
    folded = F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, u: (h.bitwiseXOR(u) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern in order, as an array."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def layers(c: Column) -> Column:
    """Parts between commas outside brackets (of one level), without empty ones."""
    return F.filter(F.transform(F.split(c, r",(?![^(]*\))"), trim), lambda x: x != "")


def bounded_count(text: Column, literal: Column) -> Column:
    """How often a literal stands in a text without a letter, digit or underscore beside it."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.when(literal == "", 0).otherwise(F.regexp_count(text, quoted))
