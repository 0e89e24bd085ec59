"""Style literals of source text: stylesheets, Vue files, markup, scripts. Pure Python, run on executors a batch of files at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.functions.values import PROPERTIES, RX_BREAKPOINT, RX_COLOR, RX_EASING, RX_INTEGER, RX_LENGTH, RX_OPACITY, RX_TIME

_COLOR, _LENGTH, _TIME, _EASING, _BREAKPOINT, _INTEGER, _OPACITY = (re.compile(p, re.A) for p in (RX_COLOR, RX_LENGTH, RX_TIME, RX_EASING, RX_BREAKPOINT, RX_INTEGER, RX_OPACITY))
_NUMBER, _PERCENT = re.compile(r"-?\d*\.?\d+", re.A), re.compile(r"-?(\d+\.?\d*|\.\d+)%", re.A)
_CATEGORY = {p: c for c, names in PROPERTIES.items() for p in names.split()}
MARKUP, SCRIPT, VUE = (".html", ".htm"), (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), ".vue"


@dataclass
class Declaration:
    prop: str
    value: str
    line: int
    column: int
    selector: str
    media: str | None
    block: int
    start: int  # of the value in the text


@dataclass
class Sheet:
    declarations: list[Declaration] = field(default_factory=list)
    media: list[tuple[str, int, int]] = field(default_factory=list)  # params, line, column


class Malformed(ValueError):
    pass


def blanked(text: str, line_comments: bool) -> str:
    """The text with comments as blanks, so that places stay."""
    out, i, n = [], 0, len(text)
    while i < n:
        c = text[i]
        if c in "\"'":
            j = i + 1
            while j < n and text[j] != c and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            if j >= n or text[j] != c:
                if not line_comments:
                    raise Malformed("unclosed string")
                j = min(j, n - 1)
            out.append(text[i : j + 1])
            i = j + 1
        elif text.startswith("/*", i):
            j = text.find("*/", i + 2)
            if j < 0:
                raise Malformed("unclosed comment")
            out.append(re.sub(r"[^\n]", " ", text[i : j + 2]))
            i = j + 2
        elif line_comments and text.startswith("//", i) and (i == 0 or text[i - 1] != ":"):
            j = text.find("\n", i)
            j = n if j < 0 else j
            out.append(" " * (j - i))
            i = j
        else:
            out.append(c)
            i += 1
    return "".join(out)


def parse(text: str, extension: str = ".css") -> Sheet:
    """Declarations and media rules with their places, in document order. Malformed text raises."""
    clean = blanked(text, extension in (".scss", ".sass", ".less"))
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    sheet = Sheet()
    stack: list[tuple[str, str, int]] = []  # kind, text, number of the block
    number = at = 0

    def place(i: int) -> tuple[int, int]:
        lo, hi = 0, len(starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if starts[mid] <= i else (lo, mid)
        return lo + 1, i - starts[lo] + 1

    def declare(a: int, b: int) -> None:
        raw = clean[a:b]
        lead = len(raw) - len(raw.lstrip())
        raw = raw.strip()
        m = re.match(r"([$@]?[\w-]+|\*[\w-]+)\s*:\s*", raw)
        if not m or raw.startswith("@") and not m:
            return
        value = re.sub(r"\s*!\s*important\s*$", "", raw[m.end() :], flags=re.I).strip()
        selector = next((t for k, t, _ in reversed(stack) if k == "rule"), None) or next((t for k, t, _ in reversed(stack)), "(root)")
        media = next((t[6:].strip() for k, t, _ in reversed(stack) if k == "at" and t.lower().startswith("@media")), None)
        line, column = place(a + lead)
        sheet.declarations.append(Declaration(m[1], value, line, column, selector, media, stack[-1][2] if stack else 0, a + lead + m.end()))

    i, depth, n = 0, 0, len(clean)
    while i < n:
        c = clean[i]
        if c in "\"'":
            j = clean.find(c, i + 1)
            while j > 0 and clean[j - 1] == "\\":
                j = clean.find(c, j + 1)
            i = n if j < 0 else j + 1
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif c == "{" and i and clean[i - 1] == "#":  # interpolation
            j = clean.find("}", i)
            if j < 0:
                raise Malformed("unclosed interpolation")
            i = j
        elif c == "{" and not depth:
            head = clean[at:i]
            lead = len(head) - len(head.lstrip())
            head = head.strip()
            number += 1
            if head.startswith("@"):
                if m := re.match(r"@media\b(.*)", head, re.S | re.I):
                    sheet.media.append((m[1].strip(), *place(at + lead)))
                stack.append(("at", head, number))
            else:
                stack.append(("rule", head, number))
            at = i + 1
        elif c == ";" and not depth:
            declare(at, i)
            at = i + 1
        elif c == "}" and not depth:
            if not stack:
                raise Malformed("a block is closed that was not opened")
            declare(at, i)
            stack.pop()
            at = i + 1
        i += 1
    if stack or depth:
        raise Malformed("unclosed block")
    declare(at, n)
    return sheet


_UNSAFE = re.compile(r"var\(|calc\(", re.I)


def _layers(value: str) -> list[str]:
    out, depth, a = [], 0, 0
    for i, c in enumerate(value):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(value[a:i].strip())
            a = i + 1
    return [x for x in (*out, value[a:].strip()) if x]


def _shadow(layer: str) -> bool:
    if layer.lower() == "none" or _UNSAFE.search(layer):
        return False
    colors, rest = _COLOR.findall(layer), _COLOR.sub(" ", layer).split()
    lengths = [w for w in rest if re.fullmatch(r"0|[-+]?(?:\d+\.?\d*|\.\d+)[a-zA-Z%]+", w)]
    return len(colors) == 1 and 2 <= len(lengths) <= 4 and all(w in lengths or w.lower() == "inset" for w in rest)


def whole(prop: str, value: str) -> str | None:
    """The category of a declaration that is one composite value."""
    own = _layers(value)
    if prop in ("box-shadow", "text-shadow") and own and all(map(_shadow, own)):
        return "shadow"
    if prop in PROPERTIES["border"].split() and len(own) == 1 and value.lower() != "none" and not _UNSAFE.search(value):
        rest = _COLOR.sub(" ", value)
        styles = {"none", "hidden", "dotted", "dashed", "solid", "double", "groove", "ridge", "inset", "outset"} & set(rest.lower().split())
        if len(_COLOR.findall(value)) == 1 and len(_LENGTH.findall(rest)) == 1 and styles:
            return "border"
    if prop == "transition" and own:
        for layer in own:
            times, easings = _TIME.findall(layer), _EASING.findall(layer)
            if layer.lower() == "none" or _UNSAFE.search(layer) or not 1 <= len(times) <= 2 or len(easings) > 1 or re.search(r"\w+\s*\(", _TIME.sub(" ", _EASING.sub(" ", layer))):
                return None
        return "transition"
    return None


def literals(prop: str, value: str) -> Iterator[tuple[str, str]]:
    """(literal, category) in order."""
    value = value.strip()
    if category := whole(prop, value):
        yield value, category
        return
    yield from ((m[0], "color") for m in _COLOR.finditer(value))
    category = _CATEGORY.get(prop, "unknown")

    def lengths(kind: str) -> Iterator[tuple[str, str]]:
        for m in _LENGTH.finditer(value):
            p = _PERCENT.fullmatch(m[0]) if kind == "spacing" else None
            if not p or abs(float(m[0][:-1])) not in (0, 50, 100) or float(m[0][:-1]) < 0:
                yield m[0], kind

    times = ((m[0], "transition") for m in _TIME.finditer(value))
    if category in ("spacing", "radius", "font-size", "letter-spacing", "shadow"):
        yield from lengths(category)
    elif category == "border":
        yield from lengths("spacing")
    elif category == "line-height":
        yield from [(value, category)] if _NUMBER.fullmatch(value) else lengths(category)
    elif category == "font-family":
        yield value, category
    elif category == "font-weight":
        if _INTEGER.match(value) or value.lower() in ("normal", "bold", "lighter", "bolder"):
            yield value, category
    elif category == "z-index":
        if _INTEGER.match(value):
            yield value, category
    elif category == "opacity":
        if _OPACITY.match(value):
            yield value, category
    elif category == "transition":
        yield from times
        yield from ((m[0], category) for m in _EASING.finditer(value))
    else:
        yield from lengths("spacing")
        yield from times


Row = tuple  # file, ord, line, column, selector, property, raw_value, full_value, category, media_query, block


def from_sheet(text: str, extension: str = ".css") -> Iterator[tuple]:
    """(line, column, selector, property, raw, full, category, media, block) of a stylesheet; nothing if it is malformed."""
    try:
        sheet = parse(text, extension)
    except Malformed:
        return
    fonts: dict[tuple[str, int], list[tuple]] = {}
    for d in sheet.declarations:
        prop = d.prop.strip().lower()
        if prop.startswith(("--", "@")):
            continue
        for raw, category in literals(prop, d.value):
            row = (d.line, d.column, d.selector, prop, raw, d.value, category, d.media, d.block)
            yield row
            if prop in ("font-family", "font-size", "font-weight", "line-height", "letter-spacing") and category != "color":
                fonts.setdefault((d.selector, d.block), []).append(row)
    order = {"font-family": "fontFamily", "font-size": "fontSize", "font-weight": "fontWeight", "line-height": "lineHeight", "letter-spacing": "letterSpacing"}
    for (selector, block), rows in fonts.items():
        parts = {r[3]: r[4] for r in rows}
        if len(parts) > 1:
            text_ = "; ".join(f"{name}: {parts[p]}" for p, name in order.items() if p in parts)
            yield (rows[0][0], rows[0][1], selector, "typography", text_, text_, "typography", rows[0][7], block)
    for params, line, column in sheet.media:
        for m in _BREAKPOINT.finditer(params):
            yield (line, column, f"@media {params}", "@media", m[2], params, "breakpoint", params, 0)


_STYLE_BLOCK = re.compile(r"<style\b([^>]*)>(.*?)</style\s*>", re.S | re.I)
_STYLE_ATTRIBUTE = re.compile(r"<([a-zA-Z][\w-]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*?)\sstyle\s*=\s*(\"[^\"]*\"|'[^']*')((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)>", re.S)
_CLASS = re.compile(r"(?<![\w$])class(?:Name)?\s*=\s*[\"']\s*([^\s\"']+)")
_TEMPLATE = re.compile(r"(?<![\w$.])(?:css|createGlobalStyle|styled(?:\.\w+|\([^()]*\))(?:\.attrs\([^`]*?\))?)\s*`((?:\\.|[^`\\])*)`", re.S)
# Prefixes of utility classes with a bracketed value.
COLOR_PREFIXES = frozenset("bg text border outline fill stroke from to via decoration accent caret ring".split())
LENGTH_PREFIXES = frozenset("p px py pt pr pb pl m mx my mt mr mb ml gap w h min-w max-w min-h max-h inset top right bottom left rounded border indent text leading tracking".split())
_UTILITY = re.compile(r"(?<![^\s\"'`])([A-Za-z-]+)-\[([^\]\s]+)\]")
_UTILITY_COLOR = re.compile(r"#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})|(?:rgba?|hsla?|oklch|oklab|lab|lch|hwb|color)\(.*\)", re.I)
_UTILITY_LENGTH = re.compile(r"-?(?:\d+\.?\d*|\.\d+)(?:px|rem|em|%|vh|vw|ch)", re.A)
_UTILITY_KIND = {"text": "font-size", "leading": "line-height", "tracking": "letter-spacing", "rounded": "radius"}


def _moved(rows: Iterator[tuple], text: str, start: int, selector: str | None = None) -> Iterator[tuple]:
    """Rows of a part of a text, with the lines of the whole."""
    lines = text.count("\n", 0, start)
    for line, column, own, *rest in rows:
        yield (line + lines, column, selector or own, *rest)


def inline_styles(text: str) -> Iterator[tuple]:
    for m in _STYLE_ATTRIBUTE.finditer(text):
        first = _CLASS.search(m[2] + " " + m[4])
        yield from _moved(from_sheet(f"x {{{m[3][1:-1]}}}"), text, m.start(3), f".{first[1]}" if first else m[1])


def css_in_js(text: str) -> Iterator[tuple]:
    for m in _TEMPLATE.finditer(text):
        body = re.sub(r"\$\{[^{}]*\}", lambda x: "x" * len(x[0]) if "\n" not in x[0] else "x" + "\n" * x[0].count("\n"), m[1])
        for row in _moved(from_sheet(body, ".scss"), text, m.start(1)):
            yield (row[0], row[1], "(css-in-js)" if row[2] == "(root)" else row[2], *row[3:])


def utilities(text: str) -> Iterator[tuple]:
    for m in _UTILITY.finditer(text):
        prefix, value = m[1], m[2]
        line, column = text.count("\n", 0, m.start()) + 1, m.start() - text.rfind("\n", 0, m.start())
        head = prefix.split("-")[0]
        if prefix in COLOR_PREFIXES and _UTILITY_COLOR.fullmatch(value):
            yield (line, column, "(class)", head, value, m[0], "color", None, 0)
        elif prefix in LENGTH_PREFIXES and _UTILITY_LENGTH.fullmatch(value):
            yield (line, column, "(class)", head, value, m[0], _UTILITY_KIND.get(head, "spacing"), None, 0)


def extract(path: str, text: str) -> Iterator[tuple]:
    """All literals of a source, by its extension."""
    extension = "." + path.rpartition(".")[2].lower() if "." in path else ""
    if extension == VUE:
        for m in _STYLE_BLOCK.finditer(text):
            lang = re.search(r"lang\s*=\s*[\"']?(\w+)", m[1])
            yield from _moved(from_sheet(m[2], f".{lang[1].lower()}" if lang else ".css"), text, m.start(2))
        yield from inline_styles(text)
        yield from css_in_js(text)
        yield from utilities(text)
    elif extension in MARKUP:
        yield from inline_styles(text)
        yield from utilities(text)
    elif extension in SCRIPT:
        yield from css_in_js(text)
        yield from utilities(text)
    else:
        yield from from_sheet(text, extension)


SCHEMA = "file string, ord long, line int, `column` int, selector string, property string, raw_value string, full_value string, category string, media_query string, block int"
NAMES = ("file", "ord", "line", "column", "selector", "property", "raw_value", "full_value", "category", "media_query", "block")


def occurrences(sources: DataFrame, path_col: str = "rel_path", text_col: str = "contents") -> DataFrame:
    """The occurrences of source files, an Arrow batch of files at a time; ord counts within a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
        for batch in batches:
            rows = [(path, i, *row) for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for i, row in enumerate(extract(path or "", text or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(NAMES))

    return sources.select(F.col(path_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
