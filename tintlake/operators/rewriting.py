"""Planned edits of sources: what may be replaced by a token, by which, and what that does to text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintlake.functions.names import rule_name
from tintlake.functions.values import bounded_count, stable_id, trim
from tintlake.sources.stylesheet import Malformed, parse


def skip_reason(prop: Column, raw: Column, full: Column, typography: Column | None = None) -> Column:
    """Why an occurrence can't be replaced safely; null if it can."""
    value = trim(raw)
    whole = trim(full) == value
    first = F.when(typography, "shorthand") if typography is not None else F.when(F.lit(False), "shorthand")
    return first.when(prop.startswith("--"), "custom-property-definition").when(prop.rlike("^-(webkit|moz|ms|o)-"), "vendor-prefix").when(whole, None).when(bounded_count(full, value) == 1, None).otherwise("ambiguous")


def reference(name: Column, file: Column) -> Column:
    return F.when(F.lower(file).rlike(r"\.(scss|sass)$"), F.concat(F.lit("$"), name)).otherwise(F.concat(F.lit("var(--"), name, F.lit(")")))


def build_plan(occurrences: DataFrame, tokens: DataFrame) -> DataFrame:
    """The occurrences with item_id, token_name, replacement, safe, accepted, skip_reason, assisted.

    A token is found by id, else by value, else by the value in lower case, else the value is named by rule. Tokens are looked
    up for distinct values; of tokens with the same value the last by name counts.
    """
    values = occurrences.select("category", "raw_value").distinct().withColumn("value", trim(F.col("raw_value")))
    ids = tokens.groupBy("cluster_id").agg(F.max("name").alias("by_id"))
    spelled = tokens.select("category", trim(F.col("value")).alias("value"), "name")
    spelled = spelled.union(spelled.select("category", F.lower("value"), "name")).groupBy("category", "value").agg(F.max("name").alias("by_value"))
    lower = spelled.select("category", F.col("value").alias("lowered"), F.col("by_value").alias("by_lower"))
    found = (
        values.withColumn("cluster_id", stable_id(F.col("category"), F.col("raw_value")))
        .withColumn("lowered", F.lower("value"))
        .join(ids, "cluster_id", "left")
        .join(spelled, ["category", "value"], "left")
        .join(lower, ["category", "lowered"], "left")
        .select("category", "raw_value", F.coalesce("by_id", "by_value", "by_lower", rule_name(F.col("category"), F.col("raw_value"))).alias("token_name"))
    )
    reason = skip_reason(F.col("property"), F.col("raw_value"), F.col("full_value"), F.col("category") == "typography")
    out = occurrences.join(found, ["category", "raw_value"]).withColumn("skip_reason", reason)
    safe = F.col("skip_reason").isNull()
    # the place in the file instead of a running number over all files, which would need one sort of everything
    out = out.withColumn("item_id", F.concat_ws(":", "file", "line", "column", "property", "ord")) if "ord" in out.columns else out
    return out.withColumn("replacement", reference(F.col("token_name"), F.col("file"))).withColumn("safe", safe).withColumn("accepted", safe).withColumn("assisted", safe & (trim(F.col("full_value")) != trim(F.col("raw_value"))))


def only_category(plan: DataFrame, category: str | None) -> DataFrame:
    return plan if category is None else plan.withColumn("accepted", F.col("accepted") & (F.col("category") == category))


def plan_counts(plan: DataFrame) -> DataFrame:
    use = F.col("accepted") & F.col("safe")
    return plan.groupBy("file").agg(F.count_if(use).alias("replaced"), F.count_if(~use).alias("skipped"))


def edit_shift(edits: DataFrame) -> DataFrame:
    """Edits (file, start, end, replacement) with new_start and new_end, their place once all are made."""
    delta = F.char_length("replacement") - (F.col("end") - F.col("start"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(delta).over(before), F.lit(0))
    return edits.withColumn("new_start", (F.col("start") + shift).cast("long")).withColumn("new_end", (F.col("start") + shift + F.char_length("replacement")).cast("long"))


def rename_references(sources: DataFrame, old: str, new: str, text_col: str = "contents") -> DataFrame:
    """Sources with var(--old) and $old renamed, and how many references there were."""
    q = "".join(f"\\{c}" if not c.isalnum() and c not in "_-" else c for c in old)
    css, scss = rf"var\(\s*--{q}(?=[\s,)])", rf"\${q}(?![\w-])"
    text = F.col(text_col)
    n = F.regexp_count(text, F.lit(css)) + F.regexp_count(text, F.lit(scss))
    made = F.regexp_replace(F.regexp_replace(text, css, f"var(--{new}"), scss, f"\\${new}")
    return sources.withColumn("references", n).withColumn(text_col, made)


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def find_literal(text: str, line: int, column: int, literal: str, starts: list[int] | None = None) -> tuple[int, int] | None:
    """Where the literal is: at the place, else once on the line, else once in the text; not inside a longer word. starts: those of the text's lines, if known."""
    starts = line_starts(text) if starts is None else starts

    def alone(i: int) -> bool:
        j = i + len(literal)
        word = lambda c: c.isascii() and (c.isalnum() or c == "_")
        return not (i > 0 and word(text[i - 1])) and not (j < len(text) and word(text[j]))

    def places(a: int, b: int) -> list[int]:
        out, i = [], text.find(literal, a, b)
        while i >= 0:
            if alone(i):
                out.append(i)
            i = text.find(literal, i + max(1, len(literal)), b)
        return out

    if not literal:
        return None
    if 1 <= line <= len(starts):
        a = starts[line - 1]
        b = starts[line] - 1 if line < len(starts) else len(text)
        i = a + column - 1
        if text.startswith(literal, i) and a <= i < b:
            return i, i + len(literal)
        own = places(a, b)
        if len(own) == 1:
            return own[0], own[0] + len(literal)
    own = places(0, len(text))
    return (own[0], own[0] + len(literal)) if len(own) == 1 else None


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Non-overlapping edits, the last first."""
    last = len(text) + 1
    for start, end, replacement in sorted(set(edits), reverse=True):
        if end > last:
            raise ValueError("edits overlap")
        text, last = text[:start] + replacement + text[end:], start
    return text


def invert_edits(text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The edits that undo these."""
    out, shift = [], 0
    for start, end, replacement in sorted(set(edits)):
        out.append((start + shift, start + shift + len(replacement), text[start:end]))
        shift += len(replacement) - (end - start)
    return out


def rewrite(sources: DataFrame, plan: DataFrame) -> DataFrame:
    """file, contents, replaced: the sources that accepted and safe edits change. Edits of one file come together, as its text does."""

    def one(key: tuple, texts: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if texts.empty or items.empty:
            return pd.DataFrame({"file": [], "contents": [], "replaced": []})
        text, edits = texts["contents"].iloc[0], set()
        starts = line_starts(text)
        for r in items.sort_values(["line", "column", "raw_value"]).itertuples():
            # the value stands after the property on its line or later; its declaration narrows the search
            if at := find_literal(text, int(r.line), int(r.column), r.full_value.strip(), starts):
                inner = find_literal(text[at[0] : at[1]], 1, 1, r.raw_value.strip())
                if inner:
                    edits.add((at[0] + inner[0], at[0] + inner[1], r.replacement))
                    continue
            if at := find_literal(text, int(r.line), int(r.column), r.raw_value.strip(), starts):
                edits.add((*at, r.replacement))
        made = apply_edits(text, list(edits))
        return pd.DataFrame({"file": [key[0]], "contents": [made], "replaced": [len(edits)]}) if made != text else pd.DataFrame({"file": [], "contents": [], "replaced": []})

    use = plan.where("accepted and safe").select("file", "line", "column", "raw_value", "full_value", "replacement")
    return sources.select("file", "contents").groupBy("file").cogroup(use.groupBy("file")).applyInPandas(one, "file string, contents string, replaced long")


def _alone(text: str, literal: str) -> list[int]:
    """Where a literal stands without a letter, digit or underscore beside it."""
    return [m.start() for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(literal)}(?![A-Za-z0-9_])", text)] if literal else []


def simple_edits(file: str, text: str, literal: str, replacement: str) -> tuple[list[tuple[int, int, str]], int]:
    """The edits that put a replacement for a literal, and how many declarations hold it more than once and stay.

    In stylesheets a declaration's whole value is replaced, or the only place of the literal in it; elsewhere, and in sheets
    that can't be read, every place where it stands alone."""
    extension = file[file.rfind(".") :].lower() if "." in file else ""
    if extension in (".css", ".scss", ".sass", ".less"):
        try:
            sheet = parse(text, extension)
        except Malformed:
            sheet = None
        if sheet is not None:
            edits, skipped = [], 0
            for d in sheet.declarations:
                if d.value == literal:
                    edits.append((d.start, d.start + len(literal), replacement))
                elif literal in d.value:
                    places = _alone(d.value, literal)
                    if len(places) == 1 and text.startswith(literal, d.start + places[0]):
                        edits.append((d.start + places[0], d.start + places[0] + len(literal), replacement))
                    else:
                        skipped += 1
            return edits, skipped
    return [(i, i + len(literal), replacement) for i in _alone(text, literal)], 0


def rewrite_simple(sources: DataFrame, literal: str, name: str) -> DataFrame:
    """file, contents, replaced, skipped: every source with one literal replaced by a token's reference. One pass, no shuffle."""
    literal = literal.strip()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for file, text in zip(frame["file"], frame["contents"], strict=True):
                to = f"${name}" if file.lower().endswith((".scss", ".sass")) else f"var(--{name})"
                edits, skipped = simple_edits(file, text or "", literal, to)
                rows.append((file, apply_edits(text or "", edits), len(edits), skipped))
            yield pd.DataFrame(rows, columns=["file", "contents", "replaced", "skipped"])

    return sources.select("file", "contents").mapInPandas(run, "file string, contents string, replaced long, skipped long")


def backups(sources: DataFrame, plan: DataFrame) -> Iterator[tuple[str, str]]:
    """The files a plan will change, as they are."""
    use = plan.where("accepted and safe").select("file").distinct()
    for r in sources.join(use, "file", "left_semi").select("file", "contents").toLocalIterator():
        yield r.file, r.contents
