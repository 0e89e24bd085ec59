"""Secret scans with multipart credential linking, in native columns only.

Base kinds, leftmost and non-overlapping each: `assign` (a keyword, `:` or `=`, a value of 6 or more characters), `access`
(AKIA and more, 20 or more characters), `hex` (24 or more lower-case hex digits). Weak kinds are too common to report
alone: `account` (a user, login, account, client or key id that is assigned), `opaque` (a mixed string of 32 or more
base64 characters, URL-safe ones too, with = at its end only) and `endpoint` (an address with a scheme). A weak span is reported only if a part it needs lies within
`SCOPE` code points of it in the same text: an account or an endpoint needs a secret (assign, hex, opaque), an opaque
string needs an identifier (access, account) or an endpoint. Weak spans that touch a base span are dropped.

Parts must be apart: a string inside a span, or one that covers it, is no complement of it. Weak spans that touch a base
span are dropped.

Spans are found without positions from the regex engine: the text is split by the pattern, and lengths of gaps and matches
add up to places. No pattern repeats a group unless possessively, so the engine's stack doesn't grow with the text. The
spans, which are narrow, are stored once and linked from there, by an interval join on buckets of SCOPE code points. Ends and
starts of parts of one kind are first summed to the least and the greatest by bucket, so a text full of parts makes no
pairs: a window of SCOPE meets two neighbouring buckets, of the first only the greatest can matter and of the second only the
least, so these two tell exactly whether one part lies in it.

`redact` merges spans that overlap or touch and cuts them in one go, so nothing but reported text is lost.

Null or empty text: no spans. Very long texts are scanned whole. Null ids and repeated rows: every row is scanned on its
own; equal texts are linked once. An empty table gives an empty result. Extra columns are ignored by `scan` and pass through
`redact`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tintlake.llm.shared import only, stored

#: Code points between parts that belong together, at most.
SCOPE = 200
#: Matches whose lengths are summed in one step, and steps in one leap.
STEP = 32
#: Code points of a piece that text is cut from.
PIECE = 4096
MARK = "[REDACTED]"

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a shorter run holds no longer match
HEX = r"[0-9a-f]{24,}"
ACCOUNT = r"""(?i)(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])"  # after an = it is a value
ENDPOINT = r"""(?i)(?<![a-z0-9])(?:https?|ftp|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)(?:[:+][a-z0-9]++)*+://[^\s"'<>]+"""
VALUE = 6

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "account", "opaque", "endpoint")
#: A cheap test that a text may hold each kind.
MAY_HOLD = {
    "assign": lambda t: t.rlike(r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike("[0-9a-f]{24}"),
    "account": lambda t: t.rlike(r"""(?i)(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]"""),
    "opaque": lambda t: t.rlike("[A-Za-z0-9+/_-]{32}"),
    "endpoint": lambda t: t.contains("://"),
}
PATTERN = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "account": ACCOUNT, "opaque": OPAQUE, "endpoint": ENDPOINT}
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "account": "identifier", "opaque": "secret", "endpoint": "endpoint"}
NEEDS = {"account": ("secret",), "opaque": ("identifier", "endpoint"), "endpoint": ("secret",)}


def _lengths(text: Column, kind: str) -> Column:
    """Gap before, length, code points before the value and whether it is kept, of each match, if the text may hold the kind."""
    rx = F.lit(PATTERN[kind])
    hits = F.regexp_extract_all(text, rx, F.lit(0))
    sizes = F.transform(hits, F.char_length)
    lead, kept = F.transform(hits, lambda h: F.lit(0)), F.transform(hits, lambda h: F.lit(True))
    if kind == "assign":
        values = F.transform(F.regexp_extract_all(text, rx, F.lit(2)), F.char_length)
        lead, kept = F.zip_with(sizes, values, lambda n, v: n - v), F.transform(values, lambda v: v >= VALUE)
    elif kind == "opaque":
        kept = F.transform(hits, lambda h: h.rlike("[0-9]") & h.rlike("[a-z]") & h.rlike("[A-Z]"))
    made = F.arrays_zip(F.transform(F.split(text, PATTERN[kind], -1), F.char_length).alias("gap"), sizes.alias("size"), lead.alias("lead"), kept.alias("kept"))
    return F.when(F.col(f"may_{kind}"), F.filter(made, lambda x: x["size"].isNotNull())).otherwise(F.array().cast("array<struct<gap:int,size:int,lead:int,kept:boolean>>"))


def _spans(kind: str) -> Column:
    """Start, kind, end and lead of the matches that are kept; sums go by whole leaps, then by steps, then within the last one."""
    rows, steps, leaps = F.col(f"len_{kind}"), F.col(f"sum_{kind}"), F.col(f"far_{kind}")

    def end(i: Column) -> Column:
        step, leap = (i / STEP).cast("int"), (i / (STEP * STEP)).cast("int")
        whole = _sum(F.slice(leaps, 1, leap)) + _sum(F.slice(steps, leap * STEP + 1, step - leap * STEP))
        return F.aggregate(F.slice(rows, step * STEP + 1, i % STEP + 1), whole, lambda a, x: a + x["gap"] + x["size"])

    placed = F.transform(rows, lambda x, i: F.named_struct(F.lit("end"), end(i), F.lit("size"), x["size"], F.lit("lead"), x["lead"], F.lit("kept"), x["kept"]))
    return F.transform(F.filter(placed, lambda x: x["kept"]), lambda x: F.struct((x["end"] - x["size"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["lead"].alias("lead")))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, y: a + y)


def _step_sums(kind: str) -> Column:
    rows = F.col(f"len_{kind}")
    return F.transform(F.sequence(F.lit(0), (F.size(rows) / STEP).cast("int")), lambda b: F.aggregate(F.slice(rows, b * STEP + 1, STEP), F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["size"]))


def _leap_sums(kind: str) -> Column:
    steps = F.col(f"sum_{kind}")
    return F.transform(F.sequence(F.lit(0), (F.size(steps) / STEP).cast("int")), lambda b: _sum(F.slice(steps, b * STEP + 1, STEP)))


def found(docs: DataFrame, key: Column, kept: list[str], text_col: str = "text", named: Callable[[Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """The kept columns, `key`, `digest` (of texts that `named` picks, else of those where something may link) and spans by kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(*kept, key.alias("key"), text.alias("scanned"))
    docs = docs.select("*", *(MAY_HOLD[k](F.col("scanned")).alias(f"may_{k}") for k in KINDS))
    docs = docs.select(*kept, "key", F.when((named or _may_link)(lambda k: F.col(f"may_{k}")), F.sha2("scanned", 256)).alias("digest"), *(_lengths(F.col("scanned"), k).alias(f"len_{k}") for k in KINDS))
    docs = docs.select("*", *(_step_sums(k).alias(f"sum_{k}") for k in KINDS))
    docs = docs.select("*", *(_leap_sums(k).alias(f"far_{k}") for k in KINDS))
    return docs.select(*kept, "key", "digest", *(_spans(k).alias(k) for k in KINDS))


def _any(has: Callable[[str], Column], kinds: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, map(has, kinds))


def _may_link(has: Callable[[str], Column]) -> Column:
    return _any(has, ("account", "endpoint")) & _any(has, ("assign", "hex", "opaque")) | has("opaque") & has("access")


def _parts(rows: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """A row for each distinct span of a text."""
    return rows.select("key", "digest", F.explode(F.concat(*(F.col(k) for k in kinds))).alias("s")).select("key", "digest", "s.*").distinct()


def _side(name: str, place: str) -> Column:
    return F.named_struct(F.lit("side"), F.lit(name), F.lit("at"), F.col(place))


def linked(rows: DataFrame) -> DataFrame:
    """key, digest, start, kind, end of the weak spans to report: a complement is near and no base span is touched."""
    parts = _parts(rows.where(F.col("digest").isNotNull() & _may_link(lambda k: F.size(k) > 0)), KINDS)
    parts = parts.select("key", "digest", F.array(*(F.lit(ROLE[k]) for k in KINDS))[F.col("kind")].alias("role"), "start", "kind", "end")
    near = parts.select("key", "digest", "role", F.explode(F.array(_side("before", "end"), _side("after", "start"))).alias("b")).select("key", "digest", "role", "b.*")
    near = near.groupBy("key", "digest", "role", "side", F.floor(F.col("at") / SCOPE).alias("bucket")).agg(F.min("at").alias("least"), F.max("at").alias("most"))
    needs = F.when(F.col("kind") == KINDS.index("opaque"), F.array(*map(F.lit, NEEDS["opaque"]))).otherwise(F.array(F.lit("secret")))
    weak = parts.where(F.col("kind") >= len(BASE)).drop("role").select("*", F.explode(needs).alias("role"), (F.col("start") - SCOPE).alias("low"))
    weak = weak.select("*", F.explode(F.array(_side("before", "low"), _side("after", "end"))).alias("b")).select("key", "digest", "start", "kind", "end", "role", "b.*")
    weak = weak.select("*", F.explode(F.array(F.floor(F.col("at") / SCOPE), F.floor(F.col("at") / SCOPE) + 1)).alias("bucket"))
    met = weak.join(near, ["key", "digest", "role", "side", "bucket"]).where((F.col("most") >= F.col("at")) & (F.col("least") <= F.col("at") + SCOPE))
    met = met.select("key", "digest", "start", "kind", "end").distinct()
    # the furthest end of the base spans that start before a weak span ends: it touches one if that lies behind its start
    base = parts.where(F.col("kind") < len(BASE)).select("key", "digest", F.col("start").alias("at"), F.col("end").alias("reach"), *(F.lit(None).cast(t).alias(c) for c, t in (("start", "long"), ("kind", "int"), ("end", "long"))))
    asked = met.select("key", "digest", F.col("end").alias("at"), F.lit(None).cast("long").alias("reach"), "start", "kind", "end")
    order = Window.partitionBy("key", "digest").orderBy("at", F.col("reach").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return asked.union(base).withColumn("reach", F.max("reach").over(order)).where("start is not null and (reach is null or reach <= start)").select("key", "digest", "start", "kind", "end")


def _strings(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = stored(found(only(docs, doc_id=id_col, text=text_col), F.xxhash64("doc_id"), ["doc_id"]), "spans")
    weak = linked(rows).select("key", "digest", F.struct("start", "kind", "end", F.lit(0).alias("lead")).alias("s"))
    links = weak.groupBy("key", "digest").agg(F.collect_list("s").alias("weak")).toDF("__k", "__d", "weak")
    rows = rows.join(links, (F.col("key") == F.col("__k")) & (F.coalesce("digest", F.lit("")) == F.col("__d")), "left")
    rows = rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.concat(*BASE).alias("base"), F.coalesce("weak", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,lead:int>>")).alias("weak"))
    return rows.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(_strings(F.col("base")), 256).alias("base_sha256"), _strings(F.concat("base", "weak")).alias("spans"))


def merged(spans: DataFrame) -> DataFrame:
    """key, digest and the array `cuts` of start and end: spans that overlap or touch are one. spans: key, digest, start, end."""
    order = Window.partitionBy("key", "digest").orderBy("start", "end")
    spans = spans.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("part", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("key", "digest", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("key", "digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _without(pieces: Column, length: Column, cuts: Column) -> Column:
    """The text with MARK for each cut; cuts ascend and lie apart. Parts are taken from pieces, as places in a string are found by counting."""

    def part(start: Column, end: Column) -> Column:
        a, b = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
        first, last = F.get(pieces, a), F.coalesce(F.get(pieces, b), F.lit(""))
        inside = first.substr((start % PIECE + 1).cast("int"), (end - start).cast("int"))
        across = F.concat(F.coalesce(first.substr((start % PIECE + 1).cast("int"), F.lit(PIECE)), F.lit("")), F.array_join(F.slice(pieces, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), last.substr(F.lit(1), (end % PIECE).cast("int")))
        return F.when(start >= end, F.lit("")).when(a == b, inside).otherwise(across)

    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda c: c["end"]))
    ends = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(length))
    return F.array_join(F.zip_with(starts, ends, part), MARK)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with [REDACTED] for each reported span; of an assignment the keyword stays. A null text stays null."""
    fields = docs.schema.fields
    held = docs.select(F.struct(*(F.col(f"`{f.name}`") for f in fields)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    may = _any(lambda k: MAY_HOLD[k](F.coalesce("text", F.lit(""))), KINDS)
    held = held.select("row", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), F.when(may, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("d"))
    rows = stored(found(held.where("d is not null").select("text", "k"), F.col("k"), [], "text", lambda has: F.lit(True)), "spans")  # no filter here: it would be pushed below and spell out every span again
    base = _parts(rows, BASE).select("key", "digest", (F.col("start") + F.col("lead")).alias("start"), "end")
    cuts = merged(base.union(linked(rows).select("key", "digest", "start", "end")))
    held = held.join(cuts, (F.col("k") == F.col("key")) & (F.coalesce("d", F.lit("")) == F.col("digest")), "left")
    held = held.select("row", "text", "cuts", F.when(F.col("cuts").isNotNull(), _pieces(F.col("text"))).alias("pieces"), F.char_length("text").cast("long").alias("n"))
    done = F.when(F.col("cuts").isNotNull(), _without(F.col("pieces"), F.col("n"), F.col("cuts"))).otherwise(F.col("text"))
    return held.select(*(done.alias(f.name) if f.name == text_col else F.col("row").getField(f.name).alias(f.name) for f in fields))
