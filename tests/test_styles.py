"""Style values and operators: known values, and extraction from small sources."""

import pytest
from pyspark.sql import functions as F

from tintlake.functions import color, names, values
from tintlake.functions.palette import PALETTE
from tintlake.operators import clusters, composites, lock, naming, review, rewriting, sinks, themes, typos
from tintlake.sources import stylesheet, workspace
from tintlake.synth import occurrences

OCC = "file string, ord long, line int, `column` int, selector string, property string, raw_value string, full_value string, category string, media_query string"


def occ(spark, *items):
    """(category, value, more) as occurrences in order."""
    base = {"file": "t.css", "line": 1, "column": 1, "selector": ".x", "property": "color", "media_query": None}
    made = []
    for i, (category, value, *more) in enumerate(items):
        r = base | (more[0] if more else {})
        made.append((r["file"], i, r["line"], r["column"], r["selector"], r["property"], value, r.get("full", value), category, r["media_query"]))
    return spark.createDataFrame(made, OCC)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_colors(spark):
    cases = ["#FFF", "rgba(0,0,0,.1)", "rgb(59 130 246 / 0.5)", "color(rec2020 1 0 0)", "#12345", "hsl(0 100% 50%)", "hwb(120 0% 0%)", "oklch(1 0 0)", "rgb(100%, none, 300)", "lab(100 0 0)", "rgb(from red r g b)", "nope"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, v string").select("i", color.parse_color(F.col("v")).alias("c")).orderBy("i").collect()
    got = [None if r.c is None else (round(r.c.r), round(r.c.g), round(r.c.b), round(r.c.a, 3)) for r in rows]
    assert got == [(255, 255, 255, 1), (0, 0, 0, 0.1), (59, 130, 246, 0.5), None, None, (255, 0, 0, 1), (0, 255, 0, 1), (255, 255, 255, 1), (255, 0, 255, 1), (255, 255, 255, 1), None, None]
    assert one(spark, color.color_key(F.lit("rgb(0 0 0 / 50%)"))) == "#000000@0.5"
    assert one(spark, F.round(color.contrast(color.parse_color(F.lit("#ffffff")), color.parse_color(F.lit("#3B82F6"))), 2)) == 3.68


def test_numbers_and_ids(spark):
    data = [("1.5", "unitless", 1.5), ("16px", "px", 16.0), ("1rem", "px", 16.0), (".5em", "px", 8.0), ("-2px", "px", -2.0), ("16px extra", None, None)]
    for value, kind, amount in data:
        got = spark.range(1).select(values.numeric_kind(F.lit(value)).alias("k"), values.numeric_amount(F.lit(value)).alias("a")).first()
        assert (got.k, got.a if got.k else None) == (kind, amount)
    assert one(spark, values.stable_id(F.lit("color"), F.lit("#3B82F6"))) == "784a8e3a"
    assert one(spark, values.stable_id(F.lit("spacing"), F.lit("16px"))) == "688dfd0d"
    assert one(spark, names.name_case(F.lit("color-blue-500"), "camel")) == "colorBlue500"
    for category, value, name in (("spacing", "1rem", "space-16"), ("transition", "0.2s", "duration-0-2s"), ("transition", "ease-in-out", "easing-ease-in-out"), ("opacity", "0.85", "opacity-0-85"), ("shadow", "0 4px 12px rgba(0,0,0,.2)", "shadow-4px-12px")):
        assert one(spark, names.rule_name(F.lit(category), F.lit(value))) == name


def test_clusters(spark):
    groups = clusters.clusters(occ(spark, ("color", "#3B82F6"), ("color", "#3b82f6"), ("color", "#3B82F5"), ("font-family", "\"Arial\",  sans-serif"), ("font-family", "'Arial', sans-serif")), least=2)
    got = {r.cluster_key: (r.canonical_value, r.n, r.members, r.below_threshold) for r in groups.collect()}
    assert got["#3b82f6"] == ("#3B82F6", 2, ["#3B82F6", "#3b82f6"], False) and got["#3b82f5"][3] and got["Arial, sans-serif"][1] == 2
    flags = {r.cluster_key: (r.requires_approval, round(r.confidence, 6)) for r in clusters.flagged(groups).collect()}
    assert flags["#3b82f6"] == flags["#3b82f5"] == (True, 0.853828) and flags["Arial, sans-serif"] == (False, 1.0)
    assert clusters.color_neighbors(groups, 0).count() == 0
    assert review.review_groups(clusters.flagged(clusters.clusters(occ(spark, ("color", "#3B82F6"), ("color", "#3B82F5"), ("color", "#000"))))).select("group_id").distinct().count() == 1


def test_typos(spark):
    found = typos.typos(occ(spark, *[("breakpoint", "768px")] * 40, ("breakpoint", "771px"))).collect()
    assert [(r.suspect_value, r.likely_intended, r.suspect_count, r.likely_count, r.reason) for r in found] == [("771px", "768px", 1, 40, "both")]
    assert typos.typos(occ(spark, *[("font-size", "14px")] * 12, *[("font-size", "16px")] * 20)).count() == 0
    assert [r.likely_intended for r in typos.typos(occ(spark, ("font-size", "21px"))).collect()] == ["20px"]
    near = [("font-size", "16px", {"selector": ".c"}), ("font-size", "17px", {"selector": ".c", "media_query": "(min-width: 1px)"})]
    assert typos.typos(occ(spark, *near)).count() == 0


def test_themes_and_contrast(spark):
    rows = occ(spark, ("color", "#fff", {"selector": ".card"}), ("color", "#111", {"selector": ".dark .card", "line": 5}), ("color", "#eee", {"selector": ".card", "file": "o.css", "line": 5}))
    got = [(r.light_value, r.dark_value, r.confidence, r.candidate_count) for r in themes.theme_pairs(rows).collect()]
    assert got == [("#fff", "#111", "low", 2)]
    rows = occ(spark, ("color", "#ffffff", {"selector": ".card", "property": "background-color"}), ("color", "#767676", {"selector": ".card__title"}), ("color", "#111111", {"selector": ".card"}))
    got = {r.pairing: (r.ratio, r.passes_aa, r.passes_aaa) for r in themes.check_contrast(rows).collect()}
    assert got == {"same-selector": (18.88, True, True), "ancestor": (4.54, True, False)}


SHEET = """/* c */ :root { --brand: #3B82F6; }
.card { color: #1d4ed8 !important; padding: calc(100% - 16px) 8px; font-size: 14px; line-height: 1.4; box-shadow: 0 4px 6px rgba(0,0,0,.1);
  border: 1px solid #1d4ed8; transition: opacity 200ms ease-in-out; z-index: 10; opacity: .5 }
@media (min-width: 768px) { .card { font-size: 16px } }
"""


def test_palette_names_colours(spark):
    groups = clusters.clusters(occ(spark, ("color", "#3B82F6"), ("color", "#ff0000"), ("color", "#7f3f10"), ("spacing", "16px")))
    named = naming.name_clusters(groups, palette_names=naming.palette_names(groups)).collect()
    got = {r.canonical_value: r.name for r in named}
    assert got["#3B82F6"] == "color-blue-500" and got["#ff0000"] == "color-red" and got["16px"] == "space-16" and len(got) == 4
    assert len(PALETTE) == 390


def test_palette_search_runs_on_distinct_values(spark):
    given = ["#FF0100", "#ff0100", None, "", "nope", "#12345", "rgb(0 0 255)", "#7f7f7f", "#00ff7f"] * 3
    values = spark.createDataFrame([(v,) for v in given], "value string")
    found = clusters.nearest_reference(values.select(F.lower("value").alias("value")), sinks.CSS_COLORS)
    got = {r.value: (r.reference, r.used_for_name) for r in found.collect()}
    assert got == {"#ff0100": ("red", True), "rgb(0 0 255)": ("blue", True), "#7f7f7f": ("gray", True)} and found.count() == 3
    # the filters on the match must stay above the distinct, or colours are parsed again for each row
    above, below = found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [value", 1)
    assert "regexp_extract" in above and "regexp_extract" not in below
    assert clusters.nearest_reference(values.limit(0), sinks.CSS_COLORS).count() == 0


def test_theme_view_keeps_the_whole_table(spark, tmp_path):
    rows = [(o, n, o * 7 % 40, o * 3 % 10, "RAN"[o % 3], "OF"[n % 2], float(n), 1.0) for o in range(1, 30) for n in range(1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = occurrences(spark, str(tmp_path), "occ_theme")
    assert found.count() == len(rows)
    assert found.where("selector like '.dark %'").count() == sum(r[4] == "R" and r[1] % 2 == 0 for r in rows)


def test_stylesheet():
    rows = list(stylesheet.extract("a.css", SHEET))
    by = {}
    for r in rows:
        by.setdefault(r[6], []).append((r[4], r[2], r[7]))
    assert by["color"] == [("#1d4ed8", ".card", None)] and [v for v, *_ in by["spacing"]] == ["16px", "8px"]
    assert by["font-size"] == [("14px", ".card", None), ("16px", ".card", "(min-width: 768px)")] and [v for v, *_ in by["breakpoint"]] == ["768px"]
    assert by["typography"][0][0] == "fontSize: 14px; lineHeight: 1.4" and len(by["typography"]) == 1
    assert [len(by[c]) for c in ("shadow", "border", "transition", "z-index", "opacity")] == [1] * 5
    assert list(stylesheet.extract("a.css", ".x { color: #fff")) == []
    assert [(r[0], r[1]) for r in stylesheet.extract("a.scss", "// a: #000\n  .a { $x: #fff; }")] == [(2, 8)]


def test_other_sources():
    vue = '<template><p class="big" style="color: #fff">x</p></template>\n<style lang="scss">\n.a { color: #000 }\n</style>'
    assert sorted((r[0], r[2], r[4]) for r in stylesheet.extract("a.vue", vue)) == [(1, ".big", "#fff"), (3, ".a", "#000")]
    assert [r[2] for r in stylesheet.extract("a.tsx", "const A = styled.div`color: #123456;`")] == ["(css-in-js)"]
    got = [(r[4], r[6]) for r in stylesheet.extract("a.html", '<p class="bg-[#fff] text-[14px] hover:p-[3px] -m-[2px]">')]
    assert got == [("#fff", "color"), ("14px", "font-size")]


def test_workspace(spark, tmp_path):
    (tmp_path / "_part.scss").write_text(".a { color: #fff }")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.css").write_text("a{}")
    (tmp_path / "b.css").write_text(".b { padding: 4px }")
    files = workspace.read_workspace(spark, str(tmp_path))
    assert sorted(r.rel_path for r in files.collect()) == ["_part.scss", "b.css"]
    found, _ = workspace.incremental(files, None)
    cached = found.cache()
    assert sorted((r.file, r.raw_value) for r in cached.collect()) == [("_part.scss", "#fff"), ("b.css", "4px")]
    assert workspace.changed(files, cached).count() == 0
    assert workspace.incremental(files, cached)[0].count() == 2


def test_composites(spark):
    got = one(spark, composites.shadow_parts(F.lit("inset 0 4px 6px rgba(0,0,0,.1)")))
    assert got == {"offsetX": "0", "offsetY": "4px", "blur": "6px", "color": "rgba(0,0,0,.1)", "inset": "true"}
    assert one(spark, composites.border_parts(F.lit("1px solid #1d4ed8"))) == {"width": "1px", "style": "solid", "color": "#1d4ed8"}
    assert one(spark, composites.transition_parts(F.lit("opacity 200ms ease-in-out"))) == {"duration": "200ms", "delay": "0s", "timingFunction": "ease-in-out"}
    assert one(spark, composites.shadow_parts(F.lit("var(--x)"))) is None


def test_rewriting(spark):
    cases = [("color", "#fff", "#fff", None), ("width", "16px", "calc(100% - 16px)", None), ("margin", "8px", "8px 8px", "ambiguous"), ("--x", "1px", "1px", "custom-property-definition"), ("-webkit-x", "1px", "1px", "vendor-prefix"), ("x", "2px", "0 4px 12px a, 0 1px 2px b", None)]
    for prop, raw, full, reason in cases:
        assert one(spark, rewriting.skip_reason(F.lit(prop), F.lit(raw), F.lit(full))) == reason
    text = "a { x: 1px; y: 2px }"
    edits = [(7, 10, "var(--one)"), (15, 18, "two")]
    made = rewriting.apply_edits(text, edits)
    assert made == "a { x: var(--one); y: two }" and rewriting.apply_edits(made, rewriting.invert_edits(text, edits)) == text


def test_lock_and_decisions(spark):
    tokens = spark.createDataFrame([("", "new-name", "color", "#fff", 2, 1), ("", "b", "color", "#000", 3, 4)], "cluster_id string, name string, category string, value string, occurrence_count long, file_count long")
    old = lock.create(tokens.withColumn("name", F.when(F.col("value") == "#fff", "old-name").otherwise(F.col("name"))), "t0")
    assert sorted((r.change, r.locked_name) for r in lock.diff(tokens, old).collect()) == [("renamed", "old-name"), ("unchanged", "b")]
    ids = {r.value: r.id for r in old.collect()}
    decisions = lock.decide({}, {"type": "merge", "source_id": ids["#000"], "target_id": ids["#fff"]})
    merged = lock.apply_decisions(old, decisions)
    for _ in range(2):
        assert [(r.name, r.occurrence_count, r.file_count) for r in lock.resolved_tokens(tokens, merged).collect()] == [("old-name", 5, 4)]
        merged = lock.merged_lock(tokens, merged, "t1")
    with pytest.raises(ValueError):
        lock.decide({}, {"type": "rename", "id": "x", "name": "9bad"})
    apart = lock.decide(decisions, {"type": "keep-separate", "cluster_ids": list(ids.values())})
    assert apart[ids["#000"]].merged_with is None and apart[ids["#fff"]].kept_separate_from == [ids["#000"]]


def test_sinks(spark):
    tokens = spark.createDataFrame([("space-16", "spacing", "16px", 2, 1, "space-padding-card"), ("color-a", "color", "#1d4ed8", 1, 1, None)], "name string, category string, value string, occurrence_count long, file_count long, semantic_name string")
    text = sinks.token_file(tokens, "spacing")
    assert "  --space-16: 16px; /* used 2x across 1 file(s) */\n  --space-padding-card: var(--space-16);\n" in text
    made = sinks.dtcg(tokens)
    assert made["spacing"]["space-16"]["$value"] == {"value": 16.0, "unit": "px"} and made["color"]["a"]["$value"]["components"] == [0.114, 0.306, 0.847]
