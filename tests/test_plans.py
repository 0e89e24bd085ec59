"""Settings, whole runs and streams."""

import json

from pyspark.sql import functions as F

from tintlake.operators import lock, rewriting
from tintlake.plans import backups, workspace
from tintlake.plans.config import Config, load
from tintlake.sources.workspace import load_cache, write_cache
from tintlake.streaming.watch import watch


def test_settings(tmp_path):
    rc = tmp_path / "rc.json"
    rc.write_text(json.dumps({"categories": ["zIndex", "color"], "case": "upper", "min_occurrences": 2}))
    found = load(str(rc), ("user", {"case": "camel", "prefix": "x"}), ("workspace", {"prefix": "y", "nope": 1}))
    assert (found.config.categories, found.config.case, found.config.prefix, found.config.min_occurrences) == (("z-index", "color"), "camel", "y", 2)
    assert len(found.warnings) == 2
    rc.write_text("{")
    assert load(str(rc)).config == Config() and len(load(str(rc)).warnings) == 1 and not load(str(tmp_path / "none")).warnings


def test_files_and_lock(spark, tmp_path):
    tokens = spark.createDataFrame([("space-16", "spacing", "16px", 2, 1, None)], "name string, category string, value string, occurrence_count long, file_count long, semantic_name string").withColumn("cluster_id", F.lit(""))
    made = workspace.Run(None, None, None, None, None, tokens, None, None, None)
    config = Config(formats=("css", "scss", "tokens-studio", "stylelint"))
    names = {p.rpartition("/")[2] for p in workspace.generate(made, config, tmp_path)}
    assert names == {"spacing.css", "spacing.scss", "index.css", "studio.json", "stylelint.json"}
    workspace.write_lock(lock.create(tokens, "now"), tmp_path / "lock.json", "now")
    assert [(r.name, r.value) for r in workspace.read_lock(spark, tmp_path / "lock.json").collect()] == [("space-16", "16px")]
    assert workspace.read_lock(spark, tmp_path / "none.json") is None
    assert workspace.main(["apply", str(tmp_path)]) == 2


def test_rewrite(spark):
    sources = spark.createDataFrame([("a.css", ".card { color: #fff; padding: 16px }\n")], "file string, contents string")
    plan = spark.createDataFrame([("a.css", 1, 9, "#fff", "#fff", "var(--white)", True, True), ("a.css", 1, 22, "16px", "16px", "var(--space)", False, True)], "file string, line int, `column` int, raw_value string, full_value string, replacement string, accepted boolean, safe boolean")
    assert [tuple(r) for r in rewriting.rewrite(sources, plan).collect()] == [("a.css", ".card { color: var(--white); padding: 16px }\n", 1)]
    assert list(rewriting.backups(sources, plan)) == [("a.css", ".card { color: #fff; padding: 16px }\n")]


def test_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"rel_path": "a.css", "contents": ".a { color: #fff }"}) + "\n")
    seen = []
    query = watch(spark, str(tmp_path / "in"), lambda df, n: seen.extend(r.raw_value for r in df.collect()), str(tmp_path / "state"))
    query.awaitTermination(60)
    assert seen == ["#fff"]


def test_scan_cache(spark, tmp_path):
    (tmp_path / "a.css").write_text(".card { color: #fff; padding: 16px }\n")
    (tmp_path / "b.scss").write_text(".x { color: #3B82F6 }\n")
    include, cache = ("**/*.css", "**/*.scss"), str(tmp_path / ".scan")
    read = lambda: workspace.read_workspace(spark, str(tmp_path), include, ())
    assert load_cache(spark, cache, include, ()) is None
    write_cache(workspace.incremental(read(), None)[0], cache, include, ())
    held = load_cache(spark, cache, include, ())
    assert sorted(r.raw_value for r in held.collect()) == ["#3B82F6", "#fff", "16px"] and load_cache(spark, cache, ("**/*.x",), ()) is None
    (tmp_path / "b.scss").write_text(".x { color: #000 }\n")
    made, fresh = workspace.incremental(read(), held)
    assert [r.rel_path for r in fresh.collect()] == ["b.scss"] and sorted(r.raw_value for r in made.collect()) == ["#000", "#fff", "16px"]


def test_user_aliases(spark):
    tokens = spark.createDataFrame([("space-16", "16px", None), ("space-4", "4px", "gap")], "name string, value string, semantic_name string")
    given = lock.alias(lock.alias(spark.createDataFrame([], "name string, alias string"), "space-16", "--x"), "space-16", "--gutter")
    assert sorted((r.name, r.semantic_name) for r in lock.with_aliases(tokens, given).collect()) == [("space-16", "gutter"), ("space-4", "gap")]


def test_bundles(tmp_path):
    (tmp_path / "a.css").write_text("new")
    home = tmp_path / ".backups"
    backups.write_bundle(home, [("a.css", "old"), ("d/b.css", "x")], "2025-01-01T00:00:00.1")
    backups.write_bundle(home, [("a.css", "older")], "2024-01-01T00:00:00.1")
    (home / "broken").mkdir()
    held = backups.bundles(home)
    assert [b.files for b in held] == [("a.css", "d/b.css"), ("a.css",)] and backups.bundles(tmp_path / "none") == []
    assert backups.restore(held[0], tmp_path) == ["a.css", "d/b.css"] and (tmp_path / "a.css").read_text() == "old"


def test_simple_rewriting(spark):
    sources = spark.createDataFrame([("a.css", ".a { margin: 4px; padding: 4px 8px; inset: 4px 4px; top: 14px }"), ("b.scss", ".a { margin: 4px }"), ("c.html", "<p style='top: 4px; left: 4px'>14px</p>"), ("d.css", ".a { margin: 4px; /* open")], "file string, contents string")
    got = {r.file: (r.contents, r.replaced, r.skipped) for r in rewriting.rewrite_simple(sources, " 4px ", "space-4").collect()}
    assert got["a.css"] == (".a { margin: var(--space-4); padding: var(--space-4) 8px; inset: 4px 4px; top: 14px }", 2, 2)
    assert got["b.scss"] == (".a { margin: $space-4 }", 1, 0)
    assert got["c.html"] == ("<p style='top: var(--space-4); left: var(--space-4)'>14px</p>", 2, 0)
    assert got["d.css"][1] == 1


def test_names_of_the_package():
    import tintlake

    assert tintlake.Config is Config and tintlake.rewriting is rewriting and "run" in tintlake.__all__
