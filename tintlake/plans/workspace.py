"""A whole run over a workspace, and its command line: scan, generate, check, preview, apply."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintlake.operators import clusters, composites, lock, naming, rewriting, sinks, themes, typos
from tintlake.operators.cut import cut
from tintlake.plans import backups
from tintlake.plans.config import Config, load
from tintlake.sources.stylesheet import occurrences
from tintlake.sources.workspace import incremental, load_cache, read_workspace, write_cache

LOCK_FILE = "tokens.lock.json"


@dataclass
class Run:
    """The relations of a run."""

    files: DataFrame
    occurrences: DataFrame
    report: DataFrame
    typos: DataFrame
    clusters: DataFrame
    tokens: DataFrame
    diff: DataFrame | None
    theme_pairs: DataFrame
    contrast: DataFrame

    def register(self) -> None:
        """Makes every relation a temporary view, for SQL."""
        for name, df in vars(self).items():
            if df is not None:
                df.createOrReplaceTempView(name)


def run(spark: SparkSession, root: str, config: Config | None = None, locked: DataFrame | None = None, cache: str | None = None, aliases: DataFrame | None = None) -> Run:
    """cache: a folder below which occurrences are kept, so that only changed files are parsed again. aliases: name and alias that users gave."""
    config = config or Config()
    files = read_workspace(spark, root, config.include, config.excludes())
    if cache is None:
        found = occurrences(files)
    else:
        made, _ = incremental(files, load_cache(spark, cache, config.include, config.excludes()))
        made = cut(made)
        write_cache(made, cache, config.include, config.excludes())
        found = made.where("property is not null").drop("rel_path", "mtime_ms", "size")
    occ = found.where(F.col("category").isin(*config.categories))
    if config.composite_mode == "component":
        occ = composites.expand_shadows(occ)
    occ = cut(occ)
    groups = cut(clusters.flagged(clusters.clusters(occ, config.min_occurrences), config.color_delta_e, config.spacing_tolerance_rem))
    tokens = naming.tokens(groups, clusters.file_counts(occ), naming.semantic_votes(occ), palette_names=naming.palette_names(groups), prefix=config.prefix, case=config.case)
    diff = None
    if locked is not None:
        diff = lock.diff(tokens, locked)
        tokens = lock.resolved_tokens(tokens, locked)
        groups = cut(lock.resolved_clusters(groups, locked))
    if aliases is not None:
        tokens = lock.with_aliases(tokens, aliases)
    return Run(files, occ, clusters.report(occ), typos.typos(occ), groups, cut(tokens), diff, themes.theme_pairs(occ, config.dark_markers), themes.check_contrast(occ))


def read_lock(spark: SparkSession, path: Path) -> DataFrame | None:
    """The lock of a JSON file; None if there is none that can be read."""
    try:
        entries = json.loads(path.read_text(encoding="utf-8"))["entries"]
    except (OSError, ValueError, KeyError, TypeError):
        return None
    names = [f.split(" ")[0] for f in lock.ENTRY.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in entries], lock.ENTRY)


def write_lock(entries: DataFrame, path: Path, now: str) -> None:
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in entries.orderBy("category", "value").toLocalIterator()]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"version": 1, "generated_at": now, "entries": rows}, indent=1) + "\n", encoding="utf-8")


def generate(made: Run, config: Config, folder: Path) -> list[str]:
    """Writes the token files of the wanted formats."""
    present = [r.category for r in made.tokens.select("category").distinct().collect()]  # 15 at most
    files: dict[str, str] = {}
    for category in present:
        if "css" in config.formats:
            files[f"{category}.css"] = sinks.token_file(made.tokens, category)
        if "scss" in config.formats:
            files[f"{category}.scss"] = sinks.token_file(made.tokens, category, scss=True)
    if "css" in config.formats:
        files["index.css"] = sinks.index_file(present)
    if "json-dtcg" in config.formats:
        files["tokens.json"] = json.dumps(sinks.dtcg(made.tokens), indent=1)
    if "tokens-studio" in config.formats:
        files["studio.json"] = json.dumps(sinks.studio(made.tokens), indent=1)
    if "stylelint" in config.formats:
        files["stylelint.json"] = json.dumps(sinks.stylelint(present), indent=1)
    if "docs" in config.formats:
        files["README.md"] = "\n".join([sinks.markdown("Tokens", made.tokens.orderBy(F.desc("occurrence_count"), "name"), ["name", "value", "occurrence_count", "file_count"]), sinks.markdown("Probable typing errors", made.typos.orderBy("suspect_count", F.desc("likely_count")), ["suspect_value", "likely_intended", "suspect_count", "likely_count", "reason"]), sinks.markdown("Failing contrast", made.contrast.where("not passes_aa"), ["file", "line", "selector", "foreground", "background", "ratio"])])
    return sinks.write(str(folder), files)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tintlake")
    parser.add_argument("command", choices=("scan", "generate", "check", "preview", "apply", "backups", "restore"))
    parser.add_argument("root")
    parser.add_argument("--config", help="project settings, JSON")
    parser.add_argument("--out", help="folder of token files")
    parser.add_argument("--plan", default="migration-plan.json")
    parser.add_argument("--category")
    parser.add_argument("--json", action="store_true", help="scan prints its report as JSON")
    parser.add_argument("--yes", action="store_true", help="apply writes sources only with this")
    args = parser.parse_args(argv)
    found = load(args.config)
    for w in found.warnings:
        print(w, file=sys.stderr)
    config, now = found.config, datetime.now(UTC).isoformat()
    folder = Path(args.root, args.out or config.output)
    if args.command in ("backups", "restore"):
        held = backups.bundles(folder / ".backups")
        if args.command == "restore" and held:
            print("\n".join(backups.restore(held[0], Path(args.root))))
        for b in held if args.command == "backups" else ():
            print(f"{b.created_at}: {len(b.files)} files")
        return int(args.command == "restore" and not held)
    spark = SparkSession.builder.appName("tintlake").getOrCreate()
    if args.command == "apply":
        if not args.yes:
            print("apply changes sources: say --yes", file=sys.stderr)
            return 2
        plan = spark.read.json(args.plan)
        files = read_workspace(spark, args.root, config.include, config.excludes())
        held = backups.write_bundle(folder / ".backups", rewriting.backups(files.withColumnRenamed("rel_path", "file"), plan), now)
        done = 0
        for r in rewriting.rewrite(files.withColumnRenamed("rel_path", "file"), plan).toLocalIterator():
            Path(args.root, r.file).write_text(r.contents, encoding="utf-8")
            done += r.replaced
        print(f"{done} replaced; the sources as they were are in {held.folder}")
        return 0
    locked = read_lock(spark, folder / LOCK_FILE)
    made = run(spark, args.root, config, locked)
    if args.command == "scan":
        rows = made.report.collect()  # a row for each category
        if args.json:
            print(json.dumps([r.asDict() for r in rows]))
        for r in () if args.json else rows:
            print(f"{r.category}: {r.total} ({r.distinct_values} distinct)")
    elif args.command == "check":
        empty = lock.create(made.tokens, now).limit(0)
        added = (made.diff if made.diff is not None else lock.diff(made.tokens, empty)).where("change = 'added'").count()
        print(f"{added} values are not in the lock")
        return int(added > 0)
    elif args.command == "generate":
        for name in generate(made, config, folder):
            print(name)
        entries = lock.create(made.tokens, now) if locked is None else lock.merged_lock(made.tokens, locked, now)
        write_lock(entries, folder / LOCK_FILE, now)
    else:
        plan = rewriting.only_category(rewriting.build_plan(made.occurrences, made.tokens), args.category)
        with open(args.plan, "w", encoding="utf-8") as f:  # a line for each edit, as Spark reads it back
            f.writelines(line + "\n" for line in plan.toJSON().toLocalIterator())
        print(args.plan)
    return 0


if __name__ == "__main__":
    sys.exit(main())
