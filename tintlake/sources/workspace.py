"""Source files of a workspace as a table, and scans that read again only what has changed."""

from __future__ import annotations

import fnmatch
import json
import os
import re
import shutil
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tintlake.sources.stylesheet import occurrences

EXTENSIONS = ("css", "scss", "sass", "less", "vue", "html", "htm", "js", "jsx", "ts", "tsx")
INCLUDE = tuple(f"**/*.{e}" for e in EXTENSIONS)
EXCLUDE = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/*.min.css")
SCHEMA = "rel_path string, contents string, mtime_ms double, size long"
#: Bytes of sources that one task reads.
PART_BYTES = 16 << 20


def glob_pattern(glob: str) -> re.Pattern:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + r"(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(map(re.escape, glob[i + 1 : end].split(","))) + ")", end + 1
        else:
            out, i = out + (fnmatch.translate(glob[i])[4:-3] if glob[i] == "?" else re.escape(glob[i])), i + 1
    return re.compile(out + r"\Z")


def output_excludes(*folders: str) -> list[str]:
    """Globs that keep written token files and backups out of a scan."""
    return list(dict.fromkeys(f"**/{f.strip('/')}/**" for f in folders if f))


def listing(root: str, include: tuple[str, ...], exclude: tuple[str, ...]) -> Iterator[tuple[str, float, int]]:
    """(path below the root, mtime in ms, bytes) of the files to scan, in path order. Hidden files are left out."""
    wanted, unwanted = [glob_pattern(g) for g in include], [glob_pattern(g) for g in exclude]
    for folder, folders, files in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel + "/"
        folders[:] = sorted(f for f in folders if not f.startswith(".") and not any(p.match(f"{rel}{f}/x") for p in unwanted))
        for name in sorted(files):
            path = rel + name
            if not name.startswith(".") and any(p.match(path) for p in wanted) and not any(p.match(path) for p in unwanted):
                try:
                    stat = os.stat(os.path.join(root, path))
                except OSError:
                    continue
                yield path, stat.st_mtime_ns / 1e6, stat.st_size


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, float, int]]):
        self.files = files


class WorkspaceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.include = tuple(filter(None, options.get("include", "").split(","))) or INCLUDE
        self.exclude = tuple(filter(None, options.get("exclude", "").split(","))) or EXCLUDE
        self.contents = options.get("contents", "true") == "true"

    def partitions(self) -> list[Part]:
        parts, held, size = [], [], 0
        for f in listing(self.root, self.include, self.exclude):
            held.append(f)
            size += f[2] if self.contents else 1000
            if size >= PART_BYTES:
                parts.append(Part(held))
                held, size = [], 0
        return [*parts, Part(held)]

    def read(self, part: Part) -> Iterator[tuple]:
        for path, mtime, size in part.files:
            text = None
            if self.contents:
                try:
                    with open(os.path.join(self.root, path), encoding="utf-8", errors="replace") as f:
                        text = f.read()
                except OSError:
                    continue
            yield path, text, mtime, size


class WorkspaceFiles(DataSource):
    """spark.read.format("workspace_files").load(root); files whose names begin with _ are read too. The root is a folder all executors see."""

    @classmethod
    def name(cls) -> str:
        return "workspace_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorkspaceReader:
        return WorkspaceReader(self.options)


def read_workspace(spark: SparkSession, root: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE, contents: bool = True) -> DataFrame:
    spark.dataSource.register(WorkspaceFiles)
    return spark.read.format("workspace_files").option("include", ",".join(include)).option("exclude", ",".join(exclude)).option("contents", str(contents).lower()).load(root)


def changed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files that the cache doesn't hold with the same time and size."""
    return files.join(cached.select("rel_path", "mtime_ms", "size").distinct(), ["rel_path", "mtime_ms", "size"], "left_anti")


def incremental(files: DataFrame, cached: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(occurrences of all files, the listing to store with them). Only changed files are parsed; files that are gone fall out.

    cached: occurrences with rel_path, mtime_ms and size of the file they were read from."""
    if cached is None:
        fresh = files
        old = None
    else:
        fresh = changed(files, cached)
        old = cached.join(files.select("rel_path", "mtime_ms", "size"), ["rel_path", "mtime_ms", "size"], "left_semi")
    marks = fresh.select(F.col("rel_path").alias("file"), "rel_path", "mtime_ms", "size")
    made = marks.join(occurrences(fresh), "file", "left")
    return (made if old is None else old.unionByName(made)), fresh.select("rel_path", "mtime_ms", "size")


CACHE_VERSION = 1


def fingerprint(include: tuple[str, ...], exclude: tuple[str, ...]) -> str:
    """What a cache must have been made with to be of use."""
    return json.dumps([CACHE_VERSION, list(include), list(exclude)])


def load_cache(spark: SparkSession, folder: str, include: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame | None:
    """The occurrences of the last scan with their files' marks; None if there are none or the settings were others."""
    if not os.path.isdir(folder):
        return None
    held = spark.read.parquet(folder)
    if held.where(F.col("fingerprint") != fingerprint(include, exclude)).isEmpty():
        return held.drop("fingerprint")
    return None


def write_cache(made: DataFrame, folder: str, include: tuple[str, ...], exclude: tuple[str, ...]) -> None:
    """Stores the occurrences of `incremental` beside the old cache, which they may be read from, and takes its place."""
    made.withColumn("fingerprint", F.lit(fingerprint(include, exclude))).write.mode("overwrite").parquet(f"{folder}.new")
    shutil.rmtree(folder, ignore_errors=True)
    os.rename(f"{folder}.new", folder)
