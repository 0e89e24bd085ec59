"""From raw documents to packed training sequences: every stage works on all that its predecessor kept.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of documents. Quality drops documents whose grade is likelier low; of near copies (five-word shingles, a similarity
of 0.8 or more) the least doc_id stays; documents that hold a benchmark item are dropped; secrets are redacted in place;
the rest is packed into sequences of 4096 tokens: a row per piece, with its ids and its place in a sequence.

Null ids and texts pass every stage (a null text packs as the closing id alone), empty texts too. Very long texts are worked
on whole. Repeated rows stay together: copies with one id are all kept or all dropped, and an id that stands for several texts
goes only if each of them is a copy. Ties fall to the least doc_id. Extra columns pass all stages but the last, whatever their
names. An empty table of documents, labels or benchmark gives an empty result, no rejection, no contamination.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintlake.llm import decontaminate, jaccard_join, packing, quality, secret_scan
from tintlake.llm.queries import tokenizer
from tintlake.llm.shared import stored, table
from tintlake.ship import ship


def _beside(docs: DataFrame, step: Callable[[DataFrame], DataFrame], made: tuple[str, ...], keep: str) -> DataFrame:
    """The rows of docs that `step` marks with `keep`, their columns as they were, even those named like what the step makes."""
    names = {c: f"__in_{i}" if c.lower() in made else c for i, c in enumerate(docs.columns)}
    out = step(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    return out.where(keep).select(*(F.col(f"`{n}`").alias(c) for c, n in names.items()))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _beside(docs, lambda d: quality.score(d, model), ("expected_grade", "tail_probability", "keep"), "keep")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicated(docs, jaccard_join.Similarity(k=5, num=80, den=100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return _beside(docs, lambda d: decontaminate.decontaminate(d, benchmark), ("contaminated", "item_id", "edits", "end_char"), "not contaminated")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer(), keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: Neither the classifier nor the tokenizer can be said in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
