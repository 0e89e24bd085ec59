"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector shared by all grades and ascending thresholds. x holds
the shares of a text's byte trigrams, hashed into `BUCKETS` buckets and square-rooted on the training side by nothing but
their scale, and one bucket for each of a few statistics of form (repetition, upper case, signs, digits, lengths). Two or
more grades are allowed; the tables here have 0 and 1. A document gets its expected grade and the probability that its
grade reaches `tail`, by which it is selected.

The model is fitted on a bounded sample of rated documents: the `SAMPLE` ratings with the smallest hash of their id, so
the sample doesn't hang on row order. Everything else is one pass over whole texts.

Null or empty text: scored by its form alone. Null ratings and ratings without a document are left out; repeated ids of
rated documents count once. With no rating at all, or a single grade, every document gets that grade (0 without any) and
is kept. Repeated rows get equal scores, very long texts are read whole, an empty table gives an empty result. Extra columns
pass through; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tintlake.llm.shared import blocks, only, per_row, utf8, with_fields

#: Rated documents that the model is fitted on, at most.
SAMPLE = 4000
BUCKETS = 4096
#: Buckets of one statistic.
STEPS = 16
STATS = 6
SIZE = BUCKETS + STEPS * STATS
#: How much the trigram shares weigh against the statistics.
SCALE = 40.0

_KIND = np.zeros(256, np.uint8)  # 1 upper case, 2 digits, 4 signs
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4


def trigrams(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte but the last two."""
    h = data.astype(np.uint32)
    h = (h[:-2] * np.uint32(0x9E3779B1) + h[1:-1] * np.uint32(0x85EBCA6B) + h[2:] * np.uint32(0xC2B2AE35)) if len(h) > 2 else h[:0]
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20)


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of STATS columns: the step of each statistic."""
    n = np.maximum(np.diff(bounds), 1).astype(float)
    kind = _KIND[data]
    upper, digits, signs = (per_row((kind == k).astype(np.int64), bounds) / n for k in (1, 2, 4))
    raw = data.tobytes()
    distinct, mean = np.ones(len(n)), np.zeros(len(n))
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if words := raw[a:b].split():
            # so that length alone doesn't lower it: distinct words against what Heaps' law lets expect
            distinct[i] = len(set(words)) / len(words) ** 0.8
            mean[i] = (b - a) / len(words)
    steps = (np.log2(distinct + 1e-3) * 3 + 12, np.sqrt(upper) * 15, np.sqrt(signs) * 15, np.sqrt(digits) * 15, np.log2(mean + 1) * 3, np.log2(n) * 0.8)
    return np.stack([np.clip(s, 0, STEPS - 1).astype(np.int64) for s in steps], 1)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A dense row per text, for training."""
    x = np.zeros((len(bounds) - 1, SIZE), np.float32)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if b - a > 2:
            x[i, :BUCKETS] = np.bincount(trigrams(data[a:b]), minlength=BUCKETS) * (SCALE / (b - a - 2))
    steps = statistics(data, bounds) + BUCKETS + np.arange(STATS) * STEPS
    np.put_along_axis(x, steps, 1.0, 1)
    return x


@dataclass
class CumulativeLink:
    grades: list[int] = field(default_factory=lambda: [0])
    weights: np.ndarray = field(default_factory=lambda: np.zeros(SIZE, np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Of each grade, by row."""
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        upto = np.concatenate((np.zeros((len(score), 1)), upto, np.ones((len(score), 1))), 1)
        return np.diff(upto, axis=1)

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        steps = statistics(data, bounds) + BUCKETS + np.arange(STATS) * STEPS
        out = self.weights[steps].sum(1).astype(float)
        if len(data) > 2:
            own = np.append(self.weights[trigrams(data)], np.zeros(2, np.float32)).astype(np.float64)
            last = np.maximum(bounds[1:] - 2, bounds[:-1])
            total = np.concatenate(([0.0], np.cumsum(own)))
            out += (total[last] - total[bounds[:-1]]) * SCALE / np.maximum(last - bounds[:-1], 1)
        return out


def fit_link(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 3e-4) -> CumulativeLink:
    """Maximum likelihood by full-batch Adam; thresholds stay ascending as their distances are exponentials."""
    grades = sorted(set(y.tolist()))
    if len(grades) < 2:
        return CumulativeLink(grades or [0])
    k = np.searchsorted(grades, y)
    share = np.clip(np.cumsum(np.bincount(k, minlength=len(grades)))[:-1] / len(y), 1e-3, 1 - 1e-3)
    cut = np.log(share / (1 - share))
    theta = np.concatenate((cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))))
    params = [np.zeros(x.shape[1], np.float32), theta]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, steps + 1):
        w, theta = params
        cuts = np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:]))))
        s = (x @ w).astype(float)
        edge = 1 / (1 + np.exp(-np.clip(cuts[None, :] - s[:, None], -40, 40)))
        padded = np.concatenate((np.zeros((len(y), 1)), edge, np.ones((len(y), 1))), 1)
        slope = padded * (1 - padded)
        rows = np.arange(len(y))
        p = np.maximum(padded[rows, k + 1] - padded[rows, k], 1e-9)
        up, low = slope[rows, k + 1] / p, slope[rows, k] / p  # d log p / d cut_k and -d log p / d cut_(k-1)
        g_cut = np.array([(np.where(k == j, up, 0) - np.where(k == j + 1, low, 0)).sum() for j in range(len(cuts))]) / len(y)
        g_s = (low - up) / len(y)
        tail = np.cumsum(g_cut[::-1])[::-1]
        grads = [-(x.T @ g_s.astype(np.float32)) + decay * w, -np.concatenate((tail[:1], tail[1:] * np.exp(theta[1:])))]
        for i, g in enumerate(grads):
            m, v = moments[i]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            params[i] = params[i] - (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(params[i].dtype)
    w, theta = params
    return CumulativeLink(grades, w, np.cumsum(np.concatenate((theta[:1], np.exp(theta[1:])))))


def fit(docs: DataFrame, ratings: DataFrame, grade_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> CumulativeLink:
    rated = only(ratings, doc_id=id_col, grade=grade_col).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so many rows at most: small enough to broadcast

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = utf8(batch.column(2))
            for i, j in blocks(bounds):
                x = features(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["doc_id", "grade", "x"])

    texts = only(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    rows = texts.mapInArrow(vectors, T.StructType([texts.schema["doc_id"], texts.schema["grade"], T.StructField("x", T.BinaryType())]))
    found = rows.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.min("x").alias("x")).toArrow()  # a row for each chosen id at most
    ids, grades, vectors_ = found.column("doc_id").to_pylist(), found.column("grade").to_pylist(), found.column("x")
    order = sorted(range(len(ids)), key=ids.__getitem__)
    if not order:
        return CumulativeLink()
    x = np.empty((len(order), SIZE), np.float32)  # filled row by row: no second copy on the driver
    for to, i in enumerate(order):
        x[to] = np.frombuffer(vectors_[i].as_buffer(), np.float16)
    del found, vectors_
    return fit_link(x, np.array([grades[i] for i in order]))


def score(docs: DataFrame, model: CumulativeLink, tail: int | None = None, text_col: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probability and keep (a tail probability of a half or more)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(docs, ("expected_grade", T.DoubleType()), ("tail_probability", T.DoubleType()), ("keep", T.BooleanType()))
    names = [f.name for f in schema.fields[:-3]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        grades = np.array(model.grades, float)
        reach = grades >= (grades[-1] if tail is None else tail)
        for batch in batches:
            data, bounds = utf8(batch.column(batch.schema.get_field_index(text_col)))
            expected, probability = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for i, j in blocks(bounds):
                p = model.probabilities(model.scores(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]))
                expected[i:j], probability[i:j] = p @ grades, p @ reach
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(expected.round(9)), pa.array(probability.round(9)), pa.array(probability >= 0.5)], names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
