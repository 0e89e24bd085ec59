"""What the operators of this subpackage share: the shared folder, Arrow text access, bounded blocks of rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tintlake-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: a cut of the lineage that survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the bounds of each value. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes together, or of one row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values within each pair of neighbouring bounds, which may be equal."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema of df with these fields at the end; columns of the same name give way."""
    names = {n.lower() for n, _ in fields}
    return T.StructType([*(f for f in df.schema.fields if f.name.lower() not in names), *(T.StructField(n, t) for n, t in fields)])


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the names the operator works with: extra columns can't clash."""
    return df.select(*(df[source].alias(name) for name, source in columns.items()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
