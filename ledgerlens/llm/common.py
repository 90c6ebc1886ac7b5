"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_dir

#: A word is a maximal run of anything but the six ASCII white-space characters.
#: The possessive form matches the same and scans faster; DuckDB has only the plain one.
WORD = r"[^\x20\x09-\x0D]++"
WORD_WITH_LEAD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of ``text``; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Bytes that a batch of rows may hold on its way to a Python worker. Texts and shingle
#: sets are long; Spark's own bound (64 MB) is met several times over in a small executor.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of Arrow batches to ``BATCH_BYTES`` if it is higher."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder (zstd Parquet) and reads it back.

    The plan ends there: later jobs, and retries after a lost executor, reread
    the files instead of running the tasks again.
    """
    bound_batches(df.sparkSession)
    path = f"{checkpoint_dir(df.sparkSession)}/ledgerlens-llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pack_array(values, dtype: str) -> bytes:
    """A numpy array as zstd-compressed bytes, its k-th bytes side by side (high bytes of small numbers vanish)."""
    import numpy as np
    import pyarrow as pa

    raw = np.ascontiguousarray(values, dtype)
    planes = raw.view("u1").reshape(len(raw), raw.dtype.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(planes, asbytes=True) if len(raw) else b"")


def unpack_array(data: bytes, dtype: str):
    """The array that :func:`pack_array` packed."""
    import numpy as np
    import pyarrow as pa

    n, width = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    planes = pa.Codec("zstd").decompress(data[8:], decompressed_size=n * width, asbytes=True)
    return np.frombuffer(planes, "u1").reshape(width, n).T.copy().view(dtype).ravel()
