"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(
    master: str | None = None,
    *,
    app_name: str = "ledgerlens",
    shuffle_partitions: int | None = None,
    driver_memory: str = "16g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return (or create) a session with the settings the library expects.

    On a cluster the session usually exists already and ``getOrCreate`` returns
    it untouched; the defaults here matter for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session. Only a ``local`` master, where
    driver and executors are one process, gets a private folder when it is unset
    (tests, trial runs); anywhere else an unset folder is an error, because each
    executor would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not _one_process(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _one_process(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run inside tasks live in the package's modules, so the Python
    workers must be able to import it wherever the driver was started from.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-code-"), "ledgerlens")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
    _SHIPPED.add(sc.applicationId)


#: Compressed size of a join's partitions up to which the smaller side is hashed.
HASHED_PARTITION = 64 << 20


def _bytes(size: str) -> int:
    """A size as Spark's settings write it ("64MB", "128m", "67108864b", "1g") in bytes."""
    digits = size.strip().lower().rstrip("b")
    power = "kmgtp".find(digits[-1:]) + 1 if digits[-1:].isalpha() else 0
    return int(digits.rstrip("kmgtp")) << 10 * power


@contextmanager
def hashed_joins(spark: SparkSession):
    """Lets the adaptive planner hash a join's smaller side where each of its partitions is seen to be small.

    The larger side is then neither sorted nor spilled. Where a partition is larger the
    planner sorts as before. It hashes none at all while the size it aims at for
    partitions is above the bound, so that is lowered to it.
    """
    bounds = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(HASHED_PARTITION)}
    aim = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if _bytes(spark.conf.get(aim)) > HASHED_PARTITION:
        bounds[aim] = str(HASHED_PARTITION)
    before = {key: spark.conf.get(key, None) for key in bounds}
    for key, value in bounds.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_shared(df, name: str = "stage"):
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One job, columnar and compressed (zstd: keys are hex digests, half of whose bits are
    empty); the result has no lineage to replay, and its columns (not its partitioning)
    carry whatever positions were computed.
    """
    path = os.path.join(checkpoint_dir(df.sparkSession), "ledgerlens-stage", f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.parquet(path)
    back._written_at = path
    return back


def drop_shared(df) -> None:
    """Remove a table that :func:`write_shared` returned and that nothing will read again."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def source_files(spark: SparkSession, paths: list[str]):
    """One row for each file behind ``paths`` (path, length, modificationTime), as Spark's reader lists them.

    Works on any storage that Spark reads, for files and folders alike. The content
    column is never selected, so no file is opened.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return listed.select("path", "length", "modificationTime")


def source_signature(spark: SparkSession, paths: list[str]) -> str:
    """Digest of the files behind ``paths``: names, sizes and times. One small job over the listing; no source row is read."""
    row = source_files(spark, paths).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("x"),
    ).first()
    return hashlib.sha1(f"{row['n']}:{row['x']}".encode()).hexdigest()[:16]
