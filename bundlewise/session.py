"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import bundlewise

# functions that run in Python workers travel with the job, so the executors need no copy of this package
cloudpickle.register_pickle_by_value(bundlewise)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the results depend on; sizing is left to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # bundles share most of their logs with their neighbours, which zstd's window spans and snappy's 64 kB do not
    set_default(spark, "spark.sql.parquet.compression.codec", "zstd")
    return spark


def set_default(spark: SparkSession, name: str, value: str) -> None:
    """Set what the cluster or the caller has not set."""
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, value)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "bundlewise") -> SparkSession:
    """Small local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.unix.domain.socket.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    Where none is named, a local master (tests) gets a folder of its own. A cluster gets an error: its executors would
    each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        root = spark.sparkContext.getCheckpointDir() or ""
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("name a folder all executors share in spark.checkpoint.dir")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, known as such to the optimizer: a union with it costs no tasks."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema).fields])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive executor loss and later branches do not recompute them."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for the tables that `store` writes meanwhile; it is removed at the end, so results must be written by then."""
    folder = f"{checkpoint_root(spark)}/scratch-{uuid.uuid4().hex}"
    before = _scratch.set(folder)
    try:
        yield folder
    finally:
        _scratch.reset(before)
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def store(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, or in the `scratch` folder around the call.

    Like `cut_lineage`, but compressed and read by column: for wide rows of which several narrow scans follow.
    """
    spark = df.sparkSession
    path = f"{_scratch.get() or checkpoint_root(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
