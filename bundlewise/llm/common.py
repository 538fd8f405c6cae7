"""Helpers shared by the operators of this subpackage.

Every operator takes a DataFrame and the names of the columns it works on, reads only those, and keeps its own columns
under its own names, so extra columns of the input, whatever they are called, neither reach it nor clash with it.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from bundlewise.session import checkpoint_root, cut_lineage, prepare

ASCII_SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ARROW_ROWS, ARROW_BYTES = 500, 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings for long texts: Arrow batches are bounded by bytes, not only by rows."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words between ASCII white space; no text, no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), lambda w: w != "")


def map_arrow(
    df: DataFrame, inputs: dict[str, Column], outputs: str, make: Callable[[], Callable], keep: list[str] | None = None
) -> DataFrame:
    """Append columns computed batch by batch in Arrow; one row out for each row in, nothing is shuffled.

    `make()` runs once per partition and returns a function from the Arrow arrays of `inputs` to the arrays or lists of
    `outputs` (a DDL schema). The result holds the input row in the struct `row` (all columns, or those in `keep`).
    """
    names = df.columns if keep is None else keep
    given = df.select(F.struct(*[df[c] for c in names]).alias("row") if names else F.lit(1).alias("row"), *[c.alias(k) for k, c in inputs.items()])
    out = StructType([StructField("row", given.schema["row"].dataType)] + StructType.fromDDL(outputs).fields)
    kinds = [(f.name, _arrow(f.dataType)) for f in StructType.fromDDL(outputs).fields]
    ins = list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            made = step(*[batch.column(k) for k in ins])
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, (_, t) in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *arrays], names=["row", *[n for n, _ in kinds]])

    return given.mapInArrow(run, out)


def _arrow(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def frozen(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder; later reads survive lost executors."""
    return cut_lineage(df)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the cluster's shared folder: compressed, and read by column."""
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def worker_store() -> dict:
    """A dict that lives as long as the Python worker, across tasks; functions shipped by value have no lasting globals."""
    return sys.modules.setdefault("_bundlewise_worker_store", types.ModuleType("_bundlewise_worker_store")).__dict__
