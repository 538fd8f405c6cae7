"""Embedding whitening: blockwise QR of centred rows, then a bidiagonal qd solver on the factor.

Rows are quantised to whole numbers, so counts, sums and deviations are exact. The covariance itself is never formed: each
task reduces its centred rows to a triangular factor, factors are reduced in a tree, and the last one gives the variances
(squared singular values) and directions.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bundlewise.llm.bidiagonal import principal
from bundlewise.llm.common import stored, table

STEPS, ORIGIN, COMPONENTS = 64, 1_000_000, 16
#: Numbers of factors that one task stacks, or the driver at the end: at least two factors, about 64 MB otherwise.
STACK_CELLS = 8_000_000
#: Rows of a block that is reduced at once.
BLOCK_ROWS = 4096
_EXACT = float(1 << 53)


def quantise(vector: Column) -> Column:
    """floor(64 c) + 1000000 for each entry c."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(STEPS)) * c.cast("double")) + F.lit(ORIGIN).cast("bigint"))


def usable(vector: Column) -> Column:
    """No null, no NaN, no infinity, and nothing whose quantised value is not an exact whole number."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(F.lit(float(STEPS)) * c.cast("double")) < _EXACT, F.lit(False)) & ~F.isnan(c.cast("double")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """(rows, sum of each dimension), exact."""

    def add(batches):
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column("x")) - ORIGIN
            n += len(x)
            for at in range(0, len(x), 512):  # so many entries of up to 2^53 fit into 64 bits
                part = x[at : at + 512].sum(axis=0).tolist()
                total = part if total is None else [a + b for a, b in zip(total, part)]
        if n:
            exact = [Decimal(s) for s in (n, *total)]
            yield pa.RecordBatch.from_arrays([pa.array([exact], pa.list_(pa.decimal128(38, 0)))], names=["s"])

    part = distinct.select("x").mapInArrow(add, "s array<decimal(38,0)>").select(F.posexplode("s").alias("at", "s"))
    got = [int(r["s"]) for r in part.groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()]
    if not got:
        return 0, []
    return got[0], [s + ORIGIN * got[0] for s in got[1:]]


class Centre:
    """Rows minus the mean S/n, to full precision: the whole part is subtracted exactly, then the rest."""

    def __init__(self, n: int, s: list[int]):
        self.whole = np.array([x // n for x in s], np.int64)
        self.rest = np.array([(x % n) / n for x in s])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest


def triangular(distinct: DataFrame, centre: Centre, d: int) -> np.ndarray:
    """R of the centred rows: a factor per task, then a tree of stacks, none larger than `STACK_CELLS`."""

    def reduce(batches):
        from pyspark import TaskContext

        r, rows = np.zeros((0, d)), []
        held = 0
        for batch in batches:
            rows.append(centre(_matrix(batch.column("x"))))
            held += len(rows[-1])
            if held >= max(BLOCK_ROWS, 2 * d):
                r, rows, held = np.linalg.qr(np.vstack([r, *rows]), mode="r"), [], 0
        if held:
            r = np.linalg.qr(np.vstack([r, *rows]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def stack(key, given):
        r = np.vstack([np.array(x).reshape(-1, d) for x in given.column("r").to_pylist()])
        r = np.linalg.qr(r, mode="r")
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    fan = max(2, STACK_CELLS // (d * d))
    factors = stored(distinct.select("x").mapInArrow(reduce, "part bigint, r array<double>"))
    n = factors.count()
    while n > fan:
        groups = -(-n // fan)
        dealt = factors.withColumn("part", F.pmod("part", F.lit(groups)).cast("bigint"))
        factors = stored(dealt.groupBy("part").applyInArrow(stack, "part bigint, r array<double>"))
        n = factors.count()
    last = [np.array(x["r"]).reshape(-1, d) for x in factors.orderBy("part").collect()]
    r = np.linalg.qr(np.vstack(last), mode="r") if last else np.zeros((0, d))
    return np.vstack([r, np.zeros((max(d - len(r), 0), d))])[:d]


def identity_error(distinct: DataFrame, centre: Centre, directions: np.ndarray, n: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over the fit list."""
    k = directions.shape[1]

    def products(batches):
        total = np.zeros((k, k))
        for batch in batches:
            y = centre(_matrix(batch.column("x"))) @ directions
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["s"])

    part = distinct.select("x").mapInArrow(products, "s array<double>").select(F.posexplode("s").alias("at", "s"))
    got = part.groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()
    return float(np.abs(np.array([r["s"] for r in got]).reshape(k, k) / n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int]:
    """Sum of (n x − S)² of each row, exact."""
    whole = [v // n for v in s]
    far = max((abs(int(v)) for v in (x - np.array(whole, np.int64)).ravel()), default=0) + 1
    if (n * far) ** 2 * len(s) < 1 << 62:
        t = n * (x - np.array(whole, np.int64)) - np.array([v % n for v in s], np.int64)
        return [int(v) for v in (t * t).sum(axis=1)]
    return [sum((n * int(v) - c) ** 2 for v, c in zip(row, s)) for row in x]


def whiten(vectors: DataFrame, vector: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row: `row`, `component`, `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    The fit list is each distinct quantised vector once. Components are numbered from 1 by falling variance. `deviation` is
    decimal(38,0). What reaches the driver: sums, stacks of d x d factors of bounded size, k x k products.

    Rows whose vector is null, empty, or holds a null, NaN or infinity (or an entry beyond 2^53 steps) are dropped. Where
    lengths differ, rows of the commonest one (the longer, if two are as common) take part and the others are dropped.
    Directions without variance have no component, so a single distinct vector, or an empty table, gives no rows.
    Repeated rows weigh once in the fit and each get their coordinates.
    """
    names = vectors.columns if keep is None else keep
    given = vectors.where(usable(vectors[vector])).select(
        F.struct(*[vectors[c] for c in names]).alias("row") if names else F.lit(1).alias("row"), quantise(vectors[vector]).alias("x")
    )
    sizes = given.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    kind = given.schema["row"].dataType
    out = "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    schema = f"row {kind.simpleString()}, {out}"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = sizes["d"]
    given = given.where(F.size("x") == d)
    distinct = stored(given.select("x").distinct())
    n, s = sums(distinct)
    centre = Centre(n, s)
    squares, v = principal(triangular(distinct, centre, d), components)
    if v.shape[1] == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    directions = v * np.sqrt(n / squares[: v.shape[1]])
    share = (squares[: v.shape[1]] / squares.sum()).tolist()
    error = identity_error(distinct, centre, directions, n)
    k = len(share)

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            rows = len(x)
            far = pa.array([Decimal(t) for t in deviations(x, n, s)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(each), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n), pa.int64()),
                 far.take(each), pa.array((centre(x) @ directions).ravel()), pa.array(share * rows, pa.float64()), pa.array([error] * (rows * k), pa.float64())],
                names=["row", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return given.mapInArrow(project, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond 64 bits is null."""
    done = whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return done.select("row.vec_id", "component", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", "identity_error")
