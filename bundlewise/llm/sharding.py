"""Sharding by Hilbert order: metadata quantised to a grid, rows sorted along the curve, equal runs cut.

DataFrame functions only. Neighbours on the curve are near in every dimension, so each shard covers a small box and files
are pruned by predicates on any of the dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bundlewise.llm.common import frozen, stored, table

SHARDS = 40
#: Cells per dimension are 2**BITS; the cuts between them are quantiles.
BITS = 4
ROW_BYTES = 16


def is_text(kind: str) -> bool:
    return kind in ("string", "binary") or kind.startswith(("varchar", "char"))


def ordinal(value: Column, kind: str) -> Column:
    """A value that keeps its order in a comparison with cuts: strings stay as they are, all else is a number, null first."""
    if is_text(kind):
        return value.cast("binary")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        value = F.unix_micros(value.cast("timestamp"))
    return F.coalesce(value.cast("double"), F.lit(-1.7e308))


def number_cuts(df: DataFrame, columns: list[str], bits: int) -> dict[str, list[float]]:
    """Quantiles of each column that cut it into at most 2**bits cells; one row of sketches reaches the driver."""
    shares = [k / 2**bits for k in range(1, 2**bits)]
    row = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in columns]).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def text_cuts(df: DataFrame, column: str, bits: int) -> list[bytes]:
    """The same for whole strings: the distinct values at the quantiles of the rows, null counted below all.

    Distinct values are counted, dealt out in sorted ranges and given the rows up to them: a running sum within a range,
    and the sum of earlier ranges from one small row per range. So values that begin alike are told apart, however long.
    """
    counted = df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranges = frozen(counted.repartitionByRange("v").withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    sizes = ranges.groupBy("_part").agg(F.sum("n").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row per range
    upto = F.col("_start") + F.sum("n").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    reached = ranges.join(F.broadcast(starts), "_part").select("v", upto.alias("upto"))
    shares = [-(-total * k // 2**bits) for k in range(1, 2**bits)]
    row = reached.agg(*[F.min(F.when(F.col("upto") >= least, F.coalesce("v", F.lit(b"")))).alias(f"c{k}") for k, least in enumerate(shares)]).first()
    return sorted({bytes(x) for x in row if x is not None})


def cell(value: Column, at: list) -> Column:
    """How many cuts lie below a value; none below null."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in at]), lambda c: c < value)) if at else F.lit(0)


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a cell of a grid of 2**bits along each axis.

    The rotations and reflections of the curve's sub-cubes are undone from the coarsest bit to the finest, the axes are
    turned from a Gray code into numbers, and their bits are interleaved.
    """
    n = len(axes)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])
    start = F.array(*[a.cast("int") for a in axes])

    def undo(x: Column, s: Column) -> Column:
        low, own = s["q"] - 1, F.get(x, s["i"])
        flip = own.bitwiseAND(s["q"]) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low)
        return F.transform(x, lambda v, k: F.when(flip, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
            F.when((k == 0) | (k == s["i"]), v.bitwiseXOR(F.when(s["i"] == 0, F.lit(0)).otherwise(swap))).otherwise(v)))

    turned = F.aggregate(steps, start, undo) if bits > 1 else start
    # Gray decoding across axes: each axis takes up the one before it
    mixed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.aggregate(F.filter(turned, lambda v, j: j <= k), F.lit(0), lambda a, v: a.bitwiseXOR(v)))

    def join(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        t = F.lit(0)
        for b in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
        index = F.lit(0).cast("bigint")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                bit = F.shiftright(F.get(x, F.lit(i)).bitwiseXOR(t), b).bitwiseAND(F.lit(1))
                index = index * 2 + bit
        return index

    return F.transform(F.array(mixed), join)[0]


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(df with `rank`, number of rows): rank in the order of columns, from 0, without a global window.

    Rows are dealt out in sorted ranges, numbered within each range by the row number that ids carry, and shifted by the
    rows of earlier ranges: one small row per range. Rows alike in all columns are told apart by their place in the input.
    """
    sorted_ = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    # written once: what follows must see the same ranges that were counted
    fixed = frozen(sorted_.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("n")).first()["n"] or 0
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # a row per range
    placed = fixed.join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.drop("_part", "_id", "_n", "_start"), total


def assign(docs: DataFrame, dimensions: list[str], text: str = "text", doc_id: str = "doc_id", shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Put every row into one of `shards` runs along the Hilbert curve of `dimensions` and the size of the text.

    Law `rows`: counts of shards are at most one apart. Equal texts share one cell (that of the least metadata among
    them) and follow one another, so copies lie in one shard or, where a cut or their number demands it, in adjacent ones.

    Result: doc_id, size, text_crc32, law, shard, slot (from 0 without gaps), grown_shard (null, counts decide), and the
    curve index `hilbert`. Text is read once for its size and hashes; narrow rows are shuffled.

    Nulls: a null text has size 16 and the checksum of no bytes; null metadata come first in their dimension; null ids
    come first among ties. Repeated rows each get a slot. With fewer rows than shards the last shards stay empty, an
    empty table gives an empty result.
    """
    kinds = dict(docs.dtypes)
    t = F.coalesce(docs[text], F.lit(""))
    own = [ordinal(docs[c], kinds[c]).alias(f"d{k}") for k, c in enumerate(dimensions)]
    narrow = docs.select(
        docs[doc_id].alias("doc_id"), (F.octet_length(t) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"), F.unhex(F.md5(t)).alias("g"), *own,
    )
    names = [f"d{k}" for k in range(len(dimensions))]
    lead = narrow.groupBy("g").agg(F.min(F.struct(*names)).alias("m"), F.first("size").cast("double").alias("bytes"), F.count("*").alias("n"))
    # read for the cuts of each dimension and for the places
    lead = stored(lead.select("g", *[F.col(f"m.{c}").alias(c) for c in names], "bytes"))
    texts = [c for c, d in zip(names, dimensions) if is_text(kinds[d])]
    edges = number_cuts(lead, [c for c in [*names, "bytes"] if c not in texts], bits) | {c: text_cuts(lead, c, bits) for c in texts}
    place = hilbert_index([cell(F.col(c), edges[c]) for c in [*names, "bytes"]], bits)
    keyed = narrow.drop(*names).join(lead.select("g", place.alias("hilbert")), "g")
    rows, n = ranked(keyed, ["hilbert", "g", "doc_id"])
    low, extra = divmod(n, shards)
    rank, bend = F.col("rank"), extra * (low + 1)
    upper = F.floor(rank / (low + 1))
    lower = F.floor((rank - bend) / max(low, 1))
    head = rank < bend
    shard = F.when(head, upper).otherwise(extra + lower)
    start = F.when(head, upper * (low + 1)).otherwise(bend + lower * low)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        (rank - start).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert",
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id") -> None:
    """Write whole rows as files under `shard=…`, in slot order; ids must be unique in both tables."""
    at = placed.select(placed["doc_id"].alias("_id"), placed["shard"].alias("shard"), placed["slot"].alias("_slot"))
    whole = docs.select(*[c for c in docs.columns if c not in ("shard", "_slot", "_id")]).join(at, F.col(doc_id).eqNullSafe(F.col("_id"))).drop("_id")
    whole.repartitionByRange("shard", "_slot").sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").mode("errorifexists").parquet(path)


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"), ["lang", "source"])
