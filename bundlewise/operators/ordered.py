"""Ordered scans that stay distributed when one key holds most of the rows.

A plain `Window.partitionBy(key).orderBy(ts)` puts a hot key into one task. Here the time line of a key is cut
into cells. Inside a cell an ordinary window runs; the state entering a cell comes from a scan over one summary
row per cell. The cell width is picked from measured counts, so the rows of a cell are bounded whatever the
distribution of keys and timestamps, down to a single microsecond that is then cut by blocks of `seq`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bundlewise.functions.timestamps import floor_bucket
from bundlewise.session import cut_lineage

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

MAX_CELL_ROWS = 1_000_000
#: Where no key has more rows than this, each key is one cell: nothing is carried from cell to cell.
WHOLE_ROWS = 131_072
WHOLE = 1 << 62
#: Counts that are kept are held as literal rows up to this number, beyond it in a checkpoint.
MAX_LITERAL = 5_000
TIE_BLOCK = 1 << 20


@dataclass(frozen=True)
class Cells:
    """Width of a cell in microseconds; `tie_block` > 0 also cuts equal timestamps by blocks of the tiebreak.

    `rows` is the row count of the input, where it was counted, and `counts` the rows `n` per key and cell, where
    they were kept.
    """

    width: int
    tie_block: int = 0
    rows: int | None = None
    counts: DataFrame | None = field(default=None, compare=False, repr=False)

    def tag(self, df: DataFrame, us: str = "us", tie: str = "seq") -> DataFrame:
        block = floor_bucket(tie, self.tie_block) if self.tie_block else F.lit(0).cast("bigint")
        if self.whole:
            return df.select("*", F.lit(0).cast("bigint").alias("_c"), block.alias("_q")).where(F.col(us).isNotNull())
        # the joins on cells imply the filter; stated here, all readers of the tagged rows share one shuffle
        return df.select("*", floor_bucket(us, self.width).alias("_c"), block.alias("_q")).where("_c is not null")

    @property
    def whole(self) -> bool:
        return self.width == WHOLE

    @property
    def parents(self) -> tuple[int, ...]:
        """Coarser widths, in cells, so that the scan over summaries is itself bounded by the calendar."""
        if self.width == 1:
            return (SECOND, DAY // SECOND)
        if self.width == SECOND:
            return (DAY // SECOND,)
        return ()


def _counts(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    return df.groupBy(*keys, bucket.alias("_c"), F.lit(0).cast("bigint").alias("_q")).agg(F.count("*").alias("n"))


def _coarser(counts: DataFrame, keys: Sequence[str], ratio: int, maxes: Sequence[str] = ()) -> DataFrame:
    return counts.groupBy(*keys, floor_bucket("_c", ratio).alias("_p"), "_q").agg(
        F.sum("n").alias("n"), *[F.max(m).alias(m) for m in maxes]
    ).withColumnRenamed("_p", "_c")


def choose_cells(
    df: DataFrame, keys: Sequence[str], us: str = "us", max_rows: int = MAX_CELL_ROWS, keep_counts: bool = False, whole: int = 0
) -> Cells:
    """The widest cell whose fullest instance holds at most `max_rows`, from counts over (keys, us).

    Where no key has more than `whole` rows in all, each key is one cell.

    Counts per key settle inputs of many keys, counts per day most others. Otherwise counts per second are rolled up. All counts use map-side
    combine, so a hot key never meets in one task; one row reaches the driver, or with `keep_counts` up to
    `MAX_LITERAL` rows of counts. `keep_counts` keeps them (more of them in a checkpoint), which saves later scans of the
    input where they are few (few keys).
    """
    keep = cut_lineage if keep_counts else lambda counts: counts
    if whole and not keep_counts:
        per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
        top = per_key.agg(F.max("n").alias("key"), F.sum("n").alias("rows")).first()
        if (top["key"] or 0) <= min(whole, max_rows):
            return Cells(WHOLE, 0, top["rows"] or 0)
    days = _counts(df, keys, floor_bucket(us, DAY))
    if keep_counts:
        few = days.limit(MAX_LITERAL + 1).collect()
        if len(few) <= MAX_LITERAL:
            per_key: dict[tuple, int] = {}
            for r in few:
                key = tuple(r[k] for k in keys)
                per_key[key] = per_key.get(key, 0) + r["n"]
            if whole and max(per_key.values(), default=0) <= min(whole, max_rows):
                return Cells(WHOLE, 0, sum(per_key.values()))
            if max(r["n"] for r in few) <= max_rows:
                return Cells(DAY, 0, sum(per_key.values()), df.sparkSession.createDataFrame(few, days.schema))
    days = keep(days)
    per_key = days.groupBy(*keys).agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    day = per_key.agg(F.max("most").alias("most"), F.max("n").alias("key"), F.sum("n").alias("rows")).first()
    rows = day["rows"] or 0
    if whole and (day["key"] or 0) <= min(whole, max_rows):
        return Cells(WHOLE, 0, rows)
    if (day["most"] or 0) <= max_rows:
        return Cells(DAY, 0, rows, days if keep_counts else None)
    seconds = keep(_counts(df, keys, floor_bucket(us, SECOND)))
    minutes = _coarser(seconds.withColumn("m_second", F.col("n")), keys, 60, ["m_second"])
    hours = _coarser(minutes.withColumn("m_minute", F.col("n")), keys, 60, ["m_second", "m_minute"])
    top = hours.agg(F.max("m_second").alias("m_second"), F.max("m_minute").alias("m_minute"), F.max("n").alias("m_hour")).first()
    for name, width in (("m_hour", HOUR), ("m_minute", MINUTE), ("m_second", SECOND)):
        if top[name] <= max_rows:
            return Cells(width, 0, rows, _coarser(seconds, keys, width // SECOND) if keep_counts else None)
    return Cells(1, TIE_BLOCK, rows)


def carry_in(
    cells: DataFrame,
    keys: Sequence[str],
    parents: Sequence[int],
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
) -> DataFrame:
    """Per cell (`_c`, `_q`) the sum / max of the named columns over all earlier cells of the key.

    Adds `in_<name>`: 0 for sums and NULL for maxes when nothing came before.
    """
    group = [*keys, "_p"] if parents else list(keys)
    # the filter is what the join below implies; stated here, both readers of the shuffle get it
    src = cells.withColumn("_p", floor_bucket("_c", parents[0])).where("_p is not null") if parents else cells
    order = Window.partitionBy(*group).orderBy("_c", "_q")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = src.select(
        "*",
        *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"in_{s}") for s in sums],
        *[F.max(m).over(before).alias(f"in_{m}") for m in maxes],
    )
    if not parents:
        return out
    # the totals of a group are read off its last row: the same shuffle serves both, a second aggregate would not
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    totals = src.select(
        "*",
        F.lead("_c").over(order).isNull().alias("_last"),
        *[F.sum(s).over(upto).alias(f"in_{s}") for s in sums],
        *[F.max(m).over(upto).alias(f"in_{m}") for m in maxes],
    )
    totals = totals.where("_last").select(
        *keys, F.col("_p").alias("_c"), F.lit(0).cast("bigint").alias("_q"), *[F.col(f"in_{n}").alias(n) for n in (*sums, *maxes)]
    )
    up = carry_in(totals, keys, parents[1:], sums, maxes).select(
        *keys,
        F.col("_c").alias("_p"),
        *[F.col(f"in_{n}").alias(f"up_{n}") for n in (*sums, *maxes)],
    )
    out = out.join(up, group)
    for s in sums:
        out = out.withColumn(f"in_{s}", F.col(f"in_{s}") + F.col(f"up_{s}")).drop(f"up_{s}")
    for m in maxes:
        out = out.withColumn(f"in_{m}", F.greatest(f"in_{m}", f"up_{m}")).drop(f"up_{m}")
    return out.drop("_p")


def _with_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The keys as one struct: unlike bare columns, structs with NULL inside are equal to one another in a join."""
    return (df.withColumn("_k", F.struct(*keys)), ["_k"]) if keys else (df, [])


def without_instant(df: DataFrame, us: str = "us") -> DataFrame:
    """The rows no ordered operator can place, with the reason: a scan over time leaves them out."""
    return df.where(F.col(us).isNull()).withColumn("reject_reason", F.lit(f"{us} is missing"))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    cells: Cells | None = None,
    us: str = "us",
    tie: str = "seq",
    totals: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums per key in (us, tie) order, exact, with no key confined to one task.

    A NULL key is a key like any. One shuffle of the rows on (keys, cell); the carried sums are one row per cell.
    Rows without an instant are left out, see `without_instant`.
    `totals`, the sums per (keys, _c, _q), may be given where they are known already.
    """
    cells = cells or choose_cells(df, keys, us, whole=WHOLE_ROWS)
    if totals is not None:
        totals = _with_key(totals, keys)[0]
    keyed, keys = _with_key(df, keys)
    tagged = cells.tag(keyed, us, tie)
    cell = [*keys, "_c", "_q"]
    if cells.whole:
        upto = Window.partitionBy(*cell).orderBy(us, tie).rowsBetween(Window.unboundedPreceding, 0)
        return tagged.select(*df.columns, *[F.sum(e).over(upto).alias(n) for n, e in sums.items()])
    if totals is None:
        totals = tagged.groupBy(*cell).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    carried = carry_in(totals, keys, cells.parents, sums=list(sums)).select(*cell, *[f"in_{n}" for n in sums])
    upto = Window.partitionBy(*cell).orderBy(us, tie).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(e).over(upto).alias(f"_l_{n}") for n, e in sums.items()])
    out = local.join(carried, cell)
    return out.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"in_{n}")).alias(n) for n in sums])


def run_positions(
    df: DataFrame,
    keys: Sequence[str],
    gap_us: int | None = None,
    restart: str | None = None,
    cells: Cells | None = None,
    us: str = "us",
    tie: str = "seq",
) -> DataFrame:
    """Cut each key's ordered rows into runs and number them: adds `run_id` and `run_pos` (1-based).

    A run starts at a row that lies at least `gap_us` after the row before it, or at a row where the boolean
    column `restart` holds. The first row of a key starts a run under `gap_us`; under `restart` alone the rows
    before the first restart form run 0. A NULL key is a key like any; rows without an instant are left out, see
    `without_instant`.
    """
    cells = cells or choose_cells(df, keys, us, whole=WHOLE_ROWS)
    flag = F.coalesce(restart, F.lit(False)) if restart is not None else F.lit(False)
    if cells.whole:
        # nothing is joined, so the bare keys do: a later grouping by them and more needs no shuffle of its own
        cell, tagged = list(keys), df.where(F.col(us).isNotNull())
    else:
        keyed, keys = _with_key(df, keys)
        cell, tagged = [*keys, "_c", "_q"], cells.tag(keyed, us, tie)

    order = Window.partitionBy(*cell).orderBy(us, tie)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_i", F.row_number().over(order)).withColumn("_prev", F.lag(us).over(order))
    wide = (F.col(us) - F.col("_prev") >= gap_us) if gap_us is not None else F.lit(False)
    if cells.whole:
        opens = F.when(F.col("_i") == 1, flag | F.lit(gap_us is not None)).otherwise(flag | F.coalesce(wide, F.lit(False)))
        local = local.withColumn("_cut", opens)
        start = F.coalesce(F.max(F.when(F.col("_cut"), F.col("_i"))).over(upto), F.lit(1))
        return local.select(
            *df.columns,
            F.sum(F.col("_cut").cast("bigint")).over(upto).alias("run_id"),
            (F.col("_i") - start + 1).cast("bigint").alias("run_pos"),
        )
    # the first row of a cell is settled later, from the cell before it
    local = local.withColumn("_cut", (F.col("_i") > 1) & (flag | F.coalesce(wide, F.lit(False))))

    totals = local.groupBy(*cell).agg(
        F.count("*").alias("n"),
        F.min(us).alias("first_us"),
        F.max(us).alias("last_us"),
        F.max(F.when(F.col("_i") == 1, flag)).alias("first_flag"),
        F.sum(F.col("_cut").cast("bigint")).alias("cuts"),
        F.max(F.when(F.col("_cut"), F.col("_i"))).alias("last_cut"),
    )
    base = carry_in(totals, keys, cells.parents, sums=["n"], maxes=["last_us"])
    if gap_us is not None:
        gap = F.col("in_last_us").isNull() | (F.col("first_us") - F.col("in_last_us") >= gap_us)
    else:
        gap = F.lit(False)
    starts = (F.col("first_flag") | gap).cast("bigint")
    base = base.withColumn("opens", starts).select(
        *cell,
        "opens",
        F.col("in_n").alias("rows_before"),
        (F.col("cuts") + F.col("opens")).alias("runs"),
        # rank in the key of the last run start inside this cell
        (F.col("in_n") + F.coalesce("last_cut", F.when(F.col("opens") == 1, F.lit(1)))).alias("start"),
    )
    carried = carry_in(base, keys, cells.parents, sums=["runs"], maxes=["start"])
    carried = carried.select(*cell, "opens", "rows_before", "in_runs", "in_start")

    local = local.select(
        "*",
        F.sum(F.col("_cut").cast("bigint")).over(upto).alias("_cuts"),
        F.max(F.when(F.col("_cut"), F.col("_i"))).over(upto).alias("_last"),
    )
    out = local.join(carried, cell)
    rank = F.col("rows_before") + F.col("_i")
    start = F.coalesce(
        F.col("rows_before") + F.col("_last"),
        F.when(F.col("opens") == 1, F.col("rows_before") + 1),
        F.col("in_start"),
        F.lit(1),
    )
    return out.select(
        *df.columns,
        (F.col("in_runs") + F.col("opens") + F.col("_cuts")).alias("run_id"),
        (rank - start + 1).alias("run_pos"),
    )
