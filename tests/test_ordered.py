import random

import pytest
from pyspark.sql import functions as F

from bundlewise.operators import ordered
from bundlewise.operators.ordered import DAY, HOUR, MINUTE, SECOND, WHOLE, Cells, choose_cells, run_positions, running_sums

LAYOUTS = [Cells(DAY), Cells(HOUR), Cells(MINUTE), Cells(SECOND), Cells(1, 4)]


def _rows(seed=7, n=600):
    """Few keys, one of them hot; clustered and equal timestamps."""
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}"
        day = rng.randrange(3) * DAY
        us = day + rng.choice([0, 0, 0, rng.randrange(DAY), rng.randrange(5) * SECOND, rng.randrange(3)])
        out.append((key, us, seq, rng.randrange(10), rng.random() < 0.3))
    return out


def _by_key(rows):
    keyed = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        keyed.setdefault(r[0], []).append(r)
    return keyed


SCHEMA = "key string, us bigint, seq bigint, v bigint, flag boolean"


@pytest.mark.parametrize("cells", LAYOUTS, ids=str)
def test_running_sums_equal_a_sequential_scan(spark, cells):
    rows = _rows()
    got = running_sums(spark.createDataFrame(rows, SCHEMA), ["key"], {"n": F.lit(1), "s": F.col("v")}, cells)
    got = {r.seq: (r.n, r.s) for r in got.collect()}
    for group in _by_key(rows).values():
        total = 0
        for i, r in enumerate(group, 1):
            total += r[3]
            assert got[r[2]] == (i, total)


@pytest.mark.parametrize("cells", LAYOUTS, ids=str)
@pytest.mark.parametrize("gap,use_flag", [(30 * SECOND, False), (None, True), (2 * HOUR, True)])
def test_run_positions_equal_a_sequential_scan(spark, cells, gap, use_flag):
    rows = _rows(11)
    df = spark.createDataFrame(rows, SCHEMA)
    got = run_positions(df, ["key"], gap_us=gap, restart="flag" if use_flag else None, cells=cells)
    got = {r.seq: (r.run_id, r.run_pos) for r in got.collect()}
    for group in _by_key(rows).values():
        run, pos, last = 0, 0, None
        for r in group:
            cut = (use_flag and r[4]) or (gap is not None and (last is None or r[1] - last >= gap))
            run, pos = (run + 1, 1) if cut else (run, pos + 1)
            last = r[1]
            assert got[r[2]] == (run, pos)


def test_cell_width_follows_the_fullest_cell(spark):
    spread = spark.range(1000).selectExpr("'a' as key", "id * 60000000 as us", "id as seq")
    assert choose_cells(spread, ["key"], max_rows=2000).width == DAY
    assert choose_cells(spread, ["key"], max_rows=100).width == HOUR
    assert choose_cells(spread, ["key"], max_rows=20).width == MINUTE
    burst = spread.unionByName(spark.range(4000).selectExpr("'b' as key", "id * 2500 as us", "id as seq"))
    assert choose_cells(burst, ["key"], max_rows=500).width == SECOND
    same = spread.unionByName(spark.range(900).selectExpr("'b' as key", "5L as us", "id as seq"))
    assert choose_cells(same, ["key"], max_rows=800) == Cells(1, 1 << 20, 1900)


def test_no_window_group_exceeds_the_bound_for_a_single_hot_instant(spark):
    rows = spark.range(4000).selectExpr("'hot' as key", "5L as us", "id as seq")
    cells = Cells(1, 256)
    tagged = cells.tag(rows)
    assert tagged.groupBy("key", "_c", "_q").count().agg(F.max("count")).first()[0] <= 256
    out = running_sums(rows, ["key"], {"n": F.lit(1)}, cells)
    assert out.where("n <> seq + 1").count() == 0 and out.count() == 4000


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_small_keys_are_one_cell_with_the_same_results(spark, keys):
    """Scans over keys that are one cell each equal the scans in many cells."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 40) * 500_000, i, rng.random() < 0.2) for i in range(300)] + [("a", None, 999, True)]
    df = spark.createDataFrame(rows, "key string, us bigint, seq bigint, flag boolean").repartition(5)
    assert choose_cells(df, keys, whole=301).whole and choose_cells(df, keys, keep_counts=True, whole=301).whole
    assert not choose_cells(df, keys, whole=50).whole and not choose_cells(df, keys, keep_counts=True, whole=50).whole
    whole, cut = Cells(WHOLE), Cells(SECOND)
    for make in (
        lambda c: running_sums(df, keys, {"s": F.col("seq"), "n": F.lit(1)}, c),
        lambda c: run_positions(df, keys, gap_us=1_500_000, cells=c),
        lambda c: run_positions(df, keys, restart="flag", cells=c),
        lambda c: run_positions(df, keys, gap_us=2_000_000, restart="flag", cells=c),
    ):
        a, b = make(whole), make(cut)
        assert a.dtypes == b.dtypes and a.count() == 300
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_grouping_runs_of_whole_keys_needs_no_second_shuffle(spark):
    df = spark.createDataFrame([(k, us, us) for k in ("a", None) for us in (0, 5, 20)], "k string, us bigint, seq bigint")
    placed = run_positions(df, ["k"], gap_us=10, cells=Cells(WHOLE))
    runs = placed.groupBy("k", "run_id").agg(F.count("*").alias("n"))
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted((str(r.k), r.run_id, r.n) for r in runs.collect()) == [("None", 1, 2), ("None", 2, 1), ("a", 1, 2), ("a", 2, 1)]


def test_small_keys_are_settled_by_the_rows_per_key(spark, monkeypatch):
    df = spark.createDataFrame([(k, us) for k in "ab" for us in (0, 5 * DAY, None)], "k string, us bigint")
    monkeypatch.setattr(ordered, "_counts", None)  # counts per day and second are not needed
    assert choose_cells(df, ["k"], whole=3) == Cells(WHOLE, 0, 6)
    with pytest.raises(TypeError):
        choose_cells(df, ["k"], whole=2)
