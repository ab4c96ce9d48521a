"""Series in blocks, and ranks by rounds, against plain Python and against windows over whole series."""

import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.timestamps import INTERVALS, normalize_millis
from tidewell.operators import anomalies, blocks, ranks, series


@pytest.fixture(params=[2, 50])
def small_blocks(request, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", request.param)
    return request.param


def table(spark, seed: int, n: int, groups: int = 0):
    """Rows with ties, gaps and unknown times; without groups the group column is a constant."""
    rnd = random.Random(seed)
    times = [None if rnd.random() < 0.02 else int(1000 * rnd.paretovariate(0.5)) % 10**12 for _ in range(n)]
    rows = [(i, t, None if rnd.random() < 0.6 else float(rnd.randint(0, 99)), "g0" if not groups or rnd.random() < 0.5 else f"g{rnd.randrange(groups)}") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "id long, t long, v double, g string").repartition(3), rows


def by_hand(rows: list[tuple]) -> list[list[tuple]]:
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        found.setdefault(r[3], []).append(r)
    return list(found.values())


@pytest.mark.parametrize("groups", [0, 4])
def test_gaps_are_filled_across_blocks(spark, small_blocks, groups):
    df, rows = table(spark, 1, 160, groups)
    wanted = {}
    for ordered in by_hand(rows):
        known = [i for i, r in enumerate(ordered) if r[2] is not None]
        for i, (id_, _, v, _) in enumerate(ordered):
            a, b = max([k for k in known if k <= i], default=None), min([k for k in known if k >= i], default=None)
            wanted[id_] = v if v is not None else None if a is None or b is None else ordered[a][2] + (ordered[b][2] - ordered[a][2]) / (b - a) * (i - a)
    got = {r.id: r.v for r in series.interpolate(df, "t", "v", "g" if groups else None, "id").collect()}
    assert got.keys() == wanted.keys() and all((got[i] is None) == (v is None) and (v is None or abs(got[i] - v) < 1e-9) for i, v in wanted.items())


@pytest.mark.parametrize("groups", [0, 4])
def test_windows_reach_across_blocks(spark, small_blocks, groups):
    df, rows = table(spark, 2, 150, groups)
    df, group = df.fillna(7.0, ["v"]), "g" if groups else None
    ordered = [[(r[0], 7.0 if r[2] is None else r[2]) for r in part] for part in by_hand(rows)]
    out, model = series.difference(df, "t", "v", 2, 2, group, "id")
    assert {r.id: r[model.output] for r in out.collect()} == {p[i][0]: p[i][1] - 2 * p[i - 2][1] + p[i - 4][1] for p in ordered for i in range(4, len(p))}
    lags = series.lagging(df, "t", "v", lag=5, frame=2, group=group, tiebreak="id")
    assert {r.id: (r.features, r.label) for r in lags.collect()} == {p[i][0]: ([x for _, x in p[i - 5 : i]], [x for _, x in p[i : i + 2]]) for p in ordered for i in range(5, len(p) - 1)}
    points = anomalies.change_points(df, "t", "v", 4, 0.5, group, "id", anomalies.mean_shift)
    assert {r.id for r in points.collect()} == {p[i][0] for p in ordered for i in range(4, len(p) - 4)}
    assert set(points.columns) == {*df.columns, "cp_score", "is_cp"} and set(lags.columns) == {*df.columns, "features", "label"}


def test_odd_series_in_blocks(spark, small_blocks):
    df = spark.createDataFrame([(1, 5, 1.0), (1, 5, 1.0), (2, None, None), (3, 5, 2.0)], "_block int, t long, v double")
    assert series.interpolate(df, "t", "v").count() == 4
    assert series.interpolate(df.where("false"), "t", "v").count() == series.difference(df.where("false"), "t", "v")[0].count() == 0
    assert series.difference(df, "t", "v")[0].count() == 2  # not the first row, nor the one behind the unknown value
    assert series.lagging(df, "t", "v", "features", lag=9).count() == 0
    days = spark.createDataFrame([(datetime(2024, 1, d).date(), float(d) if d % 3 else None) for d in range(1, 20)], "t date, v double")
    assert [r.v for r in series.interpolate(days, "t", "v").orderBy("t").collect()] == [float(d) for d in range(1, 20)]


@pytest.mark.parametrize("group", [None, "g"])
def test_prepared_series_in_blocks(spark, small_blocks, group):
    rows = [("a", 60_000 * i, float(i)) for i in (0, 3, 4, 40)] + [("b", 60_000 * i, 5.0) for i in (7, 9)] * 2
    df = spark.createDataFrame(rows, "g string, t long, v double")
    df = df if group else df.where("g = 'a'").drop("g")
    out = series.prepare(df, "t", "1min", 60_000, group=group).withColumn("i", (F.unix_millis("t") / 60_000).cast("int"))
    assert sorted((r.i, r.v) for r in (out.where("g = 'a'") if group else out).collect()) == [(i, float(i)) for i in range(41)]
    if group:
        assert sorted((r.i, r.v) for r in out.where("g = 'b'").collect()) == [(7, 5.0), (7, 5.0), (8, 5.0), (9, 5.0), (9, 5.0)]


def test_only_summaries_meet_in_one_task(spark):
    import __spark_entry__

    from tidewell.plans.catalogue import QUERIES

    plans = [__spark_entry__.entry(spark), *[QUERIES[n](spark, "/root/testdata/sf0.01") for n in ("prepare_5min", "prepare_all_columns", "diff1_single", "lag_single", "changepoint_single", "interpolate_single")]]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        for i, line in enumerate(plan):
            if "Exchange SinglePartition" in line:  # below it: an aggregation with its partial results, or one row for each block
                below = " ".join(plan[i + 1 : i + 4])
                assert "partial_" in below or "HashAggregate(keys=[_block" in below, "\n".join(plan[i : i + 4])


def test_blocks_are_even_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 1000)
    df = spark.range(40_000).select(F.exp(F.col("id") / 2000).cast("long").alias("t"), F.col("id").cast("double").alias("v"))
    found = blocks.placed(df, "t")
    sizes = [r["count"] for r in found.rows.groupBy(found.block).count().collect()]
    assert len(sizes) >= 20 and max(sizes) < 20_000  # a block has more rows only where they are of one time
    assert found.rows.agg(F.min(found.place), F.max(found.place), F.countDistinct(found.place)).first() == (1, 40_000, 40_000)
    wrong = found.rows.withColumn("n", F.lead("t").over(Window.orderBy(found.place))).where("n < t")
    assert wrong.count() == 0


@pytest.mark.parametrize("shape", ["uniform", "constant", "outlier", "lognormal", "ties", "tiny", "nan"])
def test_ranks_by_rounds(spark, monkeypatch, shape):
    monkeypatch.setattr(ranks, "FETCHED", 40)
    rnd = random.Random(7)
    values = {
        "uniform": [rnd.random() for _ in range(6000)], "constant": [3.5] * 6000, "outlier": [rnd.random() for _ in range(5999)] + [1e300], "lognormal": [rnd.lognormvariate(0, 4) for _ in range(6000)],
        "ties": [float(rnd.choice([1, 1, 1, 2, rnd.randint(0, 4000)])) for _ in range(6000)], "tiny": [2.0, 1.0, float("inf")], "nan": [1.0, float("-inf"), float("nan"), 2.0],
    }[shape]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    ordered = sorted(values, key=lambda x: (x != x, x))
    percents = (0, 1, 25, 33.3, 50, 75, 99.9, 100)
    wanted = [ordered[max(1, min(len(values), int(p / 100 * len(values) + 0.5))) - 1] for p in percents]
    assert str(ranks.rank_values(df, "x", percents)) == str(wanted)
    known = df.where(~F.isnan("x")).select(F.col("x").alias("_v"))
    left = [x.inside for x in ranks.search(known, [1, 2]) if x.found is None]
    assert all(0 < n <= 40 for n in left)


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Asia/Kolkata"])
def test_days_with_clock_changes(spark, zone):
    tz, before = ZoneInfo(zone), spark.conf.get("spark.sql.session.timeZone")
    moments = [datetime(2024, *day, tzinfo=ZoneInfo("UTC")) + timedelta(minutes=37 * i) for day in ((3, 30), (3, 10), (10, 27), (11, 3)) for i in range(60)]
    df = spark.createDataFrame([(int(m.timestamp() * 1000),) for m in moments], "t long")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        out = {r.t: r for r in df.select("t", *[normalize_millis(F.col("t"), x).alias(x) for x in INTERVALS]).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for m in moments:
        local, r = m.astimezone(tz), out[int(m.timestamp() * 1000)]
        day = local.replace(hour=0, minute=0, second=0, microsecond=0, fold=0)
        hour = int((m - timedelta(minutes=local.minute)).timestamp() * 1000)
        assert r["1d"] == int((day.replace(hour=12) if local.hour >= 12 else day).timestamp() * 1000)
        assert r["1d_round"] == int(((day + timedelta(days=1)) if local.hour >= 12 else day).timestamp() * 1000)
        assert (r["6h"], r["12h"]) == (hour - local.hour % 6 * 3_600_000, hour - local.hour % 12 * 3_600_000)
        for name, step in (("5min", 5), ("15min", 15), ("30min", 30)):
            assert r[name] == int((m - timedelta(minutes=local.minute % step)).timestamp() * 1000)
        assert r["1min"] == r.t and r["1h"] == hour + (3_600_000 if local.minute >= 30 else 0)
