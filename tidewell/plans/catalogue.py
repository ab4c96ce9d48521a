"""Registered queries of the time-series, anomaly, vector and message operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.timestamps import INTERVALS, STEPS, minmax, to_millis
from tidewell.operators import anomalies, blocks, scaling, series, uplink, vectors
from tidewell.plans import apps, saved
from tidewell.sources.pinned import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EVENTS = "WITH e AS (SELECT event_id, user_id, event_type, value AS v, props, epoch_us(ts) // 1000 AS t FROM events)"
BY_USER = "PARTITION BY user_id ORDER BY t, event_id"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("value").alias("v"), "props", to_millis(F.col("ts")).alias("t"))


def _normalize_sql(interval: str) -> str:
    step = {"1d": STEPS["12h"], "1d_round": STEPS["1d"]}.get(interval) or STEPS[interval]
    shift = step // 2 if interval in ("1min", "1h", "1d_round") else 0
    return f"{EVENTS} SELECT event_id, ((t + {shift}) // {step}) * {step} AS t FROM e"


def _normalize(interval: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return series.normalize(events(spark, sf_dir).select("event_id", "t"), "t", interval)

    f.__name__ = f"normalize_{interval}"
    query(_normalize_sql(interval))(f)


for _interval in INTERVALS:
    _normalize(_interval)


@query(f"{EVENTS} SELECT unnest(range((SELECT min(t) FROM e), (SELECT max(t) FROM e) + 1, 300000)) AS t")
def time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.time_grid(events(spark, sf_dir).select("t"), "t", 300_000)


PREPARE = (
    f"{EVENTS}, b AS (SELECT (t // 300000) * 300000 AS t, max(v) AS v FROM e GROUP BY 1), "
    "g AS (SELECT unnest(range((SELECT min(t) FROM b), (SELECT max(t) FROM b) + 1, 300000)) AS t), "
    "j AS (SELECT g.t, b.v, row_number() OVER (ORDER BY g.t) AS r FROM g LEFT JOIN b ON g.t = b.t), "
    "w AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, first_value(v IGNORE NULLS) OVER n AS z, "
    "last_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER p AS ar, first_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER n AS zr FROM j "
    "WINDOW p AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT t, CASE WHEN v IS NULL THEN a + (z - a) / (zr - ar) * (r - ar) ELSE v END AS v FROM w"
)


@query(PREPARE)
def prepare_5min(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = series.normalize(events(spark, sf_dir).select("v", "t"), "t", "5min").groupBy("t").agg(F.max("v").alias("v"))
    out = series.prepare(buckets, "t", "5min", 300_000, "v")
    return out.select(to_millis(F.col("t")).alias("t"), "v")


@query(
    f"{EVENTS}, n AS (SELECT (t // 300000) * 300000 AS t, v, CASE WHEN event_id % 3 > 0 THEN event_id END AS k, event_id FROM e), "
    "b AS (SELECT t, max(v) AS v, CAST(max(k) AS BIGINT) AS k FROM n GROUP BY 1), "
    "g AS (SELECT unnest(range((SELECT min(t) FROM b), (SELECT max(t) FROM b) + 1, 300000)) AS t), j AS (SELECT g.t, b.v, b.k::DOUBLE AS k, row_number() OVER (ORDER BY g.t) AS r FROM g LEFT JOIN b ON g.t = b.t), "
    "w AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS va, first_value(v IGNORE NULLS) OVER n AS vz, last_value(k IGNORE NULLS) OVER p AS ka, first_value(k IGNORE NULLS) OVER n AS kz, "
    "last_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER p AS var, first_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER n AS vzr, "
    "last_value(CASE WHEN k IS NOT NULL THEN r END IGNORE NULLS) OVER p AS kar, first_value(CASE WHEN k IS NOT NULL THEN r END IGNORE NULLS) OVER n AS kzr FROM j "
    "WINDOW p AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT t, CASE WHEN v IS NULL THEN va + (vz - va) / (vzr - var) * (r - var) ELSE v END AS v, CASE WHEN k IS NULL THEN ka + (kz - ka) / (kzr - kar) * (r - kar) ELSE k END AS k FROM w"
)
def prepare_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numeric columns at once; a string and a short column beside them are pruned by their types."""
    rows = series.normalize(events(spark, sf_dir).select("v", F.when(F.col("event_id") % 3 > 0, F.col("event_id")).alias("k"), "event_type", "t"), "t", "5min")
    buckets = rows.groupBy("t").agg(F.max("v").alias("v"), F.max("k").alias("k"), F.max("event_type").alias("s"), F.count("*").cast("short").alias("h"))
    out = series.prepare(buckets, "t", "5min", 300_000)
    return out.select(to_millis(F.col("t")).alias("t"), *[c for c in out.columns if c != "t"])


def series_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: hourly maxima, on a grid without gaps, as lag vectors with the next value as label."""
    hourly = series.normalize(events(spark, sf_dir).select("v", "t"), "t", "1h").groupBy("t").agg(F.max("v").alias("v"))
    bounds = blocks.grid_bounds(hourly, "t", STEPS["1h"])
    filled = series.prepare(hourly, "t", "1h", STEPS["1h"], "v", bounds=bounds)  # its times are timestamps
    return series.lagging(filled, "t", "v", lag=3, bounds=[1000 * b for b in bounds])


HOURS = "(t + 1800000) // 3600000 * 3600000"


@query(
    f"{EVENTS}, b AS (SELECT event_type AS k, {HOURS} AS t, max(v) AS v FROM e GROUP BY ALL), g AS (SELECT k, unnest(range(min(t), max(t) + 1, 3600000)) AS t FROM b GROUP BY k), "
    "j AS (SELECT g.k, g.t, b.v, row_number() OVER (PARTITION BY g.k ORDER BY g.t) AS r FROM g LEFT JOIN b ON g.t = b.t AND g.k = b.k), "
    "w AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, first_value(v IGNORE NULLS) OVER n AS z, "
    "last_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER p AS ar, first_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER n AS zr FROM j "
    "WINDOW p AS (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT k AS event_type, t, CASE WHEN v IS NULL THEN a + (z - a) / (zr - ar) * (r - ar) ELSE v END AS v FROM w"
)
def prepare_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of hours for each type of event, over its own span."""
    hourly = series.normalize(events(spark, sf_dir).select("event_type", "v", "t"), "t", "1h").groupBy("event_type", "t").agg(F.max("v").alias("v"))
    out = series.prepare(hourly, "t", "1h", STEPS["1h"], "v", "event_type")
    return out.select("event_type", to_millis(F.col("t")).alias("t"), "v")


SINGLE = "ORDER BY t, event_id"


@query(f"{EVENTS}, w AS (SELECT *, last_value(CASE WHEN event_id % 7 <> 0 THEN v END IGNORE NULLS) OVER p AS a, first_value(CASE WHEN event_id % 7 <> 0 THEN v END IGNORE NULLS) OVER n AS z, row_number() OVER ({SINGLE}) AS r FROM e WINDOW p AS ({SINGLE} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS ({SINGLE} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
       f"k AS (SELECT *, max(CASE WHEN event_id % 7 <> 0 THEN r END) OVER ({SINGLE}) AS ar, min(CASE WHEN event_id % 7 <> 0 THEN r END) OVER (ORDER BY t DESC, event_id DESC) AS zr FROM w) "
       "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN a + (z - a) / (zr - ar) * (r - ar) ELSE v END AS v FROM k")
def interpolate_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series."""
    rows = events(spark, sf_dir).select("event_id", "t", F.when(F.col("event_id") % 7 != 0, F.col("v")).alias("v"))
    return series.interpolate(rows, "t", "v", tiebreak="event_id").select("event_id", "v")


GAPS = f"{EVENTS}, j AS (SELECT event_id, user_id, t, CASE WHEN event_id % 7 = 0 THEN NULL ELSE v END AS v, row_number() OVER ({BY_USER}) AS r FROM e)"


@query(
    f"{GAPS}, w AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, first_value(v IGNORE NULLS) OVER n AS z, "
    "last_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER p AS ar, first_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER n AS zr FROM j "
    f"WINDOW p AS ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS ({BY_USER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT event_id, CASE WHEN v IS NULL THEN a + (z - a) / (zr - ar) * (r - ar) ELSE v END AS v FROM w"
)
def interpolate_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "user_id", "t", F.when(F.col("event_id") % 7 != 0, F.col("v")).alias("v"))
    return series.interpolate(rows, "t", "v", "user_id", "event_id").select("event_id", "v")


DIFF1 = f"{EVENTS}, d AS (SELECT *, lag(v) OVER ({BY_USER}) AS l FROM e), d1 AS (SELECT *, v - l AS x FROM d WHERE l IS NOT NULL)"
DIFF2 = f"{DIFF1}, d2 AS (SELECT *, lag(x) OVER ({BY_USER}) AS l2 FROM d1)"


@query(f"{DIFF1} SELECT event_id, round(x, 6) AS v_diff_1 FROM d1")
def diff1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = series.difference(events(spark, sf_dir), "t", "v", 1, 1, "user_id", "event_id")
    return out.select("event_id", F.round(model.output, 6).alias("v_diff_1"))


@query(f"{DIFF2} SELECT event_id, round(x - l2, 6) AS v_diff_2 FROM d2 WHERE l2 IS NOT NULL")
def diff2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = series.difference(events(spark, sf_dir), "t", "v", 2, 1, "user_id", "event_id")
    return out.select("event_id", F.round(model.output, 6).alias("v_diff_2"))


@query(f"{DIFF2} SELECT event_id, round(v, 6) AS v FROM d2 WHERE l2 IS NOT NULL")
def undiff2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = series.difference(events(spark, sf_dir), "t", "v", 2, 1, "user_id", "event_id")
    return series.undo_difference(out, model, model.output, "restored").select("event_id", F.round("restored", 6).alias("v"))


@query(f"{EVENTS}, d AS (SELECT event_id, v - lag(v, 3) OVER ({SINGLE}) AS x FROM e) SELECT event_id, round(x, 6) AS v_diff_1 FROM d WHERE x IS NOT NULL")
def diff1_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = series.difference(events(spark, sf_dir).select("event_id", "t", "v"), "t", "v", 1, 3, tiebreak="event_id")
    return out.select("event_id", F.round(model.output, 6).alias("v_diff_1"))


@query(
    f"{EVENTS}, d AS (SELECT event_id, t, v - lag(v) OVER ({SINGLE}) AS x FROM e), d2 AS (SELECT event_id, x - lag(x) OVER ({SINGLE}) AS y FROM d WHERE x IS NOT NULL) "
    "SELECT event_id, round(y, 6) AS v_diff_2 FROM d2 WHERE y IS NOT NULL"
)
def diff2_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = series.difference(events(spark, sf_dir).select("event_id", "t", "v"), "t", "v", 2, 1, tiebreak="event_id")
    return out.select("event_id", F.round(model.output, 6).alias("v_diff_2"))


@query(f"{EVENTS}, w AS (SELECT event_id, list(v) OVER ({SINGLE} ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS a FROM e) SELECT event_id, a[1] AS f1, a[2] AS f2, a[3] AS f3, a[4] AS l1, a[5] AS l2 FROM w WHERE len(a) = 5")
def lag_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.lagging(events(spark, sf_dir).select("event_id", "t", "v"), "t", "v", lag=3, frame=2, tiebreak="event_id")
    return out.select("event_id", *[F.get("features", F.lit(i)).alias(f"f{i + 1}") for i in range(3)], *[F.get("label", F.lit(i)).alias(f"l{i + 1}") for i in range(2)])


def _lists(start: str, end: str) -> str:
    return f"{EVENTS}, w AS (SELECT event_id, list(v) FILTER (WHERE v IS NOT NULL) OVER ({BY_USER} ROWS BETWEEN {start} AND {end}) AS a FROM e)"


@query(f"{_lists('3 PRECEDING', 'CURRENT ROW')} SELECT event_id, a[1] AS f1, a[2] AS f2, a[3] AS f3, a[4] AS label FROM w WHERE len(a) = 4")
def lag_features_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.lagging(events(spark, sf_dir), "t", "v", lag=3, group="user_id", tiebreak="event_id")
    return out.select("event_id", *[F.get("features", F.lit(i)).alias(f"f{i + 1}") for i in range(3)], "label")


@query(f"{_lists('2 PRECEDING', '1 PRECEDING')} SELECT event_id, a[1] AS f1, a[2] AS f2 FROM w WHERE len(a) = 2")
def lag_past(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.lagging(events(spark, sf_dir), "t", "v", "pastFeatures", lag=2, group="user_id", tiebreak="event_id")
    return out.select("event_id", *[F.get("features", F.lit(i)).alias(f"f{i + 1}") for i in range(2)])


@query(f"{_lists('1 PRECEDING', 'CURRENT ROW')} SELECT event_id, a[1] AS f1, a[2] AS f2 FROM w WHERE len(a) = 2")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = series.lagging(events(spark, sf_dir), "t", "v", "features", lag=2, group="user_id", tiebreak="event_id")
    return out.select("event_id", *[F.get("features", F.lit(i)).alias(f"f{i + 1}") for i in range(2)])


@query(
    f"{EVENTS}, w AS (SELECT event_id, list([v, event_id::DOUBLE]) OVER ({BY_USER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a FROM e) "
    "SELECT event_id, a[1][1] AS f11, a[1][2] AS f12, a[2][1] AS f21, a[2][2] AS f22, a[3][1] AS l1, a[3][2] AS l2 FROM w WHERE len(a) = 3"
)
def lag_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("a", F.array(F.col("v"), F.col("event_id").cast("double")))
    out = series.lagging(rows, "t", "a", lag=2, group="user_id", tiebreak="event_id")
    return out.select("event_id", *[F.get(F.get("features", F.lit(i)), F.lit(j)).alias(f"f{i + 1}{j + 1}") for i in range(2) for j in range(2)], *[F.get("label", F.lit(j)).alias(f"l{j + 1}") for j in range(2)])


@query("SELECT event_id, round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)), 9) AS v_scaled FROM events")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "v")
    return scaling.scale(rows, scaling.fit_scaler(rows, "v")).select("event_id", F.round("v_scaled", 9).alias("v_scaled"))


@query("SELECT event_id, round(value, 6) AS v FROM events")
def minmax_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", "v")
    model = scaling.fit_scaler(rows, "v")
    return scaling.unscale(scaling.scale(rows, model), model).select("event_id", F.round("v_rescaled", 6).alias("v"))


@query("SELECT event_id, round((value - 10) / 90, 9) AS v FROM events")
def minmax_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.round(minmax(F.col("v"), 10.0, 100.0), 9).alias("v"))


@query(f"{DIFF1} SELECT event_id, round((x - (SELECT min(x) FROM d1)) / ((SELECT max(x) FROM d1) - (SELECT min(x) FROM d1)), 9) AS scaled, round(v, 6) AS restored FROM d1")
def diff_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model = scaling.diff_scale(events(spark, sf_dir), "t", "v", 1, 1, group="user_id", tiebreak="event_id")
    back = scaling.undo_diff_scale(out, model)
    return back.select("event_id", F.round("scaled", 9).alias("scaled"), F.round("restored", 6).alias("restored"))


DIMENSIONS = "x AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def _dimensions(df: DataFrame, *arrays: str) -> DataFrame:
    """A row for each element of arrays of the same size, with its place from 1 on."""
    rows = df.select(*[c for c in df.columns if c not in arrays], F.posexplode(F.arrays_zip(*arrays)).alias("i", "_e"))
    return rows.select(*[c for c in df.columns if c not in arrays], (F.col("i") + 1).cast("long").alias("i"), *[F.col(f"_e.{c}") for c in arrays])


@query(f"WITH {DIMENSIONS}, m AS (SELECT i, min(v) AS a, max(v) AS b FROM x GROUP BY 1) SELECT vec_id, x.i, round((v - a) / (b - a), 9) AS s FROM x JOIN m ON x.i = m.i")
def scale_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    out = scaling.scale(rows, scaling.fit_scaler(rows, "embedding"), "s")
    return _dimensions(out.select("vec_id", "s"), "s").withColumn("s", F.round("s", 9))


@query(f"WITH {DIMENSIONS} SELECT vec_id, i, round(v, 6) AS v FROM x")
def scale_multi_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    model = scaling.fit_scaler(rows, "embedding")
    out = scaling.unscale(scaling.scale(rows, model), model, output="v")
    return _dimensions(out.select("vec_id", "v"), "v").withColumn("v", F.round("v", 6))


SPLIT = f"{EVENTS}, x AS (SELECT min(t) + ceil(0.8::DOUBLE * (max(t) - min(t))) AS edge FROM e)"


@query(f"{SPLIT} SELECT event_id, t FROM e, x WHERE t <= edge")
def time_split_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.time_split(events(spark, sf_dir).select("event_id", "t"), "t", "80:20")[0]


@query(f"{SPLIT} SELECT event_id, t FROM e, x WHERE t > edge")
def time_split_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.time_split(events(spark, sf_dir).select("event_id", "t"), "t", "80:20")[1]


@query(
    "WITH x AS (SELECT event_id, value AS v, ('0x' || substr(md5('3|' || event_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)) AS r FROM events) "
    "SELECT event_id, v, round(r, 9) AS v_rand, round(v - r, 9) AS noisy FROM x"
)
def randomize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scaling.randomize(events(spark, sf_dir).select("event_id", "v"), "v", "noisy", seed=3, with_difference=True, key="event_id")
    return out.select("event_id", "v", F.round("v_rand", 9).alias("v_rand"), F.round("noisy", 9).alias("noisy"))


RANKS = "r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS k, count(*) OVER () AS n FROM lineitem)"


@query(
    f"WITH {RANKS}, q AS (SELECT max(CASE WHEN k = greatest(1, floor(0.25 * n + 0.5)) THEN v END) AS a, max(CASE WHEN k = least(n, floor(0.75 * n + 0.5)) THEN v END) AS b FROM r), "
    "f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q) "
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice < lo THEN l_extendedprice - lo WHEN l_extendedprice > hi THEN l_extendedprice - hi ELSE 0 END, 6) AS tukey_dist FROM lineitem, f"
)
def tukey(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return anomalies.tukey_distance(rows, "l_extendedprice").select("l_orderkey", "l_linenumber", F.round("tukey_dist", 6).alias("tukey_dist"))


@query(f"WITH {RANKS} SELECT max(CASE WHEN k = floor(0.05 * n + 0.5) THEN v END) AS q0, max(CASE WHEN k = floor(0.85 * n + 0.5) THEN v END) AS q1 FROM r")
def nearest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.nearest_ranks(read(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", (5, 85))


@query(f"{_lists('2 PRECEDING', '2 FOLLOWING')} SELECT event_id, CAST(0.0 AS DOUBLE) AS cp_score, false AS is_cp FROM w WHERE len(a) = 5")
def changepoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.change_points(events(spark, sf_dir), "t", "v", 2, 0.5, "user_id", "event_id").select("event_id", "cp_score", "is_cp")


@query(
    f"{_lists('2 PRECEDING', '2 FOLLOWING')}, s AS (SELECT event_id, (a[3] + a[4]) / 2 AS y, (a[1] + a[2]) / 2 AS x FROM w WHERE len(a) = 5) "
    "SELECT event_id, round(abs(y - x) / (abs(y) + abs(x)), 6) AS cp_score, abs(y - x) / (abs(y) + abs(x)) > 0.5 AS is_cp FROM s"
)
def changepoint_mean_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomalies.change_points(events(spark, sf_dir), "t", "v", 2, 0.5, "user_id", "event_id", anomalies.mean_shift)
    return out.select("event_id", F.round("cp_score", 6).alias("cp_score"), "is_cp")


@query(
    f"{EVENTS}, w AS (SELECT event_id, list(v) OVER ({SINGLE} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS a FROM e), s AS (SELECT event_id, (a[4] + a[5] + a[6]) / 3 AS y, (a[1] + a[2] + a[3]) / 3 AS x FROM w WHERE len(a) = 7) "
    "SELECT event_id, round(abs(y - x) / (abs(y) + abs(x)), 6) AS cp_score, abs(y - x) / (abs(y) + abs(x)) > 0.3 AS is_cp FROM s"
)
def changepoint_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = anomalies.change_points(events(spark, sf_dir).select("event_id", "t", "v"), "t", "v", 3, 0.3, tiebreak="event_id", score=anomalies.mean_shift)
    return out.select("event_id", F.round("cp_score", 6).alias("cp_score"), "is_cp")


@query("SELECT p_partkey, 'p_brand=' || p_brand AS w1, 'p_size=' || p_size AS w2, 'p_type=' || p_type AS w3 FROM part")
def documentize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.documentize(read(spark, sf_dir, "part"), ["p_brand", "p_size", "p_type"])
    return out.select("p_partkey", *[F.get("document", F.lit(i)).alias(f"w{i + 1}") for i in range(3)])


def _elements(df: DataFrame, *keys: str) -> DataFrame:
    array = vector_to_array("vector")
    return df.select(*keys, F.get(array, F.lit(0)).alias("x1"), F.get(array, F.lit(1)).alias("x2"))


FLAGS = ("l_returnflag", "l_linestatus")
COUNTED = "count(*) OVER (PARTITION BY l_returnflag) AS a, count(*) OVER (PARTITION BY l_linestatus) AS b, count(*) OVER () AS n"


@query(f"SELECT l_orderkey, l_linenumber, a::DOUBLE / n AS x1, b::DOUBLE / n AS x2 FROM (SELECT l_orderkey, l_linenumber, {COUNTED} FROM lineitem)")
def frequency_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(vectors.frequency_vector(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *FLAGS), FLAGS), "l_orderkey", "l_linenumber")


@query(f"SELECT l_orderkey, l_linenumber, a::DOUBLE AS x1, b::DOUBLE AS x2 FROM (SELECT l_orderkey, l_linenumber, {COUNTED} FROM lineitem)")
def count_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(vectors.frequency_vector(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *FLAGS), FLAGS, mode="count"), "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::DOUBLE AS x1, (dense_rank() OVER (ORDER BY p_type) - 1)::DOUBLE AS x2 FROM part")
def index_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(vectors.index_vector(read(spark, sf_dir, "part"), ["p_brand", "p_type"]), "p_partkey")


@query(
    "WITH n AS (SELECT count(*) AS n FROM part), b AS (SELECT p_brand, count(*) AS d FROM part GROUP BY 1), t AS (SELECT p_type, count(*) AS d FROM part GROUP BY 1) "
    "SELECT p_partkey, round(ln((n + 1.0) / (b.d + 1)) + ln((n + 1.0) / (t.d + 1)), 6) AS total, CAST(2 AS INT) AS terms FROM part JOIN b USING (p_brand) JOIN t USING (p_type), n"
)
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.tfidf_vector(read(spark, sf_dir, "part"), ["p_brand", "p_type"])
    weights = F.unwrap_udt("vector")["values"]  # of the terms alone; the vector has a place for each bucket
    return out.select("p_partkey", F.round(F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.size(weights).alias("terms"))


@query(
    f"WITH {DIMENSIONS}, w AS (SELECT i, v, 1.0 + vec_id % 3 AS w FROM x), s AS (SELECT i, sum(w) AS sw, sum(w * w) AS sww, sum(w * v) AS swv, sum(w * v * v) AS swvv, sum(w * abs(v)) AS l1, "
    "count(*) AS count, max(v) AS max, min(v) AS min, CAST(sum((v <> 0)::INT * w) AS DOUBLE) AS n FROM w GROUP BY 1) "
    "SELECT i, round(swv / sw, 6) AS mean, round((swvv - swv * swv / sw) / (sw - sww / sw), 5) AS variance, round(sqrt((swvv - swv * swv / sw) / (sw - sww / sw)), 5) AS std, count, max, min, "
    'round(l1, 5) AS "normL1", round(sqrt(swvv), 5) AS "normL2", round(swv, 5) AS sum, CAST((SELECT count(*) FROM x AS y WHERE y.i = s.i AND y.v <> 0) AS DOUBLE) AS "numNonZeros" FROM s'
)
def summarizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").withColumn("w", 1.0 + F.col("vec_id") % 3)
    out = vectors.summarize(rows, "embedding", vectors.METRICS, "w")
    arrays = [m for m in vectors.METRICS if m != "count"]
    out = _dimensions(out.select("count", *[vector_to_array(m).alias(m) for m in arrays]), *arrays)
    places = {"mean": 6, "variance": 5, "std": 5, "normL1": 5, "normL2": 5, "sum": 5}
    return out.select("i", "count", *[(F.round(m, places[m]) if m in places else F.col(m)).alias(m) for m in arrays])


@query(f"WITH {DIMENSIONS} SELECT vec_id, CAST(i + 64 * h AS BIGINT) AS i, v FROM x, (SELECT unnest([0, 1]) AS h)")
def vector_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays to vectors and back, once by itself and once as an array of two vectors."""
    rows = vectors.vectorize(read(spark, sf_dir, "embeddings"), "embedding", "x", cast=True)
    pairs = rows.withColumn("xs", F.array("x", "x"))
    flat = vectors.flatten_vectors(vectors.devectorize(pairs, "x", "x"), "xs", "v").where(F.slice("v", 1, 64) == F.col("x"))
    return _dimensions(flat.select("vec_id", "v"), "v")


SCORE = "avg(CASE WHEN n = 1 THEN 0 WHEN a * n / (n - 1) < b THEN 1 - a * n / (n - 1) / b WHEN a * n / (n - 1) > b THEN b / (a * n / (n - 1)) - 1 ELSE 0 END)"
LONG = "WITH x AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"
OWN = "o AS (SELECT d.vec_id, max(CASE WHEN d.label = d.c THEN d.d END) AS a, min(CASE WHEN d.label <> d.c THEN d.d END) AS b, max(CASE WHEN d.label = d.c THEN d.n END) AS n FROM d GROUP BY 1)"


@query(
    f"{LONG}, s AS (SELECT vec_id, label, sum(v * v) AS q FROM x GROUP BY 1, 2), m AS (SELECT label AS c, i, avg(v) AS y FROM x GROUP BY 1, 2), "
    "k AS (SELECT label AS c, count(*) AS n, avg(q) AS p FROM s GROUP BY 1), dots AS (SELECT x.vec_id, m.c, sum(x.v * m.y) AS z FROM x JOIN m ON x.i = m.i GROUP BY 1, 2), "
    f"d AS (SELECT s.vec_id, s.label, k.c, k.n, s.q + k.p - 2 * dots.z AS d FROM s JOIN dots ON s.vec_id = dots.vec_id JOIN k ON k.c = dots.c), {OWN} SELECT round({SCORE}, 6) AS silhouette FROM o"
)
def silhouette_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silhouette(spark, sf_dir, "silhouette_euclidean")


@query(
    f"{LONG}, s AS (SELECT vec_id, sqrt(sum(v * v)) AS q FROM x GROUP BY 1), u AS (SELECT x.vec_id, x.label, x.i, x.v / s.q AS v FROM x JOIN s ON x.vec_id = s.vec_id), "
    "m AS (SELECT label AS c, i, avg(v) AS y, count(*) AS n FROM u GROUP BY 1, 2), "
    f"d AS (SELECT u.vec_id, u.label, m.c, max(m.n) AS n, 1 - sum(u.v * m.y) AS d FROM u JOIN m ON u.i = m.i GROUP BY 1, 2, 3), {OWN} SELECT round({SCORE}, 6) AS silhouette FROM o"
)
def silhouette_cos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silhouette(spark, sf_dir, "silhouette_cosine")


def _silhouette(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = vectors.vectorize(read(spark, sf_dir, "embeddings"), "embedding", "_vector", cast=True)
    return spark.createDataFrame([(round(anomalies.silhouettes(rows, "_vector", "label")[name], 6),)], "silhouette double")


@query(None)
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, placed, _ = anomalies.cluster(read(spark, sf_dir, "embeddings"), "embedding", {"k": "8", "maxIter": "20", "initSteps": "2", "tol": "1e-4"})
    return placed.select("vec_id", F.col("_cluster").alias("cluster"))


def _points(spark: SparkSession, sf_dir: str, measure: str) -> DataFrame:
    out = anomalies.silhouette_points(read(spark, sf_dir, "embeddings"), "embedding", "label", measure)
    return out.select("vec_id", F.round("silhouette", 6).alias("silhouette"))


POINT = SCORE.removeprefix("avg(").removesuffix(")")


@query(
    f"{LONG}, s AS (SELECT vec_id, label, sum(v * v) AS q FROM x GROUP BY 1, 2), m AS (SELECT label AS c, i, avg(v) AS y FROM x GROUP BY 1, 2), "
    "k AS (SELECT label AS c, count(*) AS n, avg(q) AS p FROM s GROUP BY 1), dots AS (SELECT x.vec_id, m.c, sum(x.v * m.y) AS z FROM x JOIN m ON x.i = m.i GROUP BY 1, 2), "
    f"d AS (SELECT s.vec_id, s.label, k.c, k.n, s.q + k.p - 2 * dots.z AS d FROM s JOIN dots ON s.vec_id = dots.vec_id JOIN k ON k.c = dots.c), {OWN} SELECT vec_id, round({POINT}, 6) AS silhouette FROM o"
)
def silhouette_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "squaredEuclidean")


@query(
    f"{LONG}, s AS (SELECT vec_id, sqrt(sum(v * v)) AS q FROM x GROUP BY 1), u AS (SELECT x.vec_id, x.label, x.i, x.v / s.q AS v FROM x JOIN s ON x.vec_id = s.vec_id), "
    "m AS (SELECT label AS c, i, avg(v) AS y, count(*) AS n FROM u GROUP BY 1, 2), "
    f"d AS (SELECT u.vec_id, u.label, m.c, max(m.n) AS n, 1 - sum(u.v * m.y) AS d FROM u JOIN m ON u.i = m.i GROUP BY 1, 2, 3), {OWN} SELECT vec_id, round({POINT}, 6) AS silhouette FROM o"
)
def silhouette_points_cos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "cosine")


@query(
    f"{LONG}, c AS (SELECT vec_id AS c, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings QUALIFY k < 8), "
    "d AS (SELECT x.vec_id, k, sum((x.v - y.v) * (x.v - y.v)) AS d FROM c JOIN x AS y ON y.vec_id = c JOIN x ON x.i = y.i GROUP BY ALL) SELECT vec_id, CAST(arg_min(k, {'d': d, 'k': k}) AS INT) AS cluster FROM d GROUP BY vec_id"
)
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows placed with the nearest of given centres, the vectors of the eight least ids."""
    rows = read(spark, sf_dir, "embeddings")
    centres = [r["embedding"] for r in rows.orderBy("vec_id").limit(8).collect()]
    return anomalies.nearest_centres(rows, "embedding", centres, "cluster").select("vec_id", "cluster")


@query(ORACLES["summarizer"])
def moments_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of ten slices, each summed up by itself, merged in two steps."""
    rows = read(spark, sf_dir, "embeddings").select("embedding", (1.0 + F.col("vec_id") % 3).alias("w"), (F.col("vec_id") % 10).alias("slice"), (F.col("vec_id") % 2).alias("half"))
    states = vectors.moments(rows, "embedding", "w", ["slice", "half"])
    out = vectors.finish_moments(vectors.merge_moments(vectors.merge_moments(states, ["half"])))
    arrays = [m for m in vectors.METRICS if m != "count"]
    places = {"mean": 6, "variance": 5, "std": 5, "normL1": 5, "normL2": 5, "sum": 5}
    out = _dimensions(out.select("count", *arrays), *arrays)
    return out.select("i", "count", *[(F.round(m, places[m]) if m in places else F.col(m)).alias(m) for m in arrays])


EARLY = "p_partkey % 2 = 0"


@query(f"WITH k AS (SELECT p_brand, p_type, p_partkey FROM part WHERE {EARLY}), n AS (SELECT count(*) AS n FROM k) SELECT p_partkey, (SELECT count(*) FROM k WHERE k.p_brand = p.p_brand)::DOUBLE / n AS x1, (SELECT count(*) FROM k WHERE k.p_type = p.p_type)::DOUBLE / n AS x2 FROM part AS p, n WHERE NOT {EARLY}")
def freq_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares in one half of the parts, for the other half; categories that the first half lacks have 0."""
    rows = read(spark, sf_dir, "part")
    return _elements(vectors.apply_categories(rows.where(f"NOT {EARLY}"), vectors.fit_frequency(rows.where(EARLY), ["p_brand", "p_type"])), "p_partkey")


@query(
    "WITH k AS (SELECT DISTINCT o_orderpriority AS c FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS x FROM k), d AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS x FROM (SELECT DISTINCT o_orderstatus AS c FROM orders WHERE o_orderstatus = 'F')) "
    "SELECT o_orderkey, coalesce(b.x, -1)::DOUBLE AS x1, coalesce(d.x, -1)::DOUBLE AS x2 FROM orders LEFT JOIN b ON o_orderpriority = b.c LEFT JOIN d ON o_orderstatus = d.c"
)
def index_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places among the categories of finished orders, for all orders; unknown ones have -1."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return _elements(vectors.apply_categories(rows, vectors.fit_index(rows.where("o_orderstatus = 'F'"), ["o_orderpriority", "o_orderstatus"])), "o_orderkey")


@query(
    "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS k, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'F'), "
    "q AS (SELECT max(CASE WHEN k = greatest(1, floor(0.25 * n + 0.5)) THEN v END) AS a, max(CASE WHEN k = least(n, floor(0.75 * n + 0.5)) THEN v END) AS b FROM r), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q) "
    "SELECT o_orderkey, round(CASE WHEN o_totalprice < lo THEN o_totalprice - lo WHEN o_totalprice > hi THEN o_totalprice - hi ELSE 0 END, 6) AS tukey_dist FROM orders, f"
)
def tukey_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from the fences of finished orders, for all orders."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return anomalies.apply_tukey(rows, anomalies.fit_tukey(rows.where("o_orderstatus = 'F'"), "o_totalprice")).select("o_orderkey", F.round("tukey_dist", 6).alias("tukey_dist"))


FENCES = "q AS (SELECT max(CASE WHEN k = greatest(1, floor(0.25 * n + 0.5)) THEN v END) AS a, max(CASE WHEN k = least(n, floor(0.75 * n + 0.5)) THEN v END) AS b FROM r), f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)"


@query(
    f"WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS k, count(*) OVER () AS n FROM orders), {FENCES} "
    "SELECT o_orderkey, round(CASE WHEN o_totalprice < lo THEN o_totalprice - lo WHEN o_totalprice > hi THEN o_totalprice - hi ELSE 0 END, 6) AS tukey_dist FROM orders, f"
)
def app_tukey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An application by its settings alone: the source, the model and its column."""
    settings = {"ds.name": "parquet", "ds.url": f"{sf_dir}/orders.parquet", "anon.model": "tukey", "anon.value": "o_totalprice"}
    return apps.anomalies(spark, settings).select("o_orderkey", F.round("tukey_dist", 6).alias("tukey_dist"))


@query(
    f"WITH r AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) AS k, count(*) OVER () AS n FROM customer), {FENCES}, m AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer) "
    "SELECT s_suppkey, round((s_acctbal - a) / (b - a), 6) AS scaled, round(s_acctbal, 6) AS back, round(CASE WHEN s_acctbal < lo THEN s_acctbal - lo WHEN s_acctbal > hi THEN s_acctbal - hi ELSE 0 END, 6) AS tukey_dist FROM supplier, f, m"
)
def saved_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences and bounds of customers' balances, saved, loaded and applied to suppliers; the scaling is undone by a loaded model, too."""
    known, folder = read(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("x")), shared_folder(spark, "saved")
    saved.save(spark, anomalies.fit_tukey(known, "x"), f"{folder}/fences")
    saved.save(spark, scaling.fit_scaler(known, "x"), f"{folder}/bounds")
    rows = anomalies.apply_tukey(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x")), saved.load(spark, f"{folder}/fences"))
    bounds = saved.load(spark, f"{folder}/bounds")
    out = scaling.unscale(scaling.scale(rows, bounds, "scaled"), bounds, "scaled", "back")
    return out.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("scaled", "back", "tukey_dist")])


def _message_v2(df: DataFrame) -> DataFrame:
    text = F.concat(
        F.lit('{"app_id":"app","dev_id":"'), F.col("event_type"), F.lit('","hardware_serial":"'), F.col("user_id").cast("string"), F.lit('","counter":'), F.col("event_id").cast("string"),
        F.lit(',"is_retry":false,"confirmed":'), (F.col("event_id") % 2 == 0).cast("string"), F.when(F.col("event_id") % 5 != 0, F.lit(',"payload_raw":"AQ=="')).otherwise(F.lit("")),
        F.lit(',"payload_fields":'), F.col("props"), F.lit(',"metadata":{"airtime":5,"frequency":868,"gateways":[{"gtw_id":"g","timestamp":7,"rssi":-5}]}}'),
    )
    return df.select("event_id", text.alias("value"))


@query(
    "SELECT event_id, event_type AS dev_id, CAST(event_id AS INT) AS counter, CAST(-1 AS INT) AS port, event_id % 2 = 0 AS confirmed, CAST(868 AS DOUBLE) AS frequency, "
    "CAST(7000 AS BIGINT) AS gateway_time, CAST(-5 AS INT) AS rssi, '0.0' AS altitude FROM events WHERE event_id % 5 <> 0"
)
def uplink_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = uplink.parse_v2(_message_v2(events(spark, sf_dir)))
    gateway = F.get("metadata.gateways", F.lit(0))
    return out.select("event_id", "dev_id", "counter", "port", "confirmed", "metadata.frequency", gateway["timestamp"].alias("gateway_time"), gateway["rssi"].alias("rssi"), gateway["gateway_altitude"].alias("altitude"))


@query("SELECT event_id, 'k' AS attr_name, 'Int' AS attr_type, json_extract_string(props, '$.k') AS attr_value FROM events WHERE event_id % 5 <> 0")
def uplink_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uplink.parse_v2(_message_v2(events(spark, sf_dir))).select("event_id", F.explode("attributes").alias("a")).select("event_id", "a.*")


@query(
    "SELECT event_id, event_type AS device_id, CAST(event_id AS INT) AS f_cnt, CAST(CASE WHEN event_id % 3 = 0 THEN 7 ELSE 0 END AS INT) AS f_port, value AS device_latitude, '9.0' AS device_altitude, "
    "CASE WHEN event_id % 4 = 0 THEN 'fsk' ELSE 'lora' END AS modulation, CASE WHEN event_id % 4 <> 0 THEN CAST(125000 AS BIGINT) END AS bandwidth, CASE WHEN event_id % 4 <> 0 THEN CAST(7 AS INT) END AS spreading_factor, "
    "json_extract_string(props, '$.k') AS attr_value, g AS gateway_id, CAST(12 AS BIGINT) AS gateway_time, CASE WHEN g = 'b' THEN 3.5 ELSE 0 END::DOUBLE AS gateway_latitude "
    "FROM events, (SELECT unnest(['a', 'b']) AS g) WHERE event_id % 5 <> 0 AND event_id % 7 <> 0"
)
def uplink_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which a fifth lack a mandatory key and a seventh are no JSON, a quarter of another modulation, each with two
    gateways, one of them without a location."""
    gateway = '{"gateway_ids":{"gateway_id":"%s","eui":"e"},"time":"t","timestamp":12,"rssi":-1,"channel_rssi":-1,"snr":1.5,"uplink_token":"u","channel_index":2%s}'
    other = F.col("event_id") % 4 == 0
    text = F.concat(
        F.lit('{"end_device_ids":{"device_id":"'), F.col("event_type"), F.lit('","dev_eui":"e","join_eui":"j","dev_addr":"a","application_ids":{"application_id":"app"}},"received_at":"r","uplink_message":{"received_at":"n","consumed_airtime":"1s",'),
        F.lit('"locations":{"user":{"latitude":'), F.col("v").cast("string"), F.lit(',"longitude":2,"altitude":9}},"session_key_id":"s","f_cnt":'), F.col("event_id").cast("string"), F.lit(',"decoded_payload":'), F.col("props"),
        F.when(F.col("event_id") % 5 != 0, F.lit(',"frm_payload":"p"')).otherwise(F.lit("")), F.when(F.col("event_id") % 3 == 0, F.lit(',"f_port":7')).otherwise(F.lit("")),
        F.lit(f',"rx_metadata":[{gateway % ("a", "")},{gateway % ("b", ""","location":{"latitude":3.5}""")}],"settings":{{"data_rate":'),
        F.when(other, F.lit('{"fsk":{"bit_rate":50000}}')).otherwise(F.lit('{"lora":{"bandwidth":125000,"spreading_factor":7}}')),
        F.lit(',"coding_rate":"4/5","data_rate_index":5,"frequency":"868"}}'), F.when(F.col("event_id") % 7 != 0, F.lit("}")).otherwise(F.lit("")),
    )
    out = uplink.parse_v3(events(spark, sf_dir).select("event_id", text.alias("value")))
    rows = out.withColumn("g", F.explode("gateways"))
    return rows.select(
        "event_id", "device_id", "f_cnt", "f_port", "device_latitude", "device_altitude", "transmission.modulation", "transmission.bandwidth", "transmission.spreading_factor",
        F.get("attributes", F.lit(0))["attr_value"].alias("attr_value"), "g.gateway_id", F.col("g.timestamp").alias("gateway_time"), "g.gateway_latitude",
    )


SHAPES = "event_id % 6 AS shape, event_id::VARCHAR AS n, round(value, 2)::VARCHAR AS x, event_type AS w"


@query(
    f"WITH e AS (SELECT event_id, {SHAPES} FROM events), a AS (SELECT event_id, unnest([{{'k': 'int', 't': 'Int', 'v': n}}, {{'k': 'long', 't': 'Long', 'v': '300000' || lpad(n, 7, '0')}}, {{'k': 'double', 't': 'Double', 'v': n || '.25'}}, "
    "{'k': 'text', 't': 'String', 'v': '\"' || w || '\"'}, {'k': 'flag', 't': 'Boolean', 'v': (shape % 2 = 0)::VARCHAR}, {'k': 'list', 't': 'List', 'v': '[' || n || ',\"' || w || '\"]'}, {'k': 'map', 't': 'Map', 'v': '{\"in\":' || n || '}'}]) AS a "
    "FROM e WHERE shape < 4) SELECT event_id, a.k AS attr_name, a.t AS attr_type, a.v AS attr_value FROM a"
)
def uplink_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with values of all kinds; a sixth of the messages has a JSON null in them and a sixth no object, so these go."""
    rows = events(spark, sf_dir)
    n, w = F.col("event_id").cast("string"), F.col("event_type")
    payload = F.concat(
        F.lit('{"int":'), n, F.lit(',"long":300000'), F.lpad(n, 7, "0"), F.lit(',"double":'), n, F.lit('.25,"text":"'), w, F.lit('","flag":'), (F.col("event_id") % 2 == 0).cast("string"),
        F.lit(',"list":['), n, F.lit(',"'), w, F.lit('"],"map":{"in":'), n, F.lit("}"), F.when(F.col("event_id") % 6 == 4, F.lit(',"none":null}')).otherwise(F.lit("}")),
    )
    text = F.concat(F.lit('{"app_id":"a","dev_id":"d","hardware_serial":"h","is_retry":false,"confirmed":true,"payload_raw":"p","payload_fields":'), F.when(F.col("event_id") % 6 == 5, F.lit("[1]")).otherwise(payload), F.lit("}"))
    out = uplink.parse_v2(rows.select("event_id", text.alias("value")))
    return out.select("event_id", F.explode("attributes").alias("a")).select("event_id", "a.*")


@query(
    f"WITH e AS (SELECT event_id, {SHAPES} FROM events WHERE event_id % 6 <> 5), g AS (SELECT *, unnest([1, 2, 3]) AS i FROM e) "
    "SELECT event_id, CAST(CASE shape WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE event_id END AS INT) AS counter, CAST(CASE WHEN shape = 2 THEN 5 ELSE -1 END AS INT) AS port, CAST(CASE shape WHEN 3 THEN 868 WHEN 4 THEN 0 ELSE 868.5 END AS DOUBLE) AS frequency, "
    "CASE WHEN shape = 1 THEN NULL WHEN shape = 2 THEN '' ELSE 'SF7' END AS data_rate, CASE WHEN shape = 3 THEN '12.0' ELSE '0.0' END AS device_altitude, CAST(i AS INT) AS i, CASE i WHEN 1 THEN 'a' WHEN 2 THEN '' END AS gtw_id, "
    "CAST(CASE i WHEN 1 THEN 7000 WHEN 2 THEN 3000000000 + event_id ELSE 0 END AS BIGINT) AS gateway_time, CAST(CASE i WHEN 1 THEN -5 WHEN 2 THEN -1 ELSE 0 END AS INT) AS rssi, CAST(CASE i WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1.5 END AS DOUBLE) AS snr, CASE i WHEN 3 THEN '3.0' ELSE '0.0' END AS altitude FROM g"
)
def uplink_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optional keys that are absent, null, or whole numbers where doubles are declared, three gateways with times below and above
    32 bits and none, and messages whose counter is a text, which go."""
    k, n = F.col("event_id") % 6, F.col("event_id").cast("string")
    case = lambda default, **shapes: F.coalesce(*[F.when(k == int(i[1:]), F.lit(x)) for i, x in shapes.items()], default if isinstance(default, Column) else F.lit(default))
    text = F.concat(
        F.lit('{"app_id":"a","dev_id":"d","hardware_serial":"h","is_retry":false,"confirmed":true,"payload_raw":"p"'), case(F.concat(F.lit(',"counter":'), n), _0="", _1=',"counter":null', _5=',"counter":"x"'), case("", _2=',"port":5'),
        F.lit(',"metadata":{"airtime":5'), case(',"frequency":868.5', _3=',"frequency":868', _4=',"frequency":null'), case(',"data_rate":"SF7"', _1=',"data_rate":null', _2=""), case("", _3=',"altitude":12'),
        F.lit(',"gateways":[{"gtw_id":"a","timestamp":7,"rssi":-5,"snr":2},{"timestamp":'), (F.col("event_id") + 3_000_000_000).cast("string"), F.lit('},{"gtw_id":null,"rssi":null,"snr":1.5,"altitude":3}]}}'),
    )
    out = uplink.parse_v2(events(spark, sf_dir).select("event_id", text.alias("value")))
    rows = out.select("event_id", "counter", "port", "metadata.frequency", "metadata.data_rate", "metadata.device_altitude", F.posexplode("metadata.gateways").alias("i", "g"))
    return rows.select(*[c for c in rows.columns if c not in ("i", "g")], (F.col("i") + 1).alias("i"), "g.gtw_id", F.col("g.timestamp").alias("gateway_time"), "g.rssi", "g.snr", F.col("g.gateway_altitude").alias("altitude"))


@query(
    f"WITH e AS (SELECT event_id, {SHAPES} FROM events WHERE event_id % 6 <> 5), g AS (SELECT *, unnest([1, 2]) AS i FROM e) "
    "SELECT event_id, CAST(len(CASE WHEN shape = 0 THEN [] ELSE ['c', n] END) AS INT) AS n_correlations, CAST(CASE shape WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE 9 END AS INT) AS f_port, "
    "CASE shape WHEN 3 THEN NULL WHEN 4 THEN 'fsk' ELSE 'lora' END AS modulation, CAST(CASE WHEN shape < 3 THEN 125000 END AS BIGINT) AS bandwidth, CAST(CASE shape WHEN 3 THEN NULL WHEN 2 THEN 0 ELSE 5 END AS INT) AS data_rate_index, "
    "CASE WHEN i = 1 THEN 'g' END AS gateway_id, CASE WHEN i = 1 THEN 'u' || n END AS eui, CASE WHEN i = 1 THEN 't' END AS time, CAST(CASE i WHEN 1 THEN event_id END AS BIGINT) AS gateway_time, CAST(CASE i WHEN 1 THEN -3 ELSE 0 END AS INT) AS rssi, CAST(CASE i WHEN 1 THEN -4 END AS INT) AS channel_rssi, "
    "CAST(CASE i WHEN 1 THEN 2 END AS DOUBLE) AS snr, CASE WHEN i = 1 THEN 'k' END AS uplink_token, CAST(CASE i WHEN 1 THEN 3 END AS INT) AS channel_index, CAST(CASE i WHEN 1 THEN 3.5 ELSE 0 END AS DOUBLE) AS latitude, CAST(CASE i WHEN 1 THEN 4 ELSE 0 END AS DOUBLE) AS longitude, CASE i WHEN 1 THEN '7.0' ELSE '0.0' END AS altitude FROM g"
)
def uplink_v3_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of gateways and transmissions, absent, null or known; messages whose correlation ids are no list go."""
    k, n = F.col("event_id") % 6, F.col("event_id").cast("string")
    case = lambda default, **shapes: F.coalesce(*[F.when(k == int(i[1:]), F.lit(x)) for i, x in shapes.items()], default if isinstance(default, Column) else F.lit(default))
    lora = ',"settings":{"data_rate":{"lora":{"bandwidth":125000,"spreading_factor":7}},"coding_rate":"4/5","data_rate_index":%s,"frequency":"868"}'
    text = F.concat(
        F.lit('{"end_device_ids":{"device_id":"d","dev_eui":"e","join_eui":"j","dev_addr":"a","application_ids":{"application_id":"app"}},"received_at":"r"'), case(F.concat(F.lit(',"correlation_ids":["c","'), n, F.lit('"]')), _0="", _5=',"correlation_ids":"c"'),
        F.lit(',"uplink_message":{"received_at":"n","consumed_airtime":"1s","locations":{"user":{"latitude":1,"longitude":2.5,"altitude":null}},"session_key_id":"s","frm_payload":"p","decoded_payload":{}'), case(',"f_port":9', _1="", _2=',"f_port":null'),
        case(lora % 5, _2=lora % "null", _3="", _4=(lora % 5).replace('"lora":{"bandwidth":125000,"spreading_factor":7}', '"fsk":{"bit_rate":1}')),
        F.lit(',"rx_metadata":[{"gateway_ids":{"gateway_id":"g","eui":"u'), n, F.lit('"},"time":"t","timestamp":'), n, F.lit(',"rssi":-3,"channel_rssi":-4,"snr":2,"uplink_token":"k","channel_index":3,"location":{"latitude":3.5,"longitude":4,"altitude":7}},{"rssi":null}]}}'),
    )
    out = uplink.parse_v3(events(spark, sf_dir).select("event_id", text.alias("value")))
    top = out.select("event_id", F.size("correlation_ids").alias("n_correlations"), "f_port", "transmission.modulation", "transmission.bandwidth", "transmission.data_rate_index", F.explode("gateways").alias("g"))
    names = {"timestamp": "gateway_time", "gateway_latitude": "latitude", "gateway_longitude": "longitude", "gateway_altitude": "altitude"}
    fields = ("gateway_id", "eui", "time", "timestamp", "rssi", "channel_rssi", "snr", "uplink_token", "channel_index", "gateway_latitude", "gateway_longitude", "gateway_altitude")
    return top.select(*[c for c in top.columns if c != "g"], *[F.col(f"g.{f}").alias(names.get(f, f)) for f in fields])
