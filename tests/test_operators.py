"""Hand-computed cases of the operators."""

import pytest
from pyspark.sql import functions as F

from tidewell.functions.timestamps import minmax, normalize_millis, validate_series
from tidewell.operators import anomalies, scaling, series, uplink, vectors
from tidewell.plans import saved
from tidewell.plans.apps import anomalies as anomaly_app
from tidewell.plans.apps import forecast
from tidewell.sources.readers import jdbc_options, read
from tidewell.streaming.uplinks import uplink_stream


def test_interpolation_leaves_outer_gaps(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 10.0, None, None, 40.0, 50.0, None])], "t long, v double")
    assert [r.v for r in series.interpolate(df, "t", "v").orderBy("t").collect()] == [None, 10, 20, 30, 40, 50, None]


@pytest.mark.parametrize(("interval", "wanted"), [("1min", "13:48:00"), ("5min", "13:45:00"), ("15min", "13:45:00"), ("30min", "13:30:00"), ("1h", "14:00:00"), ("6h", "12:00:00"), ("12h", "12:00:00"), ("1d", "12:00:00")])
def test_normalize(spark, interval, wanted):
    millis = F.unix_millis(F.lit("2024-01-01 13:47:31.250").cast("timestamp"))
    row = spark.range(1).select(F.date_format(F.timestamp_millis(normalize_millis(millis, interval)), "HH:mm:ss").alias("x")).first()
    assert row.x == wanted
    with pytest.raises(ValueError):
        normalize_millis(millis, "2min")


def test_grid_split_and_empty(spark):
    df = spark.createDataFrame([(0,), (250_000,)], "t long")
    assert [r.t for r in series.time_grid(df, "t", 60_000).collect()] == [0, 60_000, 120_000, 180_000, 240_000]
    assert series.time_grid(df.where("t < 0"), "t", 60_000).count() == 0
    rows = spark.range(0, 101, 10).select(F.col("id").alias("t"))
    assert [x.count() for x in series.time_split(rows, "t", "80:20")] == [9, 2]
    for bad in ("80:30", "100"):
        with pytest.raises(ValueError):
            series.time_split(rows, "t", bad)


def test_differences_of_numbers_and_arrays(spark):
    df = spark.createDataFrame([(i, (i + 1) ** 2, [float(i), float(i * i)]) for i in range(5)], "t long, v long, a array<double>")
    d2, model = series.difference(df, "t", "v", 2)
    assert [r.v_diff_2 for r in d2.orderBy("t").collect()] == [2, 2, 2]
    assert [r.x for r in series.undo_difference(d2, model, "v_diff_2", "x").orderBy("t").collect()] == [9, 16, 25]
    d1, _ = series.difference(df, "t", "v", 1, 2)
    assert [r.v_diff_1 for r in d1.orderBy("t").collect()] == [8, 12, 16]
    da, model = series.difference(df, "t", "a")
    assert [r.x for r in series.undo_difference(da, model, "a_diff_1", "x").orderBy("t").collect()] == [[float(i), float(i * i)] for i in range(1, 5)]
    with pytest.raises(ValueError):
        series.difference(df, "t", "v", 3)


def test_lags(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 7)], "t long, v long")
    out = series.lagging(df, "t", "v", lag=3).orderBy("t").collect()
    assert [(r.features, r.label) for r in out] == [([1, 2, 3], 4), ([2, 3, 4], 5), ([3, 4, 5], 6)]
    out = series.lagging(df, "t", "v", lag=2, frame=2).orderBy("t").collect()
    assert [(r.features, r.label) for r in out] == [([1, 2], [3, 4]), ([2, 3], [4, 5]), ([3, 4], [5, 6])]
    gap = spark.createDataFrame([(1, 1), (2, None), (3, 3), (4, 4), (5, 5)], "t long, v long")
    assert [(r.features, r.label) for r in series.lagging(gap, "t", "v", lag=2).collect()] == [([3, 4], 5)]


def test_scaling(spark):
    df = spark.createDataFrame([(2.0, [1.0, 5.0]), (4.0, [2.0, 5.0]), (10.0, [3.0, 5.0])], "v double, a array<double>")
    model = scaling.fit_scaler(df, "v")
    out = scaling.unscale(scaling.scale(df, model), model).orderBy("v").collect()
    assert [(r.v_scaled, r.v_rescaled) for r in out] == [(0, 2), (0.25, 4), (1, 10)]
    first = scaling.scale(df, scaling.fit_scaler(df, "a")).orderBy("v").first()
    assert first.a_scaled[0] == 0 and first.a_scaled[1] != first.a_scaled[1]
    with pytest.raises(ValueError):
        scaling.unscale(df, scaling.ScalerModel("v", None, None), "v")
    assert spark.range(1).select(minmax(F.lit(3.0), 2, 2)).first()[0] == float("inf")


def test_tukey_and_change_points(spark):
    df = spark.createDataFrame([(float(x),) for x in [*range(1, 10), 100]] + [(None,)], "x double")
    out = {r.x: r.tukey_dist for r in anomalies.tukey_distance(df.where("x is not null"), "x").collect()}
    assert out[100.0] == 84.5 and sum(v != 0 for v in out.values()) == 1
    assert anomalies.tukey_distance(df, "x").where("x IS NULL").first().tukey_dist is None
    assert anomalies.nearest_ranks(df.where("x < 0"), "x", (25, 75)).first() == (0.0, 0.0)
    with pytest.raises(ValueError):
        anomalies.tukey_distance(spark.createDataFrame([("a",)], "x string"), "x")
    rows = spark.range(6).select(F.col("id").alias("t"), F.col("id").cast("double").alias("v"))
    assert [(r.t, r.cp_score, r.is_cp) for r in anomalies.change_points(rows, "t", "v", 2, 0.5).orderBy("t").collect()] == [(2, 0.0, False), (3, 0.0, False)]
    for window, threshold in ((1, 0.5), (2, -1.0), (2, None)):
        with pytest.raises(ValueError):
            anomalies.change_points(rows, "t", "v", window, threshold)


def test_vectors(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    values = lambda x: sorted(r.vector[0] for r in x.select("vector").collect())
    assert values(vectors.frequency_vector(df, ["c"])) == [0.25, 0.25, 0.5, 0.5]
    assert values(vectors.frequency_vector(df, ["c"], mode="count")) == [1, 1, 2, 2]
    rows = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "c string")
    assert values(vectors.index_vector(rows, ["c"])) == [0, 0, 1, 2]
    doc = spark.sql("SELECT 1.5D AS temp, true AS ok, CAST(NULL AS STRING) AS note, TIMESTAMP '2024-01-01 00:00:00' AS at")
    assert vectors.documentize(doc, ["temp", "ok", "note", "at"]).first().document == ["temp=1.5", "ok=true", "note=null", "at=2024-01-01 00:00:00.0"]
    s = vectors.summarize(spark.createDataFrame([([1.0, 0.0],), ([3.0, -2.0],)], "f array<double>"), "f", ["mean", "variance", "count", "numNonZeros", "max", "min", "normL1"]).first()
    assert (list(s["mean"]), list(s["variance"]), s["count"], list(s["numNonZeros"]), list(s["max"]), list(s["min"]), list(s["normL1"])) == ([2, -1], [2, 2], 2, [2, 1], [3, 0], [1, -2], [4, 2])
    with pytest.raises(ValueError):
        vectors.summarize(rows, "c", [])


def test_silhouette(spark):
    df = vectors.vectorize(spark.createDataFrame([([0.0], 0), ([1.0], 0), ([10.0], 1), ([11.0], 1)], "v array<double>, c int"), "v", "_v")
    assert round(anomalies.silhouettes(df, "_v", "c")["silhouette_euclidean"], 6) == 0.98995


V2 = '{"app_id":"a","dev_id":"d","hardware_serial":"h","is_retry":false,"confirmed":true,"payload_raw":"p"%s}'


def test_uplink_v2_drops_and_defaults(spark):
    rows = [
        (0, V2 % ""),
        (1, V2 % ',"counter":null,"port":3,"payload_fields":{"i":1,"l":3000000000,"d":1.5,"s":"x","b":true,"li":[1],"m":{"k":"v"}}'),
        (2, (V2 % "").replace('"dev_id":"d",', "")),
        (3, "no json"),
        (4, V2 % ',"payload_fields":{"n":null}'),
        (5, V2 % ',"counter":"x"'),
        (6, V2 % ',"metadata":{"airtime":1,"frequency":868,"altitude":5,"gateways":[{"timestamp":3000000000},{"timestamp":2}]}'),
        (7, None),
    ]
    out = {r.id: r for r in uplink.parse_v2(spark.createDataFrame(rows, "id int, value string")).collect()}
    assert sorted(out) == [0, 1, 6]
    assert (out[0].counter, out[0].port, out[0].attributes, out[0].metadata) == (-1, -1, None, None)
    assert (out[1].counter, out[1].port) == (0, 3)
    assert [tuple(a) for a in out[1].attributes] == [("i", "Int", "1"), ("l", "Long", "3000000000"), ("d", "Double", "1.5"), ("s", "String", '"x"'), ("b", "Boolean", "true"), ("li", "List", "[1]"), ("m", "Map", '{"k":"v"}')]
    meta = out[6].metadata
    assert (meta.airtime, meta.frequency, meta.device_altitude, meta.time, [g.timestamp for g in meta.gateways], meta.gateways[0].rssi) == (1, 868.0, "5.0", "", [3000000000, 2000], -1)


def test_uplink_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(V2 % "" + "\nbroken\n")
    q = uplink_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("uplinks").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("uplinks").count() == 1


def test_sources_and_apps(spark):
    assert jdbc_options({"ds.url": "jdbc:x", "ds.sql": "SELECT 1", "ds.user": "u"}, "d") == {"driver": "d", "url": "jdbc:x", "query": "SELECT 1", "user": "u"}
    with pytest.raises(ValueError):
        jdbc_options({"ds.url": "jdbc:x"}, "d")
    with pytest.raises(ValueError):
        read(spark, {"ds.name": "other"})
    settings = {"ds.name": "parquet", "ds.url": "/root/testdata/sf0.001/supplier.parquet"}
    assert anomaly_app(spark, settings | {"anon.model": "tukey", "anon.value": "s_acctbal"}).count() == read(spark, settings).count()
    with pytest.raises(NotImplementedError):
        forecast(spark, settings)
    with pytest.raises(ValueError):
        validate_series(read(spark, settings), "s_name")


def test_interpolation_of_a_long_series_is_linear_in_its_rows(spark):
    rows = spark.range(60_000).select(F.col("id").alias("t"), F.when(F.col("id") % 1000 == 0, F.col("id") * 2.0).alias("v"))
    out = series.interpolate(rows, "t", "v").where("v IS NOT NULL").agg(F.count("*"), F.max(F.abs(F.col("v") - F.unix_millis("t") * 2))).first()
    assert out[0] == 59_001 and out[1] < 1e-6
    clash = spark.createDataFrame([(1, 1.0, 5), (2, None, 6), (3, 3.0, 7)], "t long, v double, _row int")
    assert [(r.v, r["_row"]) for r in series.interpolate(clash, "t", "v").orderBy("t").collect()] == [(1, 5), (2, 6), (3, 7)]


def test_grid_of_many_blocks(spark):
    df = spark.createDataFrame([(7,), (7 + 3 * 25_000,)], "t long")
    out = series.time_grid(df, "t", 3)
    assert out.agg(F.count("*"), F.min("t"), F.max("t"), F.countDistinct("t")).first() == (25_001, 7, 7 + 75_000, 25_001)


def test_arrays_of_different_sizes_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "t long, a array<double>")
    with pytest.raises(Exception, match="different sizes"):
        series.difference(df, "t", "a")[0].collect()


def test_lags_of_arrays(spark):
    df = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(1, 5)], "t long, a array<double>")
    out = series.lagging(df, "t", "a", lag=2).orderBy("t").collect()
    assert [(r.features, r.label) for r in out] == [([[1, -1], [2, -2]], [3, -3]), ([[2, -2], [3, -3]], [4, -4])]


def test_ranks_with_an_outlier_and_ties(spark):
    values = spark.range(20_000).select((F.col("id") % 5000).cast("double").alias("x")).union(spark.createDataFrame([(1e12,), (-1e12,)], "x double"))
    ordered = sorted([float(i % 5000) for i in range(20_000)] + [1e12, -1e12])
    percents = (0, 1, 25, 50, 75, 99.9, 100)
    wanted = [ordered[min(len(ordered), max(1, int(p / 100 * len(ordered) + 0.5))) - 1] for p in percents]
    assert list(anomalies.nearest_ranks(values, "x", percents).first()) == wanted
    same = spark.range(1000).select(F.lit(3.0).alias("x"))
    assert list(anomalies.nearest_ranks(same, "x", (25, 75)).first()) == [3.0, 3.0]


def test_places_of_many_categories(spark):
    rows = spark.range(3000).select(F.concat(F.lit("k"), F.md5(F.col("id").cast("string"))).alias("c")).union(spark.createDataFrame([(None,)], "c string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges
    try:
        got = {r.c: r.vector[0] for r in vectors.index_vector(rows, ["c"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {k: i for i, k in enumerate([None, *sorted(k for k in got if k)])}


def test_random_numbers_are_the_same_on_each_cluster(spark):
    rows = spark.range(1000).select("id", F.col("id").cast("double").alias("v"))
    one, two = ({r.id: r.x for r in scaling.randomize(x, "v", "x", 5, key="id").collect()} for x in (rows, rows.repartition(7)))
    assert one == two and all(0 <= x < 999 for x in one.values()) and 450 < sum(one.values()) / 1000 < 550
    assert {r.id: r.x for r in scaling.randomize(rows, "v", "x", 6, key="id").collect()} != one
    out = scaling.randomize(rows, "v", "x", 5, True).first()
    assert abs(out.v - out.v_rand - out.x) < 1e-9


def test_vector_conversions(spark):
    df = vectors.vectorize(spark.createDataFrame([(1, [1.0, 2.0])], "id int, a array<double>"), "a", "x").withColumn("xs", F.array("x", "x"))
    out = vectors.flatten_vectors(vectors.devectorize(df, "x", "y"), "xs", "z").first()
    assert (out.y, out.z) == ([1.0, 2.0], [1.0, 2.0, 1.0, 2.0])


def test_saved_models_undo_in_another_session(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i * i), [float(i), 2.0 * i]) for i in range(6)], "t long, v double, a array<double>")
    out, model = scaling.diff_scale(df, "t", "v", 1)
    things = [model, scaling.fit_scaler(df, "a"), series.difference(df, "t", "v", 2)[1], saved.Step("documentize", {"columns": ["t"], "separator": ":"})]
    for i, thing in enumerate(things):
        saved.save(spark, thing, str(tmp_path / str(i)))
        assert saved.load(spark, str(tmp_path / str(i))) == thing
    back = scaling.undo_diff_scale(out, saved.load(spark, str(tmp_path / "0")))
    assert [(r.v, round(r.restored, 9)) for r in back.orderBy("t").collect()] == [(i * i, i * i) for i in range(1, 6)]
    assert saved.load(spark, str(tmp_path / "3")).apply(df).orderBy("t").first().document == ["t:0"]
    with pytest.raises(ValueError):
        saved.Step("other")
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd/x").write_text('{"kind": "other"}')
    with pytest.raises(ValueError):
        saved.load(spark, str(tmp_path / "odd"))


def test_kmeans_places_rows_with_the_nearest_centre(spark):
    import numpy as np

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    model, placed, scores = anomalies.cluster(rows, "embedding", {"k": "4", "maxIter": "5", "initSteps": "2", "tol": "1e-4"})
    centres = np.array(model.clusterCenters())
    for r in placed.collect():
        away = ((centres - np.array(r.embedding)) ** 2).sum(axis=1)
        assert away[r["_cluster"]] <= away.min() + 1e-9
    assert -1 <= scores["silhouette_euclidean"] <= 1 and scores["perplexity"] == 0.0


V3 = (
    '{"end_device_ids":{"device_id":"d","dev_eui":"e","join_eui":"j","dev_addr":"a","application_ids":{"application_id":"app"}},"received_at":"r","correlation_ids":["c"],'
    '"uplink_message":{"received_at":"n","consumed_airtime":"1s","locations":{"user":{"latitude":1.5,"longitude":2,"altitude":9}},"session_key_id":"s","frm_payload":"p","decoded_payload":{"k":"x","n":[1]},'
    '"rx_metadata":[{"gateway_ids":{"gateway_id":"g","eui":"e"},"time":"t","timestamp":12}],"settings":{"data_rate":{"lora":{"bandwidth":125000,"spreading_factor":7}},"coding_rate":"4/5"}}}'
)


def test_uplink_v3_drops_and_defaults(spark):
    mandatory = ['"device_id":"d",', '"dev_eui":"e",', '"join_eui":"j",', '"received_at":"r",', '"received_at":"n",', '"consumed_airtime":"1s",', '"latitude":1.5,', '"longitude":2,', '"session_key_id":"s",', '"frm_payload":"p",', '"decoded_payload":{"k":"x","n":[1]},']
    rows = [(i, V3.replace(part, "")) for i, part in enumerate(mandatory)]
    rows += [(100, V3), (101, V3.replace('"lora":{"bandwidth":125000,"spreading_factor":7}', '"fsk":{"bit_rate":5}')), (102, V3[:-1]), (103, V3.replace('"latitude":1.5', '"latitude":"x"')), (104, None)]
    rows += [(105, V3.replace('"correlation_ids":["c"],', "").replace(',"settings":{"data_rate":{"lora":{"bandwidth":125000,"spreading_factor":7}},"coding_rate":"4/5"}', ""))]
    rows += [(106, V3.replace('"timestamp":12', '"timestamp":12,"location":{"latitude":3,"longitude":4.5,"altitude":1}').replace('"session_key_id"', '"f_cnt":null,"f_port":3,"session_key_id"'))]
    out = {r.id: r for r in uplink.parse_v3(spark.createDataFrame(rows, "id int, value string")).collect()}
    assert sorted(out) == [100, 101, 105, 106]
    r = out[100]
    assert (r.device_id, r.application_id, r.correlation_ids, r.device_latitude, r.device_altitude, r.f_cnt, r.f_port) == ("d", "app", ["c"], 1.5, "9.0", 0, 0)
    assert [tuple(a) for a in r.attributes] == [("k", "String", '"x"'), ("n", "List", "[1]")]
    assert (r.transmission.modulation, r.transmission.bandwidth, r.transmission.spreading_factor) == ("lora", 125000, 7)
    assert (r.gateways[0].gateway_id, r.gateways[0].rssi, r.gateways[0].gateway_latitude, r.gateways[0].gateway_altitude) == ("g", None, 0.0, "0.0")
    assert (out[101].transmission.modulation, out[101].transmission.bandwidth, out[101].transmission.spreading_factor) == ("fsk", None, None)
    assert (out[105].correlation_ids, out[105].transmission) == ([], None)
    assert (out[106].gateways[0].gateway_longitude, out[106].gateways[0].gateway_altitude, out[106].f_cnt, out[106].f_port) == (4.5, "1.0", 0, 3)


def test_a_message_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, V3)], "id int, value string")
    for f in (uplink.parse_v2, uplink.parse_v3):
        assert f(rows)._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_columns_of_any_name_stay(spark):
    rows = spark.createDataFrame([(i, float(i), "a", 9) for i in range(6)], "t long, v double, c string, z int")
    for name in ("_row", "_edge", "_low", "_high", "_w", "_band", "_list", "_key", "_value", "_words", "_rescaled"):
        df = rows.withColumnRenamed("z", name)
        outs = [
            series.interpolate(df, "t", "v"), series.time_split(df, "t")[0], anomalies.tukey_distance(df, "v"), anomalies.change_points(df, "t", "v", 2, 0.5), scaling.randomize(df, "v", "x", 1),
            series.lagging(df, "t", "v", lag=2), vectors.frequency_vector(df, ["c"]), vectors.index_vector(df, ["c"]), scaling.undo_diff_scale(*scaling.diff_scale(df, "t", "v", 1)),
        ]
        assert all(set(df.columns) <= set(x.columns) for x in outs)
    assert {r[name] for x in outs for r in x.collect()} == {9}
