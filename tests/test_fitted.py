"""Models fitted once and applied later, mergeable moments, silhouettes by row, and balanced scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import anomalies, vectors
from tidewell.plans import saved
from tidewell.sources import readers


def streamed(spark, df, apply, path) -> list:
    df.coalesce(1).write.parquet(str(path / "in"))
    name = f"out_{random.randrange(10**9)}"
    q = apply(spark.readStream.schema(df.schema).parquet(str(path / "in"))).writeStream.format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


@pytest.mark.parametrize("kind", ["freq", "count", "index"])
def test_categories_fitted_saved_and_applied(spark, tmp_path, kind):
    old = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", None), (None, "y")], "c string, d string")
    new = spark.createDataFrame([("a", None), (None, "z"), ("zz", "x")], "c string, d string")
    model = vectors.fit_index(old, ["c", "d"], unknown=9.0) if kind == "index" else vectors.fit_frequency(old, ["c", "d"], kind)
    wanted = {"freq": [[0.5, 0.25], [0.25, 0.0], [0.0, 0.5]], "count": [[2, 1], [1, 0], [0, 2]], "index": [[1, 0], [0, 9], [9, 1]]}[kind]
    saved.save(spark, model, str(tmp_path / "m"))
    again = saved.load(spark.newSession(), str(tmp_path / "m"))
    assert (again.columns, again.unknown) == (model.columns, model.unknown)
    for m in (model, saved.load(spark, str(tmp_path / "m"))):
        got = {(r.c, r.d): list(r.vector) for r in vectors.apply_categories(new, m).collect()}
        assert [got[r.c, r.d] for r in new.collect()] == wanted
    rows = streamed(spark, new, lambda x: vectors.apply_categories(x, m), tmp_path)
    assert sorted(list(r.vector) for r in rows) == sorted(map(list, wanted))
    with pytest.raises(ValueError):
        vectors.fit_frequency(old, ["c"], "other")


def test_fences_and_word_weights_applied_to_streams(spark, tmp_path):
    rows = spark.createDataFrame([(float(x), f"w{x % 3}") for x in [*range(1, 10), 100]], "x double, w string")
    saved.save(spark, anomalies.fit_tukey(rows, "x"), str(tmp_path / "t"))
    fences = saved.load(spark, str(tmp_path / "t"))
    assert (fences.low, fences.high) == (-4.5, 15.5)
    new = spark.createDataFrame([(100.0, "w1"), (-5.5, "new"), (None, None)], "x double, w string")
    assert {r.x: r.tukey_dist for r in streamed(spark, new, lambda x: anomalies.apply_tukey(x, fences), tmp_path)} == {100.0: 84.5, -5.5: -1.0, None: None}
    model = vectors.fit_tfidf(rows, ["w"], 64)
    saved.save(spark, model, str(tmp_path / "w"))
    again = saved.load(spark, str(tmp_path / "w"))
    one, two = ([r.vector.toArray().tolist() for r in vectors.apply_tfidf(new, m).orderBy("x").collect()] for m in (model, again))
    assert one == two and np.isclose(max(one[2]), np.log(11 / 5))
    with pytest.raises(ValueError):
        saved.load(spark, str(tmp_path / "nothing"))


def test_merged_moments_equal_one_pass(spark):
    rnd = random.Random(1)
    rows = [(i % 10, i % 3, [rnd.gauss(1e3, 1), float(rnd.randint(-1, 1)), 0.0], float(rnd.choice([0, 1, 2.5]))) for i in range(400)] + [(3, 0, None, 1.0), (11, 0, [9.0, 9.0, 9.0], 0.0)]
    df = spark.createDataFrame(rows, "day int, k int, v array<double>, w double")
    states = vectors.moments(df, "v", "w", ["day", "k"])
    assert states.where("day = 11").count() == 0
    orders = [vectors.merge_moments(states), vectors.merge_moments(vectors.merge_moments(states, ["day"])), vectors.merge_moments(vectors.merge_moments(states.where("k > 0"), ["k"]).drop("k").unionByName(vectors.merge_moments(states.where("k = 0"))))]
    kept = df.where("v IS NOT NULL")
    whole = vectors.summarize(kept, "v", vectors.METRICS, "w").first()
    for merged in orders:
        row = vectors.finish_moments(merged).first()
        for m in vectors.METRICS:
            assert np.allclose(row[m], whole[m] if m == "count" else whole[m].toArray(), rtol=1e-9, atol=1e-6), m
    assert vectors.merge_moments(states.where("false")).count() == vectors.moments(df.where("false"), "v").count() == 0
    assert vectors.merge_moments(states, ["k"]).count() == 3


@pytest.mark.parametrize("measure", ["squaredEuclidean", "cosine"])
def test_silhouettes_by_row(spark, measure):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(size=3).tolist(), int(i % 4)) for i in range(40)] + [(40, [5.0, 5.0, 5.0], 7), (41, None, 1), (42, [1.0, 1.0, 1.0], None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id int, v array<double>, c int, _x int")
    kept = [(i, np.array(v), c) for i, v, c in rows if v is not None and c is not None]
    away = (lambda a, b: ((a - b) ** 2).sum()) if measure == "squaredEuclidean" else (lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b)))
    wanted = {}
    for i, v, c in kept:
        means = {k: [away(v, w) for j, w, d in kept if d == k and j != i] for k in {d for *_, d in kept}}
        a, b = means.pop(c), min(np.mean(x) for k, x in means.items() if k != c)
        wanted[i] = 0.0 if not a else (b - np.mean(a)) / max(b, np.mean(a))
    out = anomalies.silhouette_points(df, "v", "c", measure)
    got = {r.id: r.silhouette for r in out.collect()}
    assert got.keys() == wanted.keys() and all(abs(got[i] - wanted[i]) < 1e-9 for i in got) and out.columns == [*df.columns, "silhouette"]
    mean = anomalies.silhouettes(vectors.vectorize(df.where("v IS NOT NULL AND c IS NOT NULL"), "v", "_v"), "_v", "c")
    assert abs(mean["silhouette_cosine" if measure == "cosine" else "silhouette_euclidean"] - np.mean(list(got.values()))) < 1e-9
    with pytest.raises(Exception, match="two clusters"):
        anomalies.silhouette_points(df.where("c = 1"), "v", "c", measure).collect()
    assert anomalies.silhouette_points(df.where("false"), "v", "c", measure).count() == 0


def test_clusters_too_large_to_hold_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(anomalies, "CLUSTER_BYTES", 100)
    with pytest.raises(ValueError):
        anomalies.silhouette_points(spark.range(9).select(F.array(F.col("id")).alias("v"), "id"), "v", "id")


def test_nearest_centres(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([5.0, 5.0],), ([2.5, 2.5],), (None,)], "v array<double>")
    assert [r["_cluster"] for r in anomalies.nearest_centres(df, "v", [[0, 0], [5, 5]]).collect()] == [0, 1, 0, None]


@pytest.mark.parametrize("kind", ["long", "double"])
def test_predicates_are_disjoint_whole_and_even(spark, kind):
    rnd = random.Random(2)
    values = [int(rnd.paretovariate(0.4)) % 10**9 for _ in range(4000)] + [77] * 1500 + [-5] * 3
    df = spark.createDataFrame([(float(v) if kind == "double" else v,) for v in values] + [(None,)] * 40, f"k {kind}")
    found = readers.balanced_predicates(df, "k", 8)
    shares = df.select(*[F.expr(p).cast("int").alias(f"p{i}") for i, p in enumerate(found)]).fillna(0)
    counts = [r for r in shares.agg(*[F.sum(c) for c in shares.columns]).first()]
    assert shares.where(" + ".join(shares.columns) + " <> 1").count() == 0 and sum(counts) == 5543 and counts[-1] == 40
    assert "k >= 77 AND k <= 77" in [p.replace(".0", "") for p in found]
    assert max(c for p, c in zip(found, counts) if "77 AND k <= 77" not in p.replace(".0", "")) < 2 * 5500 / 8
    for odd, wanted in (("false", 2), ("k = 77", 4)):
        assert len(readers.balanced_predicates(df.where(odd), "k", 8)) == wanted
    with pytest.raises(ValueError):
        readers.balanced_predicates(spark.createDataFrame([("a",)], "k string"), "k", 2)
    with pytest.raises(ValueError):
        readers.read(spark, {"ds.name": "postgres", "ds.url": "jdbc:x", "ds.balance": "4"})
