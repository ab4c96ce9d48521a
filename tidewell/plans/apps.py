"""Applications: a source, then the model that the settings name."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from tidewell.operators.anomalies import change_points, cluster, tukey_distance
from tidewell.sources.readers import read


def anomalies(spark: SparkSession, settings: Mapping[str, str]) -> DataFrame:
    """anon.model: tukey (anon.value), changepoint (anon.time, anon.value, anon.window, anon.threshold), or kmeans
    (anon.vector and anon.kmeans.*), on the table that the ds.* settings name."""
    df, model = read(spark, settings), settings.get("anon.model", "")
    if model == "tukey":
        return tukey_distance(df, settings["anon.value"])
    if model == "changepoint":
        return change_points(df, settings["anon.time"], settings["anon.value"], int(settings.get("anon.window", 30)), float(settings["anon.threshold"]), settings.get("anon.group"))
    if model == "kmeans":
        prefix = "anon.kmeans."
        return cluster(df, settings["anon.vector"], {k.removeprefix(prefix): v for k, v in settings.items() if k.startswith(prefix)})[1]
    raise ValueError(f"unknown anon.model {model!r}; known: tukey, changepoint, kmeans")


def forecast(spark: SparkSession, settings: Mapping[str, str]) -> DataFrame:
    """model.type (DL, ML or TS; DL by default) and model.algo have no forecasting model behind them: the source is checked, no
    more."""
    kind, algo = settings.get("model.type", "DL"), settings.get("model.algo", "")
    if kind not in ("DL", "ML", "TS"):
        raise ValueError(f"unknown model.type {kind!r}")
    read(spark, settings)
    raise NotImplementedError(f"there is no {kind} forecasting model{f' {algo!r}' if algo else ''}; lag vectors for one come from operators.series.lagging")
