"""Fitted models and configured operators, saved in a folder that Spark can write.

A scaler or a difference that was fitted today can undo a forecast tomorrow, in another session; categories, weights of words and fences
of one table can be applied to later ones, and to streams; and an operator with its settings can be kept beside them. (A K-means
model has save and load of its own.)
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml.feature import IDFModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import anomalies, scaling, series, vectors

OPERATORS: dict[str, Callable[..., Any]] = {
    f.__name__: f
    for f in (
        anomalies.change_points, anomalies.silhouette_points, anomalies.silhouettes, anomalies.tukey_distance, scaling.randomize, series.interpolate, series.lagging, series.normalize, series.prepare,
        vectors.documentize, vectors.frequency_vector, vectors.index_vector, vectors.summarize, vectors.tfidf_vector, vectors.vectorize,
    )
}


@dataclass(frozen=True)
class Step:
    """An operator by its name, with its settings."""

    operator: str
    settings: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}; known: {', '.join(sorted(OPERATORS))}")

    def apply(self, df: DataFrame) -> Any:
        return OPERATORS[self.operator](df, **self.settings)


def _diff_scaler(scaler: dict, diff: dict | None) -> scaling.DiffScalerModel:
    return scaling.DiffScalerModel(scaling.ScalerModel(**scaler), diff and series.DiffModel(**diff))


KINDS: dict[str, Callable[..., Any]] = {"ScalerModel": scaling.ScalerModel, "DiffModel": series.DiffModel, "DiffScalerModel": _diff_scaler, "TukeyModel": anomalies.TukeyModel, "Step": Step}
Saved = scaling.ScalerModel | series.DiffModel | scaling.DiffScalerModel | anomalies.TukeyModel | vectors.CategoryModel | vectors.TfIdfModel | Step


def save(spark: SparkSession, thing: Saved, path: str) -> None:
    """Writes a model or step to a folder, which must not exist yet: a JSON text, and for what is as large as the data its tables."""
    kind = type(thing).__name__
    if isinstance(thing, vectors.CategoryModel):
        fields = {"columns": thing.columns, "unknown": thing.unknown}
        for i, table in enumerate(thing.tables):
            table.select("_key", F.col("_value").cast("double").alias("_value")).write.parquet(f"{path}/values/{i}")
    elif isinstance(thing, vectors.TfIdfModel):
        fields = {"columns": thing.columns, "features": thing.features}
        thing.idf.write().save(f"{path}/idf")
    else:
        fields = asdict(thing)
    text = json.dumps({"kind": kind, "fields": fields})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/metadata")  # at last: only what is whole can be loaded


def load(spark: SparkSession, path: str) -> Saved:
    """What save() has written there. Raises ValueError for anything else."""
    try:
        rows = spark.read.text(f"{path}/metadata", wholetext=True).take(2)
        found = json.loads(rows[0][0]) if len(rows) == 1 else {}
    except (AnalysisException, json.JSONDecodeError):
        found = {}
    kind, fields = found.get("kind"), found.get("fields")
    if kind == "CategoryModel":
        tables = [spark.read.schema("_key string, _value double").parquet(f"{path}/values/{i}") for i in range(len(fields["columns"]))]
        return vectors.CategoryModel(tuple(fields["columns"]), tuple(tables), fields["unknown"])
    if kind == "TfIdfModel":
        return vectors.TfIdfModel(tuple(fields["columns"]), fields["features"], IDFModel.load(f"{path}/idf"))
    if kind not in KINDS:
        raise ValueError(f"no saved model in {path!r}")
    return KINDS[kind](**fields)
