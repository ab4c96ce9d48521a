"""Min-max scaling in both directions, differences with scaling, and random columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.timestamps import minmax
from tidewell.operators.blocks import unused
from tidewell.operators.series import DiffModel, difference, undo_difference


@dataclass(frozen=True)
class ScalerModel:
    """Bounds of a column: two numbers, or two lists of them for an array column."""

    column: str
    low: float | list[float] | None
    high: float | list[float] | None


def fit_scaler(df: DataFrame, column: str) -> ScalerModel:
    """One aggregation; two numbers (or vectors) come to the driver, because the inverse needs them later."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        vector = array_to_vector(F.col(column).cast("array<double>"))
        row = df.where(F.col(column).isNotNull()).select(Summarizer.metrics("min", "max").summary(vector).alias("s")).select(vector_to_array("s.min"), vector_to_array("s.max")).first()
    else:
        row = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    return ScalerModel(column, *(row or (None, None)))


def _doubles(values: list[float]):
    return F.array(*[F.lit(float(v)) for v in values])


def scale(df: DataFrame, model: ScalerModel, output: str | None = None) -> DataFrame:
    """{column}_scaled in [0, 1]; a constant column gives NaN."""
    output = output or f"{model.column}_scaled"
    if isinstance(model.low, list):
        bounds = F.arrays_zip(_doubles(model.low).alias("low"), _doubles(model.high).alias("high"))
        return df.withColumn(output, F.zip_with(F.col(model.column).cast("array<double>"), bounds, lambda v, b: minmax(v, b["low"], b["high"])))
    return df.withColumn(output, minmax(F.col(model.column), model.low, model.high))


def unscale(df: DataFrame, model: ScalerModel, column: str | None = None, output: str | None = None) -> DataFrame:
    """{column}_rescaled: low + scaled * (high - low). Raises ValueError where nothing was fitted."""
    if model.low is None:
        raise ValueError("the scaler has no bounds")
    column, output = column or f"{model.column}_scaled", output or f"{model.column}_rescaled"
    if isinstance(model.low, list):
        bounds = F.arrays_zip(_doubles(model.low).alias("low"), _doubles(model.high).alias("high"))
        return df.withColumn(output, F.zip_with(column, bounds, lambda s, b: b["low"] + s * (b["high"] - b["low"])))
    return df.withColumn(output, F.lit(model.low) + F.col(column) * F.lit(model.high - model.low))


@dataclass(frozen=True)
class DiffScalerModel:
    scaler: ScalerModel
    diff: DiffModel | None


def diff_scale(df: DataFrame, time: str, value: str, order: int = 0, offset: int = 1, output: str = "scaled", **order_by) -> tuple[DataFrame, DiffScalerModel]:
    """Differences (none for order 0), scaled to [0, 1]; the model undoes both."""
    diff = None
    if order:
        df, diff = difference(df, time, value, order, offset, **order_by)
    model = fit_scaler(df, diff.output if diff else value)
    return scale(df, model, output), DiffScalerModel(model, diff)


def undo_diff_scale(df: DataFrame, model: DiffScalerModel, column: str = "scaled", output: str = "restored") -> DataFrame:
    name = unused(df, "_rescaled")
    out = unscale(df, model.scaler, column, name)
    return (undo_difference(out, model.diff, name, output) if model.diff else out.withColumn(output, F.col(name))).drop(name)


def uniform(df: DataFrame, seed: int, key: str | Sequence[str] | None = None) -> Column:
    """A number in [0, 1) for each row, from 52 bits of a digest of the seed and the key columns (of all columns without a
    key): the same on each cluster and in each run."""
    names = [key] if isinstance(key, str) else list(key or df.columns)
    text = F.to_json(F.struct(*names)) if key is None else F.concat_ws("|", *[F.col(c).cast("string") for c in names])
    digest = F.md5(F.concat(F.lit(f"{seed}|"), text).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def randomize(df: DataFrame, column: str, output: str, seed: int, with_difference: bool = False, key: str | Sequence[str] | None = None) -> DataFrame:
    """A random column in [0, max - min); with_difference: the column minus it, and it as {column}_rand. `key`
    are columns that tell rows apart: rows alike in them (in all columns by default) get the same number."""
    random = uniform(df, seed, key)
    band = unused(df, "_band")
    ends = df.agg((F.max(column).cast("double") - F.min(column).cast("double")).alias(band))
    out = df.crossJoin(F.broadcast(ends))  # one row
    value = random * F.col(band)
    if not with_difference:
        return out.withColumn(output, value).drop(band)
    return out.withColumn(f"{column}_rand", value).withColumn(output, F.col(column) - F.col(f"{column}_rand")).drop(band)
