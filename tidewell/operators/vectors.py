"""Categories and texts as vectors, vector conversions, and weighted summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import IDF, HashingTF, IDFModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.blocks import unused
from tidewell.sources.pinned import pinned

DOCUMENT_TYPES = (T.BooleanType, T.ByteType, T.DateType, T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.StringType, T.TimestampType, T.TimestampNTZType)
METRICS = ("mean", "variance", "count", "numNonZeros", "max", "min", "normL2", "normL1", "sum", "std")


def _word(df: DataFrame, column: str, separator: str) -> Column:
    kind = df.schema[column].dataType
    if not isinstance(kind, DOCUMENT_TYPES):
        raise ValueError(f"{column!r} has a type that can't be written as a word")
    text = F.col(column).cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.when(text.contains("."), text).otherwise(F.concat(text, F.lit(".0")))
    return F.concat(F.lit(column + separator), F.coalesce(text, F.lit("null")))


def documentize(df: DataFrame, columns: Sequence[str], output: str = "document", separator: str = "=") -> DataFrame:
    """An array of words column<separator>value; null is written as null."""
    return df.withColumn(output, F.array(*[_word(df, c, separator) for c in columns]))


def _check_strings(df: DataFrame, columns: Sequence[str]) -> None:
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.StringType):
            raise ValueError(f"{c!r} is no string column")


@dataclass(frozen=True)
class CategoryModel:
    """A number for each category of some columns: tables of (_key, _value), null being a category; categories that no table
    has get `unknown`. Tables may be of any size."""

    columns: tuple[str, ...]
    tables: tuple[DataFrame, ...]
    unknown: float


def apply_categories(df: DataFrame, model: CategoryModel, output: str = "vector") -> DataFrame:
    """A dense vector of the categories' numbers, for a batch or a stream. Spark broadcasts small tables by their measured size,
    others are shuffled."""
    values, seen = [], F.lit(model.unknown)
    for c, table in zip(model.columns, model.tables, strict=True):
        key, value = unused(df, "_key"), unused(df, "_value")
        own = table.select(F.col("_key").alias(key), F.col("_value").cast("double").alias(value))
        df = df.join(own, F.col(c).eqNullSafe(F.col(key)), "left").drop(key)
        values.append(value)
    return df.withColumn(output, array_to_vector(F.array(*[F.coalesce(F.col(v), seen) for v in values]))).drop(*values)


def fit_frequency(df: DataFrame, columns: Sequence[str], mode: str = "freq", unknown: float = 0.0) -> CategoryModel:
    """Each category's share of the rows ("freq") or its rows ("count")."""
    if mode not in ("freq", "count"):
        raise ValueError("mode is freq or count")
    _check_strings(df, columns)
    tables = []
    for c in columns:
        counts = df.groupBy(F.col(c).alias("_key")).agg(F.count("*").alias("_value"))
        if mode == "freq":
            counts = counts.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select("_key", (F.col("_value") / F.col("_all")).alias("_value"))
        tables.append(counts)
    return CategoryModel(tuple(columns), tuple(tables), unknown)


def frequency_vector(df: DataFrame, columns: Sequence[str], output: str = "vector", mode: str = "freq") -> DataFrame:
    """A dense vector of each category's share of the rows ("freq") or its rows ("count"); null is a category."""
    return apply_categories(df, fit_frequency(df, columns, mode), output)


def _numbered(keys: DataFrame) -> DataFrame:
    """(_key, _value) with each distinct key's place: keys are dealt out by ranges, as many as their size asks for, and written down in
    order; then a key's place is its place in its range plus the keys of the ranges before."""
    ordered = pinned(keys.repartitionByRange("_key").sortWithinPartitions("_key").withColumn("_at", F.monotonically_increasing_id()))
    placed = ordered.select("_key", F.shiftright("_at", 33).alias("_range"), (F.col("_at") % (1 << 33)).alias("_place"))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(sizes.select("_range", before.alias("_before")), "_range").select("_key", (F.col("_before") + F.col("_place")).alias("_value"))


def fit_index(df: DataFrame, columns: Sequence[str], unknown: float = -1.0) -> CategoryModel:
    """Each category's place (from 0) in the order of its column's distinct values, null in front."""
    _check_strings(df, columns)
    return CategoryModel(tuple(columns), tuple(_numbered(df.select(F.col(c).alias("_key")).distinct()) for c in columns), unknown)


def index_vector(df: DataFrame, columns: Sequence[str], output: str = "vector") -> DataFrame:
    """A dense vector of each category's place (from 0) in the order of its column's distinct values. Nulls raise nothing
    and stay null in the order's front."""
    return apply_categories(df, fit_index(df, columns), output)


@dataclass(frozen=True)
class TfIdfModel:
    """The words' columns, the number of buckets, and Spark's model of their weights."""

    columns: tuple[str, ...]
    features: int
    idf: IDFModel


def _counted(df: DataFrame, columns: Sequence[str], features: int, output: str) -> DataFrame:
    words = unused(df, "_words")
    return HashingTF(numFeatures=features, inputCol=words, outputCol=output).transform(documentize(df, columns, words)).drop(words)


def fit_tfidf(df: DataFrame, columns: Sequence[str], features: int = 1 << 18) -> TfIdfModel:
    return TfIdfModel(tuple(columns), features, IDF(minDocFreq=1, inputCol="_counts", outputCol="_weights").fit(_counted(df.select(*columns), columns, features, "_counts")))


def apply_tfidf(df: DataFrame, model: TfIdfModel, output: str = "vector") -> DataFrame:
    """Words that weren't there when the model was fitted have the weight of their bucket: ln(n + 1) where that was empty."""
    counts = unused(df, "_counts")
    idf = model.idf.copy({model.idf.inputCol: counts, model.idf.outputCol: output})
    return idf.transform(_counted(df, model.columns, model.features, counts)).drop(counts)


def tfidf_vector(df: DataFrame, columns: Sequence[str], output: str = "vector", features: int = 1 << 18) -> DataFrame:
    """TF-IDF of the words column=value: hashed term counts times ln((n + 1) / (df + 1))."""
    return apply_tfidf(df, fit_tfidf(df, columns, features), output)


def summarize(df: DataFrame, vector: str, metrics: Sequence[str], weight: str | None = None) -> DataFrame:
    """One row with a column for each metric of a vector (or array) column; rows of weight 0 don't count."""
    if not metrics or set(metrics) - set(METRICS):
        raise ValueError(f"metrics are some of {', '.join(METRICS)}")
    if isinstance(df.schema[vector].dataType, T.ArrayType):
        df = vectorize(df, vector, vector, cast=True)
    summary = Summarizer.metrics(*metrics).summary(F.col(vector), F.col(weight) if weight else F.lit(1.0))
    return df.select(summary.alias("_s")).select(*[F.col(f"_s.{m}").alias(m) for m in metrics])


#: Of vectors, the parts of a state that add up. (Each array has a place for each component.)
ADDED = ("sum", "l1", "nonzero")


def _grouped(df: DataFrame, by: Sequence[str]) -> GroupedData:
    """By columns, or all rows as one group, which an empty table doesn't have."""
    return df.groupBy(*by) if by else df.groupBy(F.lit(0).alias("_one"))


def moments(df: DataFrame, vector: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The state of a summary, one row for each value of `by` (a day, say), to be written down and merged later: rows, weights and their
    squares, and for each component the weighted sum, sum of absolute values, sum of squared distances from the mean, number of values
    that aren't 0, least and greatest value. Null vectors and rows of weight 0 don't
    count."""
    df = df.where(F.col(vector).isNotNull())
    if isinstance(df.schema[vector].dataType, T.ArrayType):
        df = vectorize(df, vector, vector, cast=True)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    found = Summarizer.metrics("count", "mean", "variance", "sum", "normL1", "numNonZeros", "min", "max").summary(F.col(vector), w)
    rows = _grouped(df.where(w > 0), by).agg(found.alias("_s"), F.sum(w).alias("weight"), F.sum(w * w).alias("squares"))
    rows = rows.where("_s.count > 0").select(*by, "weight", "squares", *[vector_to_array(f"_s.{m}").alias(f"_{m}") for m in ("variance", "sum", "normL1", "numNonZeros", "min", "max")], F.col("_s.count").alias("rows"))
    free = F.greatest(F.col("weight") - F.col("squares") / F.col("weight"), F.lit(0.0))  # what the variance was divided by
    spread = F.transform("_variance", lambda v: v * free)
    return rows.select(*by, "rows", "weight", "squares", F.col("_sum").alias("sum"), F.col("_normL1").alias("l1"), F.col("_numNonZeros").alias("nonzero"), spread.alias("spread"), F.col("_min").alias("min"), F.col("_max").alias("max"))


def merge_moments(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """States as one for each value of `by`, whatever states these were merged from: the rule is associative. Distances from a mean
    become distances from the mean of all by what lies between the two means."""
    names = {c: unused(states, f"_all_{c}") for c in ("weight", "sum", *by)}
    vec = lambda c: array_to_vector(F.col(c))
    total = _grouped(states, by).agg(F.sum("weight").alias(names["weight"]), vector_to_array(Summarizer.metrics("sum").summary(vec("sum"))["sum"]).alias(names["sum"]))
    own = total.select(names["weight"], names["sum"], *[F.col(c).alias(names[c]) for c in by])
    joined = states.join(own, [F.col(c).eqNullSafe(F.col(names[c])) for c in by]) if by else states.crossJoin(F.broadcast(own))  # one row
    means = F.arrays_zip(F.transform("sum", lambda x: x / F.col("weight")).alias("own"), F.transform(names["sum"], lambda x: x / F.col(names["weight"])).alias("all"))
    moved = F.zip_with("spread", means, lambda d, m: d + F.col("weight") * (m["own"] - m["all"]) * (m["own"] - m["all"]))
    rows = joined.withColumn("spread", moved)

    def folded(metric: str, c: str) -> Column:
        return vector_to_array(Summarizer.metrics(metric).summary(vec(c))[metric]).alias(c)

    out = _grouped(rows, by).agg(*[F.sum(c).alias(c) for c in ("rows", "weight", "squares")], *[folded("sum", c) for c in (*ADDED, "spread")], folded("min", "min"), folded("max", "max"))
    return out.select(*by, "rows", "weight", "squares", *ADDED, "spread", "min", "max")


def finish_moments(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The metrics of summarize() as arrays, from states."""
    w, free = F.col("weight"), F.col("weight") - F.col("squares") / F.col("weight")
    variance = F.transform("spread", lambda d: F.when(free > 0, F.greatest(d / F.when(free > 0, free), F.lit(0.0))).otherwise(F.lit(0.0)))
    power = F.zip_with("spread", "sum", lambda d, x: F.sqrt(d + x * x / w))  # of the weighted squares
    return states.select(
        *by, F.transform("sum", lambda x: x / w).alias("mean"), variance.alias("variance"), F.col("rows").alias("count"), F.col("nonzero").alias("numNonZeros"), "max", "min",
        power.alias("normL2"), F.col("l1").alias("normL1"), "sum", F.transform(variance, lambda v: F.sqrt(v)).alias("std"),
    )


def vectorize(df: DataFrame, column: str, output: str, cast: bool = False) -> DataFrame:
    """An array column as a vector; cast: numbers of other types become doubles first."""
    return df.withColumn(output, array_to_vector(F.col(column).cast("array<double>") if cast else F.col(column)))


def devectorize(df: DataFrame, column: str, output: str) -> DataFrame:
    return df.withColumn(output, vector_to_array(column))


def flatten_vectors(df: DataFrame, column: str, output: str) -> DataFrame:
    """array<vector> (as locality-sensitive hashing gives it) as one array<double>."""
    return df.withColumn(output, F.flatten(F.transform(column, lambda x: vector_to_array(x))))
