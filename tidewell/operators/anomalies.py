"""Outlier distances, change-point windows, and clusters with their silhouette."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.blocks import unused
from tidewell.operators.ranks import rank_values
from tidewell.operators.series import windowed_list
from tidewell.operators.vectors import vectorize

NUMBERS = (T.ByteType, T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType)


def nearest_ranks(df: DataFrame, column: str, percents: Sequence[float]) -> DataFrame:
    """One row with q<i> for each percentage: ranks.rank_values."""
    values = rank_values(df, column, percents)
    return df.sparkSession.createDataFrame([tuple(values)], ", ".join(f"q{i} double" for i in range(len(values))))


@dataclass(frozen=True)
class TukeyModel:
    """The fences of a column: Q25 - 1.5 IQR and Q75 + 1.5 IQR."""

    column: str
    low: float
    high: float


def _check_number(df: DataFrame, column: str) -> None:
    if not isinstance(df.schema[column].dataType, NUMBERS):
        raise ValueError(f"{column!r} is no numerical column")


def fit_tukey(df: DataFrame, column: str) -> TukeyModel:
    _check_number(df, column)
    a, b = rank_values(df, column, (25, 75))
    return TukeyModel(column, a - 1.5 * (b - a), b + 1.5 * (b - a))


def apply_tukey(df: DataFrame, model: TukeyModel, output: str = "tukey_dist") -> DataFrame:
    """A value minus the fence that it lies beyond, 0 inside them, null for null; of a batch or a stream, with nothing but the row."""
    _check_number(df, model.column)
    v = F.col(model.column).cast("double")
    return df.withColumn(output, F.when(v < model.low, v - model.low).when(v > model.high, v - model.high).when(v.isNotNull(), F.lit(0.0)))


def tukey_distance(df: DataFrame, column: str, output: str = "tukey_dist") -> DataFrame:
    """Distances from the fences of the table's own values."""
    return apply_tukey(df, fit_tukey(df, column), output)


def change_points(df: DataFrame, time: str, value: str, window: int = 30, threshold: float | None = None, group: str | None = None, tiebreak: str | None = None, score: Callable[[Column, Column], Column] | None = None, bounds: Sequence[int] | None = None) -> DataFrame:
    """cp_score and is_cp (score above the threshold) of rows with `window` values on either side; other rows go.

    score compares the values before a row with those from it on (the last one of the window is not among them); without
    one the score is 0.0 throughout.
    """
    if window < 2 or threshold is None or not 0 < threshold < 1:
        raise ValueError("the window must be 2 or more, the threshold between 0 and 1")
    name = unused(df, "_w")
    rows, halo = windowed_list(df, name, value, -window, window, time, [group] if group else [], tiebreak, bounds)
    rows = rows.where(F.size(name) == 2 * window + 1)
    rows = halo.kept(rows) if halo else rows
    value_of = score(F.slice(name, 1, window), F.slice(name, window + 1, window)) if score else F.lit(0.0)
    return rows.withColumn("cp_score", value_of.cast("double")).withColumn("is_cp", F.col("cp_score") > threshold).drop(name)


def mean_shift(before: Column, after: Column) -> Column:
    """A score for change_points: the distance of the means, as a share of the sum of their absolute values."""

    def mean(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)

    return F.coalesce(F.try_divide(F.abs(mean(after) - mean(before)), F.abs(mean(after)) + F.abs(mean(before))), F.lit(0.0))


def train_kmeans(df: DataFrame, vector: str, settings: Mapping[str, str], seed: int = 1) -> KMeansModel:
    """By the settings k, maxIter, initSteps, tol (mandatory) and initMode (parallel or random)."""
    missing = [k for k in ("k", "maxIter", "initSteps", "tol") if k not in settings]
    mode = {"parallel": "k-means||", "random": "random"}.get(settings.get("initMode", "parallel"))
    if missing or mode is None:
        raise ValueError(f"missing settings {missing}" if missing else "initMode is parallel or random")
    kmeans = KMeans(featuresCol=vector, predictionCol="_cluster", k=int(settings["k"]), maxIter=int(settings["maxIter"]), initSteps=int(settings["initSteps"]), tol=float(settings["tol"]), initMode=mode, seed=seed)
    return kmeans.fit(df)


def silhouettes(df: DataFrame, vector: str, cluster: str) -> dict[str, float]:
    """Mean silhouettes by squared Euclidean and by cosine distance; perplexity and likelihood are 0, as K-means has none."""
    def one(measure: str) -> float:
        return ClusteringEvaluator(featuresCol=vector, predictionCol=cluster, metricName="silhouette", distanceMeasure=measure).evaluate(df)

    return {"silhouette_euclidean": one("squaredEuclidean"), "silhouette_cosine": one("cosine"), "perplexity": 0.0, "likelihood": 0.0}


#: Bytes of what is known of all clusters that every task may hold.
CLUSTER_BYTES = 64 << 20


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _known_clusters(stats: DataFrame, size: int) -> DataFrame:
    """All clusters as one row with one array; ValueError if that is too large for every task to hold."""
    clusters = stats.count()
    if clusters * (size + 4) * 8 > CLUSTER_BYTES:
        raise ValueError(f"{clusters} clusters of {size} components are more than {CLUSTER_BYTES} bytes")
    return stats.agg(F.collect_list(F.struct(*stats.columns)).alias("_known"))


def silhouette_points(df: DataFrame, vector: str, cluster: str, measure: str = "squaredEuclidean", output: str = "silhouette") -> DataFrame:
    """Each row's silhouette: (b - a) / max(a, b) for its mean distance a from the others of its cluster and b from the rows of the
    nearest other cluster; 0 where it is alone. Means come from each cluster's number, sum of vectors and sum of squared norms, so no
    pair of rows is looked at. Distances are squared Euclidean or cosine; a vector of zeros has no direction, and cosine distance 1
    from all. vector: an array of numbers; rows with a null one, or without a cluster, go. One cluster alone is an error."""
    if measure not in ("squaredEuclidean", "cosine"):
        raise ValueError("measure is squaredEuclidean or cosine")
    x, norm, known = unused(df, "_x"), unused(df, "_norm"), unused(df, "_known")
    rows = df.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).withColumn(x, F.col(vector).cast("array<double>"))
    rows = rows.withColumn(norm, _dot(F.col(x), F.col(x)))
    if measure == "cosine":
        length = F.sqrt(norm)
        rows = rows.withColumn(x, F.transform(x, lambda v: F.when(length > 0, v / F.when(length > 0, length)).otherwise(F.lit(0.0)))).withColumn(norm, F.lit(0.5))
    total = vector_to_array(Summarizer.metrics("sum").summary(array_to_vector(F.col(x)))["sum"])
    stats = rows.groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), F.sum(norm).alias("q"), total.alias("s"))
    first = rows.select(F.size(x)).first()
    every = _known_clusters(stats, first[0] if first else 0).withColumnRenamed("_known", known)
    joined = rows.crossJoin(F.broadcast(every))  # one row, its size checked
    if measure == "cosine":  # 1 - cos; half of the squared distance of directions
        away = lambda c: F.lit(1.0) - _dot(F.col(x), c["s"]) / c["n"]
    else:
        away = lambda c: F.col(norm) + c["q"] / c["n"] - 2 * _dot(F.col(x), c["s"]) / c["n"]
    means = F.transform(known, lambda c: F.struct((c["c"] == F.col(cluster)).alias("own"), c["n"].alias("n"), away(c).alias("d")))
    placed = joined.withColumn(known, means)
    own = F.get(F.filter(known, lambda m: m["own"]), F.lit(0))
    a = own["d"] * own["n"] / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter(known, lambda m: ~m["own"]), lambda m: m["d"]))
    alone = F.when(b.isNull(), F.raise_error(F.lit("silhouettes need two clusters")).cast("double"))
    score = F.when(own["n"] > 1, F.when(a < b, 1 - a / b).when(a > b, b / a - 1).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
    return placed.withColumn(output, F.coalesce(alone, score)).drop(x, norm, known)


def nearest_centres(df: DataFrame, vector: str, centres: Sequence[Sequence[float]], output: str = "_cluster") -> DataFrame:
    """The place (from 0) of the nearest of given centres for each row, the first of equally near ones, null for a null vector."""
    held = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(float(v)) for v in c]).alias("c")) for i, c in enumerate(centres)])
    x = F.col(vector).cast("array<double>")
    away = F.transform(held, lambda c: F.struct(F.aggregate(F.zip_with(x, c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d).alias("d"), c["i"].alias("i")))
    return df.withColumn(output, F.when(F.col(vector).isNotNull(), F.array_min(away)["i"]))


def cluster(df: DataFrame, column: str, settings: Mapping[str, str], seed: int = 1) -> tuple[KMeansModel, DataFrame, dict[str, float]]:
    """Model, rows with _vector and _cluster, and their silhouettes."""
    rows = vectorize(df, column, "_vector", cast=True)
    model = train_kmeans(rows, "_vector", settings, seed)
    placed = model.transform(rows)
    return model, placed, silhouettes(placed, "_vector", "_cluster")
