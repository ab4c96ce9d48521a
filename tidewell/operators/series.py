"""Series operators: grid, gaps, preparation, splits, differences, lags.

A series is a table with a time and a value column, and `group` tells series apart where it is given. Windows run by group; a single
series without one, and a group of more rows than a block has, is cut into blocks of time (blocks.py), so no task orders a whole
long series. Rows of equal times are ordered by `tiebreak` and then by what they hold, where series are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.timestamps import as_timestamp, normalize_millis, validate_series
from tidewell.operators.blocks import Halo, grid_bounds, placed, time_bounds, unused, with_halo

GRID_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType)


def _by(group: str | Sequence[str] | None) -> list[str]:
    return [group] if isinstance(group, str) else list(group or [])


def _ordered(time: str, group: str | Sequence[str] | None, tiebreak: str | None = None):
    return Window.partitionBy(*_by(group)).orderBy(time, *([tiebreak] if tiebreak else []))


def normalize(df: DataFrame, time: str, interval: str) -> DataFrame:
    """The time column (epoch milliseconds) moved to an interval; it becomes the last column."""
    return df.select(*[c for c in df.columns if c != time], normalize_millis(F.col(time), interval).alias(time))


#: Steps of a grid that one row of the first level stands for; it changes no result.
GRID_BLOCK = 10_000


def time_grid(df: DataFrame, time: str, step: int, group: str | None = None) -> DataFrame:
    """min, min + step, ... up to the maximum, in epoch milliseconds, for each group if there are; empty for an empty table. Blocks of
    the grid are dealt out first, so that no row holds all of it."""
    if step <= 0:
        raise ValueError("the step must be positive")
    by = _by(group)
    first, last, start = (unused(df, x) for x in ("_a", "_b", "_from"))
    ends = df.groupBy(*by).agg(F.min(F.col(time).cast("long")).alias(first), F.max(F.col(time).cast("long")).alias(last)).where(F.col(first).isNotNull())
    width = F.lit(step * GRID_BLOCK).cast("long")
    blocks = ends.select(*by, last, F.explode(F.sequence(first, last, width)).alias(start)).repartition(*by, start)
    upto = F.least(F.col(last), F.col(start) + width - step)
    return blocks.select(*by, F.explode(F.sequence(start, upto, F.lit(step).cast("long"))).alias(time))


def _around(value: str, window: WindowSpec, backwards: WindowSpec, place: Column) -> list[Column]:
    """The nearest known values before (or at) and after a row, each as (place, value). What comes after is the last of a window in
    falling order, which grows by a row at a time as the one before does."""
    v = F.col(value).cast("double")
    known = F.when(v.isNotNull(), F.struct(place.alias("p"), v.alias("v")))
    return [F.last(known, ignorenulls=True).over(x.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for x in (window, backwards)]


def _filled(value: str, before: Column, after: Column, place: Column) -> Column:
    """Linear in row position between the nearest values before and after; gaps at either end stay null."""
    v = F.col(value).cast("double")
    line = before["v"] + (after["v"] - before["v"]) / (after["p"] - before["p"]) * (place - before["p"])
    return F.when(v.isNull(), line).otherwise(v)


def _interpolated(df: DataFrame, time: str, values: list[str], by: list[str], tiebreak: str | None) -> DataFrame:
    """By groups as a whole: two windows, one for each direction. Rows of the same time keep one order in both, by their place in the
    first."""
    place = unused(df, "_row")
    rows = df.withColumn(place, F.row_number().over(_ordered(time, by, tiebreak)))
    ways = [Window.partitionBy(*by).orderBy(x) for x in (F.asc(place), F.desc(place))]
    return rows.withColumns({c: _filled(c, *_around(c, *ways, F.col(place)), F.col(place)) for c in values}).drop(place)


def interpolate(df: DataFrame, time: str, values: str | Sequence[str], group: str | None = None, tiebreak: str | None = None, bounds: Sequence[int] | None = None) -> DataFrame:
    """Fills gaps of value columns. The time column becomes a timestamp, values become doubles.

    A series in blocks is filled within its blocks; a block's first and last known values are summed up to one row, and a scan over
    these rows gives each block the last known value before it and the first one after it, for the gaps at its edges. `bounds`
    (blocks.time_bounds) says where blocks begin; they are looked for without it."""
    values, by = [values] if isinstance(values, str) else list(values), _by(group)
    for value in values:
        validate_series(df, time, value, group)
    found, stamp = placed(df, time, by, tiebreak, bounds), as_timestamp(df, time)
    if found is None:
        return _interpolated(df, time, values, by, tiebreak).withColumn(time, stamp)
    keys, place = [*by, found.block], F.col(found.place)
    ways = [Window.partitionBy(*keys).orderBy(x) for x in (F.asc(found.place), F.desc(found.place))]
    knowns = {c: F.when(F.col(c).isNotNull(), F.struct(place.alias("p"), F.col(c).cast("double").alias("v"))) for c in values}
    names = {(c, way): unused(found.rows, f"_{way}{i}") for i, c in enumerate(values) for way in ("first", "last")}
    edges = found.rows.groupBy(*keys).agg(*[f(knowns[c]).alias(names[c, way]) for c in values for way, f in (("first", F.min), ("last", F.max))])
    series = Window.partitionBy(*by).orderBy(found.block)  # a row for each block
    before, after = series.rowsBetween(Window.unboundedPreceding, -1), series.rowsBetween(1, Window.unboundedFollowing)
    own = {k: unused(found.rows, f"_key{i}") for i, k in enumerate(keys)}
    carried = edges.select(
        *[F.col(k).alias(x) for k, x in own.items()],
        *[F.last(names[c, "last"], ignorenulls=True).over(before).alias(names[c, "last"]) for c in values],
        *[F.first(names[c, "first"], ignorenulls=True).over(after).alias(names[c, "first"]) for c in values],
    )
    inside = {c: [unused(found.rows, f"_{way}{i}") for way in ("before", "after")] for i, c in enumerate(values)}
    rows = found.rows.withColumns({n: x for c in values for n, x in zip(inside[c], _around(c, *ways, place), strict=True)})
    rows = rows.join(carried, [F.col(k).eqNullSafe(F.col(x)) for k, x in own.items()])
    filled = {c: _filled(c, F.coalesce(F.col(inside[c][0]), F.col(names[c, "last"])), F.coalesce(F.col(inside[c][1]), F.col(names[c, "first"])), place) for c in values}
    return rows.withColumns(filled).withColumn(time, stamp).select(*df.columns)


def prepare(df: DataFrame, time: str, interval: str, step: int, value: str | None = None, group: str | None = None, bounds: Sequence[int] | None = None) -> DataFrame:
    """Numeric columns (or one value column) on an equidistant grid with gaps filled, for each group if there are: prune, normalize,
    grid, left join, interpolate. Rows that fall on one grid point stay several rows. The table is read twice, pruned either time,
    and once more for the bounds of blocks if these aren't given (blocks.grid_bounds of the normalized rows)."""
    by = _by(group)
    kept = [value] if value else [f.name for f in df.schema.fields if f.name not in (time, group) and isinstance(f.dataType, GRID_TYPES)]
    rows = normalize(df.select(*by, *kept, F.col(time).cast("long").alias(time)), time, interval)
    grid = normalize(time_grid(rows, time, step, group), time, interval)
    if not by:
        joined = grid.join(rows, time, "left").select(time, *kept)
        return interpolate(joined, time, kept, bounds=grid_bounds(rows, time, step) if bounds is None else bounds)
    names = {c: unused(rows, f"_{c}") for c in (*by, time)}
    other = rows.select(*[F.col(c).alias(x) for c, x in names.items()], *kept)
    joined = grid.join(other, [F.col(c).eqNullSafe(F.col(x)) for c, x in names.items()], "left").select(*by, time, *kept)
    return interpolate(joined, time, kept, group)


def time_split(df: DataFrame, time: str, ratio: str = "80:20") -> tuple[DataFrame, DataFrame]:
    """(lower, upper) by share of the time span: lower reaches to min + ceil(share * (max - min)), included."""
    parts = [float(x.strip()) / 100 for x in ratio.split(":")]
    if len(parts) != 2 or sum(parts) != 1.0:
        raise ValueError("a ratio is two percentages that sum to 100")
    ends = df.agg(F.min(F.col(time).cast("long")).alias("_a"), F.max(F.col(time).cast("long")).alias("_b"))
    name = unused(df, "_edge")
    edge = ends.select((F.col("_a") + F.ceil(F.lit(parts[0]) * (F.col("_b") - F.col("_a")))).alias(name))
    joined = df.crossJoin(F.broadcast(edge))  # one row
    return joined.where(F.col(time) <= F.col(name)).drop(name), joined.where(F.col(time) > F.col(name)).drop(name)


@dataclass(frozen=True)
class DiffModel:
    """What undoing differences needs: the value column, order and offset, and so the names of the kept lag columns."""

    value: str
    order: int
    offset: int

    @property
    def lag1(self) -> str:
        return f"{self.value}_lag_{self.offset}"

    @property
    def lag2(self) -> str:
        return f"{self.value}_diff_1_lag_{self.offset}"

    @property
    def output(self) -> str:
        return f"{self.value}_diff_{self.order}"


def _paired(df: DataFrame, a: str, b: str, f: Callable[[Column, Column], Column]) -> Column:
    """f of two columns, element by element where they are arrays; arrays of different sizes are an error."""
    kind = df.schema[a].dataType
    if not isinstance(kind, T.ArrayType):
        return f(F.col(a), F.col(b))
    unequal = F.raise_error(F.lit(f"arrays of different sizes in {a} and {b}")).cast(kind)
    return F.when(F.size(a) != F.size(b), unequal).otherwise(F.zip_with(a, b, f))


def _minus(df: DataFrame, a: str, b: str) -> Column:
    return _paired(df, a, b, lambda x, y: x - y)


def _plus(df: DataFrame, a: str, b: str) -> Column:
    return _paired(df, a, b, lambda x, y: x + y)


def _lagged(df: DataFrame, name: str, column: str, offset: int, time: str, by: list[str], tiebreak: str | None, bounds: Sequence[int] | None) -> DataFrame:
    """Rows with the value `offset` rows before them, those without one gone."""
    halo = with_halo(df, time, offset, 0, by, tiebreak, bounds)
    if halo is None:
        return df.withColumn(name, F.lag(column, offset).over(_ordered(time, by, tiebreak))).where(F.col(name).isNotNull())
    return halo.kept(halo.rows.withColumn(name, F.lag(column, offset).over(halo.window)).where(F.col(name).isNotNull()))


def difference(df: DataFrame, time: str, value: str, order: int = 1, offset: int = 1, group: str | None = None, tiebreak: str | None = None, bounds: Sequence[int] | None = None) -> tuple[DataFrame, DiffModel]:
    """First or second differences of numbers or arrays; rows without a lag go, lag columns stay for the inverse."""
    if order not in (1, 2):
        raise ValueError("order is 1 or 2")
    if offset < 1:
        raise ValueError("offset is 1 or more")
    validate_series(df, time, value, group)
    model, by = DiffModel(value, order, offset), _by(group)
    bounds = time_bounds(df, time) if not by and bounds is None else bounds
    out = _lagged(df, model.lag1, value, offset, time, by, tiebreak, bounds)
    out = out.withColumn(f"{value}_diff_1", _minus(out, value, model.lag1))
    if order == 2:
        out = _lagged(out, model.lag2, f"{value}_diff_1", offset, time, by, tiebreak, bounds)
        out = out.withColumn(model.output, _minus(out, f"{value}_diff_1", model.lag2))
    return out, model


def undo_difference(df: DataFrame, model: DiffModel, column: str, output: str) -> DataFrame:
    """Adds the kept lags to a column of differences again."""
    if model.order == 1:
        return df.withColumn(output, _plus(df, column, model.lag1))
    first = df.withColumn(output, _plus(df, column, model.lag2))
    return first.withColumn(output, _plus(first, output, model.lag1))


LAGGING = ("featuresAndLabels", "pastFeatures", "features")


def windowed_list(df: DataFrame, name: str, value: str, start: int, end: int, time: str, by: list[str], tiebreak: str | None, bounds: Sequence[int] | None) -> tuple[DataFrame, Halo | None]:
    """Rows with the known values from row start to row end around them as an array, and how to keep each row once."""
    halo = with_halo(df, time, max(0, -start), max(0, end), by, tiebreak, bounds)
    rows, window = (df, _ordered(time, by, tiebreak)) if halo is None else (halo.rows, halo.window)
    return rows.withColumn(name, F.collect_list(value).over(window.rowsBetween(start, end))), halo


def lagging(df: DataFrame, time: str, value: str, kind: str = "featuresAndLabels", lag: int = 10, frame: int = 1, group: str | None = None, tiebreak: str | None = None, features: str = "features", label: str = "label", bounds: Sequence[int] | None = None) -> DataFrame:
    """Lag vectors: the last `lag` values before a row ("pastFeatures"), with it ("features"), or before it with the next
    `frame` ones as label ("featuresAndLabels"; a single label is unwrapped). Windows with a gap or of less length go."""
    if kind not in LAGGING:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(LAGGING)}")
    validate_series(df, time, value, group)
    start, end = {"featuresAndLabels": (-lag, frame - 1), "pastFeatures": (-lag, -1), "features": (1 - lag, 0)}[kind]
    name = unused(df, "_list")
    rows, halo = windowed_list(df, name, value, start, end, time, _by(group), tiebreak, bounds)
    rows = rows.where(F.size(name) == end - start + 1)
    rows = halo.kept(rows) if halo else rows
    if kind != "featuresAndLabels":
        return rows.withColumn(features, F.col(name)).drop(name)
    labels = F.element_at(name, -1) if frame == 1 else F.slice(name, lag + 1, frame)
    return rows.withColumns({features: F.slice(name, 1, lag), label: labels}).drop(name)
