"""Long series in blocks: what windows without a group, or with a very large one, need so that no task orders a whole series.

Rows are cut into blocks by time at approximate quantiles, so a block is a range of times with about BLOCK_ROWS rows. Bounds only decide
who works on what: any bounds give the same result. Two things are built on blocks:

- `placed`: every row's place in its series, by its place in its block plus the rows of the blocks before. Only one number for
  each block meets in one task.
- `with_halo`: rows dealt out anew by their places, each block with copies of the rows next to it that windows of a bounded number of
  rows reach into. A block has the same number of rows whatever the times, so halos never end in a block that is too short.

Rows of one time are in one block when they are placed; no more than one block of them is in one task after that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, about, and the most blocks of a series (more rows than that make longer blocks, which are sorted with spilling).
BLOCK_ROWS, MOST_BLOCKS = 1 << 18, 8192
#: A shorter series is cut, too, so that all cores have some of it, if blocks of so many rows are left.
LEAST_ROWS = 100
UNHASHABLE = (T.MapType, T.VariantType)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def time_number(df: DataFrame, time: str) -> Column:
    """A time column as a number in the same order."""
    kind = df.schema[time].dataType
    return F.col(time) if isinstance(kind, T.LongType) else F.unix_micros(F.col(time).cast("timestamp"))


def _blocks_of(rows: int, cores: int = 1) -> int:
    return min(MOST_BLOCKS, max(-(-rows // BLOCK_ROWS), min(cores, rows // LEAST_ROWS)))


def _cuts(number: Column, blocks: int) -> Column:
    """Array of the times where blocks begin, but for the first."""
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    return F.array_sort(F.array_distinct(F.percentile_approx(number, shares, max(10_000, 20 * blocks))))


def time_bounds(df: DataFrame, time: str) -> list[int]:
    """Where the blocks of a table that is one series begin, but for the first: a count, and quantiles if there are several blocks.
    They can be used for tables made from this one, too."""
    blocks = _blocks_of(df.count(), df.sparkSession.sparkContext.defaultParallelism)
    return (df.agg(_cuts(time_number(df, time), blocks)).first()[0] or []) if blocks > 1 else []


def grid_bounds(df: DataFrame, time: str, step: int) -> list[int]:
    """Bounds for the rows of df (times are longs) together with a grid of this step over them, so that a block has neither too many
    rows nor too many places of the grid."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None:
        return []
    places = (high - low) // step + 1
    blocks = _blocks_of(places, df.sparkSession.sparkContext.defaultParallelism)
    return sorted({*time_bounds(df, time), *[low + places * i // blocks * step for i in range(1, blocks)]})


def _block(number: Column, bounds: Column, most: int) -> Column:
    """How many of the ascending bounds (`most` at most) are not beyond a number: a binary search. 0 for an unknown number."""
    steps = [1 << i for i in range(most.bit_length() - 1, -1, -1)] if most else []

    def step(at: Column, width: Column) -> Column:
        upto = at + width
        return F.when((upto <= F.size(bounds)) & (F.get(bounds, upto - 1) <= number), upto).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step) if steps else F.lit(0)


def with_blocks(df: DataFrame, time: str, group: Sequence[str], name: str, bounds: Sequence[int] | None = None) -> DataFrame | None:
    """df with its rows' blocks as column `name`; None if there is a group column and no group is longer than a block. Where groups are,
    only those longer than a block are cut, at their own quantiles."""
    number = time_number(df, time)
    if not group:
        bounds = time_bounds(df, time) if bounds is None else sorted(bounds)
        array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
        return df.withColumn(name, _block(number, array, len(bounds)))
    sizes = df.groupBy(*group).agg(F.count("*").alias(name)).where(F.col(name) > BLOCK_ROWS)
    largest = sizes.agg(F.max(name)).first()[0]
    if largest is None:
        return None
    keys = [unused(df, f"_g{i}") for i in range(len(group))]
    own = sizes.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)])
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys, strict=True)]
    cuts = df.select(*group, number.alias(name)).join(own, same, "left_semi").groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)])
    cuts = cuts.agg(_cuts(F.col(name), _blocks_of(largest)).alias(name))
    joined = df.join(cuts, same, "left").drop(*keys)
    return joined.withColumn(name, _block(number, F.coalesce(F.col(name), F.array().cast("array<bigint>")), _blocks_of(largest)))


def _order(df: DataFrame, time: str, tiebreak: str | None) -> list[Column]:
    """Time, then the tiebreak, then all that tells rows apart: so rows have the same order whenever they are read."""
    content = F.xxhash64(*[F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, UNHASHABLE)])
    return [F.col(time), *([F.col(tiebreak)] if tiebreak else []), content]


@dataclass(frozen=True)
class Placed:
    """Rows with their block and their place in the series (from 1), and the names of these columns."""

    rows: DataFrame
    group: tuple[str, ...]
    block: str
    place: str


def placed(df: DataFrame, time: str, group: Sequence[str] = (), tiebreak: str | None = None, bounds: Sequence[int] | None = None) -> Placed | None:
    """Every row's place in its series, without a task for a whole series; None if groups are and none is longer than a block."""
    block, place, before = unused(df, "_block"), unused(df, "_place"), unused(df, "_before")
    blocks = with_blocks(df, time, group, block, bounds)
    if blocks is None:
        return None
    numbered = blocks.withColumn(place, F.row_number().over(Window.partitionBy(*group, block).orderBy(*_order(df, time, tiebreak))).cast("long"))
    sizes = blocks.groupBy(*group, block).agg(F.count("*").alias(before))
    running = F.sum(before).over(Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1))  # of numbers of blocks
    offsets = sizes.select(*[F.col(c).alias(f"{before}{i}") for i, c in enumerate([*group, block])], F.coalesce(running, F.lit(0)).alias(before))
    same = [F.col(c).eqNullSafe(F.col(f"{before}{i}")) for i, c in enumerate([*group, block])]
    rows = numbered.join(offsets, same).withColumn(place, F.col(place) + F.col(before))
    return Placed(rows.select(*df.columns, block, place), tuple(group), block, place)


@dataclass(frozen=True)
class Halo:
    """Rows dealt out in blocks with copies of their neighbours: `window` is what windows go by, and of what they give `kept`
    keeps each row once, in its own block."""

    rows: DataFrame
    by: list[str]
    place: str
    own: str

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.place)

    def kept(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.own)).drop(self.by[-1], self.place, self.own)


def with_halo(df: DataFrame, time: str, before: int, after: int, group: Sequence[str] = (), tiebreak: str | None = None, bounds: Sequence[int] | None = None) -> Halo | None:
    """df in blocks for windows that reach `before` rows back and `after` rows on; None as in `placed`."""
    found = placed(df, time, group, tiebreak, bounds)
    if found is None:
        return None
    home, own, block, place = unused(df, "_home"), unused(df, "_own"), found.block, F.col(found.place) - 1
    width = F.lit(max(BLOCK_ROWS, before, after)).cast("long")
    rows = found.rows.drop(block).withColumn(home, F.floor(place / width))
    reached = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((place - after) / width)), F.floor((place + before) / width))
    rows = rows.withColumn(block, F.explode(reached)).withColumn(own, F.col(block) == F.col(home)).drop(home)
    return Halo(rows, [*group, block], found.place, own)
