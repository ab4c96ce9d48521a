"""Exact elements at ranks of a column, without a global sort: intervals around them are narrowed by counts, all ranks at once.

A round is one aggregation. It counts the rows below and at the ends of each rank's interval, so it knows exactly in which part the rank
is, and takes approximate quantiles inside as the next ends. Ends are excluded from the interval between them, so a value that many
rows share is met as an end and is the answer, however many rows it has. When at most FETCHED rows are left, these are ordered.
The error of the quantiles decides how many rounds there are (each leaves about a fiftieth of the rows), not what is found.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Rows of an interval that are ordered at last, at most; quantiles of an interval in a round, and their accuracy.
FETCHED, PIVOTS, ACCURACY = 10_000, 200, 10_000


@dataclass
class Search:
    """A rank (from 1), the open interval that its element is looked for in (None: no end), the rows up to its lower end and in it, and
    the element once it is known."""

    rank: int
    low: float | None = None
    high: float | None = None
    outer: tuple[float | None, float | None] = (None, None)
    below: int = 0
    inside: int = 0
    found: float | None = None

    def within(self, v: Column) -> Column:
        above = F.lit(True) if self.low is None else v > F.lit(self.low)
        return above if self.high is None else above & (v < F.lit(self.high))

    def measures(self, v: Column, name: str) -> list[Column]:
        ends = [(F.lit(0), F.lit(0)) if self.low is None else (F.count_if(v < self.low), F.count_if(v <= self.low))]
        ends.append((F.count("*"), F.count("*")) if self.high is None else (F.count_if(v < self.high), F.count_if(v <= self.high)))
        shares = F.array(*[F.lit(i / PIVOTS) for i in range(1, PIVOTS)])
        pivots = F.percentile_approx(F.when(self.within(v), v), shares, ACCURACY)
        return [F.struct(*[x.cast("long").alias(f"c{i}") for i, x in enumerate((*ends[0], *ends[1]))], pivots.alias("pivots")).alias(name)]

    def narrow(self, seen: Row) -> None:
        """What a round's counts say: the element, or a smaller interval."""
        if self.low is not None and self.rank <= seen["c0"]:
            self.low, self.high, self.inside = self.outer[0], self.low, -1  # the quantile was too high: look again
        elif self.low is not None and self.rank <= seen["c1"]:
            self.found = self.low
        elif self.rank <= seen["c2"]:
            self.below, self.inside = seen["c1"], seen["c2"] - seen["c1"]
            if self.inside > FETCHED:
                at = int((self.rank - self.below) / self.inside * PIVOTS)
                self.outer, pivots = (self.low, self.high), seen["pivots"]
                self.low = pivots[at - 2] if at >= 2 else self.low
                self.high = pivots[at + 1] if at + 1 < len(pivots) else self.high
        elif self.rank <= seen["c3"]:
            self.found = self.high
        else:
            self.low, self.high, self.inside = self.high, self.outer[1], -1


def search(values: DataFrame, ranks: Sequence[int]) -> list[Search]:
    """Each rank's element, or an interval with it of at most FETCHED rows. values has the one column _v, known numbers without NaN."""
    found, v = [Search(k) for k in ranks], F.col("_v")
    while waiting := [x for x in found if x.found is None and not 0 < x.inside <= FETCHED]:
        seen = values.agg(*[m for i, x in enumerate(waiting) for m in x.measures(v, f"m{i}")]).first()
        for i, x in enumerate(waiting):
            x.narrow(seen[i])
    return found


def rank_values(df: DataFrame, column: str, percents: Sequence[float]) -> list[float]:
    """For each percentage the element at rank round(share * n), halves up, within 1..n; nulls count as 0, NaN as more than any number; 0
    for an empty table."""
    values = df.select(F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("_v"))
    rows, odd = values.agg(F.count("*"), F.count_if(F.isnan("_v"))).first()
    ranks = [max(1, min(rows, int(p / 100 * rows + 0.5))) for p in percents]
    if not rows:
        return [0.0] * len(ranks)
    values, known = values.where(~F.isnan("_v")), sorted({k for k in ranks if k <= rows - odd})
    found = {x.rank: x for x in search(values, known)}
    return [float("nan") if k > rows - odd else x for k, x in zip(ranks, map(_ordered(values, found).get, ranks), strict=True)]


def _ordered(values: DataFrame, found: dict[int, Search]) -> dict[int, float]:
    """The elements, after the intervals that are left have been fetched: at most FETCHED rows for each rank."""
    left = [x for x in found.values() if x.found is None]
    if left:
        hits = F.array_compact(F.array(*[F.when(x.within(F.col("_v")), F.lit(x.rank).cast("long")) for x in left]))
        counts = values.select("_v", F.explode(hits).alias("_rank")).groupBy("_rank", "_v").agg(F.count("*").alias("_rows")).collect()
        for x in left:
            upto = x.below
            for value, rows in sorted((r["_v"], r["_rows"]) for r in counts if r["_rank"] == x.rank):
                upto += rows
                if upto >= x.rank:
                    x.found = value
                    break
    return {k: x.found for k, x in found.items()}
