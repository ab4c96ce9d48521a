"""Codes of vectors: each part of a vector becomes the index of its nearest codebook entry, in whole numbers throughout.

The nearest entry is found by lower bounds from coarse to fine. For any cut of a part into segments, the squared distance of two
vectors is at least the sum over segments of n * (difference of their means)^2 + (difference of their residual norms)^2, where
residuals are what is left after the mean (Cauchy-Schwarz). One segment bounds all entries at once; those that the bound leaves are
bounded again with shorter segments; what is left then gets its exact whole-number distance. Bounds are compared with room for
rounding, so no nearest entry is ever ruled out and ties go to the lower index exactly.

Codebooks are refined by Spark jobs: tasks add up the parts of each entry, sums are aggregated by part and entry, and only the
codebooks (entries x dimension numbers) are on the driver and in the tasks, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import materialise

#: Components are whole numbers of at most this size either way; larger ones count as this. So squares of differences fit 64 bits.
LARGEST = 1 << 24
#: Vectors compared at a time, so few that their bounds stay in a processor's cache; it changes no result.
AT_ONCE = 256
#: Segments of a part, coarse to fine, and the share of entries left above which bounds are computed for all of them.
CUTS, DENSE = (1, 4, 8), 0.25
#: Room for the rounding of bounds, as a share of the squared norms.
ROOM = 1e-9


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers."""
    return np.clip(np.floor(values * scale), -LARGEST, LARGEST).astype(np.int64)


class Segments:
    """Means and residual norms of the segments of vectors: sums scaled so that squared differences add up to a bound."""

    def __init__(self, rows: np.ndarray, pieces: int):
        width = rows.shape[1]
        starts = sorted({width * i // pieces for i in range(pieces)})
        lengths = np.diff([*starts, width])
        sums = np.add.reduceat(rows, starts, axis=1)
        left = (rows * np.repeat(lengths, lengths) - np.repeat(sums, lengths, axis=1)).astype(float)  # exact before the cast
        norms = np.sqrt(np.add.reduceat(left * left, starts, axis=1)) / lengths
        self.features = np.concatenate([sums / np.sqrt(lengths), norms], axis=1)


class Codebook:
    """The entries of one part position, with the bounds of each."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.levels = [Segments(entries, n).features for n in CUTS] if entries.size else []
        self.largest = float((entries.astype(float) ** 2).sum(axis=1).max(initial=0))

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry for each row, ties to the lower index."""
        if not rows.size:  # no rows, or a part without components
            return np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        everyone = np.arange(len(rows))
        norms = (rows.astype(float) ** 2).sum(axis=1)
        room = ROOM * (norms + self.largest) + 1e-6
        best, alive = np.full(len(rows), np.inf), np.ones((len(rows), len(self.entries)), bool)
        for pieces, theirs in zip(CUTS, self.levels, strict=True):
            own, bound = Segments(rows, pieces).features, np.full(alive.shape, np.inf)
            if alive.mean() > DENSE:  # one matrix product for all
                squares = (own**2).sum(axis=1)[:, None] + (theirs**2).sum(axis=1)
                np.copyto(bound, squares - 2 * (own @ theirs.T), where=alive)
            else:
                row, entry = np.nonzero(alive)
                bound[row, entry] = ((own[row] - theirs[entry]) ** 2).sum(axis=1)
            best = np.minimum(best, self._distances(rows, everyone, bound.argmin(axis=1)))
            alive = bound <= (best + room)[:, None]
        row, entry = np.nonzero(alive)
        exact = self._distances(rows, row, entry)
        least = np.minimum.reduceat(exact, np.searchsorted(row, everyone))
        hit = np.flatnonzero(exact == least[row])
        return entry[hit[np.unique(row[hit], return_index=True)[1]]], least

    def _distances(self, rows: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((rows[row] - self.entries[entry]) ** 2).sum(axis=1)


def bounds(dimension: int, parts: int) -> list[int]:
    """Where parts begin, and the end: equal parts if the dimension allows it."""
    return [dimension * i // parts for i in range(parts + 1)]


def _matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """Vectors of one length as whole numbers, a row each."""
    return whole(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1), scale)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _usable(vector: Column) -> Column:
    """Neither null nor empty, all components known and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def _least(kept: DataFrame, entries: int) -> list[list[float]]:
    """The vectors of the least ids, ascending; of vectors with one id the least. Each task hands on its own `entries` of them."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            top = max(found) if len(found) >= entries else None
            ids = batch.column(0).to_pylist()
            for i in [i for i, x in enumerate(ids) if x is not None and (top is None or x <= top)]:
                vector = batch.column(1)[i].as_py()
                found[ids[i]] = min(found.get(ids[i], vector), vector)
                if len(found) >= 2 * entries:
                    found = {x: found[x] for x in sorted(found)[:entries]}
        ids = sorted(found)[:entries]
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([found[i] for i in ids], pa.list_(pa.float64()))], ["_id", "_v"])

    from pyspark.sql.pandas.types import to_arrow_type

    rows = kept.select("_id", "_v")
    kind = to_arrow_type(rows.schema["_id"].dataType)
    least = rows.mapInArrow(own, rows.schema).groupBy("_id").agg(F.min("_v").alias("_v"))
    return [r["_v"] for r in least.orderBy("_id").limit(entries).collect()]


def fit_codebooks(kept: DataFrame, dimension: int, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """The codebook of each part position after the rounds. kept: _id, _v with vectors of one dimension."""
    edges = bounds(dimension, parts)
    first = whole(np.array(_least(kept, entries), float).reshape(-1, dimension), scale)
    books = [first[:, a:b] for a, b in zip(edges, edges[1:])]
    widest = max(b - a for a, b in zip(edges, edges[1:]))
    for _ in range(rounds if len(first) else 0):
        held = [Codebook(b) for b in books]

        def added(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((parts, len(first)), np.int64)
            sums = np.zeros((parts, len(first), widest), np.int64)
            for batch in _blocks(batches):
                rows = _matrix(batch.column(0), scale)
                for p, (a, b) in enumerate(zip(edges, edges[1:])):
                    index, _ = held[p].nearest(rows[:, a:b])
                    counts[p] += np.bincount(index, minlength=len(first))
                    order = np.argsort(index, kind="stable")
                    used, starts = np.unique(index[order], return_index=True)
                    sums[p, used, : b - a] += np.add.reduceat(rows[order, a:b], starts, axis=0)
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        partial = kept.select("_v").mapInArrow(added, "part long, entry long, n long, sums array<long>")
        total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(widest)]).alias("sums"))
        books = [b.copy() for b in books]
        for r in total.collect():  # parts x entries rows at most
            books[r["part"]][r["entry"]] = np.array(r["sums"][: books[r["part"]].shape[1]], np.int64) // r["n"]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(map(str, np.concatenate([b.ravel() for b in books]).tolist())).encode()).hexdigest()


def vector_codes(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """id, code (two hex digits for each part), error, label_error (errors summed over equal labels, nulls together) and
    codebooks_sha256, a row for each vector that can be used.

    Not used are null and empty vectors, those with null, NaN or infinite components, and those of another length than most have
    (the shorter one of equally frequent lengths). Where the length can't be divided, parts differ by one component. Rows
    without an id are coded but never begin a codebook; repeated rows are coded each; of different vectors with one id the least
    begins. Fewer than `entries` ids make smaller codebooks; without any id all codes would be undefined, so there are no rows.
    Components beyond LARGEST / scale count as that. An empty table gives no rows. Other columns aren't read.
    """
    if entries > 256:
        raise ValueError("two hex digits tell 256 entries apart")
    names = {"_id": F.col(id), "_v": F.col(vector).cast("array<double>"), "_label": F.col(label)}
    kept = df.select(*[c.alias(n) for n, c in names.items()]).where(_usable(F.col("_v")))
    lengths = kept.select(F.size("_v").alias("_n")).groupBy("_n").agg(F.count("*").alias("_rows"))
    common = lengths.orderBy(F.desc("_rows"), "_n").first()
    dimension = common["_n"] if common else 1
    kept = kept.where(F.size("_v") == dimension)
    books = fit_codebooks(kept, dimension, parts, entries, rounds, scale)
    held, edges = [Codebook(b) for b in books] if len(books[0]) else [], bounds(dimension, parts)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            if held:
                rows = _matrix(batch.column(1), scale)
                found = [book.nearest(rows[:, a:b]) for book, a, b in zip(held, edges, edges[1:])]
                codes = np.stack([x[0] for x in found], axis=1).astype(np.uint8)
                error = sum(x[1] for x in found)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error), batch.column(2)], ["_id", "_code", "_error", "_label"])

    kinds = {f.name: f.dataType for f in kept.schema.fields}
    schema = T.StructType([T.StructField("_id", kinds["_id"]), T.StructField("_code", T.StringType()), T.StructField("_error", T.LongType()), T.StructField("_label", kinds["_label"])])
    rows = materialise(kept.mapInArrow(coded, schema), "codes")
    sums = rows.groupBy(F.col("_label").alias("_group")).agg(F.sum("_error").alias("_sum"))
    out = rows.join(sums, F.col("_label").eqNullSafe(F.col("_group")))  # broadcast by its measured size, else merged
    return out.select(F.col("_id").alias(id), F.col("_code").alias("code"), F.col("_error").alias("error"), F.col("_sum").alias("label_error"), F.lit(books_digest(books)).alias("codebooks_sha256"))
