"""Operator 6, quality rules: an isolation forest on rule statistics.

The rules count words, characters in them, symbols, repeated lines and words in repeated 8-word windows; two of them
reject a document outright. The rest goes to an isolation forest: random axis-parallel splits isolate odd documents after
few steps, and a threshold on the mean path length, calibrated on labelled rows, gives the verdict. All labelled rows outside
the held-out fold count for the forest and the threshold, and every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, hash_words, held_out, materialise, ngrams, texts_of, unload

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The forest's size, and the steps in which scores are counted.
TREES, DEPTH, SCORE_STEPS = 100, 11, 1 << 16
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features that the forest sees.
N_FEATURES = 7
_ROW = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
_DDL = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,base_failed:boolean,kept:boolean>"


def repeated_words(words: np.ndarray, window: int = WINDOW) -> int:
    """How many of a text's words (hashes) stand in a window that occurs twice or more, its first occurrence included."""
    grams = ngrams(words, window)
    if len(grams) < 2:
        return 0
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    starts = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(grams, again))
    np.add.at(starts, at, 1)
    np.add.at(starts, at + window, -1)
    return int((np.cumsum(starts[:-1]) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The base statistics and the features that the forest sees (rates, so that length matters only by itself)."""
    data = text.encode("utf-8", "surrogatepass")
    words = hash_words(data)
    n = len(words)
    without = data.translate(None, SPACES)
    word_chars = len(text) - (len(data) - len(without))
    symbols = len(without) - len(without.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if not x.isspace() and x]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    per_word = 1 / max(n, 1)
    upper = len(without) - len(without.translate(None, UPPER))
    features = [min(symbols * per_word, 1.0), dup_lines / max(len(lines), 1), repeated * per_word, upper / max(len(without), 1), without.count(b"!") * per_word, word_chars * per_word, float(np.log1p(n))]
    return [n, word_chars, symbols, dup_lines, repeated], features


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


def _usual_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n points."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def random_splits(low: np.ndarray, high: np.ndarray, trees: int, depth: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and values of the splits of full trees, [tree, node] with node n's children at 2n + 1 and 2n + 2.

    A split falls anywhere in its node's part of the box from `low` to `high`, along a side that has a length; it depends on no row.
    """
    random, usable = np.random.default_rng(seed), np.flatnonzero(high > low)
    if not len(usable):
        return np.zeros((trees, 2**depth - 1), np.int8), np.full((trees, 2**depth - 1), np.inf)
    features, values = [], []
    low, high = np.broadcast_to(low, (trees, 1, len(low))), np.broadcast_to(high, (trees, 1, len(high)))
    for level in range(depth):
        feature = usable[random.integers(len(usable), size=(trees, 2**level))]
        side = feature[..., None]
        value = random.uniform(np.take_along_axis(low, side, 2), np.take_along_axis(high, side, 2))
        features.append(feature)
        values.append(value[..., 0])
        inner_low, inner_high = low.copy(), high.copy()
        np.put_along_axis(inner_low, side, value, 2)
        np.put_along_axis(inner_high, side, value, 2)
        low, high = (np.stack(x, 2).reshape(trees, 2 ** (level + 1), -1) for x in ((low, inner_low), (inner_high, high)))
    return np.concatenate(features, 1).astype(np.int8), np.concatenate(values, 1)


def leaf_counts(rows: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    """How many rows come to each of a full tree's leaves, from left to right."""
    node, every = np.zeros(len(rows), np.int64), np.arange(len(rows))
    while len(node) and node[0] < len(feature):
        node = 2 * node + 1 + (rows[every, feature[node]] >= split[node])
    return np.bincount(node - len(feature), minlength=len(feature) + 1)


def grown_tree(feature: np.ndarray, split: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """A tree whose paths end where no more than one row is left: features, splits, left children (a leaf leads to itself), paths."""
    depth, held = len(counts).bit_length() - 1, [counts]
    while len(held[0]) > 1:
        held.insert(0, held[0][::2] + held[0][1::2])
    rows = np.concatenate(held)
    level = np.repeat(np.arange(depth + 1), 2 ** np.arange(depth + 1))
    leaf = (rows <= 1) | (level == depth)
    reached = np.ones(len(rows), bool)
    for k in range(1, depth + 1):
        parents = np.arange(2 ** (k - 1) - 1, 2**k - 1)
        reached[2**k - 1 : 2 ** (k + 1) - 1] = np.repeat(reached[parents] & ~leaf[parents], 2)
    place, nodes = np.cumsum(reached) - 1, np.flatnonzero(reached)
    end = leaf[nodes]
    inner = np.where(end, 0, nodes)  # leaves have no split
    path = np.array([k + _usual_path(n) for k, n in zip(level[nodes], rows[nodes], strict=True)])
    return np.where(end, 0, feature[inner]), np.where(end, np.inf, split[inner]), np.where(end, place[nodes], place[2 * inner + 1]), np.where(end, path, 0.0)


class IsolationForest:
    """Trees as arrays; scores in (0, 1), higher for rows that random splits isolate sooner.

    Splits fall anywhere in a node's part of the box from `low` to `high`, which may be larger than what the forest's rows span. So a
    statistic that is the same in all rows can still tell others apart from them: they come to parts without any row,
    whose path ends there. Since splits depend on no row, rows are only counted (leaf_counts), by many tasks if need be (counted).
    """

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 100, sample: int = 256, extra_depth: int = 3, seed: int = 7):
        """A forest of rows in memory, of which each tree takes `sample`."""
        random = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(self.sample, 2))))) + extra_depth
        features, splits = random_splits(low, high, trees, depth, seed)
        counts = [leaf_counts(rows[random.choice(len(rows), self.sample, replace=False)], f, s) for f, s in zip(features, splits, strict=True)]
        self._grow(features, splits, counts)

    @classmethod
    def counted(cls, features: np.ndarray, splits: np.ndarray, counts: np.ndarray) -> IsolationForest:
        """A forest of all the rows that are counted at its leaves, [tree, leaf]."""
        forest = cls.__new__(cls)
        forest.sample = int(counts[0].sum())
        forest._grow(features, splits, counts)
        return forest

    def _grow(self, features: np.ndarray, splits: np.ndarray, counts: Sequence[np.ndarray]) -> None:
        self.depth = counts[0].size.bit_length() - 1
        self.trees = [grown_tree(*x) for x in zip(features, splits, counts, strict=True)]
        self.threshold = np.inf

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, left, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                inner = left[node] != node
                node = np.where(inner, left[node] + (rows[every, feature[node]] >= split[node]), node)
            total += path[node]
        return 2.0 ** (-total / len(self.trees) / max(_usual_path(self.sample), 1e-9))

    def calibrate(self, rows: np.ndarray, good: np.ndarray, keep: float = 0.99) -> None:
        """Sets the threshold between the scores that parts the labels best, among those that keep `keep` of the good rows."""
        values, at = np.unique(self.score(rows), return_inverse=True)
        self.threshold = best_cut(values, values, np.bincount(at, good, len(values)), np.bincount(at, ~good, len(values)), keep)

    def keeps(self, rows: np.ndarray) -> np.ndarray:
        return self.score(rows) < self.threshold


def best_cut(first: np.ndarray, last: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float = 0.99) -> float:
    """The threshold that parts the labels best and keeps `keep` of the good rows, of numbers of rows with scores from `first` to
    `last`, ascending; between two of these, or none."""
    if not good.any() or not bad.any():
        return np.inf
    cuts = np.concatenate([(first[1:] + last[:-1]) / 2, [np.inf]])
    kept, passed = np.cumsum(good) / good.sum(), np.cumsum(bad) / bad.sum()
    return float(cuts[np.argmax(np.where(kept >= keep, kept - passed, -1))])


def _features(text: Column) -> Column:
    """The features of a text; null for one that fails the base rules."""

    @F.arrow_udf("array<double>")
    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        unload()
        for batch in batches:
            found = [statistics(t or "") for t in texts_of(batch)]
            yield pa.array([None if fails_base(s[0], s[4]) else f for s, f in found], pa.list_(pa.float64()))

    return describe(text)


def labelled_features(docs: DataFrame, labels: DataFrame, label: str = "quality", id: str = "doc_id", text: str = "text") -> DataFrame:
    """_features and _good of every labelled document outside the held-out fold that passes the base rules, as a table written
    once. Texts aren't shuffled. Each id counts once; of repeated ones, the least features and the least label do. Rows that fail the
    rules go behind the aggregation: a filter before it would be evaluated by itself, with a second Python worker in each task."""
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    rows = docs.select(F.col(id).alias("_id"), _features(F.col(text)).alias("_features")).where("_id IS NOT NULL")
    rows = rows.groupBy("_id").agg(F.min("_features").alias("_features")).where("_features IS NOT NULL").join(known.groupBy("_id").agg(F.min("_label").alias("_label")), "_id")
    return materialise(rows.select("_features", (F.col("_label") == 1).alias("_good")), "labelled-features")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _counts_at_leaves(rows: DataFrame, features: np.ndarray, splits: np.ndarray) -> np.ndarray:
    """How many rows come to each leaf of each tree, [tree, leaf]. A task hands on one row for each leaf that it has come to."""
    trees, leaves = len(features), features.shape[1] + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, leaves), np.int64)
        for batch in batches:
            if len(batch):
                found = _matrix(batch.column(0))
                total += [leaf_counts(found, f, s) for f, s in zip(features, splits, strict=True)]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["leaf", "n"])

    sums = rows.select("_features").mapInArrow(count, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(trees * leaves, np.int64)
    counts[sums["leaf"].to_numpy()] = sums["n"].to_numpy()
    return counts.reshape(trees, leaves)


def _threshold(rows: DataFrame, forest: IsolationForest) -> float:
    """best_cut() of the scores of all rows, counted in SCORE_STEPS equal steps from 0 to 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SCORE_STEPS), np.int64)
        for batch in batches:
            if len(batch):
                at = np.minimum(forest.score(_matrix(batch.column(0))) * SCORE_STEPS, SCORE_STEPS - 1).astype(np.int64)
                good = batch.column(1).to_numpy(zero_copy_only=False)
                total += [np.bincount(at[good], minlength=SCORE_STEPS), np.bincount(at[~good], minlength=SCORE_STEPS)]
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["step", "good", "bad"])

    sums = rows.mapInArrow(count, "step bigint, good bigint, bad bigint").groupBy("step").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow().sort_by("step")
    step, good, bad = (sums[c].to_numpy() for c in ("step", "good", "bad"))
    return best_cut(step / SCORE_STEPS, (step + 1) / SCORE_STEPS, good, bad)


def fit_forest(docs: DataFrame, labels: DataFrame, *, trees: int = TREES, depth: int = DEPTH, label: str = "quality", id: str = "doc_id", text: str = "text") -> IsolationForest | None:
    """A forest grown and calibrated on all labelled documents that pass the base rules; None for less than two of them.

    The driver gets the box that they span, counts at the leaves (at most trees * 2^depth) and counts of scores (at most SCORE_STEPS).
    """
    rows = labelled_features(docs, labels, label, id, text)
    sides = [f(F.col("_features")[i]).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(N_FEATURES)]
    n, n_good, *box = rows.agg(F.count("*"), F.count_if("_good"), *sides).first()
    forest = None
    if n >= 2:
        splits = random_splits(np.array(box[:N_FEATURES]), np.array(box[N_FEATURES:]), trees, depth)
        forest = IsolationForest.counted(*splits, _counts_at_leaves(rows.where("_good") if n_good else rows, *splits))  # good ones, that others are odd beside
        forest.threshold = _threshold(rows, forest)
    discard(rows)
    return forest


def verdict(text: Column, forest: IsolationForest | None) -> Column:
    """A struct of the base statistics, base_failed and kept; a null text counts as empty, and fails for its few words."""

    @F.arrow_udf(_DDL)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        unload()
        for batch in batches:
            found = [statistics(t or "") for t in texts_of(batch)]
            failed = [fails_base(s[0], s[4]) for s, _ in found]
            kept = forest.keeps(np.array([f for _, f in found])) if forest and found else np.ones(len(found), bool)
            rows = [(*s, bad, bool(k) and not bad) for (s, _), bad, k in zip(found, failed, kept, strict=True)]
            yield pa.array(rows, pa.struct(_ROW))

    return judge(text)


def quality_report(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", **fit) -> DataFrame:
    """id, the five statistics, base_failed and kept of every whole text.

    One row for each row of docs, repeated ones and those with null ids too; empty and null texts fail the base rules.
    Without labelled rows the base rules alone decide. Texts of any length are read whole, an empty table gives an empty one. Only id and
    text of docs are read, so other columns can't clash.
    """
    forest = fit_forest(docs, labels, id=id, text=text, **fit)
    return docs.select(F.col(id), verdict(F.col(text), forest).alias("_verdict")).select(id, "_verdict.*")


def keep_good(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", **fit) -> DataFrame:
    """The rows of docs, all columns unchanged and of whatever names, that the rules keep. Null and empty texts go, for they
    have too few words; repeated rows are judged each, alike; rows with null ids stay if their texts do; an empty table gives an empty one."""
    forest = fit_forest(docs, labels, id=id, text=text, **fit)
    return docs.where(verdict(F.col(text), forest)["kept"])
