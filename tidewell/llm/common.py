"""Helpers that the operators of this package share: scratch tables, hold-out folds and word hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Text documents of the test data, in the order in which pipeline stages must return them.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Spark's setting: delete the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares, which the session names as spark.checkpoint.dir. Where that is unset, a
    session on this machine alone gets a temporary one, as in tests; on a cluster it is an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("the session needs spark.checkpoint.dir, a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidewell-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidewell-{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Within, what a query has shuffled is deleted when it is done; for writes, whose results are read back from files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    with shuffles_deleted(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_buckets(df: DataFrame, key: str, label: str) -> DataFrame:
    """As materialise(), for a table that is joined by `key` several times: it is written in buckets of it, so joins shuffle only what
    they join it with. It has a name in the session's catalog until discard()."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    name, buckets = _table_name(path), int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_deleted(spark):
        df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def _table_name(path: str) -> str:
    return path.rpartition("/")[2].replace("-", "_")


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialise() and materialise_buckets(), once nothing reads them any more."""
    for df in tables:
        spark, context = df.sparkSession, df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(folder)}")


def held_out(doc_id: Column) -> Column:
    """True for the fold that label-fitted operators never learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


_loaded: dict[tuple[str, str], object] = {}


def loaded(kind: Callable[[str], T], file: str) -> T:
    """What `kind` makes of a file, once in a Python worker, shared by its tasks. Workers are used for all that a session runs and keep
    what they have loaded, with all the words that it remembers, until another one is loaded or unload() is called."""
    key = (f"{kind.__module__}.{kind.__qualname__}", file)
    if key not in _loaded:
        unload()
        _loaded[key] = kind(file)
    return _loaded[key]


def unload() -> None:
    """Frees what earlier operators have loaded in this worker, and hands free memory back to the system; for tasks of operators that
    need the memory."""
    _loaded.clear()
    gc.collect()  # tables of remembered values refer to their owners
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.pythonapi, "malloc_trim", None):  # the GNU C library has it
        trim(0)


def texts_of(batch: pa.Array, rows: int = 250) -> Iterator[str | None]:
    """The texts of a batch, of which few are Python strings at a time."""
    for at in range(0, len(batch), rows):
        yield from batch.slice(at, rows).to_pylist()


class Remembered(dict):
    """A table of computed values of at most twice `limit` entries: when full it becomes the old one, which is asked
    before a value is computed anew, so frequent keys stay. Which values are kept changes no result."""

    def __init__(self, compute, limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(key) <= self.longest:
            self[key] = value
        return value


#: Odd multipliers of the rolling combination below; any odd 64-bit numbers would do.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shift, multiply)."""
    h = h ^ (h >> np.uint64(32))
    h *= _ODD[0]
    h ^= h >> np.uint64(29)
    h *= _ODD[1]
    h ^= h >> np.uint64(32)
    return h


_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: What to keep of 8 bytes of which a word has the first 0 to 8.
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def hash_words(data: bytes) -> np.ndarray:
    """64-bit hashes of the words (maximal runs of bytes other than ASCII white space) of a text, in order.

    A word's hash is the sum of its scrambled 8-byte pieces, each with its place, scrambled with its length.
    """
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _IS_SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    eights = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))  # the 8 bytes from each place on
    pieces = (lengths + 7) >> 3
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    values = eights[np.repeat(starts, pieces) + 8 * place] & _KEEP[np.minimum(np.repeat(lengths, pieces) - 8 * place, 8)]
    values = mix(values + place.astype(np.uint64) * _ODD[2])
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _ODD[3])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-word windows of a sequence of word hashes, in order; empty if it is shorter than n."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    if n == 1:
        return mix(words)
    k = n // 2
    left = ngrams(words, k)  # halves are hashed once; an odd window ends with a single word
    pairs = mix(left[:-k] * _ODD[2] + left[k:])
    return pairs if n % 2 == 0 else mix(pairs[:-1] * _ODD[3] + words[n - 1 :])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, max_bytes: int = 1 << 16, balance: bool = False, id: str = "doc_id", text: str = "text") -> list[tuple[str, int]]:
    """At most `limit` labelled texts (text, 0 or 1) outside the held-out fold, for fitting a model on the driver.

    The rows are those with the smallest hash of their id, so the choice is the same in each run and on each cluster;
    with `balance`, half of the limit goes to either label. Texts of over `max_bytes` bytes are passed over here, so that
    the sample takes at most limit * max_bytes bytes (half a GB for 8,000 rows); null ids, labels and texts too. Each id
    counts once.
    """
    known = labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("_label"), F.xxhash64(F.col(id)).alias("_order"))
    known = known.where(F.col("_label").isin(0, 1) & ~held_out(F.col("_id"))).dropDuplicates(["_id"])
    halves = [known.where(F.col("_label") == x) for x in (0, 1)] if balance else [known]
    chosen = None
    for half in halves:
        part = half.orderBy("_order", "_id").limit(limit // len(halves))
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where(F.octet_length("_text") <= max_bytes)
    found = rows.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]).orderBy("_order", "_id")  # bounded by limit
    return [(r["_text"], r["_label"]) for r in found.select("_text", "_label").collect()]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(features: np.ndarray, labels: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method on standardised features; weights (the last is the bias), means and deviations."""
    mean, deviation = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([(features - mean) / deviation, np.ones(len(features))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - labels) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, deviation
