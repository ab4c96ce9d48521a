"""Operator 4, n-gram Jaccard join by PartEnum signatures.

Two documents link when the Jaccard similarity of their sets of word shingles is at least 4/5; the result is the connected
components of the links. Documents with equal sets are one node from the start, so copies are never compared.

Signatures. Sizes fall into bands, each a quarter wider than its least size, so linked sets lie in the same band or in
neighbouring ones; a set makes signatures for its own band and the next. In a band, linked sets differ in at most k
elements (k: two ninths of the band's greatest size). The domain of shingles is split into partitions, and subsets that
differences must leave alone are enumerated, whose elements' hash is a signature: for k up to 3 all (n - k)-subsets of n
partitions; for k up to `TWO_LEVELS` each partition, of which one has at most one difference, is split in three again,
and every two of the three are a subset; beyond, single partitions, of which one has no difference. Subsets without
elements tell nothing and make none; a set in which so many of them are empty that a link could rest on such subsets
alone therefore adds the elements of its prefix (the least 1 + size/5 hashes), of which two such linked sets share one. So every
link has a signature in common, whatever the sets.

Candidates. Sets with a common signature form a bucket. All pairs of a bucket would be too many where copies abound, and
components need no more than some links. First each set is compared with a centre, the bucket's least key, which near
copies have in common in most of their buckets, and components are formed. Where one task alone sees a signature `HOT`
times, the least of these keys is their centre and stands for them in the bucket. So a bucket brings fewer than `HOT` of each
`AT_ONCE` signature rows to the one task that finds its least key (24 bytes a row, which can spill), whatever its share of the sets.
Buckets that still hold several components are then searched block by block (`BLOCK` sets against as many, in numpy): a set's
sketch is the parity of its elements' hashes by bucket of a bitmap, and the bits in which two sketches differ are a lower
bound of the sets' difference, close enough to rule out nearly all pairs that don't link, and none that do. Of the pairs
that pass, a spanning forest by distance is compared and components are formed again; at last, all pairs that pass between
different components are compared, each. What is left unlinked was ruled out, compared, or shares no signature.
The comparison is exact, on texts. Nothing is dropped, capped or sampled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import discard, hash_words, materialise, materialise_buckets, mix, ngrams
from tidewell.llm.components import connected_components

SHINGLE = 5
#: Links: 100 * intersection >= 80 * union.
PERCENT = 80
#: Sets in a block, partners of a centre in one group, and how often a signature is hot in a task; they change no result.
BLOCK, PARTNERS, HOT = 1024, 256, 32
#: Least and most bits of a sketch, which has 4 for each element; signature rows that a task holds at once.
LEAST_BITS, MOST_BITS, AT_ONCE = 512, 1 << 17, 1 << 18
#: Up to so many differences partitions are split in three again.
TWO_LEVELS = 16
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; of all words as one where there are fewer than SHINGLE."""
    words = hash_words((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(words):
        return words
    ordered = np.sort(ngrams(words, min(SHINGLE, len(words))))  # faster than np.unique
    return ordered[np.append(True, ordered[1:] != ordered[:-1])]


def set_key(elements: np.ndarray) -> int:
    """A signed 64-bit hash of a set: documents with the same one are taken to have equal sets."""
    return int(mix(mix(elements ^ _B).sum(keepdims=True) + np.uint64(len(elements)))[0].view(np.int64)) if len(elements) else 0


@lru_cache(maxsize=None)
def bands(size: int) -> tuple[tuple[int, int, int], ...]:
    """(number, k, partitions) of a set's own band and of the next, if a partner can be there."""
    least, number = 1, 0
    while least * 100 // PERCENT < size:
        least, number = least * 100 // PERCENT + 1, number + 1
    out = []
    for _ in range(2):
        greatest = least * 100 // PERCENT
        if size * 100 // PERCENT >= least:
            k = 2 * greatest * (100 - PERCENT) // (100 + PERCENT)
            out.append((number, k, k + 3 if k <= 3 else k // 2 + 2 if k <= TWO_LEVELS else k + 2 + k // 16))
        least, number = greatest + 1, number + 1
    return tuple(out)


@lru_cache(maxsize=None)
def _subsets(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), n - k)))


def signatures(elements: np.ndarray) -> np.ndarray:
    """The signatures of a sorted set of hashes, as signed 64-bit numbers."""
    size, high, scrambled, out = len(elements), elements >> np.uint64(32), mix(elements ^ _A), []
    for band, k, n in bands(size) if size else ():
        if k == 0:
            continue  # linked sets of this band are equal, and equal sets are one node
        cells = 3 * n if 3 < k <= TWO_LEVELS else n
        part = (high * np.uint64(cells)) >> np.uint64(32)  # ascends with the hashes
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        filled = part[first]
        sums = mix(np.add.reduceat(scrambled, first) + filled * _B)
        label = mix(np.array([band], np.uint64))[0]
        if k > TWO_LEVELS:
            out.append(mix(sums + label))
            idle, spare = n - len(first), n - k
        else:
            by_part = np.zeros(cells, np.uint64)
            by_part[filled.astype(np.int64)] = sums
            if k <= 3:
                value = by_part[_subsets(n, k)].sum(axis=1)
                idle, spare = n - len(first), n - k
            else:
                thirds = by_part.reshape(n, 3)
                value = thirds.sum(axis=1, keepdims=True) - thirds  # all but one third
                idle, spare = int((value == 0).any(axis=1).sum()), n - k // 2
                value = value.ravel()
            numbers = label + np.arange(len(value), dtype=np.uint64)
            out.append(mix(value[value != 0] + numbers[value != 0]))
        if idle >= spare:
            prefix = size - -(-size * PERCENT // 100) + 1
            out.append(mix(mix(elements[:prefix]) + label))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * PERCENT:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def set_sizes(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, key) for each row."""

    @F.arrow_udf("struct<n_shingles:bigint,key:bigint>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64())], ["n_shingles", "key"])

    return docs.select(F.col(id).alias("id"), measure(F.col(text)).alias("_s")).select("id", "_s.n_shingles", "_s.key")


def signature_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """(sig, key, hub): the signatures of each set; of a set's copies in one task only the first makes them. Of the keys that
    a task sees with a hot signature at once, the least is the hub of all, its own too; other rows have none."""

    def packed(keys: list[np.ndarray], lists: list[np.ndarray]) -> pa.RecordBatch:
        key, sig = np.concatenate(keys), np.concatenate(lists)
        hub, none = np.zeros(len(key), np.int64), np.ones(len(key), bool)
        ordered = np.sort(sig)
        if len(ordered) >= HOT and (ordered[HOT - 1 :] == ordered[: len(ordered) - HOT + 1]).any():
            order = np.lexsort((key, sig))
            first = np.flatnonzero(np.append(True, sig[order][1:] != sig[order][:-1]))
            many = np.diff(np.append(first, len(order)))
            hub[order], none[order] = np.repeat(key[order][first], many), np.repeat(many < HOT, many)
        return pa.record_batch([pa.array(sig), pa.array(key), pa.array(hub, mask=none)], ["sig", "key", "hub"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, lists, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for t in batch.column(0).slice(at, 500).to_pylist():
                    elements = shingle_set(t)
                    key = set_key(elements)
                    if len(elements) and key not in seen:
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(key)
                        found = signatures(elements)
                        keys.append(np.full(len(found), key, np.int64))
                        lists.append(found)
                        held += len(found)
                        if held >= AT_ONCE:
                            yield packed(keys, lists)
                            keys, lists, held = [], [], 0
        if keys:
            yield packed(keys, lists)

    return docs.select(text).mapInArrow(emit, "sig bigint, key bigint, hub bigint")


def starred(rows: DataFrame) -> DataFrame:
    """(sig, key, centre), some twice: signature rows of buckets with several sets. The centre of a hub's rows is the hub; hubs
    and rows without one have the least key of all such rows. A centre that all others of its bucket have is left out."""
    apart = F.when(F.col("hub") != F.col("key"), F.col("hub"))
    bucket = Window.partitionBy("sig", "apart")
    rows = rows.withColumn("apart", apart).withColumns({"least": F.min("key").over(bucket), "hubs": F.max("hub").over(bucket)})
    return rows.withColumn("centre", F.coalesce("apart", "least")).where("key > centre OR hubs IS NOT NULL").select("sig", "apart", "key", "centre").distinct().drop("apart")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link; texts: (key, text). A centre's partners come in groups of about PARTNERS, to each of
    which its text is sent once, before theirs."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, elements = None, None
        for batch in batches:
            a, b, good = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for i, (p, q, t) in enumerate(zip(a, b, batch.column(3).to_pylist(), strict=True)):
                if q is None:
                    centre, elements = p, shingle_set(t)
                elif p == centre and similar(elements, shingle_set(t)):
                    good.append(i)
            if good:
                yield batch.select([0, 2]).take(pa.array(good))

    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("_n"))
    dealt = pairs.select("a", "b").join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "_n").cast("int").alias("g"))
    own = many.select("a", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("g"))
    texts = texts.hint("merge")  # at every size, as large inputs have it
    left = own.join(texts, F.col("a") == F.col("key")).select("a", "g", F.lit(None).cast("bigint").alias("b"), "text")
    right = dealt.join(texts, F.col("b") == F.col("key")).select("a", "g", "b", "text")
    rows = left.unionByName(right).repartition("a", "g").sortWithinPartitions("a", "g", F.asc_nulls_first("b"))
    return rows.mapInArrow(compare, "a bigint, b bigint")


def linked_sets(docs: DataFrame, sizes: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(vertex, component) over the keys of the sets that link with another one; sizes: set_sizes(docs)."""
    stars = materialise(starred(signature_rows(docs, text)), "stars")
    tried = materialise(stars.where("key != centre").select(F.least("centre", "key").alias("a"), F.greatest("centre", "key").alias("b")).distinct(), "pairs")

    keys = tried.select("a").union(tried.select("b")).distinct().withColumnRenamed("a", "key")
    wanted = sizes.groupBy("key").agg(F.min("id").alias("_id")).join(keys, "key").select("_id", F.col("key").alias("_key"))
    # by merging at every size, so that a small input shows how a large one behaves; ids, and so partitions, are even
    rows = docs.select(F.col(id).alias("_doc"), F.col(text).alias("text")).join(wanted.hint("merge"), F.col("_doc").eqNullSafe(F.col("_id")))
    # joined by key time and again, so in buckets: then only pairs are shuffled
    texts = materialise_buckets(sketches(rows.select("_key", "text")), "key", "texts")
    if not texts.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():  # repeated rows
        once = materialise_buckets(texts.dropDuplicates(["key"]), "key", "texts")
        discard(texts)
        texts = once
    sketched = texts.select("key", "size", "sketch")
    likely = materialise(possible(tried, sketched), "likely")
    links = materialise(verified(likely, texts), "links")
    parts = materialise(connected_components(links), "components")
    discard(likely)
    # all pairs with a centre are compared; what is left of a bucket must hold two sets of different components
    placed = placed_rows(stars, parts)
    for spanning in (True, False):
        found = materialise(searched(placed, sketched, spanning), "found")
        pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
        rest = materialise(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if not rest.isEmpty():
            links = replaced(links, links.unionByName(verified(rest, texts)), "links")
            parts = replaced(parts, connected_components(links), "components")
            tried = replaced(tried, tried.unionByName(rest), "pairs")
        discard(rest)
        if not spanning or apart(pairs, parts).isEmpty():
            break  # each pair that may link is within a component
        # a forest's pair that doesn't link says nothing about the others of its bucket: there, all are taken
        again = found.where("sig IS NOT NULL").select("sig").distinct()
        placed = replaced(placed, placed_rows(stars.join(again, "sig", "left_semi"), parts), "placed")
        discard(found)
    discard(stars, tried, texts, links, placed, found)
    return parts


def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys in different components; a key without links is its own."""
    one = parts.select(F.col("vertex").alias("a"), F.col("component").alias("_p"))
    two = parts.select(F.col("vertex").alias("b"), F.col("component").alias("_q"))
    return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("_p", "a") != F.coalesce("_q", "b")).select("a", "b")


def replaced(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """new, written, in place of old, which is deleted."""
    out = materialise(new, label)
    discard(old)
    return out


def placed_rows(stars: DataFrame, parts: DataFrame) -> DataFrame:
    """(sig, key, part, n) of the buckets that hold sets of different components, n sets each; written. Of buckets with the
    same sets one stays (they are told by two 64-bit hashes and n)."""
    rows = stars.select("sig", "key").distinct().join(parts.withColumnRenamed("vertex", "key"), "key", "left")
    rows = materialise(rows.select("sig", "key", F.coalesce("component", "key").alias("part")), "placed")
    hashes = [F.bit_xor(F.xxhash64(F.lit(i), "key")).alias(f"_{i}") for i in range(2)]
    several = rows.groupBy("sig").agg(F.min("part").alias("_low"), F.max("part").alias("_high"), F.count("*").alias("n"), *hashes)
    one_of_each = several.where("_low < _high").groupBy("_0", "_1", "n").agg(F.min("sig").alias("sig"))
    return replaced(rows, rows.join(one_of_each.select("sig", "n"), "sig"), "placed")


def sketch_of(elements: np.ndarray) -> bytes:
    """A bitmap, of a power of two of bits: whether an odd number of elements falls on a bit."""
    bits = min(max(LEAST_BITS, 1 << (4 * len(elements) - 1).bit_length()), MOST_BITS) if len(elements) else LEAST_BITS
    odd = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of `width` 64-bit numbers: a wider one's halves are taken modulo two until it fits."""
    out = np.empty((len(sketches), width), np.uint64)
    sizes = np.array([len(x) for x in sketches]) // 8
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        block = np.frombuffer(b"".join([sketches[i] for i in rows.tolist()]), np.uint64).reshape(len(rows), size)
        while block.shape[1] > width:
            half = block.shape[1] // 2
            block = block[:, :half] ^ block[:, half:]
        out[rows] = block
    return out


def may_link(distance: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether sets of m and n elements, in at least `distance` of which they differ, can be similar."""
    return (100 * np.minimum(m, n) >= PERCENT * np.maximum(m, n)) & (distance * (100 + PERCENT) <= (100 - PERCENT) * (m + n))


def sketches(rows: DataFrame) -> DataFrame:
    """(key, text, size, sketch) of rows (key, text). An id that stands for several texts has brought them all; rows whose
    text hasn't the key go."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, bitmaps = batch.column(0).to_pylist(), [], []
            for key, t in zip(keys, batch.column(1).to_pylist(), strict=True):
                elements = shingle_set(t)
                sizes.append(len(elements) if set_key(elements) == key else None)
                bitmaps.append(sketch_of(elements))
            out = pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(bitmaps, pa.binary())], ["key", "text", "size", "sketch"])
            yield out.filter(out.column(2).is_valid())

    return rows.mapInArrow(sketch, "key bigint, text string, size bigint, sketch binary")


def possible(pairs: DataFrame, sketched: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't rule out."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (4, 5))
            m, n = (batch.column(i).to_numpy() for i in (2, 3))
            widths, distance = np.array([min(len(p), len(q)) // 8 for p, q in zip(x, y, strict=True)], np.int64), np.zeros(len(m), np.int64)
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                for k in range(0, len(at), BLOCK):
                    rows = at[k : k + BLOCK].tolist()
                    apart = folded([x[i] for i in rows], width) ^ folded([y[i] for i in rows], width)
                    distance[rows] = np.bitwise_count(apart).sum(axis=1, dtype=np.int64)
            yield batch.select([0, 1]).filter(pa.array(may_link(distance, m, n)))

    left = sketched.select(F.col("key").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x"))
    right = sketched.select(F.col("key").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(pick, "a bigint, b bigint")


def close_pairs(parts: np.ndarray, sizes: np.ndarray, bitmaps: np.ndarray, sides: np.ndarray, spanning: bool) -> np.ndarray:
    """Index pairs of different parts that the sketches leave possible; from one side to the other where there are two.
    spanning: only those of a spanning forest of the parts, the closest pairs first."""
    rows = np.flatnonzero(sides == sides[0])
    others = rows if len(rows) == len(sides) else np.flatnonzero(sides != sides[0])
    step = max(1, (1 << 21) // (len(others) * bitmaps.shape[1]))  # pairs of 16 MB at once
    pairs, distances = [], []
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        distance = np.bitwise_count(bitmaps[some][:, None, :] ^ bitmaps[others][None, :, :]).sum(axis=2, dtype=np.int64)
        near = (parts[some][:, None] != parts[others][None, :]) & may_link(distance, sizes[some][:, None], sizes[others][None, :])
        i, j = np.nonzero(near)
        if len(i):
            pairs.append(np.stack([some[i], others[j]]))
            distances.append(distance[i, j])
    if not pairs:
        return np.empty((2, 0), np.int64)
    found, distance = np.concatenate(pairs, axis=1), np.concatenate(distances)
    if others is rows:
        found, distance = found[:, once := found[0] < found[1]], distance[once]
    if not spanning:
        return found
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    chosen = []
    for at in np.argsort(distance, kind="stable").tolist():
        a, b = find(int(parts[found[0, at]])), find(int(parts[found[1, at]]))
        if a != b:
            root[a] = b
            chosen.append(at)
    return found[:, chosen]


def searched(placed: DataFrame, sketched: DataFrame, spanning: bool) -> DataFrame:
    """(a, b, null) for pairs that share a bucket and may link, and (null, null, sig) for the buckets with such pairs. A
    bucket of n sets is dealt into blocks of about BLOCK; each two blocks meet in one group of rows, so memory is bounded
    and a large bucket is spread over many tasks."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = placed.withColumn("_of", F.pmod(F.xxhash64("key"), blocks).cast("int")).withColumn("_with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("sig", "key", "part", F.least("_of", "_with").alias("_x"), F.greatest("_of", "_with").alias("_y"), F.col("_of").alias("_side"))
    rows = rows.join(sketched, "key").repartition("sig", "_x", "_y").sortWithinPartitions("sig", "_x", "_y", "key")
    rows = rows.select("sig", "_x", "_y", "_side", "key", "part", "size", "sketch")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for (sig, *_), (sides, keys, parts, sizes), bitmaps in groups_of(batches, 3):
            if (parts == parts[0]).all():
                continue
            i, j = close_pairs(parts, sizes, folded(bitmaps, min(map(len, bitmaps)) // 8), sides, spanning)
            if not len(i):
                continue
            pairs = dict.fromkeys(zip(np.minimum(keys[i], keys[j]).tolist(), np.maximum(keys[i], keys[j]).tolist(), strict=True))
            new = [(*p, None) for p in pairs if p not in seen]  # a pair shares many buckets
            if len(seen) >= 1_000_000:
                seen.clear()
            seen.update(pairs)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*new, (None, None, sig), strict=True)], ["a", "b", "sig"])

    return rows.mapInArrow(search, "a bigint, b bigint, sig bigint")


def groups_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[int], list[np.ndarray], list[bytes]]]:
    """The runs of rows that agree in the first `width` columns, of rows that are sorted by them: their values there, the other
    columns (whole numbers) but the last, and the last one (bytes)."""
    marks, columns, last = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy() for i in range(batch.num_columns - 1)])
        own = batch.column(batch.num_columns - 1).to_pylist()
        cuts = [0, *(np.flatnonzero((values[:width, 1:] != values[:width, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = values[:width, a].tolist()
            if here == marks:
                columns, last = np.concatenate([columns, values[width:, a:b]], axis=1), last + own[a:b]
                continue
            if marks is not None:
                yield marks, list(columns), last
            marks, columns, last = here, values[width:, a:b], own[a:b]
    if marks is not None:
        yield marks, list(columns), last


def shingle_components(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row: the size of its set, and the least id that links reach.

    Texts without words, and null ones, have an empty set, link with nothing and are their own component. Repeated rows
    come out each and share a component, as all rows with equal sets do; null ids count as ids only where a component has
    no other. Sets count as equal by a 64-bit hash. Only id and text of docs are read, so other columns can't clash.
    """
    sizes = materialise(set_sizes(docs, id, text), "sizes")
    links = linked_sets(docs, sizes.where("n_shingles > 0"), id, text)
    nodes = sizes.where("n_shingles > 0").groupBy("key").agg(F.min("id").alias("_least"))
    nodes = materialise(nodes.join(links.withColumnRenamed("vertex", "key"), "key", "left").select(F.col("key").alias("_key"), "_least", F.coalesce("component", "key").alias("_part")), "nodes")
    # written before they are joined, so that a part or a key that most rows have can be split
    least = materialise(nodes.groupBy("_part").agg(F.min("_least").alias("component_id")), "least")
    placed = materialise(nodes.join(least, "_part").select("_key", "component_id"), "placed")
    discard(links, nodes, least)
    found = sizes.join(placed, (F.col("n_shingles") > 0) & (F.col("key") == F.col("_key")), "left")
    return found.select(F.col("id").alias(id), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def first_of_components(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged and of whatever names, that stand for their component: those with its least id.
    Of rows repeated with id and text one stays. Rows without any word are no copies of each other; they stay, and so do
    null ids. An empty table gives an empty one."""
    found = shingle_components(docs, id=id, text=text)
    found = materialise(found.select(F.col(id).alias("_id"), "component_id"), "components")
    gone = found.where("component_id != _id").select(F.col("_id").alias(id)).distinct()
    kept = docs.join(gone.hint("merge"), id, "left_anti").select(*docs.columns)
    twice = found.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_id").alias(id))
    if twice.isEmpty():
        return kept
    # nulls are no copies of each other's ids, so they stay out of the join and are looked at apart
    known, unknown = kept.where(F.col(id).isNotNull()), kept.where(F.col(id).isNull())
    rest = known.join(twice, id, "left_anti").select(*docs.columns)
    again = known.join(twice, id, "left_semi").select(*docs.columns).unionByName(unknown)
    return rest.unionByName(again.dropDuplicates([id, text]))
