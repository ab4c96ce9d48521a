"""Operator 9, benchmark decontamination: word-pair seeds, then Smith-Waterman alignment.

Texts and test items are sequences of lower-cased words, and a pair counts from a score of `THRESHOLD` times the item's own
score. An item's seeds are its pairs of words that stand next to each other or have one word between them; a text may have
one word between them too. All are seeds, none is dropped for its frequency. A seed weighs 2 where both sides have its
words next to each other, else 1. An alignment's score is at most 2 plus the weights of its consecutive matches, since each
match adds 2 and what parts it from the last costs as much as its seed weighs less than 2. So a text is aligned where
seeds of the weight that the threshold asks for stand close enough together, and no alignment that reaches the threshold
is missed: words may be changed, dropped or added anywhere.

An item of one word is found by that word. An item of two has half its score with either word alone, which is no copy: a
copy of several words has at least two of them. So its words may have up to two words between them, and these pairs are its
seeds, too. From three words on, one word never reaches the threshold.

The test items are the query set: they are broadcast in blocks of at most `BLOCK_BYTES`, each of which is run against all
documents in one pass. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, BLOCK_BYTES, HITS_AT_ONCE = 0.5, 4 << 20, 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
_SIGNS = {c: " " for c in range(128) if not chr(c).isalnum()}
_WORD = re.compile(r"[^\W_]+")
_HIT = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
HITS = "array<struct<item_id:bigint,score:double,start:bigint,end:bigint>>"


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of any script, in lower case; typographic signs part words as plain ones do."""
    lower = text.lower()
    return lower.translate(_SIGNS).split() if lower.isascii() else _WORD.findall(lower)  # the same, but faster


class SeedIndex:
    """Items as word numbers, with their seeds in a sorted array and the items that have each.

    A word's number is its place among the words of all items, from 1 on; other words are 0, and equal nothing. A seed
    is the number that its words' numbers make as digits, so seeds are exact.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t), 1)}
        self.words = [np.array([self.numbers[w] for w in t], np.int64) for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        weights: dict[tuple[int, int], int] = {}
        for item, words in enumerate(self.words):
            for distance in (0,) if len(words) == 1 else (1,) if len(words) == 2 else (2, 1):  # the nearer pair of the same words has the last word
                weights.update(((g, item), 2 if distance == 1 else 1) for g in self.grams(words, distance).tolist())
        rows = sorted((g, item, w) for (g, item), w in weights.items())
        self.distances = (*((0,) if 1 in self.sizes else ()), 1, 2, *((3,) if 2 in self.sizes else ()))
        self.seeds, first = np.unique(np.array([g for g, _, _ in rows], np.int64), return_index=True)
        self.first = np.append(first, len(rows))
        self.items, self.weights = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))

    def read(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, len(words))

    @staticmethod
    def grams(words: np.ndarray, distance: int) -> np.ndarray:
        """The seeds of words so far apart at each place (of one word for 0); 0 where one of them is no item's."""
        if not distance:
            return words
        one, two = words[:-distance], words[distance:]
        return np.where((one > 0) & (two > 0), (one << 31) + two, 0)

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions in words, items, weights) of the seeds in a text, in parts of about HITS_AT_ONCE."""
        for distance in self.distances if len(self.seeds) else ():
            grams = self.grams(words, distance)
            at = np.flatnonzero(grams)
            place = np.minimum(np.searchsorted(self.seeds, grams[at]), len(self.seeds) - 1)
            exact = self.seeds[place] == grams[at]
            at, place = at[exact], place[exact]
            many = self.first[place + 1] - self.first[place]
            upto = np.cumsum(many)
            cuts = np.searchsorted(upto, np.arange(HITS_AT_ONCE, upto[-1], HITS_AT_ONCE)) if len(at) else ()
            for p, s, n in zip(np.split(at, cuts), np.split(place, cuts), np.split(many, cuts), strict=True):
                row = np.repeat(self.first[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield np.repeat(p, n), self.items[row], self.weights[row] if distance == 1 else np.ones(len(row), np.int64)

    def windows(self, words: np.ndarray, threshold: float) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(item, parts of words) that together hold every alignment of the item with a score from the threshold on."""
        needs = np.maximum(np.ceil(2 * threshold * self.sizes - 2 - 1e-9), 1)
        sums = np.zeros(len(self.words))
        for _, items, weights in self.hits(words):
            sums += np.bincount(items, weights, len(sums))
        enough = sums >= needs
        if not enough.any():
            return
        parts = [(p[keep], i[keep], w[keep]) for p, i, w in self.hits(words) if (keep := enough[i]).any()]
        at, items, weights = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((-weights, at, items))
        at, items, weights = at[order], items[order], weights[order]
        own = np.append(True, (items[1:] != items[:-1]) | (at[1:] != at[:-1]))  # the heaviest of each position
        at, items, weights = at[own], items[own], weights[own]
        for item, start, n in zip(*(x.tolist() for x in np.unique(items, return_index=True, return_counts=True)), strict=True):
            p, upto = at[start : start + n], np.append(0, np.cumsum(weights[start : start + n]))
            span = max(int((3 - 2 * threshold) * self.sizes[item] + 1e-9), 1)  # an alignment has no more words of the text
            last = np.searchsorted(upto, upto[:-1] + needs[item]) - 1
            j = np.flatnonzero(last < n)
            j = j[p[last[j]] - p[j] < span]
            if len(j):
                yield item, list(zip(np.maximum(p[last[j]] + 1 - span, 0).tolist(), np.minimum(p[j] + span, len(words)).tolist(), strict=True))

    def matches(self, text: str, threshold: float = THRESHOLD) -> list[tuple[int, float, int, int]]:
        """(item id, score, first word, end word) of each item that a text holds, by the best of its windows."""
        words, found = self.read(text), []
        for item, parts in self.windows(words, threshold):
            own, best = self.words[item], (0.0, 0, 0)
            for start, end in merged(parts):
                window = words[start:end]
                if np.isin(own, window).sum() >= threshold * len(own) - 1e-9:  # a score can't be higher than that
                    score, a, b = align(own, window)
                    best = max(best, (score / (MATCH * len(own)), start + a, start + b), key=lambda x: x[0])
            if best[0] >= threshold:
                found.append((self.ids[item], *best))
        return sorted(found)


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(set(parts)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman by words with linear gaps: best score, and first and end word in the window of its alignment.

    A row at a time; gaps along a row are a running maximum of scores that fall by one a step.
    """
    n = len(window)
    steps = np.arange(n + 1) * -GAP
    row, origin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for word in item:
        diagonal = row[:-1] + np.where((window == word), MATCH, MISMATCH)
        above = row[1:] + GAP
        score, source = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = np.maximum(diagonal, above)
        score[1:] = np.maximum(take, 0)
        source[1:] = np.where(take > 0, np.where(diagonal >= above, origin[:-1], origin[1:]), source[1:])
        raised = score + steps
        peak = np.maximum.accumulate(raised)
        at = np.maximum.accumulate(np.where(raised == peak, np.arange(n + 1), 0))
        along = peak - steps
        better = along > score
        score, source = np.where(better, along, score), np.where(better, source[at], source)
        row, origin = score, source
        top = int(row.argmax())
        if row[top] > best:
            best, span = int(row[top]), (int(origin[top]), top)
    return best, *span


def item_blocks(items: DataFrame, max_bytes: int = BLOCK_BYTES, *, item: str = "item_id", text: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of about max_bytes of text; null ids and items without a text are no queries."""
    rows = items.select(F.col(item).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = -(-size // max_bytes)
    for i in range(blocks):
        yield [(r["id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i).collect()]


def contamination(docs: DataFrame, items: list[tuple[int, str]], threshold: float = THRESHOLD, *, text: str = "text") -> Column:
    """A column of the items (one block of them) that each text holds: HITS; a null text counts as empty and holds none."""
    shared = docs.sparkSession.sparkContext.broadcast(SeedIndex(items))

    @F.arrow_udf(HITS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [shared.value.matches(t or "", threshold) for t in batch.to_pylist()]
            yield pa.array([[dict(zip(("item_id", "score", "start", "end"), x, strict=True)) for x in hits] for hits in found], pa.list_(_HIT))

    return find(F.col(text))


def contaminated_pairs(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """(id, item_id, score, first_word, end_word) for each document and each test item that it holds a copy of.

    Null and empty texts, and items without words, are in no pair; texts are aligned whole, however long, in windows around
    their seeds. Of windows with the same score the first in the text is given. Repeated rows of docs give their pairs each,
    repeated items count once; an empty table on either side gives no pairs. Only id and text of docs are read, so
    other columns can't clash.
    """
    rows = docs.select(F.col(id), F.col(text).alias("_text"))
    parts = [rows.select(id, F.explode(contamination(rows, block, threshold, text="_text")).alias("_hit")) for block in item_blocks(items, **columns)]
    found = parts[0] if parts else rows.select(id, F.explode(F.lit(None).cast(HITS)).alias("_hit"))
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select(id, "_hit.item_id", F.round("_hit.score", 6).alias("score"), F.col("_hit.start").alias("first_word"), F.col("_hit.end").alias("end_word"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = THRESHOLD, text: str = "text", **columns) -> DataFrame:
    """The rows of docs, all columns unchanged and of whatever names, whose texts hold no test item (see contaminated_pairs).
    Null and empty texts and rows with null ids stay, repeated rows share their fate; an empty table gives an empty one."""
    kept = docs
    for block in item_blocks(items, **columns):
        kept = kept.where(F.size(contamination(docs, block, threshold, text=text)) == 0)
    return kept
