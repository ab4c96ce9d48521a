"""Operator 8, quality classifier by compression: zstandard dictionaries built from good and from bad labelled text.

A text is cut into blocks of `BLOCK` bytes (all of it; short blocks let a dictionary matter everywhere, not only at the
start). Each block is compressed with the good and with the bad dictionary; the difference of the summed sizes, divided
by the bytes, says which kind of text it resembles. That is the one feature: a logistic fit on labelled rows that the dictionaries
have not seen turns it into a probability. Fitting uses a bounded sample (`FIT_ROWS`, balanced, see
common.labelled_sample, of which a dictionary is built from at most `BUILD_BYTES`); scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import fit_logistic, labelled_sample, sigmoid

FIT_ROWS, BLOCK, DICTIONARY_BYTES, BUILD_BYTES, LEVEL = 4000, 1024, 16 << 10, 8 << 20, 1


@lru_cache(maxsize=8)
def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    dictionaries = [zstandard.ZstdCompressionDict(d) for d in (good, bad)]
    for d in dictionaries:
        d.precompute_compress(level=LEVEL)
    return [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False) for d in dictionaries]


def size_difference(text: str, good: bytes, bad: bytes) -> float:
    """Bytes that the good dictionary saves beside the bad one, as a share of the text's; 0 for an empty text."""
    data = text.encode("utf-8", "surrogatepass")
    by_good, by_bad = _compressors(good, bad)
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    return sum([len(by_bad.compress(x)) - len(by_good.compress(x)) for x in blocks]) / max(len(data), 1)


def built_dictionary(texts: list[str]) -> bytes:
    """A dictionary built from blocks of all texts, evenly spread over each where all of them would be over BUILD_BYTES; plain
    text of theirs where there is too little to build one from."""
    share, blocks = max(1, BUILD_BYTES // BLOCK // max(len(texts), 1)), []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        own = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        blocks += own if len(own) <= share else [own[len(own) * i // share] for i in range(share)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICTIONARY_BYTES]


class CompressionClassifier:
    """Two dictionaries and the calibration of their difference; without both labels every score is the share of good."""

    def __init__(self, sample: list[tuple[str, int]]):
        sample = [(t, y) for t, y in sample if t]
        seen, rest = sample[::2], sample[1::2]
        texts = [[t for t, y in seen if y == label] for label in (1, 0)]
        labels = np.array([y for _, y in rest], float)
        self.fit, self.prior = None, float(np.mean([y for _, y in sample])) if sample else 0.5
        if all(texts) and 0 < labels.sum() < len(labels):
            self.good, self.bad = map(built_dictionary, texts)
            self.fit = fit_logistic(self._features([t for t, _ in rest]), labels)

    def _features(self, texts: list[str]) -> np.ndarray:
        return np.array([size_difference(t, self.good, self.bad) for t in texts], float).reshape(-1, 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.fit is None:
            return np.full(len(texts), self.prior)
        w, mean, deviation = self.fit
        return sigmoid((self._features(texts) - mean) / deviation @ w[:-1] + w[-1])


def quality_scores(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, label: str = "quality", id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score (0 to 1, higher for good text) of every whole text.

    One row for each row of docs, repeated ones and null ids too; null texts count as empty, which have one defined score. Texts of any
    length are read whole, block by block; an empty table gives an empty one.
    Only id and text of docs are read, so other columns can't clash. Nothing of docs is shuffled.
    """
    model = CompressionClassifier(labelled_sample(docs, labels, label, rows, balance=True, id=id, text=text))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.scores([t or "" for t in batch.to_pylist()]), pa.float64())

    return docs.select(F.col(id), score(F.col(text)).alias("score"))
