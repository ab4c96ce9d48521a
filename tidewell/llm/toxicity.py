"""Operator 7, toxicity: a convolutional text classifier in numpy.

Words and the beginnings of longer words are hashed to buckets with an embedding each, and a word's embedding is the sum
of its buckets' (inflected forms share their stem's). Filters of several widths run over the sequence of a text's words,
the maximum over all positions is pooled, and a logistic layer gives the score. Embeddings, filters and the layer start from random
numbers and are trained by Adam on a bounded sample of labelled rows (`FIT_ROWS`, see common.labelled_sample), with words left
out at random; a fifth of the sample chooses the epoch and the cut at a score of 0.5. The score never sees language, source, id
or labels; `toxicity_verdicts` puts thresholds behind it that are calibrated for each language, on labelled rows that are neither
held out nor seen by its network.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Remembered, held_out, labelled_sample, materialise, sigmoid

FIT_ROWS, BUCKETS, WIDTH, FILTERS, WIDTHS, EPOCHS = 8000, 1 << 17, 8, 6, (1, 2, 3), 6
#: Steps of training at least; few rows are passed over more often.
LEAST_STEPS = 600
#: A bucket's embedding stays zero below so many training texts; the share of words that training leaves out.
LEAST_TEXTS, LEFT_OUT = 4, 0.3
#: Lengths of the beginnings that longer words are hashed by too.
STEMS = range(4, 9)
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
PAD = max(WIDTHS) - 1


def words_of(text: str) -> list[bytes]:
    """Runs of letters, in lower case."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def buckets(word: bytes) -> list[int]:
    """Buckets of a word and its stems, padded with 0, whose embedding is zero."""
    text = word.decode("utf-8", "replace")
    parts = [text, *(text[:k] + "+" for k in STEMS if len(text) > k)]
    return [1 + xxhash.xxh3_64_intdigest(p) % (BUCKETS - 1) for p in parts] + [0] * (1 + len(STEMS) - len(parts))


class TextCnn:
    """The network. Texts come as rows of a vocabulary, whose rows are buckets; row and bucket 0 are padding, PAD rows of
    which stand before a text and PAD + 1 behind it."""

    def __init__(self, seed: int = 3):
        self.random = random = np.random.default_rng(seed)
        self.embedding = (0.1 * random.standard_normal((BUCKETS, WIDTH))).astype(np.float32)
        self.embedding[0] = 0
        #: Filter weights by (position in the window, coordinate, filter), for each width.
        self.filters = [(random.standard_normal((w, WIDTH, FILTERS)) / np.sqrt(w * WIDTH)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (random.standard_normal((len(WIDTHS), FILTERS)) / np.sqrt(FILTERS)).astype(np.float32)
        self.bias = np.full(1, -2, np.float32)

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        """(position, filter) for each width; x: embeddings of words in order."""
        out = []
        for filters in self.filters:
            n = len(x) - len(filters) + 1
            act = x[:n] @ filters[0]
            for j in range(1, len(filters)):
                act += x[j : j + n] @ filters[j]
            out.append(act)
        return out

    def pooled(self, x: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(text, width, filter): the maxima over each text, with the places where they stand."""
        every, best, places = self.activations(x), [], []
        for act, bias in zip(every, self.biases, strict=True):
            at, where = 0, []
            for n in lengths:
                where.append(at + act[at : at + n - PAD].argmax(axis=0))
                at += n
            places.append(np.array(where))
            best.append(act[places[-1], np.arange(FILTERS)] + bias)
        return np.stack(best, axis=1), places

    def head(self, best: np.ndarray) -> np.ndarray:
        return (np.maximum(best, 0) * self.out).sum(axis=(1, 2)).astype(float) + self.bias[0]

    def logits(self, texts: list[np.ndarray], vocabulary: np.ndarray) -> np.ndarray:
        vectors, out = self.embedding[vocabulary].sum(axis=1), [np.empty(0)]
        for i in range(0, len(texts), 64):
            part = texts[i : i + 64]
            out.append(self.head(self.pooled(vectors[np.concatenate(part)], [len(t) for t in part])[0]))
        return np.concatenate(out)

    def train(self, texts: list[np.ndarray], vocabulary: np.ndarray, labels: np.ndarray, batch: int = 32, rate: float = 0.01) -> Iterator[int]:
        """One epoch after the other; yields their numbers."""
        counts = np.zeros(BUCKETS, np.int64)
        for t in texts:
            counts[np.unique(vocabulary[t])] += 1
        still = counts < LEAST_TEXTS
        still[0] = True
        self.embedding[still] = 0
        parameters = [*self.filters, *self.biases, self.out, self.bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
        slow, step = (np.zeros_like(self.embedding), np.zeros_like(self.embedding)), 0
        for epoch in range(max(EPOCHS, -(-LEAST_STEPS * batch // len(texts)))):
            order = self.random.permutation(len(texts))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                part = [np.where(self.random.random(len(texts[r])) < LEFT_OUT, 0, texts[r]) for r in rows]
                gradients, words, by_word = self._gradients(part, vocabulary, labels[rows])
                step += 1
                for p, g, m in zip(parameters, gradients, moments, strict=True):
                    p -= self._adam(g, m, slice(None), step, rate)
                own, place = np.unique(vocabulary[words].ravel(), return_inverse=True)
                by_bucket = np.zeros((len(own), WIDTH), np.float32)
                np.add.at(by_bucket, place, np.repeat(by_word, vocabulary.shape[1], axis=0))
                moves = ~still[own]
                self.embedding[own[moves]] -= self._adam(by_bucket[moves], slow, own[moves], step, rate)
            yield epoch

    @staticmethod
    def _adam(g: np.ndarray, moments: tuple[np.ndarray, np.ndarray], at, step: int, rate: float) -> np.ndarray:
        first, second = moments
        first[at] = 0.9 * first[at] + 0.1 * g
        second[at] = 0.999 * second[at] + 0.001 * g * g
        return rate * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, texts: list[np.ndarray], vocabulary: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Of the parameters; and of the embeddings of those words that were maxima somewhere, which come with them."""
        words, flat = np.unique(np.concatenate(texts), return_inverse=True)
        x = self.embedding[vocabulary[words]].sum(axis=1)[flat]
        best, places = self.pooled(x, [len(t) for t in texts])
        delta = ((sigmoid(self.head(best)) - labels) / len(texts)).astype(np.float32)
        back = delta[:, None, None] * self.out * (best > 0)
        by_word, kernels = np.zeros((len(words), WIDTH), np.float32), []
        for k, filters in enumerate(self.filters):
            kernel = np.empty_like(filters)
            for j in range(len(filters)):
                at = places[k] + j
                kernel[j] = np.einsum("tfd,tf->df", x[at], back[:, k])
                np.add.at(by_word, flat[at].ravel(), (back[:, k, :, None] * filters[j].T).reshape(-1, WIDTH))
            kernels.append(kernel)
        hit = np.flatnonzero(by_word.any(axis=1))
        out = np.einsum("t,tkf->kf", delta, np.maximum(best, 0))
        return [*kernels, *back.sum(axis=0), out, delta.sum(keepdims=True)], words[hit], by_word[hit]


class ToxicityModel:
    """A trained network with its shift: the logit at which the labels part best becomes a score of 0.5."""

    def __init__(self, sample: list[tuple[str, int]]):
        self.network, labels = TextCnn(), np.array([y for _, y in sample], np.float32)
        self.prior, self.shift, self._vectors = float(labels.mean()) if len(labels) else 0.0, None, None
        if 0 < labels.sum() < len(labels):
            rows: dict[bytes, int] = {}
            texts = [[rows.setdefault(w, len(rows) + 1) for w in words_of(t)] for t, _ in sample]
            vocabulary = np.array([[0] * (1 + len(STEMS)), *map(buckets, rows)], np.int32)
            texts = [np.array([0] * PAD + t + [0] * (PAD + 1), np.int32) for t in texts]
            train = np.arange(len(texts)) % 5 != 0
            train |= not 0 < labels[~train].sum() < (~train).sum()
            check = ~train if (~train).any() else train
            seen, unseen = ([t for t, x in zip(texts, part, strict=True) if x] for part in (train, check))
            best = (-1.0, None, 0.0)
            for _ in self.network.train(seen, vocabulary, labels[train]):
                logits = self.network.logits(unseen, vocabulary)
                if (right := area(logits, labels[check])) > best[0]:
                    best = (right, self._weights(copy=True), best_cut(logits, labels[check]))
            self._weights(best[1])
            self.shift = best[2]

    def _weights(self, new: tuple | None = None, copy: bool = False) -> tuple:
        net = self.network
        if new:
            net.embedding, net.filters, net.biases, net.out, net.bias = new
        own = (net.embedding, net.filters, net.biases, net.out, net.bias)
        return tuple([x.copy() for x in p] if isinstance(p, list) else p.copy() for p in own) if copy else own

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_vectors": None}

    def logit(self, text: str) -> float:
        """Of a whole text; words' embeddings are remembered as bytes, which are joined to the matrix."""
        if self._vectors is None:
            self._vectors = Remembered(lambda word: self.network.embedding[buckets(word)].sum(axis=0).tobytes(), 200_000)
        pad = bytes(4 * WIDTH * PAD)
        data = b"".join([pad, *map(self._vectors.__getitem__, words_of(text)), pad, bytes(4 * WIDTH)])
        every = self.network.activations(np.frombuffer(data, np.float32).reshape(-1, WIDTH))
        best = [a[: len(data) // (4 * WIDTH) - PAD].max(axis=0) + b for a, b in zip(every, self.network.biases, strict=True)]
        return float(self.network.head(np.array([best]))[0])

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.shift is None:
            return np.full(len(texts), self.prior)
        return sigmoid(np.array([self.logit(t) for t in texts], float) - self.shift)


def area(values: np.ndarray, labels: np.ndarray) -> float:
    """Area under the curve of hits over false alarms: how likely a 1 has a higher value than a 0; ties count half."""
    ordered = np.sort(values[labels == 0])
    above = values[labels == 1]
    return float((np.searchsorted(ordered, above, "left") + np.searchsorted(ordered, above, "right")).mean() / (2 * len(ordered)))


def best_cut(values: np.ndarray, labels: np.ndarray) -> float:
    """The middle between two neighbours that gives the best F1 for calling what lies above it 1; the middle one of equals."""
    order = np.argsort(-values, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(values) + 1) + labels.sum())
    ordered = values[order]
    cuts = np.append((ordered[:-1] + ordered[1:]) / 2, ordered[-1] - 1)
    f1[:-1] = np.where(ordered[:-1] > ordered[1:], f1[:-1], -1)
    return float(cuts[int(np.argmax(f1))])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, label: str = "toxic", id: str = "doc_id", text: str = "text") -> ToxicityModel:
    return ToxicityModel(labelled_sample(docs, labels, label, rows, id=id, text=text))


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.scores([t or "" for t in batch.to_pylist()]), pa.float64())

    return score(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", **fit) -> DataFrame:
    """id and score (0 to 1, higher for toxic text) of every whole text.

    One row for each row of docs, repeated ones and null ids too; null and empty texts have the score of no words, texts of any length
    are read whole, an empty table gives an empty one. Without labelled rows of both kinds every score is the share of toxic
    ones (0 without any). Only id and text of docs are read, so other columns can't clash. Nothing of docs is shuffled.
    """
    model = fit_toxicity(docs, labels, id=id, text=text, **fit)
    return docs.select(F.col(id), toxicity_score(F.col(text), model).alias("score"))


def language_thresholds(scored: DataFrame, labels: DataFrame, *, language: str = "lang", label: str = "toxic", id: str = "doc_id", least: int = 50) -> DataFrame:
    """(language, threshold): for each language the multiple of 0.05 that gives the best F1 on the labelled rows of
    `scored` (id, language, score); 0.5 for languages with fewer than `least` labelled rows or no toxic one. Counts by
    language and score step are all that is shuffled."""
    known = labels.select(id, F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1)).dropDuplicates([id])
    rows = scored.select(id, language, "score").dropDuplicates([id]).join(known, id)
    steps = rows.groupBy(language, F.floor(F.col("score") * 20).cast("int").alias("_step")).agg(F.count("*").alias("_n"), F.sum("_y").alias("_hits"))
    wide = steps.groupBy(language).agg(F.collect_list(F.struct("_step", "_n", "_hits")).alias("_steps"), F.sum("_n").alias("_n"), F.sum("_hits").alias("_y"))

    def total(field: str, k: Column) -> Column:
        return F.aggregate(F.filter("_steps", lambda s: s["_step"] >= k), F.lit(0).cast("long"), lambda a, s: a + s[field])

    f1 = F.transform(F.sequence(F.lit(1), F.lit(19)), lambda k: F.struct((2.0 * total("_hits", k) / (total("_n", k) + F.col("_y"))).alias("f1"), (-F.abs(k - 10)).alias("near"), k.alias("k")))
    best = F.when((F.col("_n") >= least) & (F.col("_y") > 0), F.array_max(f1)["k"] / 20).otherwise(F.lit(0.5))
    return wide.select(language, best.alias("threshold"))


def for_calibration(doc_id: Column) -> Column:
    """True for a quarter of the ids outside the held-out fold, from which thresholds and no networks are fitted."""
    return ~held_out(doc_id) & (F.crc32(F.concat(F.lit("calibration "), doc_id.cast("string")).cast("binary")) % 4 == 0)


def toxicity_verdicts(docs: DataFrame, labels: DataFrame, *, language: str = "lang", label: str = "toxic", id: str = "doc_id", text: str = "text", least: int = 50, **fit) -> DataFrame:
    """id, language, score, threshold (of the language) and verdict (1 from the threshold on, else 0) of every whole text.

    The network learns from labelled rows outside the held-out fold and the calibration fold, so scores differ a little from
    those of toxicity_scores; thresholds come from the calibration fold (see language_thresholds for `least`), 0.5 where it
    has no row of a language. One row for each row of docs, repeated ones, null languages and ids too; null and empty texts have the
    score of no words; an empty table gives an empty one. Only id, language and text of docs are read, so other columns can't
    clash. Texts are scored once: scores are written to the shared folder, and only they are joined.
    """
    calibrating = F.coalesce(for_calibration(F.col(id)), F.lit(False))
    model = fit_toxicity(docs, labels.where(~calibrating), label=label, id=id, text=text, **fit)
    scored = materialise(docs.select(id, language, toxicity_score(F.col(text), model).alias("score")), "scores")
    thresholds = language_thresholds(scored, labels.where(calibrating).select(id, label), language=language, label=label, id=id, least=least)
    out = scored.join(thresholds.select(F.col(language).alias("_language"), "threshold"), F.col(language).eqNullSafe(F.col("_language")), "left").drop("_language")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    return out.withColumn("verdict", (F.col("score") >= F.col("threshold")).cast("int"))
