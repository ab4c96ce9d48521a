"""The models' arithmetic against plain versions: paths in trees, convolutions and their gradients, compressed sizes."""

from __future__ import annotations

import numpy as np
import zstandard

from tidewell.llm import compression_quality as Q
from tidewell.llm import toxicity as X
from tidewell.llm.quality_rules import IsolationForest, _usual_path


def test_forest_scores_are_those_of_plain_walks():
    rnd = np.random.default_rng(1)
    rows = rnd.normal(size=(300, 4))
    forest = IsolationForest(rows, rows.min(axis=0) - 1, rows.max(axis=0) + 1, trees=20, sample=64)
    new = np.concatenate([rows[:50], rnd.normal(size=(50, 4)) * 5])
    for row, score in zip(new, forest.score(new), strict=True):
        lengths = []
        for feature, split, left, path in forest.trees:
            node = 0
            while left[node] != node:  # a leaf leads to itself
                node = left[node] + (row[feature[node]] >= split[node])
            lengths.append(path[node])
        assert abs(score - 2 ** (-np.mean(lengths) / _usual_path(64))) < 1e-12
    assert forest.score(np.full((1, 4), 50.0))[0] > forest.score(rows.mean(axis=0)[None])[0]


def plain_logit(net: X.TextCnn, vectors: np.ndarray) -> float:
    """The network by loops. vectors: padded embeddings of a text's words."""
    total = float(net.bias[0])
    for k, filters in enumerate(net.filters):
        for f in range(X.FILTERS):
            best = -np.inf
            for at in range(len(vectors) - X.PAD):
                if at + len(filters) <= len(vectors):
                    best = max(best, sum(float(vectors[at + j] @ filters[j][:, f]) for j in range(len(filters))) + float(net.biases[k][f]))
            total += max(best, 0.0) * float(net.out[k, f])
    return total


def test_network_is_a_plain_convolution_with_its_gradients():
    rnd = np.random.default_rng(2)
    net = X.TextCnn()
    net.embedding, net.out, net.bias = net.embedding.astype(float), net.out.astype(float), net.bias.astype(float)
    net.filters, net.biases = [f.astype(float) for f in net.filters], [b + rnd.normal(size=b.shape) * 0.01 for b in net.biases]
    vocabulary = np.concatenate([np.zeros((1, 1 + len(X.STEMS)), np.int32), rnd.integers(1, X.BUCKETS, (12, 1 + len(X.STEMS))).astype(np.int32)])
    texts = [np.array([0] * X.PAD + rnd.integers(1, 13, n).tolist() + [0] * (X.PAD + 1), np.int32) for n in (1, 4, 9)]
    labels = np.array([1.0, 0.0, 1.0])
    vectors = net.embedding[vocabulary].sum(axis=1)
    assert np.allclose(net.logits(texts, vocabulary), [plain_logit(net, vectors[t]) for t in texts], atol=1e-6)

    def loss() -> float:
        z = net.logits(texts, vocabulary)
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    gradients, words, by_word = net._gradients(texts, vocabulary, labels)
    for i, (p, g) in enumerate(zip([*net.filters, *net.biases, net.out, net.bias], gradients, strict=True)):
        for _ in range(6):
            at = tuple(rnd.integers(0, n) for n in p.shape)
            before = p[at]
            p[at] = before + 1e-5
            up = loss()
            p[at] = before - 1e-5
            down = loss()
            p[at] = before
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5 + 1e-3 * abs(g[at]), (i, at)
    for word, g in [x for x in zip(words.tolist(), by_word, strict=True) if x[0]][:4]:  # padding stays as it is
        bucket, place = int(vocabulary[word, 0]), int(np.abs(g).argmax())
        share = sum((vocabulary[w] == bucket).sum() * (by_word[words == w][0][place] if (words == w).any() else 0.0) for w in range(1, 13))
        before = net.embedding[bucket, place]
        net.embedding[bucket, place] = before + 1e-5
        up = loss()
        net.embedding[bucket, place] = before - 1e-5
        down = loss()
        net.embedding[bucket, place] = before
        assert abs((up - down) / 2e-5 - share) < 1e-5 + 1e-3 * abs(share)


def test_sizes_are_those_of_plain_compression():
    rnd = np.random.default_rng(3)
    words = [bytes(rnd.integers(97, 123, 6)).decode() for _ in range(200)]
    good, bad = (Q.built_dictionary([" ".join(rnd.choice(part, 400)) for _ in range(40)]) for part in (words[:100], words[100:]))

    def size(block: bytes, dictionary: bytes) -> int:
        return len(zstandard.ZstdCompressor(level=Q.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False).compress(block))

    for n, part in ((5, words), (300, words[:100]), (900, words[100:]), (2000, words)):
        data = " ".join(rnd.choice(part, n)).encode()
        blocks = [data[i : i + Q.BLOCK] for i in range(0, len(data), Q.BLOCK)]
        wanted = sum(size(b, bad) - size(b, good) for b in blocks) / len(data)
        assert abs(Q.size_difference(data.decode(), good, bad) - wanted) < 0.02 and (part is words or wanted * (1 if part == words[:100] else -1) > 0)
    assert Q.size_difference("", good, bad) == 0
