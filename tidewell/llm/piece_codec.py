"""Operator 5, SentencePiece encoding and decoding by a max-plus scan over chunks.

The model at hand is a BPE model, not a unigram one, so the lattice has no sum of piece scores to maximise. In its place an
arc costs one token, and a pair of tokens that BPE would not leave side by side (pieces.py) costs minus infinity; the one
path that is left is the library's encoding. The rest is the Viterbi scan in the max-plus semiring: a text is split into
chunks of `CHUNK` characters, anywhere in a word; a chunk yields the matrix from the pieces that can cross its left end to
those that can cross its right end; matrices combine associatively; the best state at each cut follows, and each chunk is
traced back by itself between its two states. Between two word boundaries of a chunk, which no piece crosses, every path is
the same, and words' tokens are remembered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Remembered, loaded, texts_of
from tidewell.llm.pieces import META, Automaton, Pieces

#: Characters in a chunk of a text; it changes no result.
CHUNK = 1 << 13
#: Words and transitions that a codec remembers, and those of a lean one, for workers that share an executor's memory with other
#: stages' leavings: some 130 MB instead of 300 MB, for more time. They change no result.
WORDS, TRANSITIONS = 250_000, 800_000
LEAN_WORDS, LEAN_TRANSITIONS = 100_000, 300_000


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two transfer matrices."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=-np.inf)


class Chunk(NamedTuple):
    """A chunk's transfer matrix from entries to exits, and what its traceback needs: the first certain end of a token (None
    without any), where its last word begins, the ids between them, those of the spaces before that word, and whether
    the word's first token is among these."""

    text: str
    start: int
    stop: int
    entries: list[tuple[int, int, str]]
    exits: list[tuple[int, int, str]]
    matrix: np.ndarray
    first: int | None
    last: int | None
    inner: bytes
    run: bytes
    merged: int = 0


class PieceCodec:
    """Encodes to and decodes from arrays of little-endian 32-bit ids, as bytes."""

    def __init__(self, pieces: Pieces, chunk: int = CHUNK, words: int = WORDS, transitions: int = TRANSITIONS):
        self.pieces, self.automaton, self.chunk = pieces, Automaton(pieces, transitions), chunk
        self.spaced = Remembered(lambda word: self._pack(self.word(META + word)), words)
        self.bare = Remembered(lambda word: self._pack(self.word(word)), 50_000)
        self.newline = self._pack(pieces.fallback("\n"))
        self.lone = self._pack([pieces.ids[META]])
        self._known, self._word = re.compile(f"({pieces.known})(.?)", re.S), re.compile(f"[^{META}\n]*")

    @staticmethod
    def _pack(ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _ids(self, tokens: list[str]) -> bytes:
        return self._pack([self.pieces.ids[t] for t in tokens])

    def chunk_of(self, text: str, start: int, stop: int) -> Chunk:
        entries, exits = self.pieces.covering(text, start), self.pieces.covering(text, stop)
        matrix = np.full((len(entries), len(exits)), -np.inf)
        first = self.pieces.first_certain(text, start, stop)
        chunk = Chunk(text, start, stop, entries, exits, matrix, first, None, b"", b"")
        if first is None:
            for i, (_, end, piece) in enumerate(entries):
                if end >= stop:  # one piece over the whole chunk
                    matrix[i] = [0 if x == entries[i] else -np.inf for x in exits]
                else:
                    matrix[i] = self._to_exits(text, end, stop, piece, exits)
            return chunk
        last = self.pieces.last_certain(text, stop, first)
        spaces = self.pieces.last_space(text, last, stop)
        run, merged = b"", 0
        if spaces > last:  # how the spaces merge shows in the whole word
            known = self._known.match(text, spaces, spaces + 1 + len(self._word.match(text, spaces + 1)[0]))[1]
            merged = int(self.automaton.path(known)[0] == META)
            run = self._pack(self.pieces.space_run(spaces - last + merged))
        inner = self.joined(text[first:last]) if last > first else b""
        chunk = chunk._replace(last=spaces, inner=inner, run=run, merged=merged)
        tails = np.zeros(1) if last == stop else self._to_exits(text, spaces, stop, "", exits)
        tails -= len(inner) // 4 + len(run) // 4 - merged
        for i, (_, end, piece) in enumerate(entries):
            state, count = self.automaton.run(text[end:first], Automaton.behind(piece))
            if state[1][-1]:
                matrix[i] = tails - count
        return chunk

    def _to_exits(self, text: str, start: int, stop: int, before: str, exits: list[tuple[int, int, str]]) -> np.ndarray:
        """Minus the tokens from behind a piece to each exit, its own piece included; minus infinity without a path."""
        out = np.full(len(exits), -np.inf)
        taken = self.automaton.walk(text[start:stop], Automaton.behind(before))
        counts = list(accumulate([x[1] for x in taken], initial=0))
        for j, (at, _, piece) in enumerate(exits):
            if at >= start and (at == start or taken[at - start - 1][2]):
                token = text[at - taken[at - start - 1][2] : at] if at > start else before
                if self.pieces.fits(token, piece):
                    out[j] = -counts[at - start] - 1
        return out

    def _traced(self, text: str, start: int, stop: int, before: str) -> list[str]:
        part = text[start:stop]
        return self.automaton.traced(part, self.automaton.walk(part, Automaton.behind(before)), len(part))

    def traceback(self, chunk: Chunk, entry: int, exit: int) -> bytes:
        """The ids of a chunk behind its entry's piece, up to and with its exit's."""
        text, (_, end, before), (at, upto, piece) = chunk.text, chunk.entries[entry], chunk.exits[exit]
        if chunk.first is None:
            return b"" if end >= chunk.stop else self._ids([*self._traced(text, end, at, before), piece])
        head = self._ids(self._traced(text, end, chunk.first, before))
        if not piece:
            return head + chunk.inner
        tail = [*self._traced(text, chunk.last, at, ""), piece]
        return head + chunk.inner + chunk.run + self._ids(tail[chunk.merged :])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if not text:
            return b""
        text = META + text.replace(" ", META)
        cuts = self.pieces.cuts(text, self.chunk)
        chunks = [self.chunk_of(text, a, b) for a, b in zip(cuts, cuts[1:])]
        if len(chunks) == 1:
            return self.traceback(chunks[0], 0, 0)
        ahead = list(accumulate([c.matrix for c in chunks], max_plus))
        behind = list(accumulate([c.matrix for c in chunks[::-1]], lambda a, b: max_plus(b, a)))[::-1]
        chosen = [0, *[int(np.argmax(ahead[i][0] + behind[i + 1].max(axis=1))) for i in range(len(chunks) - 1)], 0]
        return b"".join([self.traceback(c, chosen[i], chosen[i + 1]) for i, c in enumerate(chunks)])  # each by itself

    def word(self, text: str) -> list[int]:
        """Ids of a word, with or without its meta space."""
        ids: list[int] = []
        for known, other in self._known.findall(text):
            if known:
                ids += map(self.pieces.ids.__getitem__, self.automaton.path(known))
            if other:
                ids += self.pieces.fallback(other)
        return ids

    def _spaced_words(self, parts: list[str]) -> Iterator[bytes]:
        spaces = 0
        for word in parts:
            spaces += 1
            if word:
                ids = self.spaced[word]
                if spaces == 1:
                    yield ids
                elif ids[:4] == self.lone:
                    yield self._pack(self.pieces.space_run(spaces)) + ids[4:]
                else:
                    yield self._pack(self.pieces.space_run(spaces - 1)) + ids
                spaces = 0
        if spaces:
            yield self._pack(self.pieces.space_run(spaces))

    def _line(self, text: str) -> bytes:
        word, meta, rest = text.partition(META)
        first = self.bare[word] if word else b""
        if not meta:
            return first
        parts = rest.split(META)
        return first + b"".join(self._spaced_words(parts) if "" in parts else map(self.spaced.__getitem__, parts))

    def joined(self, text: str) -> bytes:
        """The ids of a text that begins and ends where tokens end for certain, word by word."""
        return self.newline.join(map(self._line, text.split("\n")))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.pieces.surface.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _codec(model_file: str) -> PieceCodec:
    return PieceCodec(Pieces(model_file))


def _lean_codec(model_file: str) -> PieceCodec:
    return PieceCodec(Pieces(model_file), words=LEAN_WORDS, transitions=LEAN_TRANSITIONS)


def codec(model_file: str, lean: bool = False) -> PieceCodec:
    """One codec for each model in a Python worker, shared by its tasks."""
    return loaded(_lean_codec if lean else _codec, model_file)


def encoded(text: Column, model_file: str) -> Column:
    """The ids (array<int>) of a text column; null and empty texts have none."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = codec(model_file).encode
        for batch in batches:
            ids = [one(t or "") for t in batch.to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    return encode(text)


def decoded(ids: Column, model_file: str) -> Column:
    """The text of an array<int> column of ids; null counts as no ids."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = codec(model_file).decode
        for batch in batches:
            yield pa.array([one(np.asarray(x or [], "<u4").tobytes()) for x in batch.to_pylist()], pa.string())

    return decode(ids)


DIGEST = "struct<n_tokens:bigint,ids_crc32:bigint,text_crc32:bigint,round_trip:boolean>"


def piece_digests(docs: DataFrame, model_file: str, *, lean: bool = False, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each whole text and decodes it again: id, n_tokens, crc32 of the ids as little-endian 32-bit integers,
    crc32 of the decoded text's UTF-8 bytes, and whether that text equals the original with meta spaces as spaces.

    A null text counts as empty (no ids, both sums 0, true). One row for each row, repeated ones too; other columns of
    docs are left out, so none can clash. Texts of any length are read whole, an empty table gives an empty one; nothing is shuffled.
    With `lean`, workers remember less (LEAN_WORDS, LEAN_TRANSITIONS).
    """

    @F.arrow_udf(DIGEST)
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model_file, lean)
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                ids = own.encode(text or "")
                back = own.decode(ids)
                same = back == (text or "").replace(META, " ")
                rows.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode()), same))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            names = ["n_tokens", "ids_crc32", "text_crc32", "round_trip"]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col(id), digest(F.col(text)).alias("_digest")).select(id, "_digest.*")
