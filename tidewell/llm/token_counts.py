"""Operator 2, token counts: a finite-state tokenizer, compiled as far as the texts need it.

`pieces.Automaton` is the deterministic transducer: its transitions are annotated with emitted-token counts.

A text is cut into chunks of `CHUNK` characters, anywhere in a word. A chunk acts on states as a map (state -> state, tokens),
whose domain is the states that can stand at its left end: the one behind the beginning of the word that is cut, or in a word too
long to look back to its beginning, those behind each piece that may be there. Up to the chunk's first word boundary the map
runs the transducer from each of them; there every state becomes the same one, so the words up to the last boundary add a
constant, and the beginning of the last word leads to the exit state. Maps compose associatively and are folded by a tree-shaped
scan; a text's tokens are what the whole map emits from the start state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import Remembered
from tidewell.llm.pieces import META, Automaton, Pieces

#: Characters in a chunk of a text, and how far a chunk looks back for the beginning of a word; they change no result.
CHUNK, REACH = 1 << 13, 48
#: (state -> state, tokens): what a chunk does to each state that can stand at its left end.
ChunkMap = dict[tuple, tuple[tuple, int]]


class CountTransducer:
    """Counts the tokens of words and texts."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.automaton = pieces, Automaton(pieces)
        self._word = re.compile(f"[^{META}\n]*")
        self.spaced, self.bare = Remembered(lambda word: self.run(META + word)), Remembered(self.run, 50_000)

    def run(self, text: str) -> int:
        """Tokens of a word: the sum of what its transitions emit."""
        return sum([x[1] for x in self.automaton.walk(text)])

    def first_is_meta(self, word: str) -> bool:
        """Whether a lone meta space is the first token of this word, so that it merges with the spaces before it."""
        known = re.match(self.pieces.known, word)[0]  # what follows an unknown character does not matter
        return self.automaton.path(META + known)[0] == META

    def inner(self, parts: list[str]) -> int:
        """Tokens of words that each follow one meta space; an empty word stands for one more meta space."""
        if "" not in parts:
            return sum(map(self.spaced.__getitem__, parts))
        total = spaces = 0
        for word in parts:
            spaces += 1
            if not word:
                continue
            if spaces == 1:
                total += self.spaced[word]
            elif self.first_is_meta(word):
                total += len(self.pieces.space_run(spaces)) + self.spaced[word] - 1
            else:
                total += len(self.pieces.space_run(spaces - 1)) + self.spaced[word]
            spaces = 0
        return total + len(self.pieces.space_run(spaces)) if spaces else total

    def closed(self, text: str) -> int:
        """Tokens of a text that begins and ends at boundaries."""
        return sum(map(self._line, text.split("\n"))) + text.count("\n")

    def _line(self, text: str) -> int:
        if text[:1] == META:
            return self.inner(text[1:].split(META))
        word, meta, rest = text.partition(META)
        return (self.bare[word] if word else 0) + (self.inner(rest.split(META)) if meta else 0)

    def states(self, text: str, at: int) -> list[tuple]:
        """The states that can stand at a cut."""
        if self.pieces.certain(text, at):
            return [Automaton.START]
        start = self.pieces.word_start(text, at, REACH)
        if start is not None:
            return [self.automaton.run(text[start:at], Automaton.START)[0]]
        covers = self.pieces.covering(text, at - REACH + self.pieces.longest)
        found = [self.automaton.run(text[end:at], Automaton.behind(piece))[0] for _, end, piece in covers if end <= at]
        return [x for x in dict.fromkeys(found) if x != Automaton.LOST]

    def chunk_map(self, text: str, start: int, stop: int) -> ChunkMap:
        first = self.pieces.first_certain(text, start, stop)
        if first is None:
            return {s: self.automaton.run(text[start:stop], s) for s in self.states(text, start)}
        last = self.pieces.last_certain(text, stop, first)
        spaces = self.pieces.last_space(text, last, stop)
        exit, tail = self.automaton.run(text[spaces:stop], Automaton.START)
        if spaces > last:  # how the spaces merge shows in the whole word
            word = self._word.match(text, spaces + 1)[0]
            tail += len(self.pieces.space_run(spaces + 1 - last)) - 1 if self.first_is_meta(word) else len(self.pieces.space_run(spaces - last))
        inner = self.closed(text[first:last])
        heads = {s: self.automaton.run(text[start:first], s) for s in self.states(text, start)}
        return {s: (exit, n + inner + tail) for s, (end, n) in heads.items() if end[1][-1]}

    @staticmethod
    def compose(a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b; associative."""
        return {s: (b[t][0], n + b[t][1]) for s, (t, n) in a.items() if t in b}

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        text = META + text.replace(" ", META)
        cuts = self.pieces.cuts(text, chunk)
        maps = [self.chunk_map(text, a, b) for a, b in zip(cuts, cuts[1:])]
        while len(maps) > 1:  # a level of the scan's tree
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0][Automaton.START][1]


_loaded: dict[str, CountTransducer] = {}


def transducer(model_file: str) -> CountTransducer:
    """One transducer for each model in a Python worker, shared by its tasks."""
    if model_file not in _loaded:
        _loaded[model_file] = CountTransducer(Pieces(model_file))
    return _loaded[model_file]


def with_token_counts(docs: DataFrame, model_file: str, limit: int = 4096, *, text: str = "text", counts: str = "n_tokens", size: str = "n_bytes", over: str = "over_limit") -> DataFrame:
    """docs with its texts' UTF-8 bytes, tokens (as the sentencepiece library gives them) and whether those exceed `limit`.

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each; columns that have one of the
    three names are replaced; an empty table gives an empty one. Nothing is shuffled, texts of any length are read whole.
    """

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = transducer(model_file).count
        for batch in batches:
            yield pa.array([count(t) for t in batch.to_pylist()], pa.int64())

    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(size, F.octet_length(whole).cast("long")).withColumn(counts, tokens(whole)).withColumn(over, F.col(counts) > limit)
