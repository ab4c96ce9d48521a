"""Sentence pieces of a BPE model as a lattice of compatible tokens.

BPE merging has a local test: a sequence of tokens is the encoding of its own text exactly if each adjacent pair is
the encoding of the pair's text. So the encoding is the one path through the lattice of vocabulary pieces on which all
adjacent pairs are compatible, and a prefix of a path is the encoding of its text too: given where a path starts, at most
one token can end at each position. Token counting (token_counts.py) and encoding (piece_codec.py) both rest on this.

Three things bound a path. A character without a piece of its own becomes one byte token for each UTF-8 byte and nothing
merges across it. A meta space follows a non-space: no piece of the model spans that boundary (checked when loading), so
a text splits into words. In runs of meta spaces the pieces have one and the same, worst score: they merge last, leftmost
first, which `space_run` does by itself. All searches end with the chunk they are for, so a text of any length without a
boundary, or of nothing but spaces, takes time in proportion to its length.
"""

from __future__ import annotations

import re

from sentencepiece import sentencepiece_model_pb2

META = "▁"
NORMAL, BYTE = 1, 6
NEVER = -float("inf")


class Pieces:
    """The vocabulary of a model file; `limit` bounds the table of tested pairs, which is emptied when full."""

    def __init__(self, model_file: str, limit: int = 50_000):
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a BPE model with identity normalisation and a dummy prefix is needed")
        self.names = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if any(META in p.lstrip(META) for p in self.ids) or len(self.byte_ids) < 256:
            raise ValueError("pieces with inner meta spaces, or without byte fallback, aren't supported")
        self.chars = {p for p in self.ids if len(p) == 1}
        known = re.escape("".join(sorted(self.chars)))
        self.known = f"[{known}]*"
        self._edge = re.compile(f"(?<=[^{META}]){META}|(?=[^{known}])|(?<=[^{known}])|\\Z", re.S)
        self.prefixes = {p[:i] for p in self.ids for i in range(len(p) + 1)}
        self.longest = max(map(len, self.ids))
        #: What decoding puts for each id: the piece's bytes, or the byte itself, or nothing.
        self.surface = [p.piece.replace(META, " ").encode() if p.type == NORMAL else b"" for p in proto.pieces]
        for byte, i in self.byte_ids.items():
            self.surface[i] = bytes([byte])
        self.limit = limit
        self._fits: dict[tuple[str, str], bool] = {}
        self._runs: dict[int, tuple[int, ...]] = {0: ()}
        self._no_meta = re.compile(f"[^{META}]")
        #: Meta spaces in the longest piece of them.
        self.widest = max(len(p) for p in self.ids if not p.strip(META))
        if self._merged(self.widest) != [self.widest]:
            raise ValueError("the longest piece of meta spaces doesn't come from merging them")

    def fits(self, left: str, right: str) -> bool:
        """Whether right can follow left: their joint text merges to just these two. left is empty at the start."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= self.limit:
                self._fits.clear()
            known = self._fits[key] = self._merges_to(left, right)
        return known

    def _merges_to(self, left: str, right: str) -> bool:
        """Plain BPE: merge the best-scored adjacent pair, the leftmost of equals, until none is left or the seam goes."""
        parts, scores, wanted = list(left + right), self.scores, 2 if left else 1
        pairs = [scores.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        seam = len(left)  # the part that begins right
        while pairs and (best := max(pairs)) > NEVER:
            at = pairs.index(best)
            if at + 1 == seam:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = scores.get(parts[at] + parts[at + 1], NEVER)
            if at:
                pairs[at - 1] = scores.get(parts[at - 1] + parts[at], NEVER)
            seam -= at < seam
        return len(parts) == wanted

    def ending(self, text: str, at: int, first: int = 0) -> list[tuple[int, str]]:
        """Pieces of the text that end at a position and start at `first` or later: (start, piece), the longest first."""
        low = max(first, at - self.longest)
        return [(i, text[i:at]) for i in range(low, at) if text[i:at] in self.ids]

    def certain(self, text: str, at: int) -> bool:
        """Whether a token ends here for certain: at either end of a text, by a character without a piece, and before the
        first of some meta spaces."""
        return at in (0, len(text)) or text[at] not in self.chars or text[at - 1] not in self.chars or (text[at] == META != text[at - 1])

    def first_certain(self, text: str, at: int, stop: int) -> int | None:
        """The first such place from `at` to `stop`, if any."""
        if at == 0:
            return 0
        found = self._edge.search(text, at, stop + 1)  # no further: what is behind a chunk is looked at with the next one
        return found.start() if found and found.start() <= stop else None

    def last_certain(self, text: str, at: int, first: int) -> int:
        """The last such place up to `at`; one is at `first` or behind it."""
        while at > first and not self.certain(text, at):
            if text[at] == META == text[at - 1]:  # within a run of spaces: on to its first one
                at = first + len(text[first:at].rstrip(META))
            else:
                at -= 1
        return max(at, first)

    def word_start(self, text: str, at: int, reach: int) -> int | None:
        """Where the word begins (with its meta space) that a place within it is in; None if further back than `reach`."""
        for i in range(at - 1, max(-1, at - 1 - reach), -1):
            if text[i] == META:
                return i
            if text[i] not in self.chars:
                return i + 1
        return 0 if at <= reach else None

    def cuts(self, text: str, chunk: int) -> list[int]:
        """Places to cut a text into chunks: multiples of `chunk`, anywhere in a word, but never behind the first of several meta
        spaces, nor between those and a word: then before them."""
        out, covered = [0], 0
        for at in range(chunk, len(text), chunk):
            if at <= covered:  # in a run of spaces that has been cut before
                continue
            if text[at - 1] == META and (text[at] == META or text[at - 2 : at - 1] == META):
                behind = self._no_meta.search(text, at)
                covered = behind.start() if behind else len(text)
                at = out[-1] + len(text[out[-1] : at].rstrip(META))
            if at > out[-1]:
                out.append(at)
        return [*out, len(text)]

    def last_space(self, text: str, at: int, stop: int) -> int:
        """The last of the meta spaces that begin at a place, before `stop`; the place itself if there are none."""
        behind = self._no_meta.search(text, at, stop)
        return max(at, (behind.start() if behind else stop) - 1)

    def covering(self, text: str, at: int) -> list[tuple[int, int, str]]:
        """The pieces (start, end, piece) that can cover a cut, or end there; one empty piece where a token ends for certain."""
        if self.certain(text, at):
            return [(at, at, "")]
        start, last = self.word_start(text, at, self.longest), min(len(text), at + self.longest - 1)
        return [(i, j, p) for j in range(at, last + 1) for i, p in self.ending(text, j, start or 0) if i < at]

    def space_run(self, length: int) -> tuple[int, ...]:
        """Ids of a run of meta spaces that nothing else has merged with: leftmost merges first. As soon as the longest piece of meta
        spaces is there, it merges no more, so a long run begins with as many of these as it can hold."""
        if length >= self.widest:
            return (self.ids[META * self.widest],) * (length // self.widest) + self.space_run(length % self.widest)
        if length not in self._runs:
            self._runs[length] = tuple(self.ids[META * n] for n in self._merged(length))
        return self._runs[length]

    def _merged(self, length: int) -> list[int]:
        done: list[int] = []
        for _ in range(length):
            done.append(1)
            while len(done) > 1 and META * (done[-2] + done[-1]) in self.ids:
                done[-2:] = [done[-2] + done[-1]]
        return done

    def fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]


class Automaton:
    """The lattice's forward pass over words, as a deterministic transducer that is compiled as far as texts need it.

    A state keeps what later characters can still ask for: the longest suffix of the text so far that begins a piece, and
    for each position in it the last token of the encoding up to there, with its token count relative to that of the last
    position that has one. A position that no path reaches, as there are behind a piece that a word doesn't really have, has
    none. States are finitely many; a character leads to one next state, and its transition is annotated with the change of
    the token count and the length of the token that now is the last (0 for none, and for a character without a piece,
    whose bytes are counted). Transitions are compiled when first taken; when there are more than `limit` of them, all are
    forgotten. So across walks a state is known by its meaning, not its number.
    """

    START, LOST = ("", (("", 0),)), ("", (None,))

    def __init__(self, pieces: Pieces, limit: int = 800_000):
        self.pieces, self.limit = pieces, limit
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.meanings: list[tuple] = []
        self.ends: dict[tuple[str, int], tuple[str, int]] = {}  # equal ones share memory
        self.steps: list[dict[str, tuple[int, int, int]]] = []
        self.size = 0
        self.start = self._number(self.START)

    def _number(self, meaning: tuple) -> int:
        number = self.numbers.get(meaning)
        if number is None:
            number = self.numbers[meaning] = len(self.meanings)
            self.meanings.append(meaning)
            self.steps.append({})
        return number

    @staticmethod
    def behind(piece: str) -> tuple:
        """The state behind a piece, whatever was before it."""
        return ("", ((piece, 0),))

    def _compile(self, state: int, char: str) -> tuple[int, int, int]:
        pieces = self.pieces
        suffix, ends = self.meanings[state]
        if char not in pieces.chars:
            return (self.start, len(char.encode("utf-8", "surrogatepass")), 0) if ends[-1] else (self._number(self.LOST), 0, 0)
        text, ids, fits = suffix + char, pieces.ids, pieces.fits
        length = count = 0
        for at in range(len(text)):  # at most one token can end here, from the start of a word exactly one
            token = text[at:]
            if ends[at] and token in ids and fits(ends[at][0], token):
                length, count = len(token), ends[at][1] + 1
                break
        ends = (*ends, (token, count) if length else None)
        cut = 0
        while text[cut:] not in pieces.prefixes or len(text) - cut >= pieces.longest:
            cut += 1
        left = tuple([self.ends.setdefault(e := (x[0], x[1] - count), e) if x else None for x in ends[cut:]])
        return self._number((text[cut:], left) if any(left) else self.LOST), count, length

    def walk(self, text: str, meaning: tuple | None = None) -> list[tuple[int, int, int]]:
        """The transitions that a word takes, from the start or from a state."""
        if self.size > self.limit:
            self._reset()
        state, taken, steps = self._number(meaning) if meaning else self.start, [], self.steps
        for char in text:
            step = steps[state].get(char)
            if step is None:
                step = steps[state][char] = self._compile(state, char)
                self.size += 1
            state = step[0]
            taken.append(step)
        return taken

    def run(self, text: str, meaning: tuple) -> tuple[tuple, int]:
        """The state behind a text, and the tokens up to its last position that has one."""
        taken = self.walk(text, meaning)
        return (self.meanings[taken[-1][0]] if taken else meaning), sum([x[1] for x in taken])

    @staticmethod
    def traced(text: str, taken: list[tuple[int, int, int]], at: int) -> list[str]:
        """The tokens of text[:at], whose transitions were taken: the last, then the one before it, and so on."""
        tokens = []
        while at:
            tokens.append(text[at - taken[at - 1][2] : at])
            at -= taken[at - 1][2]
        return tokens[::-1]

    def path(self, text: str) -> list[str]:
        """The tokens of a word whose characters are all pieces."""
        return self.traced(text, self.walk(text), len(text))
