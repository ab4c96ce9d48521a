"""Operator 10, secret scans by a trigram inverted index.

Each rule's parsed regular expression gives a Boolean query over trigrams: alternatives of lists of trigrams, one of which
any match holds as a whole (`trigram_query`). Texts are indexed block by block (an Arrow batch is a block): one pass over a
text's trigrams sets its row in the postings of those that the rules ask for. Lists intersect, alternatives unite, and the
expression runs over the candidate texts alone, as wholes. An expression without a mandatory trigram (hex runs, which
have no fixed letters) has the query "every row".

Base rules come first and keep all their spans; further rules add theirs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from re import _constants as C
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of hexadecimal digits; 24 or more of them count as a secret.
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24


#: What stands for any characters in a string of an expression; most strings of one, and characters of a class among them.
ANY, MOST, MOST_IN_CLASS = "\uffff", 64, 8


def _letter(code: int, flags: int) -> str:
    """A literal as it stands in lower-case text; ANY if it isn't ASCII or has a case outside ASCII (i, k and s)."""
    c = chr(code).lower()
    return ANY if not 0 < code < 128 or flags & re.IGNORECASE and not flags & re.ASCII and c in "iks" else c


def _joined(left: set[str], right: set[str]) -> set[str]:
    return {x + y for x in left for y in right} if len(left) * len(right) <= MOST else {x + ANY for x in left}


def _strings(nodes, flags: int) -> set[str]:
    """Strings with ANY, one of which each match of a parsed sequence fits."""
    out = {""}
    for op, arg in nodes:
        if op is C.LITERAL:
            new = {_letter(arg, flags)}
        elif op is C.IN and all(o in (C.LITERAL, C.RANGE) for o, _ in arg):
            codes = [c for o, a in arg for c in ([a] if o is C.LITERAL else range(a[0], min(a[1], a[0] + 2 * MOST_IN_CLASS) + 1))]
            new = {_letter(c, flags) for c in codes}
            new = new if len(new) <= MOST_IN_CLASS and ANY not in new else {ANY}
        elif op is C.BRANCH:
            new = set().union(*(_strings(x, flags) for x in arg[1]))
        elif op is C.SUBPATTERN:
            # a group that sets its alphabet to Unicode is ASCII no more
            new = _strings(arg[3], (flags | arg[1]) & ~arg[2] & ~(re.ASCII if arg[1] & re.UNICODE else 0))
        elif op is C.ATOMIC_GROUP:
            new = _strings(arg, flags)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = arg
            new = _strings(inner, flags) if least or most == 1 else {ANY}
            new = new | {""} if not least and most == 1 else new if most == 1 else _joined(new, {ANY})
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue  # without a width
        else:
            new = {ANY}
        out = _joined(out, new)
        if len(out) > MOST:
            out = {ANY}
    return out


@lru_cache(256)
def trigram_query(pattern: re.Pattern) -> list[list[str]]:
    """Alternatives of conjunctions of lower-case trigrams, one of which each match holds; [[]] if none is mandatory."""
    found = {frozenset(part[i : i + 3] for part in x.split(ANY) for i in range(len(part) - 2)) for x in _strings(_parser.parse(pattern.pattern, pattern.flags), pattern.flags)}
    return sorted(sorted(x) for x in found if not any(y < x for y in found))


class Rule(NamedTuple):
    kind: str
    pattern: re.Pattern
    valid: Callable[[re.Match], bool] = lambda m: True

    def query(self) -> list[list[str]]:
        return trigram_query(self.pattern)


#: The three base kinds.
BASE = (
    Rule("assign", re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= MIN_VALUE),
    Rule("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= MIN_ACCESS),
    # runs are maximal, so short ones can be left out by the expression itself
    Rule("hex", re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{MIN_HEX},}}")),
)
MORE = (
    Rule("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    Rule("web_token", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    Rule("host_token", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    Rule("chat_token", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    Rule("maps_key", re.compile(r"\bAIza[A-Za-z0-9_-]{35}")),
    Rule("url_login", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:[^\s/@]+@")),
)
RULES = BASE + MORE


@lru_cache(16)
def _numbers(rules: tuple[Rule, ...]) -> tuple[dict[str, int], np.ndarray]:
    """The trigrams that rules ask for, numbered from 1 on, and their numbers by three codes of 7 bits; 0 for others."""
    numbers = {t: i for i, t in enumerate(sorted({t for r in rules for ts in r.query() for t in ts}), 1)}
    table = np.zeros(1 << 21, np.int16 if len(numbers) < 1 << 15 else np.int32)
    for t, i in numbers.items():
        table[ord(t[0]) << 14 | ord(t[1]) << 7 | ord(t[2])] = i
    return numbers, table


class BlockIndex:
    """The trigram index of a block of texts: for each trigram that the rules ask for, the rows that hold it."""

    def __init__(self, texts: list[str], rules: tuple[Rule, ...] = RULES, part: int = 1 << 20):
        self.numbers, table = _numbers(rules)
        self.postings = np.zeros((len(self.numbers) + 1, len(texts)), bool)
        for row, text in enumerate(texts):
            data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
            for start in range(0, len(data) - 2, part):
                codes = data[start : start + part + 2].astype(np.int32)
                codes[codes > 127] = 0  # no trigram of a query has it
                self.postings[table[codes[:-2] << 14 | codes[1:-1] << 7 | codes[2:]], row] = True

    def candidates(self, rule: Rule) -> list[int]:
        found = np.zeros(self.postings.shape[1], bool)
        for trigrams in rule.query():
            found |= self.postings[[self.numbers[t] for t in trigrams]].all(axis=0)
        return np.flatnonzero(found).tolist()


Span = tuple[int, int, str]


def scan_block(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[Span]]:
    """Spans (start, end, kind) in code points of each text, by start, then in the order of the rules."""
    index, found = BlockIndex(texts, rules), [[] for _ in texts]
    for rank, rule in enumerate(rules):
        for i in index.candidates(rule):
            found[i] += [(m.start(), rank, m.end(), rule.kind) for m in rule.pattern.finditer(texts[i]) if rule.valid(m)]
    return [[(start, end, kind) for start, _, end, kind in sorted(spans)] for spans in found]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<kind, start, end>> of a text column; a null text counts as empty and has none."""

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = scan_block([t or "" for t in batch.to_pylist()], rules)
            yield pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in spans] for spans in found], pa.list_(_SPAN))

    return scan(text)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_REPORT = pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = MORE, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, spans of each base kind, a digest of the base spans, and all spans (base and `rules`) as a string.

    One row for each row of docs, repeated ones and null ids too; null and empty texts have no spans, and the digest of
    an empty string. Texts of any length are read whole; an empty table gives an empty one. Only id and text of docs are read, so other columns can't clash; nothing is shuffled.
    """
    base = {r.kind for r in BASE}

    @F.arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>")
    def report(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for spans in scan_block([t or "" for t in batch.to_pylist()], BASE + rules):
                own = [s for s in spans if s[2] in base]
                count = [sum(s[2] == r.kind for s in own) for r in BASE]
                rows.append((*count, hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans)))
            yield pa.array(rows, _REPORT)

    return docs.select(F.col(id), report(F.col(text)).alias("_report")).select(id, "_report.*")


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each secret in its texts replaced by a mark (overlapping spans by one); null texts stay null, empty ones empty.
    All other columns, of whatever names, stay as they are, so do repeated rows; an empty table gives an empty one."""

    @F.arrow_udf("string")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, out = batch.to_pylist(), []
            for whole, spans in zip(texts, scan_block([t or "" for t in texts], rules), strict=True):
                if not spans:
                    out.append(whole)
                    continue
                parts, at = [], 0
                for start, end, _ in spans:
                    if start >= at:
                        parts += [whole[at:start], mark]
                    at = max(at, end)
                out.append("".join(parts) + whole[at:])
            yield pa.array(out, pa.string())

    return docs.withColumn(text, mask(F.col(text)))
