"""Conversation repair, license scan and vector codes against brute force, with odd inputs."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.oracle import connect, same_rows
from tidewell.llm import conversation_repair as C
from tidewell.llm import license_scan as L
from tidewell.llm import queries
from tidewell.llm import vector_codes as V

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_conversation_repair", "op12_license_scan", "op13_vector_codes"])
def test_query_equals_its_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])


NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def best_repair(rows: list[tuple[str, str, str]]) -> tuple[int, str, list[str]]:
    """The cheapest repair, of equals the least audit: (cost, audit, lines), by plain recursion over all edits. rows: role, text, fault."""

    @functools.cache
    def rest(i: int, last: str, inserts: int) -> tuple[int, str, tuple[str, ...]]:
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def edit(letter: str, cost: int, j: int, role: str | None, text: str, used: int = 0) -> None:
            if role is None or role[:1] in [*NEXT[last]]:
                more = rest(j, role[0] if role else last, used)
                found.append((cost + more[0], letter + more[1], (*([] if role is None else [f"{role}:{text}"]), *more[2])))

        if inserts < 2:
            edit("I", 3, i, "user", "", inserts + 1)
            edit("I", 3, i, "assistant", "", inserts + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            edit("D", 4, i + 1, None, "")
            if fault not in ("blank", "duplicate"):
                t = 3 * (fault == "truncated")
                edit("K", t, i + 1, role, text)
                edit("R", 3 + t, i + 1, "user", text)
                edit("R", 3 + t, i + 1, "assistant", text)
        return min(found, default=(1 << 40, "", ()))

    cost, audit, lines = rest(0, "", 0)
    return cost, audit, list(lines)


def expected_repairs(rows: list[tuple]) -> dict:
    damaged, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        damaged[conv] += [(turn, "user" if what == 4 else role, text)] * {0: 0, 3: 2}.get(what, 1)
    for conv, turns in damaged.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = best_repair([(r, t, f) for (_, r, t), f in zip(turns, faults, strict=True)])
        out[conv] = (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    rows = [(c, rnd.choice([0, 1, 2, 3, 3, 5, None]), rnd.choice(["user", "assistant", "system", "tool", "", None]), rnd.choice(["Hi.", "Yes!", "no", "", " \n", None, "Fin. \t", "x" * 70 + ".", "x" * 70 + "a."])) for c in [*range(n), None] for _ in range(rnd.randint(1, 4))]
    return rows + [(n, 0, "user", "Hi.")] * 3 + [(n, 1, "assistant", "Oh?")]


@pytest.mark.parametrize("block", [1, 2, 1024])
def test_repairs_are_the_cheapest_of_all(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = conversations(block, 60)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, _key int")
    got = {r[0]: tuple(r)[1:] for r in C.repair_report(table).collect()}
    assert got == expected_repairs(rows)
    assert C.repair_report(table.where("false")).count() == 0


def test_long_conversations_of_many_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(7, i, rnd.choice(["user", "assistant", "user"]), rnd.choice(["Hi.", f"T {i}.", f"t {i}"])) for i in range(3000)] + [(7, 4000, "user", "Again.")] * 500
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = [tuple(r) for r in C.repair_report(table).collect()]
    monkeypatch.setattr(C, "BLOCK", 64)
    assert [tuple(r) for r in C.repair_report(table).collect()] == whole and len(whole) == 1
    assert len(whole[0][7]) >= 3000 and whole[0][3] >= 499


LICENSED = [
    (1, "It is Under the MIT-license; under the mit license."), (2, "CC BY-NC 4.0 and the Apache License, Version 2.0"), (3, None), (4, ""), (4, ""), (None, "cc by"),
    (5, "é under the mit licenseé"), (6, "Permission is hereby granted, free of cost, to any person obtaining a copy of this software and associated documentation files (the Software), to deal with the Software without restriction"),
    (7, "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), (8, "cc by nc " * 40_000), (9, "w" * 300_000 + " cc by nc"),
    (10, "redistribution and use of binary forms"), (11, "licensed under the GNU General Public License, version 3"),
]


def test_licenses_in_odd_texts(spark):
    table = spark.createDataFrame([(i, t, "x", 3) for i, t in LICENSED], "doc_id long, text string, labels string, _row int")
    out = sorted(map(tuple, L.license_report(table).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert len(out) == len(LICENSED)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for (i, text), row in zip(sorted(LICENSED, key=lambda r: (r[0] is None, r[0] or 0)), out, strict=True):
        words = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        phrases = [(n.label, n.words.split()) for n in L.BASE]
        places = [(p, label) for p in range(len(words)) for label, w in phrases if words[p : p + len(w)] == w]
        assert row[:6] == (i, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
    labels = {r[0]: (r[6], r[7]) for r in out}
    assert labels[1] == ("mit", 1.0) and labels[2] == ("apache-2,cc-by-nc", 1.0) and labels[3] == labels[4] == ("", 0.0)
    assert labels[6][0] == "mit" and 0.4 < labels[6][1] < 1 and labels[7][0] == "cc-by-nc" and labels[10][0] == "" and 0 < labels[10][1] < 0.6 and labels[11][0] == "gpl-3"
    assert L.license_report(table.where("false")).count() == 0


def test_windows_are_the_same_however_texts_are_cut(monkeypatch):
    rnd, own = random.Random(3), L.Windows(L.BASE + L.NOTICES)
    for _ in range(200):
        text = "".join(rnd.choice(["under ", "the ", "MIT", "-", " license", "é", "\n", "  "]) for _ in range(rnd.randint(0, 60))).encode()
        found = []
        for size in (1 << 20, 7):
            monkeypatch.setattr(L, "PIECE", size)
            pieces = list(own.pieces(text))
            hashes = [(p + i, int(h)) for p, hs, _ in pieces for i, h in enumerate(hs)]
            found.append((hashes, [(p + i, w) for p, _, s in pieces for i, w in s], pieces[-1][0]))
        assert found[0] == found[1]
        assert [p for p, _ in found[0][0]] == list(range(max(0, found[0][2] - 2)))


def test_nearest_entries_are_exact():
    rnd = np.random.default_rng(1)
    for width, most in ((16, 300), (1, 2), (5, 2), (16, V.LARGEST), (0, 1)):
        entries, rows = rnd.integers(-most, most + 1, (200, width)), rnd.integers(-most, most + 1, (500, width))
        index, distance = V.Codebook(entries).nearest(rows)
        plain = ((rows[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def plain_codes(rows: list[tuple], entries: int, parts: int, rounds: int) -> list[tuple]:
    kept = [(i, np.floor(np.array(v, float) * 1024).astype(int), label) for i, v, label in rows]
    size, first = len(kept[0][1]), {}
    for i, v, _ in sorted([r for r in kept if r[0] is not None], key=lambda r: (r[0], r[1].tolist())):
        first.setdefault(i, v)
    edges, books, found = [size * p // parts for p in range(parts + 1)], [], []
    for a, b in itertools.pairwise(edges):
        book, data = np.array([first[i] for i in sorted(first)[:entries]])[:, a:b], np.array([v[a:b] for _, v, _ in kept])
        for _ in range(rounds):
            near = ((data[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
            book = np.array([data[near == e].sum(axis=0) // (near == e).sum() if (near == e).any() else book[e] for e in range(len(book))])
        square = ((data[:, None] - book[None]) ** 2).sum(axis=2)
        books.append(book)
        found.append((square.argmin(axis=1), square.min(axis=1)))
    errors, sums = sum(d for _, d in found), defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        sums[label] += int(e)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return [(i, "".join(f"{n[k]:02x}" for n, _ in found), int(errors[k]), sums[label], digest) for k, (i, _, label) in enumerate(kept)]


@pytest.mark.parametrize("size", [8, 6, 3])
def test_codes_equal_plain_ones(spark, size):
    rnd = np.random.default_rng(size)
    rows = [(int(i), rnd.normal(size=size).round(3).tolist(), [None, 1, 2][i % 3]) for i in range(60)]
    rows += [rows[3], (3, rnd.normal(size=size).tolist(), 1), (None, rnd.normal(size=size).tolist(), None), (2, [0.5] * size, 2), (99, [0.0] * size, 1)]
    odd = [(100, None, 1), (101, [], 1), (102, [None] + [0.0] * (size - 1), 1), (103, [float("nan")] * size, 1), (104, [float("-inf")] * size, 1), (105, [1.0] * (size + 1), 1)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, code string").repartition(3)
    got = sorted(map(tuple, V.vector_codes(table, entries=16).collect()), key=str)
    assert got == sorted(plain_codes(rows, 16, 4, 4), key=str)
    assert V.vector_codes(table.where("false")).count() == V.vector_codes(table.where("vec_id > 99")).where("vec_id <> 105").count() == 0
