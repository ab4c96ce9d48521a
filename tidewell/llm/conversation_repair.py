"""Conversations damaged on purpose, and their cheapest repair.

A repair leads from the first row to the last through a small graph: its nodes are (place before a row, state of the role pattern),
its arcs keep, rerole, delete or insert a turn. Forward and backward minimum costs tell which arcs lie on a cheapest repair: those
where cost up to the arc + its cost + cost behind it is the total. Along them a walk takes the least edit letter at each step, with
all nodes that the letters so far can lead to as its frontier.

Rows are ordered by a range shuffle, so a conversation of any length is spread over tasks, and cut into blocks of at most BLOCK rows.
A block is a 4 x 4 matrix of costs from state to state; a conversation with several blocks is a min-plus product of these, by
which each block learns its costs at either end, and then walks by itself from each state that a cheapest repair can enter it in.
Up to there no texts are moved, only their digests. Only the digest of a repaired conversation is sequential: texts and
edits meet once, sorted, and are hashed as they pass, with nothing held but the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import discard, materialise

WHITE = " \t\n\x0b\x0c\r"
#: Rows of a block; it changes no result.
BLOCK = 1024
#: States: nothing yet, behind system, behind user, behind assistant. The turn that an edit can make in each, and the state after it.
ROLES, MADE, START, ACCEPTING = ("", "system", "user", "assistant"), (2, 2, 3, 2), 0, (0, 3)
#: (state, initial: 0 s, 1 u, 2 a, 3 other) -> state, where a row can stay as it is.
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
DELETE, REROLE, INSERT, TRUNCATED, NEVER = 4, 3, 3, 3, 1 << 60
FORCED, SHORT = 4, 8  # flags of a row's code beside its initial

Costs = list[int]
Row = tuple[int, int]  # code, number of copies: all but the first are deleted


def _arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done to a row, by letter."""
    found = [("D", DELETE, state)]
    if not code & FORCED:
        more = TRUNCATED if code & SHORT else 0
        if (state, code & 3) in KEPT:
            found.append(("K", more, KEPT[state, code & 3]))
        found.append(("R", REROLE + more, MADE[state]))
    return found


ARCS = [[_arcs(code, q) for q in range(4)] for code in range(16)]


def with_inserts(costs: Sequence[int]) -> Costs:
    """Costs behind a place, if turns may be inserted there first."""
    return [min(costs[q], INSERT + costs[MADE[q]], 2 * INSERT + costs[MADE[MADE[q]]]) for q in range(4)]


def inserted(costs: Sequence[int]) -> Costs:
    """Costs up to a place, if turns may be inserted there."""
    out = list(costs)
    for _ in range(2):
        for q in range(4):
            out[MADE[q]] = min(out[MADE[q]], out[q] + INSERT)
    return out


AT_END = with_inserts([0 if q in ACCEPTING else NEVER for q in range(4)])


def backward(rows: Sequence[Row], leave: Sequence[int]) -> list[Costs]:
    """Costs behind each place before a row, and behind the last row."""
    out = [list(leave)]
    for code, n in reversed(rows):
        after, more = out[-1], DELETE * (n - 1)
        out.append(with_inserts([more + min([w + after[t] for _, w, t in ARCS[code][q]]) for q in range(4)]))
    return out[::-1]


def forward(rows: Sequence[Row], enter: Sequence[int]) -> list[Costs]:
    """Costs up to each place before a row (inserts there included), and up to behind the last row (without)."""
    out, now = [], list(enter)
    for code, n in rows:
        now = inserted(now)
        out.append(now)
        after, more = [NEVER] * 4, DELETE * (n - 1)
        for q in range(4):
            for _, w, t in ARCS[code][q]:
                after[t] = min(after[t], now[q] + w + more)
        now = after
    return [*out, now]


def transfer(rows: Sequence[Row]) -> list[Costs]:
    """Costs from each state before a block to each state behind it."""
    columns = [backward(rows, [0 if q == t else NEVER for q in range(4)])[0] for t in range(4)]
    return [list(x) for x in zip(*columns)]


def walks(rows: Sequence[Row], enter: Sequence[int], leave: Sequence[int], last: bool) -> dict[int, tuple[str, int]]:
    """For each state in which a cheapest repair can enter a block: the least letters, and the state behind them."""
    f, b = forward(rows, enter), backward(rows, leave)
    total = min(x + y for x, y in zip(inserted(enter), b[0], strict=True))
    found = {}
    for entry in range(4):
        if enter[entry] + b[0][entry] != total:
            continue
        letters, frontier = [], {entry}
        for i, (code, n) in enumerate(rows):
            before, behind, more, letter = f[i], b[i + 1], DELETE * (n - 1), "I"
            while letter == "I":
                options: dict[str, set[int]] = {}
                for q in frontier:
                    if before[q] + INSERT + b[i][MADE[q]] == total:
                        options.setdefault("I", set()).add(MADE[q])
                    for x, w, t in ARCS[code][q]:
                        if before[q] + w + more + behind[t] == total:
                            options.setdefault(x, set()).add(t)
                letter = min(options)
                frontier = options[letter]
                letters.append(letter)
            letters.append("D" * (n - 1))
        while last and not frontier & set(ACCEPTING):
            frontier = {MADE[q] for q in frontier}
            letters.append("I")
        found[entry] = ("".join(letters), min(frontier))
    return found


def damage(rows: DataFrame, id: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows after damage by a checksum of `id:turn` (nulls written as one space): _gone, or with _copies, _role and _text. _key tells
    conversations apart, null ids too; _known and _turn order rows, unknown turns first."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col(id).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    what = F.crc32(key.cast("binary")) % 20
    plain, gone = F.coalesce(F.col(text), space), what == 0
    changed = F.when(what == 1, "").when(what == 2, F.translate(plain, ".!?", "")).otherwise(plain)
    number = F.col(turn).cast("long")
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(id).cast("string")), F.lit("")).alias("_key"), F.col(id).alias("_id"), gone.alias("_gone"),
        (number.isNotNull() & ~gone).alias("_known"), F.when(gone, 0).otherwise(F.coalesce(number, F.lit(0))).alias("_turn"),
        F.when(gone, "").when(what == 4, "user").otherwise(F.coalesce(F.col(role), space)).alias("_role"), F.when(gone, "").otherwise(changed).alias("_text"),
        F.when(what == 3, 2).otherwise(1).cast("long").alias("_copies"),
    )


#: What rows of a conversation are ordered by: turns, and where these are equal, roles and texts (beyond 64 characters their digests).
PLACE = ("_known", "_turn", "_role", "_head", "_digest")


def _placed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_head": F.substring("_text", 1, 64), "_digest": F.md5(F.col("_text").cast("binary"))})


def _codes(rows: DataFrame) -> DataFrame:
    """Rows without their texts, equal ones as one with their number, with _blank, _first and _code, in order by _ord."""
    trimmed = F.rtrim(F.col("_text"), F.lit(WHITE))
    light = rows.withColumns({"_blank": trimmed == "", "_short": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")})
    light = materialise(light.groupBy("_key", "_gone", *PLACE, "_blank", "_short").agg(F.sum("_copies").alias("_n"), F.max("_id").alias("_id")), "turns")
    same = ["_key", "_role", "_head", "_digest"]
    repeated = light.where(~F.col("_gone")).groupBy(*same).agg(F.min(F.struct("_known", "_turn")).alias("_least"), F.count("*").alias("_rows")).where("_rows > 1")
    joined = light.join(repeated.drop("_rows"), same, "left")  # a hot conversation's rows differ in these columns
    first = F.col("_least").isNull() | (F.struct("_known", "_turn") == F.col("_least"))
    initial = F.when(F.col("_role").startswith("s"), 0).when(F.col("_role").startswith("u"), 1).when(F.col("_role").startswith("a"), 2).otherwise(3)
    flags = F.when(F.col("_blank") | ~first, FORCED).when(F.col("_short"), SHORT).otherwise(0)
    coded = joined.select("_key", "_id", "_gone", *PLACE, "_n", "_blank", first.alias("_first"), (initial + flags).alias("_code"))
    ordered = coded.repartitionByRange("_key", *PLACE).sortWithinPartitions("_key", *PLACE)
    out = materialise(ordered.withColumn("_ord", F.monotonically_increasing_id()), "order")  # partition, then row
    discard(light)
    return out


def _stats(codes: DataFrame) -> DataFrame:
    n, count = F.col("_n"), lambda x: F.sum(F.when(x, F.col("_n")).otherwise(0))
    here = ~F.col("_gone")
    spare = F.sum(F.when(here & ~F.col("_blank"), n - F.col("_first").cast("long")).otherwise(0))
    turns = codes.groupBy("_key", "_known", "_turn").agg(
        F.max("_id").alias("_id"), count(here & F.col("_blank")).alias("blank"), spare.alias("duplicate"), F.count_if(here & (F.col("_code") >= SHORT)).alias("truncated")
    )
    known = F.when(F.col("_known"), F.col("_turn"))
    gaps = F.coalesce(F.max(known) - F.min(known) + 1 - F.count_if("_known"), F.lit(0))
    return turns.groupBy("_key").agg(F.max("_id").alias("_id"), gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def _blocks(codes: DataFrame) -> DataFrame:
    """_key, _block, _rows (at most BLOCK, in order) and the place of the first of them."""
    block = F.shiftright("_ord", 33) * (1 << 33) + (F.col("_ord") % (1 << 33)) - (F.col("_ord") % (1 << 33)) % BLOCK
    rows = F.array_sort(F.collect_list(F.struct("_ord", "_code", "_n")))
    grouped = codes.where(~F.col("_gone")).groupBy("_key", block.alias("_block")).agg(rows.alias("_rows"), F.min(F.struct("_ord", *PLACE)).alias("_at"))
    return grouped.select("_key", "_block", F.transform("_rows", lambda r: F.struct(r["_code"].alias("c"), r["_n"].alias("n"))).alias("_rows"), *[F.col("_at")[c].alias(c) for c in PLACE])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few blocks at a time, whose rows are looked at as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def _rows_of(value) -> list[Row]:
    return [(r["c"], r["n"]) for r in value]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        found = []
        for value in batch.column(2).to_pylist():
            rows = _rows_of(value)
            found.append([x for line in transfer(rows) for x in line] + [rows[-1][0] & 3])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["_key", "_block", "_matrix"])


def _ends(rows: pd.DataFrame) -> pd.DataFrame:
    """What the blocks of one conversation cost up to their beginning and behind their end, and the initial before them."""
    rows = rows.sort_values("_block")
    matrices = [list(m) for m in rows["_matrix"]]
    enter, leave, initial = [[0, NEVER, NEVER, NEVER]], [AT_END], [-1]
    for m in matrices[:-1]:
        enter.append([min(NEVER, *(enter[-1][q] + m[4 * q + t] for q in range(4))) for t in range(4)])
        initial.append(m[16])
    for m in matrices[:0:-1]:
        leave.append([min(NEVER, *(m[4 * q + t] + leave[-1][t] for t in range(4))) for q in range(4)])
    last = [False] * (len(matrices) - 1) + [True]
    return pd.DataFrame({"_key": rows["_key"].to_list(), "_block": rows["_block"].to_list(), "_enter": enter, "_leave": leave[::-1], "_before": initial, "_last": last})


_WALKED = "_key string, _block long, _entry int, _exit int, _letters string, _cost long, _illegal long"


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _WALKED.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
    for batch in _slices(batches):
        found = []
        for key, block, value, enter, leave, before, last in zip(*[batch.column(c).to_pylist() for c in ("_key", "_block", "_rows", "_enter", "_leave", "_before", "_last")], strict=True):
            rows = _rows_of(value)
            enter, leave = enter or [0, NEVER, NEVER, NEVER], leave or AT_END
            cost = backward(rows, leave)[0][START] if before == -1 else 0
            initials = ([before] if before >= 0 else []) + [c & 3 for c, _ in rows]
            illegal = sum(x not in LEGAL for x in zip(initials, initials[1:])) + sum(n - 1 for _, n in rows)  # copies are never legal
            found += [(key, block, entry, end, letters, cost, illegal) for entry, (letters, end) in walks(rows, enter, leave, last).items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 7, kinds, strict=True)], names)


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of one conversation is entered, from its first block on."""
    exits, state, taken = dict(zip(zip(rows["_block"], rows["_entry"]), rows["_exit"])), START, []
    blocks = sorted(set(rows["_block"]))
    for block in blocks:
        taken.append(state)
        state = exits[block, state]
    return pd.DataFrame({"_key": rows["_key"].iloc[0], "_block": blocks, "_entry": taken})


def _edits(blocks: DataFrame) -> DataFrame:
    """blocks with _letters, _cost (in a conversation's first block) and _illegal; written. Conversations of one block, which most
    are, have their ends by definition; those of several get them from the products of their blocks' matrices."""
    several = blocks.groupBy("_key").agg(F.count("*").alias("_blocks")).where("_blocks > 1").select("_key")
    parts = blocks.select("_key", "_block", "_rows").join(several, "_key", "left_semi")
    matrices = parts.mapInArrow(_matrices, "_key string, _block long, _matrix array<long>")
    ends = matrices.groupBy("_key").applyInPandas(_ends, "_key string, _block long, _enter array<long>, _leave array<long>, _before int, _last boolean")
    given = blocks.select("_key", "_block", "_rows").join(ends, ["_key", "_block"], "left")
    given = given.withColumns({"_before": F.coalesce("_before", F.lit(-1)), "_last": F.coalesce("_last", F.lit(True))})
    walked = materialise(given.mapInArrow(_walked, _WALKED), "walks")
    chained = walked.join(several, "_key", "left_semi").select("_key", "_block", "_entry", "_exit")
    taken = chained.groupBy("_key").applyInPandas(_chain, "_key string, _block long, _entry int").withColumn("_taken", F.lit(True))
    chosen = walked.join(several, "_key", "left_anti").unionByName(walked.join(taken, ["_key", "_block", "_entry"]).drop("_taken"))
    out = materialise(blocks.drop("_rows").join(chosen, ["_key", "_block"]), "edits")
    discard(walked)
    return out


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and digest of conversations, whose rows come in order, each block's letters before its first row."""
    key, audit, letters, at, state, digest, empty = None, [], "", 0, START, None, True

    def line(role: str, text: str) -> None:
        nonlocal empty
        digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
        empty = False

    def inserts() -> None:
        nonlocal at, state
        while letters[at : at + 1] == "I":
            state, at = MADE[state], at + 1
            line(ROLES[state], "")

    def ended() -> tuple:
        inserts()
        return key, "".join(audit), digest.hexdigest()

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 3)], ["_key", "audit", "repaired_sha256"])

    for batch in batches:
        done = []
        keys, kinds, copies, roles, texts = [batch.column(c) for c in ("_key", "_kind", "_copies", "_role", "_text")]
        for i in range(batch.num_rows):
            now = keys[i].as_py()
            if now != key:
                if key is not None:
                    done.append(ended())
                key, audit, letters, at, state, digest, empty = now, [], "", 0, START, hashlib.sha256(), True
            text, role = texts[i].as_py(), roles[i].as_py()
            if kinds[i].as_py() == 0:
                letters, at = text, 0
                audit.append(text)
                continue
            for _ in range(copies[i].as_py()):
                inserts()
                letter, at = letters[at], at + 1
                if letter == "K":
                    state = KEPT[state, ("s", "u", "a").index(role[0])]
                    line(role, text)
                elif letter == "R":
                    state = MADE[state]
                    line(ROLES[state], text)
        yield out(done)
    if key is not None:
        yield out([ended()])


def repair_report(rows: DataFrame, *, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each conversation id of rows (null is one, too): gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256
    after damage.

    Null roles and texts count as one space, in the checksum null ids and turns, too. Rows of equal turns are ordered by role and text. A
    role's initial is its first character; a role without one, or with another than s, u, a, can't be kept. Repeated rows are
    duplicates of each other. Conversations that lose all rows have zeros, an empty audit and the digest of an empty string. Other columns
    aren't read; an empty table gives an empty one.
    """
    damaged = _placed(damage(rows, id, turn, role, text))
    codes = _codes(damaged)
    blocks = materialise(_blocks(codes), "blocks")
    edits = _edits(blocks)
    discard(blocks)
    stream = ["_key", *PLACE, "_kind", "_copies", "_text"]
    texts = damaged.where(~F.col("_gone")).withColumn("_kind", F.lit(1)).select(*stream)
    letters = edits.withColumns({"_kind": F.lit(0), "_copies": F.lit(1).cast("long"), "_text": F.col("_letters")}).select(*stream)
    sorted_rows = texts.unionByName(letters).repartition("_key").sortWithinPartitions("_key", *PLACE, "_kind")
    done = sorted_rows.mapInArrow(_repaired, "_key string, audit string, repaired_sha256 string")
    costs = edits.groupBy("_key").agg(F.sum("_illegal").alias("illegal"), F.sum("_cost").alias("cost"))
    out = _stats(codes).join(costs, "_key", "left").join(done, "_key", "left")
    none: dict[str, Column] = {"illegal": F.lit(0), "cost": F.lit(0), "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return out.select(F.col("_id").alias(id), "gaps", "blank", "duplicate", "truncated", *[F.coalesce(c, x).alias(c) for c, x in none.items()])
