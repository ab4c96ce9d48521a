"""License notices in texts, by votes for diagonals.

Every window of SHINGLE words of every text is joined, by its hash and its words, with the windows of a few fixed notices. A hit
votes for the diagonal (place in the text - place in the notice) that it lies on: where a notice stands word for word all its hits
have one diagonal, where words were put in, left out or changed they have a few that are near each other. So votes are added
up by diagonal, neighbouring diagonals are merged to spans, and a span is verified by the share of the notice's windows that
it holds and by its extent. Of spans that overlap those with the largest share count.

Phrases of the base are complete where one diagonal has all their windows. The joined side is a few hundred rows of constants, so it is
broadcast; long texts are hashed in pieces, and a text's rows meet again only as votes, which are added up before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import hash_words, ngrams

SHINGLE = 3
#: Diagonals at most this far apart are neighbours; it allows for so many words put in or left out at one place.
NEAR = 4
#: Least share of a notice's windows in a span, and the largest extent of a span as a multiple of the notice's length.
SHARE, EXTENT = 0.6, 2.0
#: Bytes of a text that are hashed at a time, at least; rows handed on at a time. They change no result.
PIECE, ROWS = 1 << 20, 1 << 16


@dataclass(frozen=True)
class Notice:
    """A notice in lower-case words; a base phrase counts only where it is complete."""

    label: str
    words: str
    base: bool = False

    def windows(self) -> list[str]:
        w = self.words.split()
        return [" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]


BASE = (Notice("mit", "under the mit license", True), Notice("apache-2", "apache license version 2", True), Notice("cc-by-nc", "cc by nc", True))
#: Well-known notices of licenses, without punctuation; at most 124 words each.
NOTICES = (
    Notice("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Notice("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Notice("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    Notice("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Notice("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Notice("gpl-2", "licensed under the gnu general public license version 2"),
    Notice("gpl-3", "licensed under the gnu general public license version 3"),
    Notice("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Notice("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Notice("unlicense", "this is free and unencumbered software released into the public domain"),
)

#: Lower-cases A-Z and makes every other ASCII sign but digits and a-z a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _window_hashes(windows: list[str]) -> np.ndarray:
    return np.array([ngrams(hash_words(w.encode()), SHINGLE)[0] for w in windows], np.uint64)


def window_table(spark: SparkSession, notices: tuple[Notice, ...]) -> DataFrame:
    """A row for each window of each notice; its place is also a bit in _low or _high (62 places each)."""
    rows = []
    for n, notice in enumerate(notices):
        windows = notice.windows()
        if not 1 <= len(windows) <= 124:
            raise ValueError("a notice has 3 to 126 words")
        for at, (hashed, words) in enumerate(zip(_window_hashes(windows).astype(np.int64).tolist(), windows, strict=True)):
            rows.append((hashed, words.encode(), n, notice.label, notice.base, at, len(windows), 1 << at if at < 62 else 0, 1 << (at - 62) if at >= 62 else 0))
    return spark.createDataFrame(rows, "_hash long, _windows binary, _notice int, _label string, _base boolean, _at int, _size int, _low long, _high long")


class Windows:
    """All windows of texts with their hashes, and their words where they may be a notice's."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.hinted = np.zeros(1 << 16, bool)
        for notice in notices:
            self.hinted[_window_hashes(notice.windows()) & np.uint64(0xFFFF)] = True

    def pieces(self, text: bytes) -> Iterator[tuple[int, np.ndarray, list[tuple[int, bytes]]]]:
        """(place of the first window, hashes, [(index, words)]) for each piece of a text; at last (number of words, none, [])."""
        plain, at, total, left, kept = text.translate(_PLAIN), 0, 0, b"", 0
        while at < len(plain):
            end = plain.find(b" ", at + PIECE)
            end = len(plain) if end < 0 else end
            piece, at = left + plain[at:end], end
            words, first = hash_words(piece), total - kept
            hashes = ngrams(words, SHINGLE)
            gaps = np.frombuffer(b" " + piece + b" ", np.uint8) == 32
            edges = np.flatnonzero(gaps[1:] != gaps[:-1])  # where words begin and end
            hinted = np.flatnonzero(self.hinted[hashes & np.uint64(0xFFFF)]).tolist()
            yield first, hashes, [(h, b" ".join(piece[edges[2 * h] : edges[2 * (h + SHINGLE) - 1]].split())) for h in hinted]
            total, kept = first + len(words), min(len(words), SHINGLE - 1)  # the next windows begin with these words
            left = piece[edges[2 * (len(words) - kept)] :] if kept else b""
        yield total, np.empty(0, np.uint64), []


_EMITTED = "_row long, _id {id}, _place long, _hash long, _windows binary, _words long"


def _emitted(notices: tuple[Notice, ...], kind: pa.DataType):
    """A row for each window of each text, and one with the number of its words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, size = Windows(notices), [], 0
        names = [x.split(" ")[0] for x in _EMITTED.split(", ")]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*waiting)], names)

        for batch in batches:
            rows, ids, texts = batch.columns
            for i in range(batch.num_rows):
                for first, hashes, spelled in own.pieces(texts[i].as_py() or b""):
                    n = len(hashes)
                    words = pa.nulls(n, pa.binary())
                    if spelled:
                        sparse = np.full(n, None, object)
                        sparse[[h for h, _ in spelled]] = [w for _, w in spelled]
                        words = pa.array(sparse, pa.binary())
                    waiting.append([pa.array(np.full(n, rows[i].as_py())), pa.nulls(n, kind), pa.array(np.arange(first, first + n)), pa.array(hashes.view(np.int64)), words, pa.nulls(n, pa.int64())])
                    size += n + 1
                    if size >= ROWS:
                        yield out()
                        waiting, size = [], 0
                waiting.append([rows.slice(i, 1), ids.slice(i, 1), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([first])])
        if waiting:
            yield out()

    return emit


def license_report(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: id, n_words, places of base phrases (n_base, first_word, last_word), base_labels, labels (of base and
    notices), score (the largest share of a notice's windows in one place; 1 with a base phrase).

    Null texts count as empty: no words, no labels, null places, score 0. Repeated rows and null ids have rows of their own. Rows are told
    apart by their place in the input, which is the same whenever files are read again; write down an input whose order changes
    first. Other columns aren't read, and an empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    notices = BASE + notices
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id).alias("_id"), F.col(text).cast("binary").alias("_text"))
    kind = rows.schema["_id"].dataType
    windows = rows.mapInArrow(_emitted(notices, to_arrow_type(kind)), _EMITTED.format(id=kind.simpleString()))
    table = window_table(docs.sparkSession, notices)
    hits = windows.join(F.broadcast(table), ["_hash", "_windows"], "left").where("_notice IS NOT NULL OR _words IS NOT NULL")  # constants
    diagonal = F.col("_place") - F.col("_at")
    votes = hits.groupBy("_row", "_notice", diagonal.alias("_diagonal")).agg(
        *[F.max(c).alias(c) for c in ("_id", "_words", "_label", "_base", "_size")], F.bit_or("_low").alias("_low"), F.bit_or("_high").alias("_high"),
        F.min("_place").alias("_first"), F.max("_place").alias("_last"),
    )
    found = F.bit_count("_low") + F.bit_count("_high")
    votes = votes.repartition("_row").withColumn("_found", found)  # all that follows is by row
    by_notice = Window.partitionBy("_row", "_notice").orderBy("_diagonal")
    starts = F.coalesce(F.col("_diagonal") - F.lag("_diagonal").over(by_notice) > NEAR, F.lit(False)).cast("int")
    whole = F.coalesce(F.col("_base") & (F.col("_found") == F.col("_size")), F.lit(False))
    merged = votes.withColumn("_begins", starts).withColumn("_group", F.sum("_begins").over(by_notice)).groupBy("_row", "_notice", "_group").agg(
        *[F.max(c).alias(c) for c in ("_id", "_words", "_label", "_base", "_size")], F.bit_or("_low").alias("_low"), F.bit_or("_high").alias("_high"),
        F.max("_found").alias("_most"), F.min("_first").alias("_first"), F.max("_last").alias("_last"),
        F.count_if(whole).alias("_places"), F.min(F.when(whole, F.col("_diagonal"))).alias("_first_place"), F.max(F.when(whole, F.col("_diagonal"))).alias("_last_place"),
    )
    compact = F.col("_last") - F.col("_first") + 1 <= EXTENT * F.col("_size")
    share = F.when(~F.col("_base"), F.when(compact, found).otherwise(F.col("_most")) / F.col("_size"))  # else its best diagonal
    spans = merged.withColumn("_share", share)
    by_row = Window.partitionBy("_row").orderBy(F.col("_base"), "_first", "_last", "_notice")
    before = F.max(F.when(F.col("_share") >= SHARE, F.col("_last"))).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_apart", F.when(F.col("_share") >= SHARE, F.coalesce(F.col("_first") > before, F.lit(True)).cast("int")).otherwise(0))
    spans = spans.withColumn("_cluster", F.when(F.col("_share") >= SHARE, F.sum("_apart").over(by_row)))
    best = F.max("_share").over(Window.partitionBy("_row", "_cluster"))
    counts = F.coalesce((F.col("_share") >= SHARE) & (F.col("_share") == best), F.lit(False))
    labelled = spans.withColumn("_counts", counts)
    base_labels = F.array_sort(F.collect_set(F.when(F.col("_places") > 0, F.col("_label"))))
    labels = F.array_sort(F.collect_set(F.when((F.col("_places") > 0) | F.col("_counts"), F.col("_label"))))
    n_base = F.sum("_places")
    return labelled.groupBy("_row").agg(
        F.max("_id").alias(id), F.max("_words").alias("n_words"), n_base.alias("n_base"), F.min("_first_place").alias("first_word"), F.max("_last_place").alias("last_word"),
        F.concat_ws(",", base_labels).alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce(F.max("_share"), F.lit(0.0))).cast("double").alias("score"),
    ).drop("_row")
