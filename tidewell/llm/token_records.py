"""Operator 3, token-id output: length-delimited binary records with masked checksums and a separate offset index.

A record is: payload length (8 bytes, little-endian), masked CRC-32 of those 8 bytes (4), payload, masked CRC-32 of the
payload (4), and a line feed. The payload is the document's id (8 bytes, signed), the number of bytes of a token id (1,
with the highest bit set where a document has no id) and the ids, little-endian. A file holds the records of a range of
document ids in ascending order, and the numbers in file names ascend with the ranges. There are so many files that each
has about `FILE_BYTES` bytes of text. The index (Parquet) has for each record its file, offset and length, so that readers can
fetch records in any order; it is built from the files, by reading the frames back and checking both checksums.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import Remembered, scratch_path, shuffles_deleted

#: Fixed value: the constant that masks checksums, so that a checksum of data that holds checksums stays sound.
MASK = 0xA282EAD8
HEAD, TAIL = 12, 5
#: Bytes of text in a file, at which a file is far from the 2 GB that one value of a row can hold.
FILE_BYTES = 64 << 20
#: What a record takes beside its text's tokens, about; records that are handed on at a time.
RECORD_BYTES, ROWS = 30, 1 << 16
NO_ID = 0x80
_NUMBER = re.compile(r"part-(\d+)")
#: Characters that are white space to the tokenizer's pattern; a word ends where one of them follows another character. It also
#: ends between Latin letters or digits and an ASCII sign, so that signs make no new words.
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
_WORDS = re.compile(f"[{_SPACES}]*+[0-9A-Za-zÀ-ÖØ-öø-ɏ]++(?=[{_SPACES}{re.escape(_SIGNS)}]|\\Z)|[{_SPACES}]*[^{_SPACES}]+|[{_SPACES}]+")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload)), b"\n"))


def frames(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of each record of a file; raises ValueError where a checksum or a length is wrong."""
    view, at = memoryview(data), 0
    while at < len(view):
        head = bytes(view[at : at + 8])
        if len(head) < 8 or struct.unpack("<I", view[at + 8 : at + HEAD])[0] != masked(head):
            raise ValueError(f"a damaged length at offset {at}")
        size = struct.unpack("<Q", head)[0]
        payload = view[at + HEAD : at + HEAD + size]
        if len(view) < at + HEAD + size + TAIL or struct.unpack("<I", view[at + HEAD + size : at + HEAD + size + 4])[0] != masked(payload):
            raise ValueError(f"a damaged record at offset {at}")
        yield at, payload
        at += HEAD + size + TAIL


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qB", doc_id or 0, width | (NO_ID if doc_id is None else 0)) + ids


def ids_of(payload: memoryview) -> tuple[int | None, np.ndarray]:
    doc_id, width = struct.unpack("<qB", payload[:9])
    return None if width & NO_ID else doc_id, np.frombuffer(payload[9:], f"<u{width & ~NO_ID}")


class WordTokens:
    """Ids of texts by the tokenizers library, word by word. The library splits a text before it merges, and always before white
    space that follows another character and between a letter or digit and a sign; so a text's ids are those of its words in
    order, and words are remembered. A word of letters only is one pre-token, which goes to the library's model without its other steps. A
    text that holds one of the added tokens' strings is left to the library as a whole.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        if not isinstance(self.tokenizer.pre_tokenizer, ByteLevel) or self.tokenizer.normalizer is not None:
            raise ValueError("a byte-level tokenizer without a normaliser is needed")
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}  # fixed values: bytes that byte-level keeps as they are
        rest = [b for b in range(256) if b not in plain]
        self.letters = {b: 256 + i for i, b in enumerate(rest)}
        self.space = chr(self.letters[32])
        self.packed = [self._pack([i]) for i in range(self.tokenizer.get_vocab_size())]
        self.words = Remembered(self._word, 350_000)

    def _pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _word(self, word: str) -> bytes:
        if word[0] == "\n" and word[1:] and not word[1].isspace():  # a single line feed is a pre-token by itself
            return self.words["\n"] + self.words[word[1:]]
        bare = word[1:] if word[0] == " " else word
        if bare.isalpha():
            spelt = word.encode().decode("latin-1").translate(self.letters) if not word.isascii() else word if bare is word else self.space + bare
            return b"".join([self.packed[t.id] for t in self.model.tokenize(spelt)])
        if bare[-1:] in (".", ",", "!") and bare[:-1].isalpha():  # letters end before signs
            return self.words[word[:-1]] + self.words[word[-1]]
        return self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))


_loaded: dict[str, WordTokens] = {}


def word_tokens(tokenizer_file: str) -> WordTokens:
    if tokenizer_file not in _loaded:
        _loaded[tokenizer_file] = WordTokens(tokenizer_file)
    return _loaded[tokenizer_file]


def write_records(docs: DataFrame, path: str, tokenizer_file: str, *, end_id: int = 0, file_bytes: int = FILE_BYTES, id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every whole text (null: empty), each with `end_id` behind, to record files under path.

    Files take consecutive ranges of document ids, as many as make about `file_bytes` of text and frames each, and at least the session's
    shuffle partitions; so the one shuffle moves texts, not ids. Rows without an id come last; repeated rows make repeated
    records, in no fixed order among themselves, and can fill several files; an empty table gives no records. Only id and
    text of docs are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES)).first()[0] or 0
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokens(tokenizer_file)
        end = own._pack([end_id])
        for batch in batches:
            out = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.append(frame(payload_of(key, own.encode(t or "") + end, own.width))[:-1])  # the writer puts the line feed
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    place = (F.asc_nulls_last("id"), F.asc("place"))  # a number, so that rows of one id can be parted
    rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(files, *place).sortWithinPartitions(*place)
    with shuffles_deleted(spark):
        rows.select("id", "text").mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


INDEX = "file string, number bigint, offset bigint, length bigint, doc_id bigint, place bigint, n_tokens bigint, start_in_file bigint, ids_crc32 bigint"


def write_index(spark: SparkSession, path: str, index_path: str) -> None:
    """Reads the record files under path, checks them, and writes their index: the file and offset of each record, its
    document, its tokens with those before it in the file, and the crc32 of its ids as 32-bit integers."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], ["file", "number", "offset", "length", "doc_id", "place", "n_tokens", "start_in_file", "ids_crc32"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py().rpartition("/")[2], batch.column(1)[i].as_buffer()
                number, rows, before = int(_NUMBER.search(name)[1]), [], 0
                for place, (offset, payload) in enumerate(frames(data)):
                    doc_id, ids = ids_of(payload)
                    rows.append((name, number, offset, HEAD + len(payload) + TAIL, doc_id, place, len(ids), before, zlib.crc32(ids.astype("<u4"))))
                    before += len(ids)
                    if len(rows) >= ROWS:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found.mapInArrow(index, INDEX).write.parquet(index_path)


def read_records(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(doc_id, ids) of the records that the rows of an index name, in whatever order or selection those come. Spark reads a
    file once and whole (files are bounded, see FILE_BYTES); of it, only the named ranges are looked at. A record that is named several
    times comes as often, null ids come as null; an empty index gives no rows."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *(len(ids) for _, ids in rows)]), pa.int32())
        return pa.record_batch([pa.array([x for x, _ in rows], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([ids.astype("<i4") for _, ids in rows])))], ["doc_id", "ids"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = memoryview(batch.column(0)[i].as_buffer())
                rows, size = [], 0
                for offset, length in batch.column(1)[i].as_py():
                    ((_, payload),) = frames(data[offset : offset + length])
                    rows.append(ids_of(payload))
                    size += length
                    if len(rows) >= ROWS or size >= 1 << 22:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    wanted = index.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("_at"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    content = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    pairs = F.transform("_at", lambda x: F.array(x["offset"], x["length"]))
    return content.join(wanted, "file").select("content", pairs.alias("_at")).mapInArrow(fetch, "doc_id bigint, ids array<int>")


def record_starts(index: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of an index whose files ascend by number.

    Offsets are a two-level prefix sum: within a file the index has them, and one row for each file is summed over files.
    """
    files = index.groupBy("number").agg(F.sum("n_tokens").alias("_in_file"))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("number", F.coalesce(F.sum("_in_file").over(before), F.lit(0)).alias("_before"))
    return index.join(files, "number").select("doc_id", (F.col("_before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def token_records(docs: DataFrame, tokenizer_file: str, *, path: str | None = None, end_id: int = 0, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes records and index under path (a new shared folder by default) and returns record_starts() of what was read.

    Odd rows are as in write_records: null texts are empty and have the end id alone, rows without an id come last, repeated rows have a
    record each, texts of any length are read whole, and an empty table gives no rows. Only id and text of docs are read."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "records")
    write_records(docs, f"{path}/records", tokenizer_file, end_id=end_id, id=id, text=text)
    write_index(spark, f"{path}/records", f"{path}/index")
    return record_starts(spark.read.schema(INDEX).parquet(f"{path}/index"))
