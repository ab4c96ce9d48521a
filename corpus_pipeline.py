"""A cleaning pipeline over `documents`: each stage works on what the one before it has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import DOCUMENT_COLUMNS, discard, materialise, read_table
from tidewell.llm.decontamination import drop_contaminated
from tidewell.llm.piece_codec import piece_digests
from tidewell.llm.quality_rules import keep_good
from tidewell.llm.queries import tokenizer_file
from tidewell.llm.secret_scan import mask_secrets
from tidewell.llm.shingle_join import first_of_components


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; repeated rows share their fate. Only the columns of
    documents go on, here and in each stage, whatever others there are; an empty table gives an empty one."""
    return keep_good(docs.select(*DOCUMENT_COLUMNS), read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id; of repeated rows one. Texts without a word,
    null ones too, are copies of nothing and stay."""
    return first_of_components(docs.select(*DOCUMENT_COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go; null and empty texts hold none, repeated rows share their fate."""
    return drop_contaminated(docs.select(*DOCUMENT_COLUMNS), read_table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every document stays, repeated ones too, with the length of its new text (null for null)."""
    return mask_secrets(docs.select(*DOCUMENT_COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded and decoded: a digest of ids and text for each row; a null text counts as empty."""
    return piece_digests(docs, tokenizer_file("piece_bpe_32k.model"), lean=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("piece_encoding", piece_encoding),
]
#: Forests, alignments and token ids are no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages make of documents; each stage's table is deleted once the next one is written."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before:
            discard(before)
        before = docs
    return docs
