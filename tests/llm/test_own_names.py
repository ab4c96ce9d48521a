"""Tables whose extra columns have the names that operators give their own; empty tables and repeated rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.llm import queries
from tidewell.llm.compression_quality import quality_scores
from tidewell.llm.conversation_repair import repair_report
from tidewell.llm.decontamination import contaminated_pairs
from tidewell.llm.html_cut import page_texts
from tidewell.llm.license_scan import license_report
from tidewell.llm.piece_codec import piece_digests
from tidewell.llm.quality_rules import keep_good, quality_report
from tidewell.llm.secret_scan import mask_secrets, secret_report
from tidewell.llm.shingle_join import shingle_components
from tidewell.llm.token_counts import with_token_counts
from tidewell.llm.token_records import token_records
from tidewell.llm.toxicity import toxicity_verdicts
from tidewell.llm.vector_codes import vector_codes

OWN = (
    "n_tokens n_bytes over_limit score threshold verdict kept _verdict spans _report start place _label _order _language _digest _s key sig _hit n_words labels _row _id _place "
    "_hash _key _turn _n _code _v item_id n_chars"
).split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"password = hunter2secret{i} under the mit license some words follow here, number {i}.", "en") for i in range(12)]
    rows += [(3, rows[3][1], "en"), (None, "no id at all", None), (20, None, "de"), (21, "", "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)], "doc_id long, quality int, toxic int")


def operators(spark, labels):
    piece, byte = queries.tokenizer_file("piece_bpe_32k.model"), queries.tokenizer_file("byte_bpe_50k.json")
    items = spark.createDataFrame([(1, "some words follow here number 5", "x")], "item_id long, text string, score string")
    return {
        "op2": lambda d: with_token_counts(d, piece, 5).select("doc_id", "n_bytes", "n_tokens", "over_limit"),
        "op3": lambda d: token_records(d, byte).drop("start"),  # repeated rows have no order among themselves
        "op4": shingle_components,
        "op5": lambda d: piece_digests(d, piece),
        "op6": lambda d: quality_report(d, labels),
        "op6 filter": lambda d: keep_good(d, labels).select("doc_id", "text"),
        "op7": lambda d: toxicity_verdicts(d, labels, rows=12),
        "op8": lambda d: quality_scores(d, labels),
        "op9": lambda d: contaminated_pairs(d, items),
        "op10": secret_report,
        "op10 mask": lambda d: mask_secrets(d).select("doc_id", "text"),
        "op12": license_report,
    }


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op6", "op6 filter", "op7", "op8", "op9", "op10", "op10 mask", "op12"])
def test_extra_columns_change_nothing(spark, docs, labels, name):
    run = operators(spark, labels)[name]
    clashing = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in OWN])
    plain = sorted(map(str, run(docs).collect()))
    assert sorted(map(str, run(clashing).collect())) == plain and (name in ("op9", "op6 filter") or len(plain) == 16)
    assert run(clashing.where("false")).count() == 0


def test_extra_columns_of_other_tables(spark):
    extra = [F.lit("own").alias(c) for c in OWN if c not in ("n_chars",)]
    for f, table in ((page_texts, "pages"), (repair_report, "conversations"), (vector_codes, "embeddings")):
        rows = spark.createDataFrame(spark.read.parquet(f"{SF}/{table}.parquet").limit(40).collect())
        assert sorted(map(str, f(rows.select("*", *extra)).collect())) == sorted(map(str, f(rows).collect()))
