"""The registered queries of this package: each operator on its whole table, with the parameters of production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import oracles
from tidewell.llm.common import held_out, read_table
from tidewell.llm.compression_quality import quality_scores
from tidewell.llm.conversation_repair import repair_report
from tidewell.llm.decontamination import contaminated_pairs
from tidewell.llm.html_cut import page_texts
from tidewell.llm.license_scan import license_report
from tidewell.llm.piece_codec import piece_digests
from tidewell.llm.quality_rules import quality_report
from tidewell.llm.secret_scan import secret_report
from tidewell.llm.shingle_join import shingle_components
from tidewell.llm.token_counts import with_token_counts
from tidewell.llm.token_records import token_records
from tidewell.llm.toxicity import toxicity_verdicts
from tidewell.llm.vector_codes import vector_codes


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(read_table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, tokenizer_file("piece_bpe_32k.model"), 4096).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op4_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(read_table(spark, sf_dir, "documents"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def _with_prediction(scores: DataFrame, threshold: float, *more: str) -> DataFrame:
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predicted has the one threshold 0.5, verdict that of the text's language."""
    return _with_prediction(toxicity_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), 0.5, "lang", "threshold", "verdict")


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_prediction(quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), 0.3)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(read_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(read_table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(read_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_cut, op2_token_counts, op3_token_records, op4_shingle_join, op5_piece_codec, op6_quality_rules, op7_toxicity, op8_compression_quality,
        op9_decontamination, op10_secret_scan, op11_conversation_repair, op12_license_scan, op13_vector_codes,
    )
}
#: The other nine rest on models, libraries' ids, alignments or spans, which SQL can't express; tests/llm holds them against brute
#: force, the libraries and labels.
ORACLES: dict[str, str] = {
    "op4_shingle_join": oracles.SHINGLE_JOIN,
    "op11_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op12_license_scan": oracles.LICENSE_SCAN,
    "op13_vector_codes": oracles.VECTOR_CODES,
}
