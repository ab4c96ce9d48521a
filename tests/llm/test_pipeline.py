"""The pipeline against the operators' own decisions, stage by stage."""

from __future__ import annotations

import corpus_pipeline as P
from tests.llm.test_llm_operators import brute_components
from tidewell.llm import decontamination, quality_rules, secret_scan
from tidewell.llm.common import DOCUMENT_COLUMNS

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_decisions(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.quality_report(docs, labels).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    part = brute_components([(i, texts[i]) for i in kept])
    kept = {i for i in kept if part[i][1] == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontamination.SeedIndex(items)  # all seeds, no rarity
    kept = {i for i in kept if not index.matches(texts[i])}
    out = {r.doc_id: r for r in P.run(spark, SF).collect()}
    assert set(out) == kept and all(r.round_trip for r in out.values())


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != P.STAGES[-1][0]:
            assert tuple(out.columns) == DOCUMENT_COLUMNS
    masked = P.secret_scans(spark, spark.createDataFrame([(1, "token = abcdef123456", "en", "s", 20), (2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"), SF)
    assert [(r.text, r.n_chars) for r in masked.orderBy("doc_id").collect()] == [("[secret]", 8), (None, None)]
    assert secret_scan.scan_block([]) == []


def test_shingle_join_equals_its_sql(spark):
    from tests.oracle import connect, same_rows
    from tidewell.llm import queries

    same_rows(queries.op4_shingle_join(spark, SF), connect(SF), queries.ORACLES["op4_shingle_join"])
