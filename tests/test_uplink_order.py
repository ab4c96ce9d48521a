"""Texts that are no JSON objects are left out before the costly parses."""

from __future__ import annotations

from tidewell.operators import uplink


def test_no_objects_are_left_out_before_parsing(spark):
    texts = ["{", "", "[1]", "7", "null", None, '{"a":1', "{} x", '{"a":1}']
    rows = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts))), "i int, value string")  # of no local rows, which would be filtered in the plan
    for parse in (uplink.parse_v2, uplink.parse_v3):
        out = parse(rows)
        plan = out._jdf.queryExecution().analyzed().toString()
        parsed, filtered = plan.index("from_json"), plan.rindex("json_object_keys")
        assert "Filter" in plan[plan.rindex("\n", 0, filtered) : filtered] and parsed < filtered  # below, so it comes first
        assert out.count() == 0
