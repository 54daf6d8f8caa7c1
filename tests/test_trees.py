"""Runs as trees: a line is parsed once."""

import json

import pytest

from strandlake.sources import trees


def test_a_line_is_parsed_once(spark):
    df = trees.runs(spark.createDataFrame([("",)], "value string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson") + plan.count("parse_json") == 1 and "json_object_keys" not in plan and "jsonobjectkeys" not in plan


def test_lines_that_are_no_objects(spark):
    run = {"situation": "x", "recovery_target": 0.9, "n_trials": 3, "iterations": [7], "is_mock": False}
    for line, what in (("{", "run: not an object: {"), ("null", "run: not an object: null"), ("3", "run: not an object: 3"), (json.dumps(run), "iteration: not an object: 7")):
        with pytest.raises(Exception, match=what):
            trees.runs(spark.createDataFrame([(line,)], "value string")).collect()
    assert trees.runs(spark.createDataFrame([(json.dumps(run | {"iterations": None}),)], "value string")).first().iterations is None
