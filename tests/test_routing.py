"""Task fields by path: defaults, odd types, reasons."""

import json

import pytest
from pyspark.sql import functions as F

from lakequill.functions import routing as R

PARAMS = {"verdict_item": [True, False], "item_roles": ["insurance", "node"], "derivation": {"ops": [1]}}
TASK = {"family_id": "f", "axis": "A", "dose_level": 3, "break_side": "must_change", "must_change": [1, 2], "must_persist": [1], "axis_params": PARAMS}


def read(spark, text, f):
    r = spark.createDataFrame([(text,)], "t string").select(R.task(F.col("t")).alias("v")).select(f(F.col("v")).alias("r")).first()["r"]
    return r


@pytest.mark.parametrize(
    ("change", "verdicts", "defaulted"),
    [
        ({}, [True, False], False),
        ({"axis_params": None}, [True, True], True),
        ({"axis_params": "text"}, [True, True], True),
        ({"axis_params": {"verdict_item": "yes"}, "break_side": "must_persist"}, [True], True),
        ({"axis_params": {}, "break_side": "other"}, [True, True], True),
        ({"axis_params": {}, "must_change": "many"}, [], True),
        ({"axis_params": {"verdict_item": []}}, [], False),
        ({"axis_params": {"verdict_item": [True, "x", None]}}, [True, None, None], False),
    ],
)
def test_routing(spark, change, verdicts, defaulted):
    r = read(spark, json.dumps({**TASK, **change}), R.routing)
    assert (r.verdict_item, r.verdict_item_defaulted, r.family_id) == (verdicts, defaulted, "f")


@pytest.mark.parametrize(("dose", "expected"), [(1, 1), ("D3", 3), ("2", 2), ("x", None), (None, None), ([1], None), ("D", None)])
def test_dose(spark, dose, expected):
    assert read(spark, json.dumps({**TASK, "dose_level": dose}), R.routing).dose_level == expected


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (json.dumps(TASK), None),
        (None, "json"),
        ("", "json"),
        ('{"axis": ', "json"),
        ("[1]", "json"),
        ("{}", "axis_params"),
        (json.dumps({**TASK, "axis_params": [1]}), "axis_params"),
        (json.dumps({**TASK, "axis_params": {"verdict_item": []}}), "item_roles"),
        (json.dumps({**TASK, "axis_params": {"item_roles": []}}), "verdict_item"),
        (json.dumps({**TASK, "must_change": None}), "must_change"),
        (json.dumps({**TASK, "must_change": [1]}), "lengths"),
        (json.dumps({**TASK, "axis_params": {**PARAMS, "derivation": {}}}), "derivation.ops"),
        (json.dumps({**TASK, "axis_params": {**PARAMS, "derivation": {"ops": []}}}), "steps"),
    ],
)
def test_rejection(spark, text, reason):
    assert read(spark, text, R.rejection) == reason


def test_rate(spark):
    rows = [([True, True, False], {"0": True, "1": False, "2": True}), ([True, True], {"1": True}), ([False], {"0": True}), ([True, None], {"1": True}), (None, {"0": True}), ([True], None)]
    df = spark.createDataFrame(rows, "v array<boolean>, a map<string, boolean>")
    assert [r.x for r in df.select(R.verdict_rate(F.col("v"), F.col("a")).alias("x")).collect()] == [0.5, 1.0, None, None, None, None]
