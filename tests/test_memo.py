"""The memo of scored pairs: nothing is scored twice, plans leave the memo where it lies."""

import uuid

import pytest
from pyspark.sql import functions as F

from lakequill.operators import memo as M


def scorer(df):
    return df.withColumn("score", F.length("a") * 10.0 + F.length("b"))


@pytest.fixture
def table(spark, tmp_path):
    name = f"memo_{uuid.uuid4().hex}"
    M.create(spark, name, f"file://{tmp_path}/memo", 4)
    yield name
    spark.sql(f"DROP TABLE {name}")


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "id int, p string, h string")


def test_runs(spark, table):
    one = pairs_of(spark, [(1, "ab", "c"), (2, "a", "bc"), (3, "ab", "c"), (4, None, "x"), (5, "", "")])
    assert M.unseen(one, "p", "h", table).count() == 3
    M.extend(one, "p", "h", table, scorer)
    assert M.unseen(one, "p", "h", table).count() == 0
    two = one.union(pairs_of(spark, [(6, "new", "one"), (7, "new", "one")]))
    assert [(r.a, r.b) for r in M.unseen(two, "p", "h", table).collect()] == [("new", "one")]
    M.extend(two, "p", "h", table, scorer)
    M.extend(two, "p", "h", table, lambda df: df.withColumn("score", F.lit(-1.0)))
    assert spark.table(table).count() == 4
    got = {r.id: r.score for r in M.looked_up(two, "p", "h", table).collect()}
    assert got == {1: 21.0, 2: 12.0, 3: 21.0, 4: None, 5: 0.0, 6: 33.0, 7: 33.0}


def test_plan_has_no_exchange_on_the_memo(spark, table):
    pairs = pairs_of(spark, [(i, f"p{i}", "h") for i in range(50)])
    M.extend(pairs, "p", "h", table, scorer)
    for df in (M.unseen(pairs, "p", "h", table), M.looked_up(pairs, "p", "h", table)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        scan = next(i for i, x in enumerate(lines) if table in x and "Scan" in x)
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        above, at = [], depth(lines[scan])
        for x in reversed(lines[:scan]):
            if depth(x) < at:
                at = depth(x)
                above.append(x)
            if "SortMergeJoin" in above[-1]:
                break
        assert above and "SortMergeJoin" in above[-1] and not any("Exchange" in x for x in above)


def test_gate(spark, table):
    pairs = pairs_of(spark, [(i, f"p{i}", "h") for i in range(400)])
    M.extend(pairs, "p", "h", table, scorer)
    assert tuple(M.disagreements(pairs, "p", "h", table, scorer, 1.0).first()) == (400, 0)
    part = M.disagreements(pairs, "p", "h", table, lambda df: df.withColumn("score", F.lit(None)), 0.25).first()
    assert 60 < part.checked < 140 and part.differing == part.checked
    assert tuple(M.disagreements(pairs.limit(0), "p", "h", table, scorer).first()) == (0, 0)
