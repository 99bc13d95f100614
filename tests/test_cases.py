"""Echo classification, scored cases, verdicts, puzzles and output parsing, with positive and negative controls."""

import itertools

import pytest
from pyspark.sql import functions as F

from lakequill.functions import echo, outputs
from lakequill.operators import cases, puzzles

SCHEMA = "task_id string, family_id string, arm string, dose_level int, scored_cases array<struct<case_id:string,cls:string,A_correct:string,A_wrong:string,emitted:string,a_correct_fired:boolean,a_wrong_fired:boolean>>, positive_control struct<target:string,emitted:string>"


@pytest.mark.parametrize(
    ("statement", "premises", "correct", "expected"),
    [
        ("The total load is 8,000 kg, which fails the limit of 7500 kg.", ["The total load is 8000 kg and fails the limit."], "7000 kg", "REAL"),
        ("The total load is 8,000 kg, which fails the limit of 7500 kg.", ["The load was 8,000 kg in the earlier figure; it is now 7000 kg."], "7000 kg", "SUPERSESSION"),
        ("The total load is 8,000 kg, which fails the limit of 7500 kg.", ["The total load is 7000 kg and meets the limit."], "7000 kg", "INSTRUMENT"),
        ("The yield is 120 tonnes.", ["The area is 120 hectares."], "90 tonnes", "INSTRUMENT"),
        ("The yield is 120 tonnes.", ["The yield is 120 tonnes."], "120 tonnes", "INSTRUMENT"),
        ("Silo 4's stock is 50 tonnes.", ["Silo 4's stock is 70 tonnes."], "70 tonnes", "INSTRUMENT"),
    ],
)
def test_classification(spark, statement, premises, correct, expected):
    df = spark.createDataFrame([(statement, premises, correct)], "s string, p array<string>, c string")
    assert df.select(echo.classified(F.col("s"), F.col("p"), F.col("c")).alias("x")).first().x == expected


def test_rewrite(spark):
    get = lambda t, a, b: spark.range(1).select(echo.rewrite_number(F.lit(t), F.lit(float(a)), F.lit(float(b))).alias("x")).first().x
    assert get("It is 1,200 kg of 40", 1200, 3400).text == "It is 3,400 kg of 40"
    assert get("It is 40 kg", 40, 1500).text == "It is 1500 kg"
    assert get("40 and 40", 40, 1).reason == "ambiguous" and get("x40y", 40, 1).reason == "absent"


def trajectory(task, family, arm, dose, *cells, kept=True, control=("1", "1")):
    emit = {"TF": "10", "FT": "20", "FF": "30"}
    made = [("e", "EXCEPTED", "10", "20", "10" if kept else "20", None, None)]
    made += [(str(i), "RULE", "10", "20" if arm == "SCOPED" else None, emit[c], None, None) for i, c in enumerate(cells)]
    return (task, family, arm, dose, made, control)


def test_guarded_counts(spark):
    rows = [trajectory("a", "f", "SCOPED", 1, "TF", "FT", "FF"), trajectory("b", "f", "SCOPED", 1, "FT", kept=False), trajectory("c", "f", "BLANKET", 1, "TF", "FF", "FT")]
    got = {r.arm: r for r in cases.by_dose(cases.exploded(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert (got["SCOPED"].events, got["SCOPED"].trials, got["SCOPED"].ff) == (1, 2, 1)
    assert (got["BLANKET"].events, got["BLANKET"].trials) == (2, 3)


def test_case_verdicts(spark):
    def run(rates, blanket=0):
        rows = [trajectory(f"{f}-{d}", f"f{f}", "SCOPED", d, *(["FT"] * k + ["TF"] * (10 - k))) for f in range(10) for d, k in zip((1, 2, 3), rates, strict=True)]
        rows += [trajectory(f"{f}-b", f"f{f}", "BLANKET", 3, *(["FF"] * blanket + ["TF"] * (10 - blanket))) for f in range(10)]
        return cases.verdict(cases.exploded(spark.createDataFrame(rows, SCHEMA)), 0.1, 0.1, 0.05)["verdict"]

    assert run((0, 2, 5)) == "SCOPE_LEAK" and run((0, 2, 5), 5) == "DEGRADES_BUT_NOT_SEPARABLE" and run((5, 2, 0)) == "NO_BREAK"


def test_mismatch_withholds(spark):
    rows = [trajectory("a", "f", "SCOPED", d, "TF") for d in (1, 2, 3)]
    rows[0][4][1] = ("0", "RULE", "10", "20", "10", False, False)
    assert cases.verdict(cases.exploded(spark.createDataFrame(rows, SCHEMA)), 0.1, 0.1, 0.05)["reasons"] == ["mismatch"]


def test_acceptance(spark):
    df = spark.createDataFrame([trajectory("a", "f", "SCOPED", d, *(["FT"] * d + ["TF"] * (9 - d))) for d in (1, 2, 3)], SCHEMA)
    assert all(cases.accepted(cases.exploded(df), cases.positive_controls(df)).first())
    bad = df.withColumn("positive_control", F.struct(F.lit("1").alias("target"), F.lit("none").alias("emitted")))
    assert not cases.accepted(cases.exploded(df), cases.positive_controls(bad)).first().controls_fire


def test_axis_and_program(spark):
    doses = lambda *xs: spark.createDataFrame([(d + 1, x, 100) for d, x in enumerate(xs)], "dose int, x int, n int")
    broke = cases.axis_verdict(doses(1, 10, 30), 0.1, 0.05 / 3, 3, 3, "PASS")
    assert broke == {"status": "SCORED", "breaks": True}
    assert cases.axis_verdict(doses(1, 10, 30), 0.1, 0.05 / 3, 4, 3, "PASS")["status"] == "PARTIAL_WITHHELD"
    assert cases.axis_verdict(doses(1, 10, 30), 0.1, 0.05 / 3, 3, 3, None)["status"] == "ORACLE_WITHHELD"
    assert cases.program_verdict({"A": broke, "B": {"status": "PENDING", "breaks": None}})["status"] == "PENDING"
    assert cases.program_verdict({"A": broke})["any_break"]


def test_fidelity_precedence(spark):
    bars = {"r2": 0.5, "spearman": 0.5, "within": 0.3, "margin": 0.05, "negatives": 20, "ood_pooled": 0.5, "ood_min": 0.1, "vs_verbal": 0, "vs_entropy": 0, "probe_over": 0, "auc": 0.8}
    good = {"r2": 0.6, "spearman": 0.7, "within_spearman": 0.5, "oracle_margin": 0.2, "n_negatives": 30, "within_length_residual": 0.4, "range_uncovered": False, "ood_pooled": 0.6, "ood_min": 0.2, "vs_verbal_low": 0.1, "vs_entropy_low": 0.1, "probe_over_low": -0.1, "auc": 0.9}
    changes = [({}, "confirmed"), ({"n_negatives": 3, "r2": 0.0}, "not_evaluable"), ({"range_uncovered": True, "ood_min": 0.0}, "range_uncovered"), ({"ood_min": 0.0}, "ood_failure"), ({"vs_verbal_low": 0.0}, "no_margin_over_verbalised"), ({"r2": 0.1}, "binary_only"), ({"oracle_margin": 0.0, "auc": 0.5}, "margin_only"), ({"r2": 0.1, "auc": 0.5}, "no_signal")]
    df = spark.createDataFrame([tuple((good | c).values()) for c, _ in changes], list(good))
    assert [r.v for r in df.select(cases.fidelity_verdict(bars).alias("v")).collect()] == [e for _, e in changes]


def test_comparability(spark):
    df = spark.createDataFrame([("N-k1", False, False)] * 98 + [("S-k2", True, False), ("S-k2", True, True), ("draft", True, False)], "run string, failed boolean, skip boolean")
    r = cases.comparability(df, F.col("skip")).first()
    assert (r.n, r.failures, r.comparable) == (99, 1, True)


def test_packets(spark):
    df = spark.range(40).select(F.col("id").alias("k"), (F.col("id") < 5).alias("flag"), (F.col("id") % 2).alias("s"))
    got = cases.census_and_controls(df, F.col("flag"), "k", 1, 10, "s")
    assert {r.part: r["count"] for r in got.groupBy("part").count().collect()} == {"census": 5, "control": 10}
    with pytest.raises(ValueError):
        cases.blinded(df, "k", ["flag"], ["flag"])


def plain_puzzle(n, clues):
    """Solutions, shortest prefix and pruned clues by enumeration, one clue at a time."""
    rule = {"at": lambda p, a, b: p[a] == b, "nat": lambda p, a, b: p[a] != b, "imm": lambda p, a, b: p[a] + 1 == p[b], "lt": lambda p, a, b: p[a] < p[b], "adj": lambda p, a, b: abs(p[a] - p[b]) == 1}
    left = lambda cs: [p for p in itertools.permutations(range(1, n + 1)) if all(rule[o](p, a, b) for o, a, b in cs)]
    found = left(clues)
    if len(found) != 1:
        return found, None, None
    prefix = next(i for i in range(len(clues) + 1) if len(left(clues[:i])) == 1)
    kept, i = list(clues), 0
    while i < len(kept):
        fewer = kept[:i] + kept[i + 1 :]
        if fewer and len(left(fewer)) == 1:
            kept, i = fewer, 0
        else:
            i += 1
    return found, prefix, kept


def test_puzzles(spark):
    import random

    rng, made = random.Random(2), []
    for i in range(60):
        n = rng.choice([1, 2, 3, 4, 4, 5])
        p = rng.sample(range(1, n + 1), n)
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
        true = [("at", a, p[a]) for a in range(n)] + [("nat", a, s) for a in range(n) for s in range(1, n + 1) if p[a] != s] + [("lt", a, b) for a, b in pairs if p[a] < p[b]] + [("imm", a, b) for a, b in pairs if p[a] + 1 == p[b]] + [("adj", a, b) for a, b in pairs if abs(p[a] - p[b]) == 1]
        clues = rng.sample(true, min(len(true), rng.randint(1, 12))) + ([("lt", 0, 1), ("lt", 1, 0)] if n > 1 and i % 9 == 0 else [])
        made.append((i, n, clues))
    schema = "id int, n int, clues array<struct<op string, a int, b int>>"
    got = {r.id: r for r in puzzles.solved(spark.createDataFrame(made, schema), F.col("n"), "clues", 5).collect()}
    assert {r.reason for r in got.values()} == {None, "none", "several"}
    for i, n, clues in made:
        found, prefix, kept = plain_puzzle(n, clues)
        assert got[i].solutions == sorted(sum(s << 4 * a for a, s in enumerate(p)) for p in found)
        assert got[i].prefix == prefix and (got[i].minimal is None if kept is None else [tuple(c) for c in got[i].minimal] == kept)


def test_puzzles_are_solved_in_batches(spark):
    made = puzzles.hashed_puzzles(spark.range(40), "id", 4)
    done = puzzles.solved(made, F.lit(4), "clues", 4)
    plan = done._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan  # clue by clue in lambdas of a row before
    assert "lambda" not in made._jdf.queryExecution().analyzed().toString()
    got = done.collect()
    assert len(got) == 40
    for r in got:
        found, prefix, kept = plain_puzzle(4, [tuple(c) for c in r.clues])
        assert r.reason is None and len(r.solutions) == len(found) == 1 and r.prefix == prefix and [tuple(c) for c in r.minimal] == kept


def test_puzzles_of_another_kind(spark):
    schema = "id int, n int, clues array<struct<op string, a int, b int>>"
    rows = [(0, None, [("at", 0, 1)]), (1, 9, [("at", 0, 1)]), (2, 2, None), (3, 2, [("over", 0, 1)]), (4, 2, []), (5, 1, []), (6, 2, [("at", None, 1)])]
    got = {r.id: (r.reason, r.prefix, r.minimal) for r in puzzles.solved(spark.createDataFrame(rows, schema), F.col("n"), "clues", 3).collect()}
    assert [got[i][0] for i in range(7)] == ["seats", "seats", "clues", "clues", "several", None, "clues"] and all(got[i][1] is None for i in range(7))
    assert puzzles.solved(spark.createDataFrame([], schema), F.col("n"), "clues").count() == 0
    assert [len(r.seatings) for r in puzzles.seatings(spark, 6).orderBy("n").collect()] == [1, 2, 6, 24, 120, 720]


def test_generated_families(spark):
    made = puzzles.families(spark.range(30), "id", 5, 3)
    assert made.where("reason IS NULL").where("size(totals) = 4").count() > 5
    drawn = {(r.family, r.k): r.value for r in puzzles.draws(spark.range(30).repartition(3), "id", 4, 5, -20, 60).collect()}
    assert len(drawn) == 120 and min(drawn.values()) < 0 < max(drawn.values())
    for r in made.collect():
        v = [drawn[r.family, k] for k in range(4)]
        assert (r.base, r.corrections, r.totals) == (v[0] + 100, v[1:], [v[0] + 100 + sum(v[1 : t + 1]) for t in range(4)])
    far = spark.createDataFrame([(10**15,), (None,)], "id long")
    assert all(r.family is None or -20 <= r.value <= 60 for r in puzzles.draws(far, "id", 4, 5, -20, 60).collect())


@pytest.mark.parametrize(
    ("raw", "reason"),
    [
        ('{"claims": [{"id": 0, "text": "t", "source_ids": [1]}], "conclusion": "c"}', None),
        ('{"claims": [], "conclusion": "c", "more": 1}', "keys"),
        ('{"claims": [{"id": 0, "text": "t", "source_ids": []}, {"id": 0, "text": "u", "source_ids": []}], "conclusion": "c"}', "duplicate id"),
        ('{"claims": [{"id": "x", "text": "t", "source_ids": []}], "conclusion": "c"}', "claim"),
        ("nonsense", "not an object"),
    ],
)
def test_output_parsing(spark, raw, reason):
    r = spark.createDataFrame([(raw,)], "raw string").select(outputs.parse(F.col("raw")).alias("p")).first().p
    assert r.reason == reason and (r.output is None) == (reason is not None)


def test_positive_control_and_confidence(spark):
    r = spark.range(1).select(outputs.contaminate(outputs.parse(F.lit('{"claims": [{"id": 3, "text": "t", "source_ids": [0]}], "conclusion": "c"}'))["output"], F.lit("stale")).alias("o"), outputs.verbalised(F.lit("no idea"), F.lit("maybe 85 of 100")).alias("v")).first()
    assert [c.id for c in r.o.claims] == [3, 4] and r.o.conclusion == "c stale" and (r.v.value, r.v.missing) == (85, False)
