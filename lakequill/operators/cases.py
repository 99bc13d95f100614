"""Scored cases of trajectories: guarded counts by arm and dose, paired contrasts, acceptance gates, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.functions.text import canonical_decimal
from lakequill.operators import decisions, stats
from lakequill.operators.votes import count_if

TOP = 3


def same_scalar(a: Column, b: Column) -> Column:
    """Equal as exact decimals; an unparseable side is not equal."""
    return F.coalesce(canonical_decimal(a) == canonical_decimal(b), F.lit(False))


def exploded(rows: DataFrame) -> DataFrame:
    """One row a case, with the cell re-derived, whether the capture agrees, and whether the trajectory kept its exception.

    rows: task_id, family_id, arm, dose_level, scored_cases (case_id, cls, A_correct, A_wrong, emitted, a_correct_fired, a_wrong_fired).
    """
    right = lambda c: same_scalar(c["emitted"], c["A_correct"])
    kept = F.exists("scored_cases", lambda c: (c["cls"] == "EXCEPTED") & right(c) & ~same_scalar(c["emitted"], c["A_wrong"]))
    cases = rows.select("task_id", "family_id", "arm", "dose_level", kept.alias("kept"), F.explode("scored_cases").alias("c"))
    ac, aw = right(F.col("c")), same_scalar(F.col("c.emitted"), F.col("c.A_wrong"))
    agrees = F.coalesce((F.col("c.a_correct_fired") == ac) & (F.col("c.a_wrong_fired") == aw), F.col("c.a_correct_fired").isNull())
    return cases.select("task_id", "family_id", "arm", "dose_level", "kept", F.col("c.case_id").alias("case_id"), F.col("c.cls").alias("cls"), decisions.cell(ac, aw).alias("cell"), agrees.alias("agrees"))


def by_dose(cases: DataFrame) -> DataFrame:
    """(arm, dose_level, events, trials, ff, tt, mismatches). A scoped case counts only where the exception was kept and its cell
    is decided; a blanket case always counts, and is an event unless it is right."""
    scored, scoped = F.col("cls").isin("RULE", "NEW"), F.col("arm") == "SCOPED"
    decided = F.col("cell").isin("TF", "FT")
    trial = scored & F.when(scoped, F.col("kept") & decided).otherwise(F.lit(True))
    event = trial & F.when(scoped, F.col("cell") == "FT").otherwise(F.col("cell") != "TF")
    return cases.groupBy("arm", "dose_level").agg(
        count_if(event).alias("events"), count_if(trial).alias("trials"), count_if(scored & scoped & (F.col("cell") == "FF")).alias("ff"),
        count_if(scored & scoped & (F.col("cell") == "TT")).alias("tt"), count_if(~F.col("agrees")).alias("mismatches"),
    )


def family_contrast(cases: DataFrame) -> DataFrame:
    """(family_id, difference): scoped rate less blanket rate at the top dose, for families that have trials in both."""
    top = by_dose(cases.where(F.col("dose_level") == TOP).withColumn("dose_level", F.col("family_id"))).where("trials > 0")
    rate = lambda arm: top.where(F.col("arm") == arm).select(F.col("dose_level").alias("family_id"), (F.col("events") / F.col("trials")).alias(arm))
    return rate("SCOPED").join(rate("BLANKET"), "family_id").select("family_id", (F.col("SCOPED") - F.col("BLANKET")).alias("difference"))


def verdict(cases: DataFrame, theta: float, delta: float, alpha: float, permutations: int = 2000, seed: int = 1) -> dict[str, object]:
    """WITHHELD, NO_BREAK, DEGRADES_BUT_NOT_SEPARABLE or SCOPE_LEAK, with the counts it rests on (a few rows on the driver)."""
    counts = by_dose(cases)
    rows = {(r["arm"], r["dose_level"]): r for r in counts.collect()}
    scoped = [rows.get(("SCOPED", d)) for d in (1, 2, 3)]
    ff, tt, bad = (sum(r[c] for r in rows.values()) for c in ("ff", "tt", "mismatches"))
    trials = sum(r["trials"] for r in scoped if r)
    reasons = [n for n, on in (("mismatch", bad), ("tt", tt), ("ff_ceiling", ff > 0.05 * (trials + ff))) if on]
    out: dict[str, object] = {"reasons": reasons, "scoped": [(r["events"], r["trials"]) if r else (0, 0) for r in scoped]}
    if reasons or not all(r and r["trials"] for r in scoped):
        return out | {"verdict": "WITHHELD"}
    gate = stats.monotone(counts.where("arm = 'SCOPED'"), "dose_level", "events", "trials").first()["passes"]
    crossed = scoped[2]["events"] >= stats.critical_count(scoped[2]["trials"], theta, alpha)
    flip = stats.sign_flip(family_contrast(cases), "family_id", "difference", permutations, seed).first()
    blanket = rows.get(("BLANKET", TOP))
    apart = blanket is not None and blanket["trials"] and scoped[2]["events"] / scoped[2]["trials"] - blanket["events"] / blanket["trials"] >= delta and (flip["p"] or 1) < alpha
    name = "NO_BREAK" if not (gate and crossed) else "SCOPE_LEAK" if apart else "DEGRADES_BUT_NOT_SEPARABLE"
    return out | {"verdict": name, "gate": gate, "crossed": crossed, "p": flip["p"]}


def positive_controls(rows: DataFrame) -> DataFrame:
    """(controls, fired) of rows with a positive_control (target, emitted)."""
    fired = same_scalar(F.col("positive_control.emitted"), F.col("positive_control.target"))
    return rows.where("positive_control IS NOT NULL").agg(F.count("*").alias("controls"), count_if(fired).alias("fired"))


def accepted(cases: DataFrame, controls: DataFrame, ff_ceiling: float = 0.05, tolerance: float = 0.02) -> DataFrame:
    """(controls_fire, no_tt, ff_ok, curve_ok): gates before any verdict; the curve may fall by the tolerance."""
    counts = by_dose(cases).where("arm = 'SCOPED'")
    curve = stats.monotone(counts.where("trials > 0"), "dose_level", "events", "trials", tolerance).select(F.col("rising").alias("curve_ok"))
    sums = counts.agg((F.sum("tt") == 0).alias("no_tt"), (F.sum("ff") <= ff_ceiling * (F.sum("trials") + F.sum("ff"))).alias("ff_ok"))
    return controls.select((F.col("controls") == F.col("fired")).alias("controls_fire")).crossJoin(sums).crossJoin(curve)


def axis_verdict(counts: DataFrame, theta: float, alpha: float, expected: int | None, present: int, oracle: str | None) -> dict[str, object]:
    """Break of one axis from (dose, x, n) rows: PENDING without results, withheld when partial or unverified, VOID with an empty dose."""
    if not present:
        return {"status": "PENDING", "breaks": None}
    rows = {r["dose"]: r for r in counts.collect()}
    full = all(d in rows and rows[d]["n"] > 0 for d in (1, 2, 3))
    breaks = None
    if full:
        gate = stats.monotone(counts, "dose", "x", "n").first()["passes"]
        breaks = bool(gate and rows[3]["x"] >= stats.critical_count(rows[3]["n"], theta, alpha))
    status = "PARTIAL_WITHHELD" if expected is not None and present < expected else "ORACLE_WITHHELD" if oracle != "PASS" else "SCORED"
    return {"status": status, "breaks": breaks}


def program_verdict(axes: dict[str, dict[str, object]]) -> dict[str, object]:
    """FINAL once every axis is scored: some axis broke, or none did."""
    broke = sorted(a for a, v in axes.items() if v["status"] == "SCORED" and v["breaks"])
    if any(v["status"] != "SCORED" or v["breaks"] is None for v in axes.values()):
        return {"status": "PENDING", "broke": broke}
    return {"status": "FINAL", "broke": broke, "any_break": bool(broke)}


def fidelity_verdict(bars: dict[str, float]) -> Column:
    """The branch of a row of fidelity measures, by precedence: evidence first, transfer before added value."""
    c = F.col
    faithful = (c("r2") >= bars["r2"]) & (c("spearman") >= bars["spearman"]) & (c("within_spearman") >= bars["within"]) & (c("oracle_margin") >= bars["margin"])
    return decisions.verdict(
        [
            ("not_evaluable", c("n_negatives") < bars["negatives"]),
            ("length_confounded", faithful & (c("within_length_residual") < bars["within"])),
            ("range_uncovered", faithful & c("range_uncovered")),
            ("ood_failure", faithful & ((c("ood_pooled") < bars["ood_pooled"]) | (c("ood_min") < bars["ood_min"]))),
            ("no_margin_over_verbalised", faithful & (c("vs_verbal_low") <= bars["vs_verbal"])),
            ("no_margin_over_entropy", faithful & (c("vs_entropy_low") <= bars["vs_entropy"])),
            ("dominated_by_correctness_probe", faithful & (c("probe_over_low") > bars["probe_over"])),
            ("confirmed", faithful),
            ("binary_only", c("auc") >= bars["auc"]),
            ("margin_only", c("r2") >= bars["r2"]),
        ],
        "no_signal",
    )


def blinded(items: DataFrame, key: str, shown: list[str], hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """What annotators see and what they don't, joined by key only; a column in both lists is refused."""
    if both := set(shown) & set(hidden):
        raise ValueError(f"shown and hidden: {sorted(both)}")
    return items.select(key, *shown), items.select(key, *hidden)


def census_and_controls(items: DataFrame, flagged: Column, key: str, seed: int, controls: int, stratum: str) -> DataFrame:
    """Every flagged item and a proportional sample of the others, told apart by `part`."""
    from lakequill.operators.sampling import proportional

    every = items.where(F.coalesce(flagged, F.lit(False))).withColumn("part", F.lit("census"))
    other = proportional(items.where(~F.coalesce(flagged, F.lit(False))), stratum, key, seed, controls).withColumn("part", F.lit("control"))
    return every.unionByName(other)


def comparability(rows: DataFrame, excluded: Column, ceiling: float = 0.02) -> DataFrame:
    """(n, failures, rate, comparable) over final rows that aren't excluded; rows: run (like N-k3), failed."""
    final = rows.where(F.col("run").rlike(r"^[NS]-k\d+$") & ~F.coalesce(excluded, F.lit(False)))
    out = final.agg(F.count("*").alias("n"), count_if(F.col("failed")).alias("failures"))
    return out.withColumn("rate", F.try_divide("failures", "n")).withColumn("comparable", F.coalesce(F.col("rate") <= ceiling, F.lit(False)))
