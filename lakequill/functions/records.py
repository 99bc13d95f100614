"""Nested records: sources, claims, prompts, verdict items, derivations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_texts(sources: Column) -> Column:
    """Texts of (id, text) structs by id, so that position is the id."""
    return F.transform(F.array_sort(sources), lambda s: s["text"])


def substitute(texts: Column, index: Column, other: Column) -> Column:
    return F.transform(texts, lambda x, i: F.when(i == index, other).otherwise(x))


def with_evidence(texts: Column, extra: Column) -> Column:
    return F.array_append(texts, extra)


def axis_documents(axis: Column, sources: Column, withheld: Column, corrections: Column) -> Column:
    """Axis A2 leaves sources out, the others append corrections."""
    left = F.filter(sources, lambda s: ~F.array_contains(withheld, s["id"]))
    return F.when(axis == "A2", ordered_texts(left)).otherwise(F.concat(ordered_texts(sources), corrections))


def numbered(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x)), "\n")


def turns(sources: Column, corrections: Column) -> Column:
    """One prompt list for each turn: the sources and the first t corrections, t from 0 to all of them."""
    return F.transform(F.sequence(F.lit(0), F.size(corrections)), lambda t: F.concat(sources, F.when(t > 0, F.slice(corrections, 1, F.greatest(t, F.lit(1)))).otherwise(F.array().cast("array<string>"))))


def sane_claims(claims: Column, n_sources: Column) -> Column:
    """Claims whose every source id exists."""
    return F.filter(claims, lambda c: F.forall(c["source_ids"], lambda i: (i >= 0) & (i < n_sources)))


def unique_ids(claims: Column) -> Column:
    ids = F.transform(claims, lambda c: c["id"])
    return F.size(F.array_distinct(ids)) == F.size(ids)


def asserted_texts(conclusion: Column, claims: Column) -> Column:
    return F.concat(F.array(conclusion), F.transform(claims, lambda c: c["text"]))


def contaminated(with_: Column, full: Column, floor: float = 0.7, ceiling: float = 0.3) -> Column:
    """Quantised dual threshold: rounding is half-even."""
    return (F.bround(with_, 9) >= floor) & (F.bround(full - with_, 9) < ceiling)


def flagged(source_ids: Column, is_contaminated: Column) -> Column:
    """Decorative (no sources) or contaminated."""
    return (F.size(source_ids) == 0) | is_contaminated


def contract(claims: Column) -> Column:
    """The fixpoint of dropping flagged claims. A claim's flag depends on nothing but itself, so one pass reaches it."""
    return F.filter(claims, lambda c: ~(c["flagged"]))


def dose(c: Column) -> Column:
    """All digits of the text as one number; no digit raises."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.when(digits != "", digits.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no dose in "), c)).cast("int"))


def in_band(summary_words: Column, document_words: Column, low: float, high: float) -> Column:
    """Compression ratio within bounds; no document words is outside."""
    return F.when(document_words > 0, (summary_words / document_words).between(low, high)).otherwise(F.lit(False))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def entail_scalar(entail: Column, contradict: Column) -> Column:
    return (entail - contradict + 1) / 2


def leave_one_out(scores: Column, dropped: Column) -> Column:
    """Best score over all sources less the best without one of them; an unknown index raises."""
    without = F.filter(scores, lambda x, i: i != dropped)
    best = lambda a: F.coalesce(F.array_max(a), F.lit(0.0))
    ok = (dropped >= 0) & (dropped < F.size(scores))
    return F.when(ok, best(scores) - best(without)).otherwise(F.raise_error(F.lit("no such source")).cast("double"))


def leave_set_out(scores: Column, dropped: Column) -> Column:
    """Best score over all sources less the best without those of a set; an index out of range, or null, raises, a repeated one counts once."""
    best = lambda a: F.coalesce(F.array_max(a), F.lit(0.0))
    known = F.forall(dropped, lambda i: i.isNotNull() & (i >= 0) & (i < F.size(scores)))
    contrast = best(scores) - best(F.filter(scores, lambda x, i: ~F.array_contains(dropped, i)))
    return F.when(known, contrast).otherwise(F.raise_error(F.concat(F.lit("no such source: "), F.array_join(dropped.cast("array<string>"), ", ", "null"))).cast("double"))


def entropy(p: Column) -> Column:
    """Of a probability array, in nats."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def evaluate(inputs: Column, ops: Column) -> Column:
    """A derivation: ops are (op, left, right) over the values so far, each adding one value; the values come back."""
    step = lambda v, o: F.array_append(
        v,
        F.when(o["op"] == "+", v[o["left"]] + v[o["right"]]).when(o["op"] == "-", v[o["left"]] - v[o["right"]]).when(o["op"] == "*", v[o["left"]] * v[o["right"]]).otherwise(F.try_divide(v[o["left"]], v[o["right"]])),
    )
    return F.aggregate(ops, inputs, step)


def cost_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 3.5).cast("long")


def leaks_token(c: Column, tokens: list[str]) -> Column:
    """Forbidden tokens that the text holds."""
    return F.filter(F.array(*map(F.lit, tokens)), lambda t: F.contains(F.lower(c), F.lower(t)))
