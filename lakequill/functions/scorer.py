"""Scoring of answers by family as Column expressions: numbers with a tolerance, letters, and runs of words.

An answer that was cut off is excluded and never an error, unless what it was asked for stands in it. Answers are folded and
digitised before they are read; see text.fold and text.digitize.

The work is cut into steps, each of which names what the one before has found. `score` binds them as columns, which Spark compiles; `scored`
binds them in one expression by lambdas, which Spark interprets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.functions import text as X

#: What announces a final answer.
MARKERS = ("therefore", "answer", "equals", "total", "so", "is", "=", ":")
_NUMBER = r"[-+]?\d[\d,]*\.?\d*"
_CAPITAL = r"(?<![A-Za-z])[A-Z](?![A-Za-z])"
#: From the text's beginning over the last or the first marker; atomic, so that no other marker is tried when nothing fits behind it.
_LAST, _FIRST = (rf"(?s)^(?>{gap}(?=[{X.initials(MARKERS)}])(?i:{'|'.join(MARKERS)}))" for gap in (".*", ".*?"))


def _spelt(c: Column) -> Column:
    out = c
    for n, word in enumerate(X.NUMBER_WORDS):
        out = F.regexp_replace(out, rf"(?i)\b{word}\b", f" {n} ")
    return F.when(c.rlike(rf"(?i)(?=[{X.initials(X.NUMBER_WORDS)}])\b(?:{'|'.join(X.NUMBER_WORDS)})\b"), out).otherwise(c)  # most texts hold none


def spelt_out(c: Column) -> Column:
    """Number words from zero to twenty as digits, in place."""
    return X.once(c, _spelt)


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("double")


def _last(c: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(-1))


def _after(c: Column, wanted: str, last: bool = True) -> Column:
    """What is wanted behind the last or first marker, else an empty string."""
    return F.regexp_extract(c, rf"{_LAST if last else _FIRST}.*?({wanted})", 1)


def _how(after: Column, last: bool) -> Column:
    return F.when(after != "", "after-marker" if last else "first-after-marker").otherwise("last-number-fallback" if last else "first-number")


def _anywhere(said: Column, last: bool) -> Column:
    return _last(said, _NUMBER) if last else F.nullif(F.regexp_extract(said, _NUMBER, 0), F.lit(""))


def final_number(answer: Column, last: bool = True) -> Column:
    """(number, how): the first number after the last marker, else the last of all; for facts the first marker and number."""

    def read(said: Column) -> Column:
        return X.once(_after(said, _NUMBER, last), lambda after: X.once(F.when(after != "", after).otherwise(_anywhere(said, last)), lambda found: told(after, found)))

    def told(after: Column, found: Column) -> Column:
        return F.struct(_number(found).alias("number"), F.when(found.isNull(), "no-number").otherwise(_how(after, last)).alias("how"))

    return X.once(spelt_out(answer), read)


def _result(correct: Column, extracted: Column, note: Column, truncated: Column) -> Column:
    return F.struct(F.coalesce(correct, F.lit(False)).alias("correct"), F.coalesce(extracted, F.lit("")).alias("extracted"), note.alias("note"), truncated.alias("truncated"))


_Row = dict[str, Column]
#: How a gold is looked for: as the last number, as the first, as a letter, as words.
_NUMBER_LAST, _NUMBER_FIRST, _LETTER, _WORDS = range(4)


def _routed(r: _Row) -> _Row:
    name = F.trim(r["gold"])
    fact, deduced = r["family"] == "factual", r["family"] == "deduction"
    counted = name.rlike(r"^[-+]?\d+\.?\d*$")
    kind = F.when((r["family"] == "arithmetic") | (deduced & counted), _NUMBER_LAST).when(fact & counted, _NUMBER_FIRST)
    return {"name": name, "kind": kind.when((fact | deduced) & name.rlike(r"^\p{L}$"), _LETTER).when(fact | deduced, _WORDS)}


def _normal(r: _Row) -> _Row:
    worded = r["kind"] == _WORDS
    return {"said": F.when(r["kind"] < _LETTER, _spelt(r["answer"])), "words": F.when(worded, X.fold(r["answer"])), "run": F.when(worded, X.fold(r["name"]))}


def _marked(r: _Row) -> _Row:
    """What stands after a marker; words in a line."""
    kind = r["kind"]
    after = F.when(kind == _NUMBER_LAST, _after(r["said"], _NUMBER)).when(kind == _NUMBER_FIRST, _after(r["said"], _NUMBER, False)).when(kind == _LETTER, _after(r["answer"], _CAPITAL))
    return {"after": after, "words": X.spaced(r["words"]), "run": X.spaced(r["run"])}


def _found(r: _Row) -> _Row:
    kind = r["kind"]
    other = F.when(kind == _NUMBER_LAST, _anywhere(r["said"], True)).when(kind == _NUMBER_FIRST, _anywhere(r["said"], False)).when(kind == _LETTER, _last(r["answer"], _CAPITAL))
    return {"found": F.when(r["after"] != "", r["after"]).otherwise(other), "words": X.digit_line(r["words"]), "run": X.digit_line(r["run"])}


def _compared(r: _Row) -> _Row:
    """The numbers; the spelling whose words stand in the answer, the gold before others."""
    counted, worded, more = r["kind"] < _LETTER, r["kind"] == _WORDS, F.size(r["accept"]) > 0
    spelt = F.transform(r["accept"], lambda a: F.struct(F.trim(a).alias("name"), X.word_line(X.fold(F.trim(a))).alias("run")))
    other = F.get(F.filter(spelt, lambda n: (n["run"] != " ") & F.contains(r["words"], n["run"])), F.lit(0))["name"]
    hit = F.when(worded & (r["run"] != " ") & F.contains(r["words"], r["run"]), r["name"]).when(worded & more, other)
    right = F.when(r["kind"] == _LETTER, (r["found"] == r["name"]) | (more & F.exists(r["accept"], lambda a: F.trim(a) == r["found"])))
    return {"number": F.when(counted, _number(r["found"])), "want": F.when(counted, _number(_last(r["gold"], _NUMBER))), "hit": hit, "right": right}


def _judged(r: _Row) -> _Row:
    kind, cut, within = r["kind"], ~r["finished"], F.coalesce(r["tolerance"], F.lit(0.0))
    how = F.when(kind == _NUMBER_LAST, _how(r["after"], True)).otherwise(_how(r["after"], False))
    note = F.when(cut, "truncated-excluded").when(r["number"].isNull(), "no-number-parsed").when(r["want"].isNull(), "gold-not-numeric").otherwise(F.concat(F.lit("numeric["), how, F.lit("]tol="), within.cast("string")))
    number = _result(~cut & (F.abs(r["number"] - r["want"]) <= F.greatest(F.lit(1e-9), within)), r["number"].cast("string"), note, cut)

    note = F.when(cut, "truncated-excluded").when(r["right"], "conclusion-letter-match").otherwise("conclusion-letter-mismatch")
    letter = _result(~cut & r["right"], F.when(~cut, F.coalesce(r["found"], F.right(r["answer"], F.lit(40)))), note, cut)

    empty = r["run"] == " "
    ok = ~empty & r["hit"].isNotNull()
    note = F.when(empty, "empty-gold").when(r["words"] == " ", "empty-answer").when(ok, "token-run-match").when(cut, "truncated-excluded").otherwise("no-token-match")
    words = _result(ok, F.when(ok, r["hit"]).when(~empty, F.substring_index(F.trim(r["words"]), " ", -8)), note, cut & ~empty & ~ok)
    return {"result": F.when(kind < _LETTER, number).when(kind == _LETTER, letter).when(kind == _WORDS, words)}


_STEPS: tuple[Callable[[_Row], _Row], ...] = (_routed, _normal, _marked, _found, _compared, _judged)


def scored(family: Column, gold: Column, answer: Column, accept: Column, tolerance: Column, finished: Column) -> Column:
    """(correct, extracted, note, truncated) of one answer; null for families other than arithmetic, factual and deduction.

    accept: other spellings of the gold. Numeric golds of any family are compared as numbers, facts by the first number.
    """

    def after(row: _Row, k: int) -> Column:
        if k == len(_STEPS):
            return row["result"]

        def step(r: Column) -> Column:
            bound = {name: r[name] for name in row}
            return after(bound | _STEPS[k](bound), k + 1)

        return X.once(F.struct(*(c.alias(name) for name, c in row.items())), step)

    return after({"family": family, "gold": gold, "answer": answer, "accept": accept, "tolerance": tolerance, "finished": finished}, 0)


def score(df: DataFrame, into: str, family: Column, gold: Column, answer: Column, accept: Column, tolerance: Column, finished: Column) -> DataFrame:
    """df with scored() of its rows in a further column. Every step is a projection, so that nothing is shuffled and little interpreted."""
    row = {"family": family, "gold": gold, "answer": answer, "accept": accept, "tolerance": tolerance, "finished": finished}
    names = set[str]()
    for step in (lambda _: row, *_STEPS):
        new = step({name: F.col(f"__{name}") for name in names})
        df = df.withColumns({f"__{name}": c for name, c in new.items()})
        names |= set(new)
    return df.withColumn(into, F.col("__result")).drop(*(f"__{name}" for name in names))
