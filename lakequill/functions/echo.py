"""Whether an output repeats a superseded value or verdict as live. All tests are Column expressions over one row.

A text is read once into its measures, an array of numbers with the words on either side, and everything else is set and array
operations on measures: the stale value of a statement is the first measure it assigns, an output repeats it if its premises
hold a measure of that value, and each reason not to count the repetition (threshold, right value, other unit, label,
retraction) is one entry of a list. No reason is left over for a value that is repeated as live.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakequill.functions.text import STOP_WORDS, once

#: Words that mark a premise as retracting what it mentions.
SUPERSESSION = (
    "supersede", "superseded", "supersedes", "original", "prior figure", "earlier", "revised", "replacing", "replaced", "instead of", "treated as false",
    "corrects", "corrected", "updating", "updated", "raised to", "raising it", "no longer", "previously", "revision", "was ", "had been", "overrides", "overridden",
)
#: Words of a verdict, on either side of a threshold.
VERDICTS = (
    "exceed", "fail", "falls short", "fall short", "below", "short of", "violat", "cannot", "not all", "may not", "does not meet", "doesn't meet", "not meet",
    "insufficient", "over the", "over capacity", "beyond", "too ", "meets", "within", "fits", "sufficient", "satisf",
)
#: Words that assign the number after them, and units that tell a quantity without such a word.
ASSIGNING = ("is", "of", "=", "total", "totals", "equals", "reaches")
QUANTITY_UNITS = (
    "tonne", "tonnes", "metre", "metres", "meter", "meters", "kw", "hour", "hours", "passenger", "passengers", "crate", "crates", "loaves", "cakes", "litre", "litres",
    "liter", "liters", "unit", "units", "vehicle", "vehicles", "ride", "rides", "batch", "batches", "pascal", "pascals", "kn", "%", "°", "dollar", "dollars", "per",
)
#: Verbs before which a statement names its quantity.
VERBS = ("is", "are", "was", "were", "exceed", "exceeds", "fail", "fails", "meet", "meets", "fits", "falls", "violates", "cannot", "below", "above")
_NUMBER = r"\$?\d+(?:,\d+)*(?:\.\d+)?"
#: A number with a possessive ending if it has one, a word, or any other sign.
_TOKEN = rf"{_NUMBER}(?:['’]s\b)?|\p{{L}}[\p{{L}}\p{{N}}/'’-]*|\S"
#: Words of a topic have so many letters at least, and are so many at most.
_TOPIC_LETTERS, _TOPIC_WORDS = 4, 4


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(0))


def measures(c: Column) -> Column:
    """The numbers of a text in order: value, unit (the word or sign that follows directly, '' if none does), label (a possessive
    ordinal like "Silo 4's") and lead (the word before). Currency signs and separators are dropped."""
    unit = lambda t: F.when(t.rlike(r"^[\p{L}%°]"), F.lower(t)).otherwise("")

    def found(words: Column) -> Column:
        read = lambda t, i: F.struct(_number(t).alias("value"), F.coalesce(unit(F.get(words, i + 1)), F.lit("")).alias("unit"), t.rlike("['’]s$").alias("label"), F.lower(F.get(words, i - 1)).alias("lead"))
        return F.filter(F.transform(words, lambda t, i: F.when(_numeric(t), read(t, i))), lambda m: m["value"].isNotNull())

    return once(_tokens(c), found)


def _numeric(token: Column) -> Column:
    return token.rlike(r"^\$?\d")


def _number(token: Column) -> Column:
    return F.regexp_replace(token, r"[$,]|['’]s$", "").try_cast("double")


def money(c: Column) -> Column:
    """Numbers in order, with currency signs and separators dropped."""
    return F.filter(F.transform(F.filter(_tokens(c), _numeric), _number), lambda v: v.isNotNull())


def _marked(c: Column, words: tuple[str, ...]) -> Column:
    return once(F.lower(c), lambda low: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))


def _of(found: Column, value: Column) -> Column:
    """The measures of one value."""
    return F.filter(found, lambda m: m["value"] == value)


def stale_value(statement: Column) -> Column:
    """(value, threshold): the first measure that the statement assigns, by a word before it or a unit after it, and the number
    that comes next. A label's ordinal is no measure; a statement without an assignment has neither."""
    return once(measures(statement), _assigned)


def _assigned(found: Column) -> Column:
    """The same from the statement's measures."""
    assigns = lambda m: ~m["label"] & (F.coalesce(m["lead"].isin(*ASSIGNING), F.lit(False)) | m["unit"].isin(*QUANTITY_UNITS))
    pick = lambda at, i: F.when(at > 0, F.get(found, i)["value"])
    return once(F.array_position(F.transform(found, assigns), True).cast("int"), lambda at: F.struct(pick(at, at - 1).alias("value"), pick(at, at).alias("threshold")))


def value_echo(statement: Column, premises: Column, correct: Column) -> Column:
    """(value, threshold, mentions, reasons, echo): how often the premises hold the stale value, and why they don't repeat it as
    live. correct is the text of the right final state."""
    read = F.struct(measures(statement).alias("own"), F.transform(premises, measures).alias("said"))
    return once(read, lambda r: once(_assigned(r["own"]), lambda stale: once(_of(F.flatten(r["said"]), stale["value"]), lambda theirs: _echo(stale, r["own"], r["said"], theirs, premises, correct))))


def _echo(stale: Column, own: Column, said: Column, theirs: Column, premises: Column, correct: Column) -> Column:
    """value_echo of texts that have been read; theirs are the premises' measures of the stale value."""
    value, mine = stale["value"], _of(own, stale["value"])
    units = lambda found: F.transform(found, lambda m: m["unit"])
    holding = F.filter(premises, lambda p, i: F.size(_of(F.get(said, i), value)) > 0)
    reasons = {
        "threshold": value == stale["threshold"],
        "correct": F.size(_of(measures(correct), value)) > 0,
        "unit": ~F.arrays_overlap(units(mine), units(theirs)),
        "label": F.forall(theirs, lambda m: m["label"]),
        "superseded": F.forall(holding, lambda p: _marked(p, SUPERSESSION)),
    }
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in reasons.items())))
    mentions = F.coalesce(F.size(theirs), F.lit(0))
    kept = F.when(mentions > 0, found).otherwise(F.array().cast("array<string>"))
    told = lambda kept: F.struct(value.alias("value"), stale["threshold"].alias("threshold"), mentions.alias("mentions"), kept.alias("reasons"), ((mentions > 0) & (F.size(kept) == 0)).alias("echo"))
    return once(kept, told)


def topic(statement: Column) -> Column:
    """The first longer words before the statement's verb, which name what it is about."""
    words = F.transform(_tokens(statement), lambda w: F.lower(w))
    verb = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(w.isin(*VERBS), i)), lambda i: i.isNotNull()))
    named = F.filter(words, lambda w, i: F.coalesce(i < verb, F.lit(True)) & w.rlike(rf"^\p{{L}}{{{_TOPIC_LETTERS},}}") & ~w.isin(*STOP_WORDS, "total", "combined"))
    return F.slice(named, 1, _TOPIC_WORDS)


def verdict_echo(statement: Column, premises: Column, correct: Column) -> Column:
    """A value repeated as live in a premise that also speaks of the statement's topic and gives a verdict."""
    def judged(r: Column) -> Column:
        stale, about = r["stale"], r["about"]
        on_topic = lambda p: (F.size(about) == 0) | F.exists(about, lambda w: F.contains(F.lower(p), w))
        judging = F.filter(premises, lambda p: _marked(p, VERDICTS) & ~_marked(p, SUPERSESSION) & on_topic(p))
        return stale["echo"] & F.exists(judging, lambda p: F.size(_of(measures(p), stale["value"])) > 0)

    return once(F.struct(value_echo(statement, premises, correct).alias("stale"), topic(statement).alias("about")), judged)


def classified(statement: Column, premises: Column, correct: Column) -> Column:
    """REAL where the value is repeated as live, SUPERSESSION where being retracted is all that speaks against it, else INSTRUMENT."""
    def named(found: Column) -> Column:
        only_retracted = (F.size(found["reasons"]) == 1) & F.array_contains(found["reasons"], "superseded")
        return F.when(found["echo"], "REAL").when(only_retracted, "SUPERSESSION").otherwise("INSTRUMENT")

    return once(value_echo(statement, premises, correct), named)


def acknowledged(premises: Column, source_ids: Column, superseded_ids: Column, corrections: Column) -> Column:
    """A correction is acknowledged by a marker word, by citing no superseded source, or by a number of its own."""
    marker = F.exists(premises, lambda p: _marked(p, SUPERSESSION))
    avoids = (F.size(source_ids) > 0) & ~F.arrays_overlap(source_ids, superseded_ids)
    number = F.arrays_overlap(money(F.array_join(premises, " ")), money(F.array_join(corrections, " ")))
    tests = F.struct(marker.alias("marker"), avoids.alias("avoids"), number.alias("number"))
    return once(tests, lambda t: F.struct(*(t[n].alias(n) for n in ("marker", "avoids", "number")), (t["marker"] | t["avoids"] | t["number"]).alias("acknowledged")))


def flipped(before: Column, after: Column, threshold: Column) -> Column:
    """The requirement's verdict changes; undetermined numbers don't flip."""
    return F.coalesce((before >= threshold) != (after >= threshold), F.lit(False))


def rewrite_number(text: Column, old: Column, new: Column) -> Column:
    """(text, reason): old replaced by new in the old one's style. A number that doesn't stand alone exactly once is refused."""
    plain = lambda n: F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))
    grouped = lambda n: F.when(n == F.floor(n), F.format_number(n, 0)).otherwise(plain(n))
    found = F.filter(F.regexp_extract_all(text, F.lit(r"(?<![\w.,])\d[\d,]*(?:\.\d+)?(?![\w])"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").try_cast("double") == old)
    once = F.size(found) == 1
    spelt = F.when(F.contains(found[0], F.lit(",")), grouped(new)).otherwise(plain(new))
    reason = F.when(F.size(found) == 0, "absent").when(~once, "ambiguous")
    alone = F.concat(F.lit(r"(?<![\w.,])\Q"), F.try_element_at(found, F.lit(1)), F.lit(r"\E(?!\w)"))
    done = F.regexp_replace(text, alone, spelt)
    return F.struct(F.when(once, done).alias("text"), reason.alias("reason"))
