"""Text normalisation, number extraction and rule-based tests as Column expressions (no Python on the executors).

Character classes are ASCII on purpose; pass text through fold() first where diacritics matter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words from zero to twenty.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
).split()
#: Words that carry no content.
STOP_WORDS = ("a an the of to in on at by for and or is are was were be it its this that with as from what which how many much does do did").split()
_NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
#: Letters that have no decomposition, as they are spelt without their stroke or dot.
_LETTERS = {"ł": "l", "đ": "d", "ø": "o", "ß": "ss", "ı": "i"}
#: Ligatures, which have none either.
_LIGATURES = {"œ": "oe", "æ": "ae"}
#: Keywords of a refusal, few and many.
REFUSAL_FEW = ("cannot compute", "not provided", "no meter", "were not provided", "no values", "cannot calculate", "not specified", "declarations page", "unable to")
REFUSAL_MANY = (
    *REFUSAL_FEW, "missing", "not given", "need the", "were provided", "without the", "don't have", "do not have", "please provide", "isn't sufficient",
    "is not sufficient", "provide the", "provide those",
)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c evaluated once a row however often f uses it: an expression that a lambda or several branches name is evaluated anew each time."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def norm_exact(c: Column) -> Column:
    """Lower case, every run of other characters one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f\x0b]+", " "))


def tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def content_tokens(c: Column, stop: tuple[str, ...] | list[str] = STOP_WORDS) -> Column:
    return F.array_except(tokens(c), F.array(*map(F.lit, stop)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; empty against empty is 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, str, dict[str, str]]:
    """What folding does to each code point that compatibility decomposition changes: ones that become one other, those
    dropped (combining marks), and those that become several, lower-cased like the text.
    """
    one, dropped, several = dict[str, str](), [], _LIGATURES | {k: v for k, v in _LETTERS.items() if len(v) > 1}
    one |= {k: v for k, v in _LETTERS.items() if len(v) == 1}
    for code in range(128, 0x110000):
        if 0xAC00 <= code < 0xD7A4 or 0xD800 <= code < 0xE000:  # syllables, which are made of letters outside Latin; surrogates
            continue
        c = chr(code)
        out = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).lower()
        if not out:
            dropped.append(c)
        elif out != c and c not in several:
            (one if len(out) == 1 else several).setdefault(c, out)
    return "".join(one), "".join(one.values()), "".join(dropped), several


def fold(c: Column) -> Column:
    """Lower case, compatibility decomposition, no combining marks; strokes, sharp s and ligatures spelt out.

    ASCII stays as it is. One translate does nearly all; code points that become several (ligatures, fractions, units) are looked up only in texts
    that hold any.
    """
    was, now, dropped, several = _decompositions()
    common = ("ß", "œ", "æ")
    lower = low = F.lower(c)
    for a in common:
        low = F.replace(low, F.lit(a), F.lit(several[a]))
    rare = {k: v for k, v in several.items() if k not in common}
    keys, spans = "".join(rare), list[list[int]]()
    for code in sorted(map(ord, rare)):  # a few wide ranges: the test may let others through, it must not miss any
        if spans and code - spans[-1][1] < 64:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    inside = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"
    values = F.split(F.lit("\x01".join(rare.values())), "\x01")  # in the order of keys
    spelt = F.array_join(F.transform(F.split(low, ""), lambda x: F.when(x < "\x80", x).otherwise(F.coalesce(F.get(values, F.instr(F.lit(keys), x) - 1), x))), "")
    folded = F.translate(F.when(low.rlike(inside), spelt).otherwise(low), was + dropped, now)
    return F.when(F.octet_length(lower) > F.length(lower), folded).otherwise(lower)  # ASCII is not looked up


def gold_key(c: Column) -> Column:
    """Only the letters a to z, in lower case, and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def numbers(c: Column) -> Column:
    """All numbers in order, thousands separators dropped."""
    found = F.regexp_extract_all(c, F.lit(_NUMBER), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(x, ",", "").try_cast("double")), lambda x: x.isNotNull())


def number_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(numbers(c)))


def _plain(n: Column) -> Column:
    """A number without grouping, and without zeros at its end."""
    return F.regexp_replace(F.replace(F.format_number(n.cast("double"), 10), F.lit(","), F.lit("")), r"\.?0+$", "")


def number_forms(n: Column) -> Column:
    """The spellings under which a number may stand in a text: whole ones also with zeros behind the point, others by their places."""
    whole = n.cast("long")
    d = n.cast("double")
    two = F.format_number(d, 2)
    of_whole = F.array(whole.cast("string"), F.format_number(whole, 0), two, F.concat(whole.cast("string"), F.lit(".0")))
    tenth = F.when(F.round(d, 1) == d, F.replace(F.format_number(d, 1), F.lit(","), F.lit("")))
    other = F.array_compact(F.array(_plain(d), F.replace(two, F.lit(","), F.lit("")), two, tenth))
    return F.array_distinct(F.when(d == whole, of_whole).otherwise(other))


def spellings(n: Column) -> Column:
    """The spellings of a rewrite: a whole number plain and grouped, another also by two places, or one; each with and without $."""
    whole, d = n.cast("long"), n.cast("double")
    forms = F.when(d == whole, F.array(whole.cast("string"), F.format_number(whole, 0))).otherwise(number_forms(n))
    return F.array_distinct(F.concat(forms, F.transform(forms, lambda x: F.concat(F.lit("$"), x))))


def _digits(words: Column) -> Column:
    names = F.array(*map(F.lit, NUMBER_WORDS))
    return F.transform(words, lambda w: F.when(w.isin(*NUMBER_WORDS), (F.array_position(names, w) - 1).cast("string")).otherwise(w))


def digitize(c: Column) -> Column:
    """Word list with number words as digits and without articles."""
    kept = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    for article in ("a", "an", "the"):
        kept = F.array_remove(kept, article)
    return _digits(kept)


def spaced(c: Column) -> Column:
    """The words of a text in lower case, without articles, a space before each and at the end: a run of words is a part of the string."""
    gap = "[^a-z0-9]+"
    return F.regexp_replace(F.concat(F.lit(" "), c, F.lit(" ")), f"{gap}(?:(?:an?|the){gap})*+", " ")  # possessive, so that many articles need no stack


def digit_line(line: Column) -> Column:
    """Number words of a spaced line as digits."""
    spelt = rf" (?=[{initials(NUMBER_WORDS)}])(?:{'|'.join(NUMBER_WORDS)}) "
    return F.when(line.rlike(spelt), F.array_join(_digits(F.split(line, " ")), " ")).otherwise(line)


def word_line(c: Column) -> Column:
    """The words of digitize as a spaced line; c in lower case."""
    return once(spaced(c), digit_line)


def initials(words: tuple[str, ...] | list[str]) -> str:
    """The first letters of the words in either case, for a character class that a pattern tries before the words."""
    return "".join(sorted({x for w in words for x in (w[0].lower(), w[0].upper())}))


def number_after_marker(c: Column, marker: str) -> Column:
    """The first number after the last marker; without a marker the text's last number; null if there is none."""
    low = F.lower(c)
    tail = F.when(F.contains(low, F.lit(marker)), F.substring_index(low, marker, -1))
    return F.coalesce(F.try_element_at(numbers(tail), F.lit(1)), F.try_element_at(numbers(c), F.lit(-1)))


def bounded_int(c: Column, last: bool = True, low: int = 0, high: int = 100) -> Column:
    """The first or last whole number of the text that lies within bounds."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.try_element_at(F.filter(found, lambda x: (x >= low) & (x <= high)), F.lit(-1 if last else 1))


def canonical_decimal(c: Column) -> Column:
    """The text's one number as DECIMAL(38,10); null when there is none or more than one (unparseable)."""
    found = F.regexp_extract_all(c, F.lit(_NUMBER), F.lit(0))
    return F.when(F.size(found) == 1, F.regexp_replace(found[0], ",", "").try_cast("decimal(38,10)"))


def conclusion_letter(c: Column, letters: str = "ABCDE") -> Column:
    """The last option letter that stands alone."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(rf"(?<![A-Za-z])([{letters}])(?![A-Za-z'])"), F.lit(1)), F.lit(-1))


def contains_run(words: Column, run: Column) -> Column:
    """Whether the word array holds the other as neighbours in order; an empty run is not held."""
    n, k = F.size(words), F.size(run)
    return F.when((k > 0) & (n >= k), F.exists(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.slice(words, i, k) == run)).otherwise(F.lit(False))


def mentions(c: Column, keywords: list[str]) -> Column:
    low = F.lower(c)
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k))


def refusal(c: Column, broad: bool = False) -> Column:
    """Keyword refusal, narrow or broad."""
    narrow = ["i cannot", "i can't", "unable to", "not possible to determine"]
    return mentions(c, narrow + (["insufficient", "not enough information", "cannot be determined", "unknown"] if broad else []))


def declines(c: Column, many: bool = False) -> Column:
    """Whether a keyword of refusal stands in the text; a null text declines nothing."""
    return mentions(F.coalesce(c, F.lit("")), list(REFUSAL_MANY if many else REFUSAL_FEW))


def presence_proxy(item: Column, text: Column, least: int = 2) -> Column:
    """The item's numbers meet the text's, or `least` content words do."""
    return F.arrays_overlap(number_set(item), number_set(text)) | (F.size(F.array_intersect(content_tokens(item), content_tokens(text))) >= least)


def worksheet(c: Column) -> Column:
    """Lines 'name: number' as a map; the last of equal names wins."""
    names = F.regexp_extract_all(c, F.lit(r"(?m)^\s*([A-Za-z_]\w*)\s*[:=]\s*-?\d+(?:\.\d+)?\s*$"), F.lit(1))
    values = F.regexp_extract_all(c, F.lit(r"(?m)^\s*[A-Za-z_]\w*\s*[:=]\s*(-?\d+(?:\.\d+)?)\s*$"), F.lit(1))
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    later = F.filter(pairs, lambda p, i: ~F.exists(F.slice(names, i + 2, F.greatest(F.size(names), F.lit(1))), lambda n: n == p["k"]))
    return F.map_from_arrays(F.transform(later, lambda p: p["k"]), F.transform(later, lambda p: p["v"].cast("double")))


def unit_after(c: Column, number: Column) -> Column:
    """The word that follows a number, by splitting into words rather than by a pattern for each row."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]+|\d[\d,]*(?:\.\d+)?"), F.lit(0))
    at = F.array_position(F.transform(words, lambda w: F.regexp_replace(w, ",", "")), number.cast("string"))
    word = F.try_element_at(words, (at + 1).cast("int"))
    return F.when((at > 0) & word.rlike("^[a-z]+$"), word)


def only_superseded(premises: Column, needle: str, marker: str) -> Column:
    """Every premise that mentions the needle has the marker; false when none mentions it."""
    found = F.filter(premises, lambda p: F.contains(F.lower(p), F.lit(needle)))
    return (F.size(found) > 0) & F.forall(found, lambda p: F.contains(F.lower(p), F.lit(marker)))


def stale_only_in_retraction(premises: Column, value: Column, markers: tuple[str, ...]) -> Column:
    """Every premise with a spelling of the number (plain or grouped, with $ or not) has a marker; false without such a premise."""
    whole, d = value.cast("long"), value.cast("double")
    grouped = F.regexp_replace(F.format_number(d, 10), r"\.?0+$", "")
    forms = F.when(d == whole, F.array(whole.cast("string"), F.format_number(whole, 0))).otherwise(F.array(_plain(d), grouped))  # with $ they hold these
    found = F.filter(premises, lambda p: F.exists(forms, lambda f: F.contains(p, f)))
    return F.coalesce((F.size(found) > 0) & F.forall(found, lambda p: mentions(p, list(markers))), F.lit(False))


def conclusion(claims: Column, none: str = "No conclusion.") -> Column:
    """Claim texts joined by '; ', without their full stops."""
    return F.when(F.size(claims) > 0, F.concat(F.array_join(F.transform(claims, lambda x: F.rtrim(x, F.lit(" ."))), "; "), F.lit("."))).otherwise(F.lit(none))


def words_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"[ \t\n\r\f\x0b]+"), lambda w: w != ""))
