"""Model outputs: strict parsing, rejection reasons, verbalised confidence, codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<claims:array<struct<id:int,text:string,source_ids:array<int>>>,conclusion:string>"


def parse(raw: Column) -> Column:
    """(output, reason): the record, or why it is rejected. Nothing is repaired."""
    out = F.from_json(raw, SCHEMA)
    keys = F.json_object_keys(raw)
    ids = F.transform(out["claims"], lambda c: c["id"])
    reason = (
        F.when(out.isNull() | keys.isNull(), "not an object")
        .when(F.array_sort(keys) != F.array(F.lit("claims"), F.lit("conclusion")), "keys")
        .when(out["claims"].isNull() | out["conclusion"].isNull(), "types")
        .when(F.exists(out["claims"], lambda c: c["id"].isNull() | c["text"].isNull() | c["source_ids"].isNull()), "claim")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate id")
    )
    return F.struct(F.when(reason.isNull(), out).alias("output"), reason.alias("reason"))


def serialise(output: Column) -> Column:
    return F.to_json(output)


def verbalised(first: Column, retry: Column) -> Column:
    """(value, missing): the first answer's number in 0..100, or else the retry's."""
    get = lambda c: F.regexp_extract(c, r"(?<!\d)(100|[1-9]?\d)(?!\d)", 1).try_cast("int")
    value = F.coalesce(get(first), get(retry))
    return F.struct(value.alias("value"), value.isNull().alias("missing"))


def contaminate(output: Column, statement: Column) -> Column:
    """A positive control: the statement as another claim and in the conclusion."""
    ids = F.transform(output["claims"], lambda c: c["id"])
    claim = F.struct((F.coalesce(F.array_max(ids), F.lit(-1)) + 1).alias("id"), statement.alias("text"), F.array(F.lit(0)).alias("source_ids"))
    return F.struct(F.array_append(output["claims"], claim).alias("claims"), F.concat(output["conclusion"], F.lit(" "), statement).alias("conclusion"))


def boolean_sentence(holds: Column, subject: Column) -> Column:
    return F.concat(subject, F.when(holds, " holds.").otherwise(" does not hold."))
