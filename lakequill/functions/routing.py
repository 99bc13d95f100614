"""Tasks whose parameters differ in shape by axis: fields are read from a VARIANT by path, defaults are told apart from values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("must_change", "must_persist")


def task(text: Column) -> Column:
    """The task as a VARIANT; null where the text is not JSON or not an object."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def items(v: Column, path: str) -> Column:
    """The list at a path; null where there is none or something else."""
    return F.try_variant_get(v, path, "array<variant>")


def dose_level(v: Column) -> Column:
    """A whole number, or a text like D3 or 3; anything else is null."""
    said = F.try_variant_get(v, "$.dose_level", "string")
    return F.regexp_extract(said, r"^D?(\d{1,9})$", 1).try_cast("int")


def routing(v: Column) -> Column:
    """(family_id, axis, dose_level, break_side, verdict_item, verdict_item_defaulted, item_roles) of a task.

    verdict_item says of each item of the broken side whether the verdict counts it. Where the field is not a list, all items
    count and verdict_item_defaulted is true; a side that is unknown means must_change, a side without a list has no items. An
    element that is no boolean is null. Parameters that are no object have no fields. Null where the task is.
    """
    text = lambda path: F.try_variant_get(v, path, "string")
    side = text("$.break_side")
    broken = F.when(side == SIDES[1], items(v, f"$.{SIDES[1]}")).otherwise(items(v, f"$.{SIDES[0]}"))
    given = items(v, "$.axis_params.verdict_item")
    own = F.transform(given, lambda x: F.try_variant_get(x, "$", "boolean"))
    every = F.transform(F.coalesce(broken, F.array().cast("array<variant>")), lambda _: F.lit(True))
    roles = F.transform(items(v, "$.axis_params.item_roles"), lambda x: F.try_variant_get(x, "$", "string"))
    fields = {"family_id": text("$.family_id"), "axis": text("$.axis"), "dose_level": dose_level(v), "break_side": side, "verdict_item": F.coalesce(own, every), "verdict_item_defaulted": given.isNull(), "item_roles": roles}
    return F.when(v.isNotNull(), F.struct(*(c.alias(n) for n, c in fields.items())))


def rejection(v: Column) -> Column:
    """Why a task can't be transformed: the first path that is missing or of another type, then counts that don't agree; null if fine.

    Roles, verdicts and must_change have one element an item; of the items, those whose role is not insurance have one derivation
    step each.
    """
    roles, verdicts, change, ops = (items(v, p) for p in ("$.axis_params.item_roles", "$.axis_params.verdict_item", "$.must_change", "$.axis_params.derivation.ops"))
    params = F.schema_of_variant(F.try_variant_get(v, "$.axis_params", "variant"))
    derived = F.size(F.filter(roles, lambda r: ~F.try_variant_get(r, "$", "string").eqNullSafe(F.lit("insurance"))))
    out = F.when(v.isNull(), "json").when(params.isNull() | ~params.startswith("OBJECT"), "axis_params")
    for name, found in (("item_roles", roles), ("verdict_item", verdicts), ("must_change", change)):
        out = out.when(found.isNull(), name)
    out = out.when((F.size(roles) != F.size(verdicts)) | (F.size(roles) != F.size(change)), "lengths")
    return out.when(ops.isNull(), "derivation.ops").when(derived != F.size(ops), "steps")


def verdict_rate(verdict_item: Column, asserted: Column) -> Column:
    """The share asserted of the items that the verdict counts; `asserted` maps an item's index, as a text, to a boolean, and items
    that are not in it were pruned. Null where no item is left."""
    kept = F.filter(F.transform(verdict_item, lambda counts, i: F.when(counts, F.try_element_at(asserted, i.cast("string")))), lambda x: x.isNotNull())
    return F.try_divide(F.size(F.filter(kept, lambda x: x)).cast("double"), F.when(kept.isNotNull(), F.size(kept)).cast("double"))
