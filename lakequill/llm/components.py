"""Connected components of an edge table by hooking to the least neighbour and contracting.

Each round every node hooks to the smallest node next to it, pointers are followed one step further, and the edges are
rewritten between the nodes that are left; each component at least halves, so rounds grow with the logarithm of its size.
Hubs cost nothing special: neighbours are reduced by a partial aggregate, and the joins have one row for each key on one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import Store


def connected_components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, root) for every node with an edge; root is the component's least node.

    edges has the columns a and b of one orderable type; direction, repeats, loops and null ends don't matter. No edges
    give no rows.
    """
    ordered = lambda e: e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = store.save(ordered(edges), "edges")
    steps: list[DataFrame] = []
    while not e.isEmpty():
        near = e.union(e.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        hooks = store.save(near.select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "hooks")
        top = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = store.save(hooks.join(top, "up").select("node", F.col("top").alias("root")), "step")
        steps.append(step)
        ends = lambda c: step.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        left = e.join(ends("a"), "a").join(ends("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        e = store.save(ordered(left), "edges")
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[-1]
    for step in reversed(steps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
        out = store.save(step.join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "roots")
    return out


def least_members(members: DataFrame, salts: int = 16) -> DataFrame:
    """(node, least): the least value of the node's component. members: (node, root, value).

    The values of a component are reduced by a partial aggregate; a component of any size takes its result back in `salts` shares.
    """
    least = members.groupBy("root").agg(F.min("value").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = members.select("node", "root", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int").alias("salt"))
    return dealt.join(least, ["root", "salt"]).select("node", "least")
