"""Connected components of a graph by contraction: every class joins its smallest neighbour until no edge is left.

The number of classes at least halves per round, and all group-bys are minima that collapse before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colsift.plans.session import cut_lineage


def _jump_to_roots(hooks: DataFrame) -> DataFrame:
    """Follow (node, root) until every root is its own root. Roots only get smaller, so there are no cycles."""
    while True:
        onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        jumped = cut_lineage(hooks.join(onward, "root", "left").select(
            "node", F.coalesce("_next", "root").alias("root"),
            (F.coalesce("_next", "root") != F.col("root")).alias("moved")), "hooks")
        hooks = jumped.select("node", "root")
        if not jumped.agg(F.bool_or("moved")).first()[0]:
            return hooks


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `nodes` (node); `edges` is (u, v), each pair once in either direction."""
    both = edges.unionAll(edges.select("v", "u")).filter("u <> v").distinct()
    left = cut_lineage(both, "edges")
    result = nodes.select("node", F.col("node").alias("root"))
    while not left.isEmpty():
        hooks = left.groupBy("u").agg(F.min("v").alias("v")).select(
            F.col("u").alias("node"), F.least("u", "v").alias("root"))
        hooks = _jump_to_roots(cut_lineage(hooks, "hooks"))
        of = lambda name: hooks.select(F.col("node").alias(name), F.col("root").alias(f"_{name}"))
        left = cut_lineage(left.join(of("u"), "u").join(of("v"), "v").select(
            F.col("_u").alias("u"), F.col("_v").alias("v")).filter("u <> v").distinct(), "edges")
        onward = hooks.select(F.col("node").alias("root"), F.col("root").alias("_root"))
        result = result.join(onward, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return cut_lineage(result, "components")
