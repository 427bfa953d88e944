"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(nodes: DataFrame, links: DataFrame, most: int = 60) -> DataFrame:
    """(node, label): the smallest label reachable over links (a, b), for nodes (node, label) that have a link.

    Each round takes the minimum over neighbours (pre-aggregated, so a hub's links don't meet in one task)
    and then jumps: the label of the node that a label came from. Rounds grow with the logarithm of a
    component's diameter. Each round is a written table. Raises if ``most`` rounds don't settle it.
    """
    both = common.written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"), "links")
    state = common.written(nodes.join(both.select(F.col("a").alias("node")).distinct(), "node").select("node", "label", F.col("node").alias("at")), "labels")
    for _ in range(most):
        best = F.min(F.struct("label", "at"))
        near = both.join(state.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(best.alias("near"))
        step = state.join(near, "node").select("node", F.col("label").alias("old"), F.least(F.struct("label", "at"), F.col("near")).alias("new"))
        step = step.select("node", "old", F.col("new.label").alias("label"), F.col("new.at").alias("at"))
        jump = state.select(F.col("node").alias("at"), F.col("label").alias("j_label"), F.col("at").alias("j_at"))
        step = step.join(jump, "at").select("node", "old", F.least(F.struct("label", "at"), F.struct(F.col("j_label").alias("label"), F.col("j_at").alias("at"))).alias("new"))
        moved = common.written(step.select("node", "old", F.col("new.label").alias("label"), F.col("new.at").alias("at")), "labels")
        state = moved.select("node", "label", "at")
        if moved.where("label <> old").limit(1).count() == 0:
            return state.select("node", "label")
    raise RuntimeError(f"components didn't settle in {most} rounds")
