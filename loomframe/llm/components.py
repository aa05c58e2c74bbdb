"""Connected components of a table of links: least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links: (a long, b long). Returns (node, component): the least node reachable, for every node of a link.

    Each round every node takes the least label around it, then the label of
    its label; rounds are logarithmic in a component's width for the stars and
    chains that similarity joins yield. Minima are pre-aggregated, so a node
    with very many links is no single task's burden, and every round is cut to
    the shared folder.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        stepped = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = cut(
            stepped.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels"
        )
        moved = jumped.filter("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not moved:
            return labels.select("node", F.col("label").alias("component"))
