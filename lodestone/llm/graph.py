"""Connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Tables


def connected_components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, root) for each node of edges (src, dst): root is the component's smallest node.

    Every round takes the smallest label among a node's neighbours, then jumps to that label's own label, so the rounds
    grow with the logarithm of a component's diameter. Only partial aggregates and plain equi-joins run, so a hub with a
    third of all edges is combined before it is sent and split by the skew join. A round's labels are a table among
    tables, or of their own; then the last of them stays.
    Null ends are ignored; an empty input gives an empty result.
    """
    own = Tables(edges.sparkSession)
    pairs = edges.where("src is not null and dst is not null and src <> dst").select("src", "dst")
    both = own.write(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = own.write(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select("node", F.least("node", "near").alias("root")))
    while True:
        seen = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("root").alias("near"))
        stepped = labels.join(seen, labels.node == seen.src).select("node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        of = stepped.select(F.col("node").alias("of"), F.col("root").alias("next"))
        jumped = stepped.join(of, stepped.root == of["of"]).select("node", "before", F.least("root", "next").alias("root"))
        jumped = own.write(jumped, "node")  # the join left a component's nodes together
        own.drop(both, jumped)
        labels = jumped.select("node", "root")
        if jumped.where("root <> before").isEmpty():
            own.drop(jumped)
            if tables is not None:
                tables.paths += own.paths
            return labels
