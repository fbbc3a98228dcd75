"""Connected components of records that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut


def by_shared_keys(links: DataFrame, node: str = "node", key: str = "key", rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of `links` that share a key with another
    node, directly or through others; a component is named by its least node.

    Labels travel from nodes to keys and back by minima, which combine before
    each shuffle, so a key or node that holds a large part of the rows is no
    bottleneck; labels are then replaced by the labels of their labels, so that
    a chain takes a number of rounds logarithmic in its length.  Each round is
    cut by a table in the shared folder.
    """
    rows = links.select(F.col(node).alias("n"), F.col(key).alias("k")).distinct()
    several = rows.groupBy("k").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).filter("lo <> hi").select("k")
    rows = cut(rows.join(several, "k"), "links")
    labels = None
    for _ in range(rounds):
        if labels is None:
            own = rows.select("n", "k", F.col("n").alias("label"))
        else:
            own = rows.join(labels, "n")
        low = own.groupBy("k").agg(F.min("label").alias("low"))
        new = rows.join(low, "k").groupBy("n").agg(F.min("low").alias("label"))
        if labels is not None:
            # A label is itself a node: take over what it is labelled with by now.
            jump = labels.select(F.col("n").alias("label"), F.col("label").alias("further"))
            new = new.join(jump, "label", "left").select("n", F.least("label", F.coalesce("further", "label")).alias("label"))
            old = labels.select("n", F.col("label").alias("before"))
            new = new.join(old, "n").select("n", F.least("label", "before").alias("label"), (F.least("label", "before") != F.col("before")).alias("moved"))
            new = cut(new, "labels")
            moved = not new.filter("moved").isEmpty()
            labels = new.select("n", "label")
            if not moved:
                break
        else:
            labels = cut(new, "labels").select("n", "label")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.select(F.col("n").alias(node), F.col("label").alias("component"))
