"""Connected components over an edge table, distributed: hook to the least neighbour, shorten, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.llm.shared import drop, written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): root is the least node reachable. Nodes without links don't appear; links that repeat
    or join a node with itself add nothing; an empty table gives no rows. Other columns are ignored; ids aren't null.

    Each round gives every remaining node the least of itself and its neighbours as parent, follows parents
    twice, and contracts the links; stars, the usual shape here, end after one round. Nothing is collected:
    a round's tables are written to the shared folder, and the driver sees only whether links remain.
    """
    links = written(edges.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parent")
        first = parent
        for _ in range(2):
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("up"))
            parent = parent.join(up, "p").select("a", F.col("up").alias("p"))
        parent = written(parent, "parent")
        drop(first)
        to = parent.select(F.col("a").alias("root"), F.col("p").alias("next"))
        if labels is None:
            new = written(parent.select(F.col("a").alias("node"), F.col("p").alias("root")), "labels")
        else:
            new = written(labels.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        ends = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        rest = links.join(parent.withColumnRenamed("p", "pa"), "a").join(ends, "b")
        rest = written(rest.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        drop(links, parent, *([labels] if labels is not None else []))
        links, labels = rest, new
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
