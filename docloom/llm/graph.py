"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(edges: DataFrame) -> DataFrame:
    """id and comp, the smallest id reachable, of every node of edges (u long, v long).

    Each round every node takes the smallest label among its neighbours and then its label's label. Edges and
    labels stay in tables; only the number of changes reaches the driver.
    """
    both = store(edges.filter("u <> v").select("u", "v").union(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = store(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        taken = labels.join(near, labels["id"] == near["u"]).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("comp").alias("far"))
        new = store(taken.join(jump, "mid").select("id", "old", F.least("mid", "far").alias("comp")), "labels")
        changed = new.filter("old <> comp").limit(1).count()
        labels = new.select("id", "comp")
        if not changed:
            return labels
