"""Connected components of a table of links, in rounds of joins that end after about log(diameter) of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of ``links`` (x, y), comp being one id of the component, the same for all its nodes.

    Every round gives a node the smallest label among its neighbours and then the label of that
    label. Each round's table is written, so a lost executor costs no earlier round.
    """
    both = stage(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = stage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("comp")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("y"), F.col("comp").alias("c")), "y")
                .groupBy(F.col("x").alias("n")).agg(F.min("c").alias("near")))
        low = labels.join(near, F.col("node") == F.col("n")).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        new = stage(low.join(jump, "low", "left").select("node", "old", F.least("low", "far").alias("comp")))
        labels = new.select("node", "comp")
        if new.where(F.col("old") != F.col("comp")).limit(1).count() == 0:
            return labels
