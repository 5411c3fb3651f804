"""Connected components of a link table by least labels and pointer jumping; nothing is gathered on the driver but one count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, comp): comp is the least node that links lead to. Nodes without links have no row."""
    both = stash(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        hooked = labels.join(seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("to"))
        at = labels.select(F.col("node").alias("to"), F.col("comp").alias("next"))
        found = stash(hooked.join(at, "to").select("node", "old", F.least("to", "next").alias("comp")), "labels")
        labels = found.select("node", "comp")
        if found.filter("old <> comp").isEmpty():
            return labels
