"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from demandloom.sources.staging import new_folder


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b): label is the smallest node of the component.

    Each round gives a node the smallest label among its own and its neighbours', then takes that
    label's own label (pointer jumping), so the rounds grow with the logarithm of the longest path.
    Neighbours' labels are minima, combined before the shuffle; joins on hot nodes are split by
    adaptive execution. Every round is a written table.
    """
    spark = links.sparkSession

    def written(df: DataFrame, changed) -> tuple[DataFrame, int]:
        seen = Observation()
        path = new_folder(spark, "labels")
        df.observe(seen, F.coalesce(F.sum(changed.cast("long")), F.lit(0)).alias("changed")).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), seen.get["changed"]

    both = links.select("a", "b").union(links.select("b", "a")).where("a != b")
    both, _ = written(both, F.lit(False))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels, _ = written(labels.select("node", F.least("node", "low").alias("label")), F.lit(False))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = lower.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))
        following, changed = written(jumped, F.col("label") != F.col("old"))
        labels = following.select("node", "label")
        if not changed:
            return labels
