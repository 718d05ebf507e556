"""Connected components with DataFrames: alternating star contraction.

Large-star and small-star steps alternate on an edge table (``a`` and ``b`` of
one orderable type) until the table stops changing. Every step is a ``min`` by
node, pre-aggregated before its shuffle, and a join back. The step's table is
written to the shared folder, so lineage stays short and nothing but a row
count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm._store import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(low, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) for every node with an edge; root is its component's least node.

    Self-links and repeated edges are allowed; null ends are left out. An empty
    edge table gives an empty result. Raises if ``most_rounds`` do not suffice.
    """
    now = materialise(
        spark,
        edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    check = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    seen = now.agg(*check).first()
    for _ in range(most_rounds):
        if seen["n"] == 0:
            break
        nxt = materialise(spark, _star(_star(now, True), False), "links")
        said = nxt.agg(*check).first()
        discard(spark, now)
        now = nxt
        if said == seen:
            break
        seen = said
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
