"""Boxes, pages, logits and texts derived from plain tables, alike in Spark and in SQL.

``BOXES`` and the others are common table expressions for DuckDB; the functions
give the same rows as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELS = ("text", "Title", "table", "figure", "caption", "formula", "footnote", "header", "doc_title", "reference_content", "flowchart", "number", "unheard_of")
KINDS = ("text", "paragraph_title", "table", "image", "figure_title", "formula", "footnote", "header", "doc_title", "reference_content", "chart", "number", "other")
_SQL_LABELS = ", ".join(f"'{x}'" for x in LABELS)
_SQL_KINDS = ", ".join(f"'{x}'" for x in KINDS)

BOXES = f"""boxes AS (
  SELECT l_orderkey AS doc_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS idx,
         CAST(l_partkey % 80 AS DOUBLE) AS x1, CAST(l_suppkey % 80 AS DOUBLE) AS y1,
         CAST(l_partkey % 80 AS DOUBLE) + l_quantity AS x2, CAST(l_suppkey % 80 AS DOUBLE) + 5 + CAST(l_quantity AS BIGINT) % 23 AS y2,
         l_returnflag AS cls, l_discount + l_linenumber * 0.001::DOUBLE AS score,
         list_extract([{_SQL_LABELS}], CAST(l_partkey % 13 + 1 AS INTEGER)) AS label, list_extract([{_SQL_KINDS}], CAST(l_partkey % 13 + 1 AS INTEGER)) AS kind,
         CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'Item ' || CAST(l_partkey AS VARCHAR) END AS text,
         CAST(l_quantity AS BIGINT) % 4 + 1 AS num_lines
  FROM lineitem)"""

LOGITS = """steps AS (
  SELECT vec_id // 10 AS seq, CAST(vec_id % 10 AS INTEGER) AS t, list_transform(range(0, 8), lambda c: list_max(list_transform(range(c, len(embedding), 8), lambda d: CAST(embedding[d + 1] AS DOUBLE)))) AS scores FROM embeddings)"""

HYPHENS = """texts AS (SELECT doc_id, replace(coalesce(text, ''), ' the ', '-' || chr(10) || 'the ') AS text FROM documents)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes of files to a task, 225,000 to 500,000 rows of lineitem
PART_BYTES = 4 << 20


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """``frame`` by its keys in as many partitions as its files ask for, so that a task's share does not grow with the table."""
    spark = frame.sparkSession
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return frame if size <= least * PART_BYTES else frame.repartition(-(-size // PART_BYTES), *keys)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, idx, box, cls, score, label, kind, text, num_lines: an order is a page, its lines are boxes."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    # numbered before anything is derived: only plain columns are shuffled and sorted, and all readers of one table share that exchange
    li = spread(li, "l_orderkey").withColumn("idx", F.row_number().over(order))
    pick = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("l_partkey") % 13 + 1).cast("int"))
    x1, y1, q = (F.col("l_partkey") % 80).cast("double"), (F.col("l_suppkey") % 80).cast("double"), F.col("l_quantity")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), "idx", x1.alias("x1"), y1.alias("y1"), (x1 + q).alias("x2"), (y1 + 5 + q.cast("long") % 23).alias("y2"),
        F.col("l_returnflag").alias("cls"), (F.col("l_discount") + F.col("l_linenumber") * F.lit(0.001)).alias("score"), pick(LABELS).alias("label"), pick(KINDS).alias("kind"),
        F.when(F.col("l_suppkey") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("Item "), F.col("l_partkey").cast("string"))).alias("text"), (q.cast("long") % 4 + 1).alias("num_lines"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(boxes of even idx, boxes of odd idx): one table against another on the same pages."""
    b = boxes(spark, sf_dir)
    return b.filter("idx % 2 = 0"), b.filter("idx % 2 = 1")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, t, scores: ten steps of eight class scores a sequence, each the largest of every eighth dimension."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("seq"), (F.col("vec_id") % 10).cast("int").alias("t"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.array_max(F.filter("embedding", lambda v, i: i % 8 == c)).cast("double")).alias("scores")
    )


def hyphened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with line-break hyphens put in."""
    return table(spark, sf_dir, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(" the "), F.lit("-\nthe ")).alias("text"))


def rounded(frame: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({n: F.round(n, digits) for n in names})
