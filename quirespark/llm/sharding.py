"""Sharding by rendezvous hashing, with DataFrame functions only.

A row's key meets every shard: the shard of the best score takes the row. The
score of a shard of weight w is ``-w / ln(u)`` with u in (0, 1) hashed from key
and shard number, so shards win rows in proportion to their weights and adding
a shard moves only the rows that the new shard wins. Nothing but the key, the
shard numbers and the weights decides: no state, no shuffle.

Slots number a shard's rows from 0 without gaps. Each shard is cut into ranges
of a row hash; range counts give each range's first slot and rows are numbered
inside their range, so no task holds a whole shard. Rows equal in id, CRC and
size are counted first and take a run of slots, so that a third of all rows
being equal costs a task one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
RANGES = 1024


def shard_of(key: Column, shards: int | Sequence[float]) -> Column:
    """The shard (int) of a key among ``shards`` equal ones, or of the given weights (zero: never chosen).

    Equal scores go to the lower number. Null keys hash like any other value.
    """
    weights = [1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]
    if not any(w > 0 for w in weights) or min(weights) < 0:
        raise ValueError("shards need weights of at least 0, one of them above")
    scores = []
    for j, w in enumerate(weights):
        if w > 0:
            h = F.xxhash64(key, F.lit(j))
            if len(set(weights)) == 1:
                scores.append(F.struct(h.alias("s"), F.lit(-j).alias("j")))
            else:
                u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)
                scores.append(F.struct((F.lit(-w) / F.ln(u)).alias("s"), F.lit(-j).alias("j")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["j"]).cast("int")


def place(docs: DataFrame, shards: int | Sequence[float] = SHARDS, id_col: str = "doc_id", text_col: str = "text", new_weight: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``shards`` is their number or their weights; the shard that ``grown_shard``
    adds has weight ``new_weight``. Size is the text's UTF-8 bytes plus 16; null
    text has none and the CRC of nothing, 0. Rows of equal doc_id share a shard,
    null ids too. Slots follow (row hash, doc_id, CRC, size), which reruns
    repeat; rows equal in all are interchangeable. Very long texts are summed
    whole. Extra columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    grown = shards + 1 if isinstance(shards, int) and new_weight == 1.0 else [*([1.0] * shards if isinstance(shards, int) else shards), new_weight]
    rows = rows.withColumns({"shard": shard_of(F.col("doc_id"), shards), "grown_shard": shard_of(F.col("doc_id"), grown)})
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("r", F.pmod("h", F.lit(RANGES)))
    ahead = Window.partitionBy("shard").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x RANGES rows, whatever the input
    first = rows.groupBy("shard", "r").agg(F.sum("n").alias("n")).select("shard", "r", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "r").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("k", F.sum("n").over(inside) - F.col("n")).join(first, ["shard", "r"])
    out = out.withColumn("slot", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda x: x + F.col("first") + F.col("k"))))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
