"""Exact deduplication over an extendible-hash index on shared files.

Texts are normalised (each run of the six ASCII white-space characters to one
space) and keyed by a 64-bit hash. The index is a set of tables in the shared
folder: one entry a row (id, key, SHA-256), one row a distinct key, and the
directory. The directory maps prefixes of keys to buckets: it doubles until no
bucket holds over ``bucket_keys`` distinct keys, so overfull buckets split and
others stay whole. A bucket is a range of keys.

Keys of one row are settled by the index alone. The texts of the others, the
suspects, travel to owner tasks, one of which takes a bucket whole; each map task
sends one copy of a text with its count and least id, so a text that a third of
all rows hold costs its owner one copy a map task. Owners compare the bytes of
whole texts and chain those that share a key. Rows take their answer from the
chain of their key; where a chain has several texts, by the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.llm._lookup import FEW, HOT, look_up
from quirespark.llm._store import materialise, passing, unused

#: distinct keys of a bucket, and the bits of a prefix at most
BUCKET_KEYS = 2_000
MOST_DEPTH = 20


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _prefix(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a 64-bit key as a number."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, most_depth: int = MOST_DEPTH) -> tuple[DataFrame, int]:
    """The directory over the distinct ``key`` of ``keys``: (slot, bucket, depth) for every slot that holds a key, and its depth.

    A slot is a prefix of as many bits as the directory has. Buckets of fewer
    bits take several slots; ``bucket`` is their first. A bucket splits while it
    holds over ``bucket_keys`` keys, at most to ``most_depth`` bits, so that the
    directory has 2^20 slots at most whatever the input.
    """
    total = keys.count()
    depth = 0
    while depth < most_depth and total > bucket_keys << depth:
        depth += 1
    # hashes fill slots evenly; four doublings more are room for those that do not
    depth = min(most_depth, depth + 4) if depth else 0
    slots = keys.groupBy(_prefix(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    every = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d")).withColumn("p", F.expr(f"shiftright(slot, {depth} - d)"))
    held = every.groupBy("d", "p").agg(F.sum("n").alias("n"))
    # the bucket of a slot: its shortest prefix that fits, else the slot itself
    fits = held.filter((F.col("n") <= bucket_keys) | (F.col("d") == depth)).select("d", "p")
    mine = every.join(fits, ["d", "p"]).groupBy("slot").agg(F.min("d").alias("depth"))
    return mine.select("slot", F.expr(f"shiftleft(shiftright(slot, {depth} - depth), {depth} - depth)").alias("bucket"), "depth"), depth


def _suspects_of(docs: DataFrame, id_col: str, text_col: str, key: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, norm, key) of each row."""
    return docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("key", key(F.col("norm")))


def groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS, key: Callable[[Column], Column] = F.xxhash64, few: int = FEW, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    Null text counts as empty. The row with the least doc_id of equal texts
    stays; null ids rank last, so a group without any other keeps a null id.
    Where rows repeat that doc_id all of them are marked kept = doc_id equals
    keep_id. Very long texts are hashed and compared whole. Extra columns are not
    read. Any ``key`` (a long) gives the same result; a weak one, longer chains.
    """
    with passing(spark) as keep:
        entries = _suspects_of(docs, id_col, text_col, key)
        entries = materialise(spark, entries.select("doc_id", "key", F.sha2("norm", 256).alias("sha")), "entries")
        keys = materialise(spark, entries.groupBy("key").agg(F.count(F.lit(1)).alias("held")), "keys")
        slots, depth = directory(keys, bucket_keys)
        slots = materialise(spark, slots, "directory")
        shared = keys.filter("held > 1").select("key", "held", F.lit(True).alias("shared"))
        texts = look_up(_suspects_of(docs, id_col, text_col, key), shared, "key", "held", few, hot).filter("shared").drop("shared")
        # the directory has 2^20 rows of two numbers at most
        owned = texts.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
        owned = owned.withColumn("slot", _prefix(F.col("key"), depth)).join(F.broadcast(slots.select("slot", "bucket")), "slot")
        owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
        chain = Window.partitionBy("bucket", "key")
        # a bucket's owner: equal texts are one row by now, so rows of one key are a chain of texts that differ in bytes
        chains = owned.repartition(owners, "bucket").select("key", "n", "least", F.count(F.lit(1)).over(chain).alias("texts"), "norm")
        chains = materialise(spark, chains.withColumn("norm", F.when(F.col("texts") > 1, F.col("norm"))), "chains")
        keep(entries, chains)
    single = chains.filter("texts = 1").select("key", F.col("n").alias("size"), F.col("least").alias("first"), F.col("n").alias("held"))
    out = look_up(entries, single, "key", "held", few, hot)
    out = out.select("key", "doc_id", F.coalesce(F.when(F.col("size").isNotNull(), F.col("first")), F.col("doc_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), "sha")
    several = chains.filter("texts > 1").select("key", "norm", F.col("n").alias("size"), F.col("least").alias("first"))
    if not several.isEmpty():
        # rows whose key has several texts are answered by the text, from the documents; a key's rows spread by text
        apart = several.groupBy("key").agg(F.sum("size").alias("held")).withColumn("apart", F.lit(True))
        out = look_up(out, apart, "key", "held", few, hot).filter("apart is null").drop("apart")
        asked = look_up(_suspects_of(docs, id_col, text_col, key), apart, "key", "held", few, hot).filter("apart")
        by_text = several.select(F.struct("key", "norm").alias("k"), "size", "first", F.col("size").alias("held"))
        told = look_up(asked.select("key", "doc_id", "norm", F.struct("key", "norm").alias("k")), by_text, "k", "held", 0, hot)
        out = out.unionByName(told.select("key", "doc_id", F.col("first").alias("keep_id"), F.col("size").alias("group_size"), F.sha2("norm", 256).alias("sha")))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one a text, all columns kept; rows repeating id and text are reduced to one."""
    with passing(spark) as keep:
        kept = groups(spark, docs, id_col, text_col).filter("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
        i, k, n = unused(docs, "kept_id", "kept_sha", "kept_rows")
        kept = materialise(spark, kept.select(F.col("doc_id").alias(i), F.col("text_sha256").alias(k), F.col("n").alias(n)), "kept")
        keep(kept)
    joined = docs.join(kept, docs[id_col].eqNullSafe(kept[i]) & (F.sha2(normalised(docs[text_col]), 256) == kept[k]))
    once = joined.filter(F.col(n) == 1).select(*[f"`{c}`" for c in docs.columns])
    return once.unionByName(joined.filter(F.col(n) > 1).dropDuplicates([i, k]).select(*[f"`{c}`" for c in docs.columns]))


ORACLE_OP5 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
