"""From raw documents to token ids: five stages, each one operator over all rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm import bpe, line_dedup, mixing, quality, simhash
from quirespark.llm._arrow import bound_batches
from quirespark.llm._store import discard, materialise, passing, unused

#: BPE and SimHash have no SQL form; tests hold run() against a brute-force version of all five stages.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines; n_chars follows the text."""
    bound_batches(spark)
    return quality.keep_good(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that five or more documents share; n_chars follows the text."""
    bound_batches(spark)
    lines, dropped = unused(docs, "line_count", "line_dropped")
    out = line_dedup.dedup_lines(spark, docs, counts=(lines, dropped))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    bound_batches(spark)
    return simhash.near_dedup(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at the budget's end is cut there."""
    return mixing.mixed(spark, docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' columns but the text, with token ids and the text decoded from them."""
    bound_batches(spark)
    path = bpe.vocabulary_path()
    ids, decoded = unused(docs, "ids", "decoded")
    return bpe.encode_decode(docs, path, ids_col=ids, decoded_col=decoded)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table is deleted once the next one has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing(spark) as keep:
            after = materialise(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep(after)
        discard(spark, docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
