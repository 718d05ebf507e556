"""SimHash near-duplicate detection over a byte-position inverted index.

A 64-bit fingerprint is eight positional bytes. Two fingerprints at most four
bits apart differ in at most four bytes, so the guaranteed minimum is four
shared positional bytes. The index posts each distinct fingerprint under its
positional bytes; of every pair that meets in a list the shared positional bytes
are tallied, pairs reaching the minimum are kept and then verified by their
Hamming distance.

Four shared bytes of eight include one of the first five, so those five lists
are enough. A list of one byte holds a 256th of the corpus, and tallying all its
pairs is quadratic: a list of over ``list_limit`` fingerprints is therefore split
by a further positional byte, later ones in order, until its parts are short or
share four bytes (5, 15, 35 and at most 70 lists a fingerprint). Any four shared
bytes lead a pair down to one list, so none that passes the count filter is lost.

Lists that share four bytes and are still long are linked exactly by another
way: two values are within four bits if and only if some value lies within two
bits of both, so each member is posted under the 2,081 values in its radius-2
ball and neighbours in the order of each posting are linked. A ball has 2,081
members at most, so no group is unbounded, and no link is dropped at any size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm._arrow import slices
from quirespark.llm._components import components
from quirespark.llm._lookup import look_up
from quirespark.llm._store import materialise, passing, unused

SPACE = b" \t\n\x0b\x0c\r"
MOST_BITS = 4
SHINGLE = 4
LIST_LIMIT = 128
#: lists' keys (a long each) that are broadcast; where more are asked for, all postings but a few are taken
BROADCAST_KEYS = 200_000
#: rows (id and digest) of near_dedup's decisions that are broadcast, else joined by a shuffle
BROADCAST_ROWS = 500_000
_BYTES = 8


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: bytes that two fingerprints within ``MOST_BITS`` share at least
LEAST_SHARED = _BYTES - MOST_BITS
#: By level, the sets of byte positions that key its lists: those that can still grow to ``LEAST_SHARED``.
LEVELS = [list(combinations(range(MOST_BITS + k), k)) for k in range(LEAST_SHARED + 1)]
#: Every flip of at most two bits.
FLIPS = [0] + [_signed(1 << i) for i in range(64)] + [_signed((1 << i) | (1 << j)) for i in range(64) for j in range(i)]


def fingerprint_of(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text.

    A-Z are lowered; words are runs of anything but the six ASCII white-space
    characters; a text of fewer words than a shingle is one shingle; null, empty
    or blank text gives 0. A bit is set if more than half of the shingles' XXH64
    (seed 42) have it; exactly half does not set it.
    """
    import xxhash

    if not text:
        return 0
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split()
    if not words:
        return 0
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    # shingles are slices of the space-joined words
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n - shingle + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, text_key) for every row: fp a signed 64-bit fingerprint, text_key a digest of the whole text."""
    fields = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(F.col(text_col)).alias("text_key"))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, "text"):
            fps = [_signed(fingerprint_of(t.as_py(), shingle)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64()), b.column("text_key")], names=["doc_id", "fp", "text_key"])

    return fields.mapInArrow(run, f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, fp long, text_key long")


def _tally(x: Column, y: Column) -> Column:
    """Number of positional bytes that two fingerprints share."""
    apart = x.bitwiseXOR(y)
    return sum((F.shiftrightunsigned(apart, 8 * p).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for p in range(_BYTES))


def _pairs_within(lists: DataFrame) -> DataFrame:
    """Links (a, b) among the fingerprints of each short list: tallied, filtered by count, verified."""
    x, y = F.col("x"), F.col("y")
    pairs = lists.select(F.posexplode("fps").alias("i", "x"), "fps").select("x", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("y"))
    return pairs.filter(_tally(x, y) >= LEAST_SHARED).filter(F.bit_count(x.bitwiseXOR(y)) <= MOST_BITS).select(x.alias("a"), y.alias("b"))


def _split(lists: DataFrame, level: int) -> DataFrame:
    """(fp, key) of the lists at ``level`` that those of the level before, rows (fp, key), are split into.

    A key is the number of the position set in its level and the set's bytes.
    """
    above = {s: n for n, s in enumerate(LEVELS[level - 1])}
    parts: list[list] = [[] for _ in above]
    for n, s in enumerate(LEVELS[level]):
        parts[above[s[:-1]]].append(F.struct(F.lit(n << 32).alias("n"), F.lit(8 * s[-1]).alias("at")))
    mine = F.element_at(F.array(*[F.array(*p) for p in parts]), F.shiftrightunsigned("key", 32).cast("int") + 1)
    low = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))

    def keyed(c: Column) -> Column:
        byte = F.call_function("shiftrightunsigned", F.col("fp"), c["at"]).bitwiseAND(F.lit(0xFF))
        return c["n"].bitwiseOR(low).bitwiseOR(F.shiftleft(byte, 8 * (level - 1)))

    return lists.select("fp", F.explode(F.transform(mine, keyed)).alias("key"))


def links(spark: SparkSession, values: DataFrame, list_limit: int = LIST_LIMIT, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Links (a, b) of a graph on distinct ``fp`` with the components of "at most four bits apart".

    At each level lists are counted by key alone, partial counts first; only
    members of short lists of two or more are then gathered.
    """
    from pyspark.sql import Window

    # a value becomes up to 70 rows: spread them first, as a few small partitions are merged otherwise
    # (by no key: a hash of fp, as they already lie, would be taken as done)
    lists = values.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("fp", F.lit(0).cast("long").alias("key"))
    found = spark.createDataFrame([], "a long, b long")
    for level in range(1, LEAST_SHARED + 1):
        posted = _split(lists, level)
        counts = materialise(spark, posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "postings")
        short, long_ = counts.filter(F.col("n") <= list_limit).select("key"), counts.filter(F.col("n") > list_limit).select("key")
        n_long = long_.count()
        n_short = counts.count() - n_long
        if n_short:
            # a join with many keys would shuffle every posting, as gathering them does; single ones then pair with none
            if n_short <= broadcast_keys:
                some = posted.join(F.broadcast(short), "key", "left_semi")
            elif n_long:
                some = posted.join(F.broadcast(long_) if n_long <= broadcast_keys else long_, "key", "left_anti")
            else:
                some = posted
            gathered = some.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
            found = found.unionByName(materialise(spark, _pairs_within(gathered).distinct(), "near-pairs"))
        if not n_long:
            return found.distinct()
        # splitting a list that is not long costs postings and loses nothing, so many long ones take the rest along
        lists = posted.join(F.broadcast(long_), "key", "left_semi") if n_long <= broadcast_keys else posted
    if n_long > broadcast_keys:
        lists = posted.join(long_, "key", "left_semi")
    dense = lists.select("fp").distinct()
    near = dense.select("fp", F.explode(F.transform(F.array(*[F.lit(f) for f in FLIPS]), lambda m: F.col("fp").bitwiseXOR(m))).alias("near"))
    chained = near.select("near", F.col("fp").alias("a"), F.lag("fp").over(Window.partitionBy("near").orderBy("fp")).alias("b")).filter(F.col("b").isNotNull())
    return found.unionByName(chained.select("a", "b")).distinct()


def near_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = LIST_LIMIT) -> DataFrame:
    """(doc_id, fp, text_key, component_id) for every row.

    component_id is the least doc_id that links reach, itself included. Rows of
    null id take part; their component is the least non-null id, else null.
    Repeated rows give repeated results; extra columns are not read.
    """
    with passing(spark) as keep:
        prints = materialise(spark, fingerprints(docs, id_col, text_col), "fingerprints")
        reps = materialise(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("held")), "distinct-fingerprints")
        roots = components(spark, links(spark, reps.select("fp"), list_limit))
        linked = materialise(spark, roots.join(reps, roots["node"] == reps["fp"]).select("fp", "root", "least"), "linked")
        best = materialise(spark, linked.groupBy("root").agg(F.min("least").alias("best"), F.count(F.lit(1)).alias("held")), "roots")
        moved = look_up(linked, best, "root", "held").select("fp", "best")
        # a fingerprint of one row that nothing links needs no answer
        answers = reps.join(moved, "fp", "left").filter("held > 1 or best is not null").select("fp", F.coalesce("best", "least").alias("of_print"), "held")
        answers = materialise(spark, answers, "components")
        keep(prints, answers)
    return look_up(prints, answers, "fp", "held").select("doc_id", "fp", "text_key", F.coalesce("of_print", "doc_id").alias("component_id"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each near-duplicate group left, all columns kept.

    The row with the least (id, text digest) stays, nulls first; of rows equal in
    both, one. The choice needs ids and digests only; whole texts never shuffle
    but for rows that repeat both.
    """
    key = F.struct(F.col("doc_id").alias("i"), F.col("text_key").alias("k"))
    with passing(spark) as keep:
        groups = near_groups(spark, docs, id_col, text_col)
        # groups without any id are told apart by their fingerprint
        alone = F.when(F.col("component_id").isNull(), F.col("fp"))
        per = materialise(spark, groups.groupBy("component_id", alone.alias("lone"), "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")), "members")
        best = per.groupBy("component_id", "lone").agg(F.min_by(key, key).alias("best")).select(F.col("component_id").alias("c"), F.col("lone").alias("l"), "best")
        same = per["component_id"].eqNullSafe(best["c"]) & per["lone"].eqNullSafe(best["l"])
        is_best = F.col("doc_id").eqNullSafe(F.col("best.i")) & (F.col("text_key") == F.col("best.k"))
        i, k, n = unused(docs, "near_id", "near_key", "near_rows")
        marked = per.join(best, same).filter(~is_best | (F.col("n") > 1))
        marked = materialise(spark, marked.select(F.col("doc_id").alias(i), F.col("text_key").alias(k), F.when(is_best, F.col("n")).otherwise(0).alias(n)), "marked")
        keep(marked)
    # what goes, and what stays but repeats, is a small part: whole texts move only if it outgrows a broadcast
    few = marked.count() <= BROADCAST_ROWS
    on = lambda m: docs[id_col].eqNullSafe(m[i]) & (F.xxhash64(docs[text_col]) == m[k])
    once = docs.join(F.broadcast(marked) if few else marked, on(marked), "left_anti")
    repeats = marked.filter(F.col(n) > 0)
    again = docs.join(F.broadcast(repeats) if few else repeats, on(repeats)).dropDuplicates([i, k]).select(*[f"`{c}`" for c in docs.columns])
    return once.unionByName(again)
