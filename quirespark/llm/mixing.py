"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a seeded shuffle; a queue whose
target exceeds its size starts over, so that a document comes up to three
times. A turn's virtual finish time is the source's tokens up to and including
it, divided by the source's target. Turns are range-sorted by finish time and
taken until the total budget is spent; the turn that crosses it is cut.

Both running sums are built from ranges: range totals first, then sums inside
each range, so that neither a source with a third of all rows nor the global
order ever meets in one task. A source's ranges grow in number with the rows.
The range of finish times that the budget falls into is cut into ranges again
until it holds ``RANGE_ROWS`` turns at most; only those are sorted, and what a
row is taken then follows from the one turn that crosses the budget. Ids,
sources and sizes move; texts do not, but for ``mixed``, which joins what each
row is taken to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.llm._store import materialise, passing, unused

WEIGHTS = (1, 2, 3)
MOST_TIMES = 3
#: ranges that finish times are cut into at once, turns that a task sorts, and rows a source's range should hold
RANGES = 4096
RANGE_ROWS = 100_000


def words_in(text: Column) -> Column:
    """Number of maximal runs outside the six ASCII white-space characters; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """(source, rank, source_size, target): the total shared by weight, water-filled under ``most_times`` x size.

    ``sizes`` has source and size. Sources in code-point order, null last, take
    the weights in turn. There is one row a source here, so that their order is
    one task's work.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("rank", rank).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most_times)))
    # by rising cap / weight, a source is at its cap if the level of what is left exceeds it
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", left / rest).withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return per.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * level)).select("source", "rank", "source_size", "target")


def _crossing(turns: DataFrame, budget: int, ranges: int, range_rows: int) -> tuple[Row, int] | None:
    """The turn that spends the budget's last word, and the words spent before it; None if the turns do not spend it."""
    start, low, high = 0, 0.0, 2.0
    while True:
        at = F.least(F.lit(ranges - 1), F.floor((F.col("finish") - low) / F.lit(high - low) * ranges).cast("int"))
        turns = turns.withColumn("g", F.greatest(F.lit(0), at))
        spans = turns.groupBy("g").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("finish").alias("low"), F.max("finish").alias("high"))
        earlier = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.withColumn("start", F.lit(start) + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        span = spans.filter((F.col("start") < budget) & (F.col("start") + F.col("n") >= budget)).first()
        if span is None:
            return None
        start, low, high = span["start"], span["low"], span["high"]
        turns = turns.filter(F.col("g") == span["g"])
        # turns of one finish time: at most one a source
        if span["rows"] <= range_rows or low == high:
            break
    order = Window.orderBy("finish", "rank", "at").rowsBetween(Window.unboundedPreceding, 0)
    ends = turns.withColumn("end", F.lit(start) + F.sum("size").over(order))
    turn = ends.filter((F.col("end") >= budget) & (F.col("end") - F.col("size") < budget)).first()
    return turn, turn["end"] - turn["size"]


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, text_key, size, source_size, target, taken) for every row.

    taken counts the words the mix takes of a row, repeats included, at most
    ``most_times`` x size. Null and blank texts have size 0 and are never taken;
    a source of such rows alone has target 0. The shuffle is by MD5 of id and
    text, so reruns agree; rows that repeat both are interchangeable.
    """
    with passing(spark) as keep:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(text).alias("size"), F.md5(text).alias("text_key"))
        sized = materialise(spark, sized, "sizes")
        goal = materialise(spark, targets(sized, weights, most_times), "targets")
        # a source's rank stands for it from here: never null, and orders turns of equal finish time
        rows = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).select("doc_id", "text_key", "size", "rank", "source_size", "target")
        digits = 3
        while sized.count() > range_rows << 4 * digits:
            digits += 1
        rows = rows.withColumn("o", F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_key"))).withColumn("r", F.substring("o", 1, digits))
        ahead = Window.partitionBy("rank").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy("rank", "r").agg(F.sum("size").alias("n")).select("rank", "r", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
        inside = Window.partitionBy("rank", "r").orderBy("o", "size").rowsBetween(Window.unboundedPreceding, 0)
        placed = rows.withColumn("part", F.sum("size").over(inside)).join(starts, ["rank", "r"])
        placed = placed.select("doc_id", "text_key", "size", "rank", "source_size", "target", (F.col("start") + F.col("part")).alias("cum"))
        placed = materialise(spark, placed, "placed")

        times = F.least(F.lit(most_times), F.floor(F.col("target") / F.col("source_size")).cast("int") + 1)
        turns = placed.filter((F.col("size") > 0) & (F.col("target") > 0)).select("rank", "size", "target", F.explode(F.sequence(F.lit(0), times - 1)).alias("turn"), "source_size", "cum")
        turns = turns.withColumn("at", F.col("turn") * F.col("source_size") + F.col("cum")).withColumn("finish", F.col("at") / F.col("target"))
        turns = turns.select("rank", "size", "at", "finish")

        budget = goal.agg(F.sum("source_size")).first()[0] or 0
        cross = _crossing(turns, budget, ranges, range_rows) if budget else None
        keep(placed)
    taken = F.lit(0)
    for turn in range(most_times if cross is not None else 0):
        at = F.col("source_size") * turn + F.col("cum")
        now = F.struct((at / F.col("target")).alias("f"), F.col("rank").cast("int").alias("r"), at.alias("a"))
        last = F.struct(F.lit(cross[0]["finish"]).alias("f"), F.lit(cross[0]["rank"]).cast("int").alias("r"), F.lit(cross[0]["at"]).cast("long").alias("a"))
        cut = F.lit(budget - cross[1])
        came = F.when((F.col("size") <= 0) | (F.col("target") <= 0) | (F.lit(turn) >= times), 0)
        taken = taken + came.when(now < last, F.col("size")).when(now == last, cut).otherwise(0)
    return placed.select("doc_id", "text_key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns kept.

    A row comes once for each whole time it is taken; the one row that the
    budget cuts comes as its first words. Rows not taken, and texts without
    words, are left out. Documents are shuffled once, to what they are taken,
    and neither sorted nor gathered.
    """
    with passing(spark) as keep:
        chosen = mix(spark, docs, weights, most_times, id_col, text_col, source_col).filter("taken > 0")
        # rows that repeat id and text share what they were taken
        i, k, size, total, rows, part = unused(docs, "mix_id", "mix_key", "mix_size", "mix_sum", "mix_rows", "mix_part")
        per = chosen.groupBy(F.col("doc_id").alias(i), F.col("text_key").alias(k)).agg(F.max("size").alias(size), F.sum("taken").alias(total), F.count(F.lit(1)).alias(rows))
        per = materialise(spark, per, "chosen")
        keep(per)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    columns = [f"`{c}`" for c in docs.columns]

    def met(decided: DataFrame) -> DataFrame:
        return docs.join(decided.hint("shuffle_hash"), docs[id_col].eqNullSafe(decided[i]) & (F.md5(text) == decided[k]))

    out = met(per.filter(F.col(rows) == 1))
    again = per.filter(F.col(rows) > 1)
    if not again.isEmpty():
        out = out.unionByName(met(again).dropDuplicates([i, k]))
    out = out.withColumn(part, F.explode(F.expr(f"transform(sequence(0L, ({total} - 1) div {size}), t -> least({size}, {total} - t * {size}))")))
    words = F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    first = F.when(F.col(part) == F.col(size), F.col(text_col)).otherwise(F.array_join(F.slice(words, F.lit(1), F.col(part).cast("int")), " "))
    return out.withColumn(text_col, first).select(*columns)


ORACLE_OP4 = r"""
WITH s AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS text_key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM p),
w AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM r),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0.0::DOUBLE))
            / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0::DOUBLE)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, rank, source_size,
         CASE WHEN cap <= w * level THEN cap ELSE w * max(CASE WHEN cap > w * level THEN level END) OVER () END AS target
  FROM l),
q AS (
  SELECT s.doc_id, s.text_key, s.size, g.rank, g.source_size, g.target,
         CAST(sum(s.size) OVER (PARTITION BY g.rank ORDER BY md5(concat_ws('/', coalesce(CAST(s.doc_id AS VARCHAR), ''), s.text_key)), s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
  FROM s JOIN g ON s.source IS NOT DISTINCT FROM g.source),
t AS (
  SELECT q.*, k.turn, k.turn * source_size + cum AS pos, (k.turn * source_size + cum) / target AS finish
  FROM q, (SELECT unnest([0, 1, 2]) AS turn) k
  WHERE size > 0 AND target > 0 AND k.turn < least(3, CAST(floor(target / source_size) AS BIGINT) + 1)),
e AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ends FROM t),
k AS (
  SELECT rank, cum, sum(greatest(0, least(size, (SELECT sum(source_size) FROM g) - (ends - size)))) AS took
  FROM e GROUP BY rank, cum)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(CASE WHEN q.size > 0 THEN coalesce(k.took, 0) ELSE 0 END AS BIGINT) AS taken
FROM q LEFT JOIN k ON q.rank = k.rank AND q.cum = k.cum
"""
