"""Left joins with a table of answers that no hot key can pile onto one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: answers that are broadcast; beyond, only those of hot keys are
FEW = 2_000_000
#: rows from which on a key is hot
HOT = 100_000


def look_up(rows: DataFrame, answers: DataFrame, key: str, held: str, few: int = FEW, hot: int = HOT) -> DataFrame:
    """``rows`` with the columns of ``answers`` but ``held``, null where ``key`` has no answer.

    ``answers`` has one row a key (a table that is cheap to read twice) and in
    ``held`` at least the number of rows that have the key. Up to ``few`` answers
    are broadcast. Beyond, keys of over ``hot`` rows are: at most ``few`` of
    them, as ``hot`` rises with the number of rows. The rest, no group of which
    is hot, is shuffled. Rows of null key never shuffle.
    """
    many, total = answers.agg(F.count(F.lit(1)), F.sum(held)).first()
    if many <= few:
        return rows.join(F.broadcast(answers.drop(held)), key, "left")
    limit = max(hot, -(-total // few)) if few else hot
    top = answers.filter(F.col(held) > limit).drop(held)
    rest = answers.filter(F.col(held) <= limit).drop(held)
    asked = rows.filter(F.col(key).isNotNull())
    head = asked.join(F.broadcast(top), key)
    tail = asked.join(F.broadcast(top.select(key)), key, "left_anti").join(rest, key, "left")
    none = rows.filter(F.col(key).isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in rest.schema.fields if f.name != key})
    return head.unionByName(tail).unionByName(none)
