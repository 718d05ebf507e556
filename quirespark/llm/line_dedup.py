"""Line deduplication with two Bloom filters over hashed lines.

A line's key is the line without the six ASCII white-space characters at its
ends, A-Z lowered. Three passes over the texts, of which the first two emit
hashes only:

1. Keys' 64-bit hashes (once a document) go to owner tasks by hash range. An
   owner keeps two Bloom filters, for hashes seen once and seen twice; a hash
   found in the first enters the second and is emitted, once, as suspect. What
   the second filter holds is compared with the hashes emitted before it is left out.
2. Suspects make a compact filter in the shared folder. Only lines found in it
   shuffle, as whole keys, for the exact count of documents and the choice of
   the largest doc_id.
3. Confirmed keys (128-bit digest, keeper) are applied to each text in place.

A false positive costs a shuffled line, never a wrong result. Hot lines are
pre-aggregated per batch (pass 1) and map-side (pass 2). If the filter or the
confirmed keys outgrow ``memory_bytes`` in a task, joins replace the look-ups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm._arrow import slices
from quirespark.llm._store import materialise, passing, path_of, read_shared, unused

SPACE = b" \t\n\x0b\x0c\r"
LEAST_CHARS = 40
LEAST_DOCS = 5
MEMORY_BYTES = 64 << 20
#: bits of an owner's filters, and keys an owner should get
OWNER_BITS = 1 << 23
OWNER_KEYS = 400_000
SEGMENT_BITS = 1 << 20
BITS_PER_KEY = 16
PROBES = 4


def lines_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def key_of(line: bytes, least_chars: int) -> bytes | None:
    """The key of a line, None if it has fewer than ``least_chars`` code points."""
    if len(line) < least_chars:
        return None
    key = line.strip(SPACE).lower()
    n = len(key)
    if n < least_chars:
        return None
    if n < 4 * least_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return key


class Bloom:
    """A plain Bloom filter over 64-bit hashes, vectorised."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.bits, self.words = bits, np.zeros((bits + 63) // 64, np.uint64) if words is None else words

    def _at(self, h: np.ndarray) -> list[np.ndarray]:
        a = h & np.uint64(0xFFFFFFFF)
        b = (h >> np.uint64(32)) | np.uint64(1)
        return [((a + np.uint64(i) * b) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(self.bits) for i in range(PROBES)]

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for p in self._at(h):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def add(self, h: np.ndarray) -> None:
        for p in self._at(h):
            np.bitwise_or.at(self.words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))


def _hashes(docs: DataFrame, least_chars: int) -> DataFrame:
    """(h, twice): each batch's hashes of keys, once; twice if two of the batch's documents hold it."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh64_intdigest
        for b in batches:
            found: list[int] = []
            for t in b.column(0):
                keys = {k for k in (key_of(x, least_chars) for x in lines_of(t.as_py())) if k is not None}
                found.extend(map(digest, keys))
            h, n = np.unique(np.array(found, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], names=["h", "twice"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "h long, twice boolean")


def _suspects(hashes: DataFrame, owners: int) -> DataFrame:
    """Hashes that two documents hold, and false positives; each once per owner."""

    def run(batches):
        import pyarrow as pa

        once, twice = Bloom(OWNER_BITS), Bloom(OWNER_BITS)
        sent: set[int] = set()
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            sure = b.column("twice").to_numpy(zero_copy_only=False)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            again = once.has(u) | (n > 1)
            again |= np.isin(u, h[sure])
            once.add(u)
            new = u[again]
            # of what the filter holds only hashes that were emitted are left out
            old = twice.has(new)
            old[old] = [x in sent for x in new[old].tolist()]
            new = new[~old]
            twice.add(new)
            sent.update(new.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64))], names=["h"])

    return hashes.repartition(owners, "h").mapInArrow(run, "h long")


def _filter_table(spark: SparkSession, suspects: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The suspects' filter as rows (seg, bits) of one segment each, and its number of segments."""
    segments = max(1, -(-n * BITS_PER_KEY // SEGMENT_BITS))

    def run(batches):
        import pandas as pd

        held: dict[int, Bloom] = {}
        for b in batches:
            for seg, part in b.groupby("seg"):
                held.setdefault(int(seg), Bloom(SEGMENT_BITS)).add(part["h"].to_numpy().view(np.uint64))
        yield pd.DataFrame({"seg": list(held), "bits": [f.words.tobytes() for f in held.values()]})

    keyed = suspects.select("h", F.pmod(F.shiftrightunsigned("h", 7), F.lit(segments)).alias("seg"))
    return materialise(spark, keyed.repartition(min(segments, 64), "seg").mapInPandas(run, "seg long, bits binary"), "bloom"), segments


def _suspected_lines(docs: DataFrame, path: str | None, segments: int, least_chars: int) -> DataFrame:
    """(doc_id, key, h) of each document's distinct keys that the filter at ``path`` holds; all keys if None."""
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        import pyarrow as pa
        import xxhash

        words = np.zeros(0, np.uint64)
        if path:
            t = read_shared(path, ["seg", "bits"])
            words = np.zeros((segments, SEGMENT_BITS // 64), np.uint64)
            for s, bits in zip(t["seg"].to_pylist(), t["bits"].to_pylist()):
                words[s] = np.frombuffer(bits, np.uint64)
        for b in slices(batches, "text"):
            at: list[int] = []
            keys: list[bytes] = []
            for i, t in enumerate(b.column("text")):
                mine = list(dict.fromkeys(k for k in (key_of(x, least_chars) for x in lines_of(t.as_py())) if k is not None))
                keys.extend(mine)
                at.extend([i] * len(mine))
            h = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
            hit = np.ones(len(h), bool)
            if path and len(h):
                # all segments at once: a probe's word lies in its segment's row
                seg = (h >> np.uint64(7)) % np.uint64(segments)
                for p in Bloom(SEGMENT_BITS, words[:1])._at(h):  # noqa: SLF001
                    hit &= (words[seg, p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            pick = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(np.array(at, np.int64)[pick])), pa.array([keys[i] for i in pick], pa.binary()), pa.array(h[pick].view(np.int64))],
                names=["doc_id", "key", "h"],
            )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, key binary, h long")


def _digest128(key: bytes) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(key)
    return d >> 64, d & (1 << 64) - 1


def repeated_keys(spark: SparkSession, docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """(key, n_docs, keeper) of keys that at least ``least_docs`` rows hold; keeper is the largest doc_id among them."""
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = max(parts, -(-chars // ((least_chars + 1) * OWNER_KEYS)))
    suspects = materialise(spark, _suspects(_hashes(docs, least_chars), owners), "suspects")
    n = suspects.count()
    if n * BITS_PER_KEY // 8 <= memory_bytes:
        table, segments = _filter_table(spark, suspects, n)
        lines = _suspected_lines(docs, path_of(table), segments, least_chars)
    else:
        lines = _suspected_lines(docs, None, 1, least_chars).join(suspects.distinct(), "h", "left_semi")
    counted = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("n_docs") >= least_docs)


def _apply(docs: DataFrame, path: str, least_chars: int, extra: tuple[str, str]) -> DataFrame:
    """``docs`` with text cleaned, and n_lines and n_dropped; the keys at ``path`` fit in memory."""
    names = docs.columns
    at = names.index("text")
    ids = names.index("doc_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{extra[0]}` long, `{extra[1]}` long"

    def run(batches):
        import pyarrow as pa

        t = read_shared(path, ["key", "keeper"])
        held = dict(zip(map(_digest128, t["key"].to_pylist()), t["keeper"].to_pylist()))
        del t
        for b in slices(batches, at):
            texts, total, dropped = [], [], []
            for doc, cell in zip(b.column(ids), b.column(at)):
                raw, doc = cell.as_py(), doc.as_py()
                lines = lines_of(raw.encode() if isinstance(raw, str) else raw)
                kept = []
                for line in lines:
                    key = key_of(line, least_chars)
                    if key is not None and held and (d := _digest128(key)) in held and held[d] != doc:
                        continue
                    kept.append(line)
                texts.append(raw if len(kept) == len(lines) else b"\n".join(kept).decode("utf-8", "surrogateescape"))
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = [*b.columns]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=[*b.schema.names, *extra])

    return docs.mapInArrow(run, schema)


def _apply_joined(docs: DataFrame, keys: DataFrame, least_chars: int, extra: tuple[str, str]) -> DataFrame:
    """As ``_apply``, by joins: for more repeated keys than a task may hold."""
    d, gone_col = unused(docs, "line_doc", "line_drop")
    lines = _suspected_lines(docs, None, 1, least_chars).join(keys, "key")
    lines = lines.filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("doc_id", "key").distinct()
    drops = lines.groupBy(F.col("doc_id").alias(d)).agg(F.collect_list("key").alias(gone_col))
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops[d]), "left")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{extra[0]}` long, `{extra[1]}` long"
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, "text"):
            texts, total, dropped = [], [], []
            for cell, gone in zip(b.column(names.index("text")), b.column(gone_col)):
                raw, gone = cell.as_py(), set(gone.as_py() or ())
                lines = lines_of(raw.encode() if isinstance(raw, str) else raw)
                kept = [x for x in lines if key_of(x, least_chars) not in gone]
                texts.append(raw if len(kept) == len(lines) else b"\n".join(kept).decode("utf-8", "surrogateescape"))
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = [b.column(c) for c in names]
            columns[names.index("text")] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, *extra])

    return joined.select(*[f"`{c}`" for c in names], gone_col).mapInArrow(run, schema)


def dedup_lines(spark: SparkSession, docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, memory_bytes: int = MEMORY_BYTES, counts: tuple[str, str] = ("line_count", "line_dropped")) -> DataFrame:
    """All rows and columns of ``docs`` with text cleaned, plus two counts (long): lines before, and lines dropped.

    ``counts`` names them; ``docs`` must not have columns of those names.

    Keys of at least ``least_chars`` code points that at least ``least_docs``
    rows hold lose all their lines except in rows of the largest doc_id that
    holds them (so repeated rows of that id keep theirs). Null text counts as
    one empty line and stays null. Where every holder's doc_id is null, no
    largest exists and those rows keep their lines.
    """
    source = docs.withColumn("text", F.col("text").cast("string"))
    with passing(spark) as keep:
        keys = materialise(spark, repeated_keys(spark, source, least_chars, least_docs, memory_bytes), "repeated")
        keep(keys)
    size = keys.agg(F.count(F.lit(1)), F.sum(F.octet_length("key"))).first()
    if 300 * size[0] <= memory_bytes and (size[1] or 0) <= memory_bytes:
        return _apply(source, path_of(keys), least_chars, counts)
    return _apply_joined(source, keys, least_chars, counts)
