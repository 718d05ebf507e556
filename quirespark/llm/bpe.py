"""BPE encoding and decoding with contiguous rank arrays.

The tokenizer file's whole chain is carried out here: added tokens are cut out
of the raw text, the rest is normalised (NFC, white space to one space,
lower-cased code point by code point), split by the file's pattern, turned into
byte symbols and merged. A word's merge state is two contiguous arrays, part
boundaries and the rank of each adjacent pair; the least rank (leftmost of
equals) is found by scanning, its inner boundary deleted and the two
neighbouring ranks refreshed. That is quadratic in the word's length, so words
of more than ``SHORT`` symbols take an equivalent heap over linked parts.

Words recur, so each Python worker keeps the encodings of recent words in two
dictionaries of bounded bytes: a full one becomes the elder, whose words are
looked up and moved back while the younger fills. A task holds the vocabulary,
one slice of rows and those dictionaries. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm._arrow import SLICE_BYTES, slices

SHORT = 64
#: bytes, about, of the encodings that a worker keeps
CACHE_BYTES = 128 << 20
_NONE = 1 << 60
#: Unicode White_Space, which the normaliser's ``\s`` stands for
_WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte value in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class WordBpe:
    """Encoder and decoder of one tokenizer file of the kind "BPE with word ends"."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        chain = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or chain != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError(f"{path}: not a tokenizer of the supported kind")
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.unknown = model.get("unk_token")
        self.tokens = {i: t for t, i in self.vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.ranks: dict[tuple[str, str], int] = {}
        for k, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks.setdefault((a, b), k)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split, regex.V0)
        self.white = regex.compile(f"[{_WHITE}]+")
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.symbols = byte_symbols()
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.elder: dict[str, tuple[int, str, str]] = {}
        self.held = 0

    # -- merging

    def merge(self, parts: list[str]) -> list[str]:
        """The parts left when no adjacent pair has a rank."""
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[str]) -> list[str]:
        rank = self.ranks.get
        ranks = [rank(p, _NONE) for p in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), _NONE)
        return parts

    def _heap(self, parts: list[str]) -> list[str]:
        rank, n = self.ranks.get, len(parts)
        live: list[str | None] = list(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, i + 1, live[i], live[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if live[i] != a or live[j] != b or right[i] != j:
                continue
            live[i], live[j] = a + b, None
            right[i] = right[j]
            if right[i] != -1:
                left[right[i]] = i
                k = right[i]
                if (r := rank((live[i], live[k]))) is not None:
                    heapq.heappush(heap, (r, i, k, live[i], live[k]))
            if (k := left[i]) != -1 and (r := rank((live[k], live[i]))) is not None:
                heapq.heappush(heap, (r, k, i, live[k], live[i]))
        return [p for p in live if p is not None]

    def word(self, word: str) -> tuple[int, str, str]:
        """(number of tokens, ids joined by a space, tokens joined by a space) of one split word."""
        got = self.cache.get(word)
        if got is None:
            got = self.elder.get(word)
            if got is None:
                parts = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
                parts[-1] += self.end
                # a symbol outside the vocabulary is dropped, as the file has no unknown token
                parts = self.merge([p for p in parts if p in self.vocab])
                got = (len(parts), " ".join(str(self.vocab[p]) for p in parts), " ".join(parts))
            if len(word) <= SHORT:
                # three strings, a tuple and their place in the dictionary
                self.held += 320 + len(word) + len(got[1]) + len(got[2])
                if self.held > CACHE_BYTES // 2:
                    self.cache, self.elder, self.held = {}, self.cache, 0
                self.cache[word] = got
        return got

    # -- texts

    def normalise(self, text: str) -> str:
        text = self.white.sub(" ", unicodedata.normalize("NFC", text))
        # per code point: a capital sigma never becomes a final one
        return text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """``word`` of each word and added token of a text, in order."""
        if self.cut is None or not any(c in text for c in self.added):
            return [self.word(w) for w in self.words.findall(self.normalise(text)) if w]
        out = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append((1, str(self.added[part]), part))
            elif part:
                out.extend(self.word(w) for w in self.words.findall(self.normalise(part)) if w)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.pieces(text or "") if p[0] for i in p[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder. Unknown ids are skipped."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text (null and empty: an empty array).

    ``docs`` must not have a column ``ids_col``; repeated rows give repeated results.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        bpe = tokenizer(path)
        for b in slices(batches, at):
            ids = pa.array([bpe.encode(t.as_py()) for t in b.column(at)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, ids_col])

    return docs.mapInArrow(run, f"{schema}, `{ids_col}` array<int>")


def decode(frame: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``frame`` with the text of each row's ids (null: null)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    at = frame.columns.index(ids_col)

    def run(batches):
        import pyarrow as pa

        bpe = tokenizer(path)
        for b in slices(batches, at, most_bytes=SLICE_BYTES // 4):
            texts = [None if x.as_py() is None else bpe.decode(x.as_py()) for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, text_col])

    return frame.mapInArrow(run, f"{schema}, `{text_col}` string")


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` without the text, with its ids and the text decoded from them, in one pass over each whole text.

    Null and empty texts have no ids and decode to the empty string. Equal to
    ``decode`` of ``encode``, but the text never returns from the Python worker
    and one vocabulary serves both. ``docs`` must not have other columns of the
    two names; repeated rows give repeated results.
    """
    rest = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"`{ids_col}` array<int>", f"`{decoded_col}` string"])
    at = docs.columns.index(text_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        bpe = tokenizer(path)
        for b in slices(batches, at):
            ids, texts, ends = [], [], [0]
            for t in b.column(at):
                found = [p for p in bpe.pieces(t.as_py() or "") if p[0]]
                ids += [p[1] for p in found]
                ends.append(ends[-1] + sum(p[0] for p in found))
                texts.append(" ".join([p[2] for p in found]).encode("utf-8", "surrogatepass"))
            flat = np.array(" ".join(ids).split(" "), np.int32) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            columns = [c for k, c in enumerate(b.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(texts, pa.binary()).cast(pa.string(), safe=False)], names=[*[f.name for f in rest], ids_col, decoded_col])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text; null counts as empty.

    Repeated rows give repeated results; extra columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        bpe, sha = tokenizer(path), hashlib.sha256
        for b in slices(batches, "text"):
            n, ids, texts = [], [], []
            for t in b.column("text"):
                found = [p for p in bpe.pieces(t.as_py() or "") if p[0]]
                n.append(sum(p[0] for p in found))
                ids.append(sha(" ".join([p[1] for p in found]).encode()).hexdigest())
                texts.append(sha(" ".join([p[2] for p in found]).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_digests(spark: SparkSession, docs: DataFrame, name: str = "word_bpe_49k.json") -> DataFrame:
    return digests(docs, vocabulary_path(name))
