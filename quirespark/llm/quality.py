"""Line-first quality rules.

Every line of a text is judged alone by punctuation, navigation, symbol and
boilerplate rules; failing lines are removed; a document that loses more than
``MOST_LOST`` of its words is rejected. Base measures of the whole text are
computed beside and reject short and repetitive texts outright.

Rules of one line (words are runs of non-white-space). Each needs a least number
of words that show the fault, so that headings, list items and short lines are
left alone, and holds at any length else:

* punctuation: at least half of the words, and four, end in two or more ``!`` or ``?``;
* shouting, in lines of at least ``LEAST_WORDS`` words: at least half of the words
  have a Latin-1 letter, and at least 80 % of those have capitals, no small letter,
  and two characters or more;
* symbols: at least a quarter of the words, and two, hold one of ``#*$%&|<>`` twice
  in a row;
* navigation: at least a quarter of the words, and two, are separators (``|``,
  ``>``, ``»``, ``·``, ``•``, ``/``, ``›``);
* boilerplate, in lines of at most ``BOILERPLATE_WORDS`` words, as longer ones are
  prose that mentions such things: consent notices, script warnings, calls to
  subscribe, filler text.

A line with a word that equals an earlier line of its text fails as a repetition.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm._arrow import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
LEAST_WORDS = 8
BOILERPLATE_WORDS = 30
MOST_LOST = 0.5
_BLANKS = " \t\n\x0b\x0c\r"
_DOUBLED = re.compile(r"##|\*\*|\$\$|%%|&&|\|\||<<|>>")
_CAPITAL, _SMALL = re.compile("[A-ZÀ-ÖØ-Þ]"), re.compile("[a-zß-öø-ÿ]")
_ENDS = ("!!", "??", "!?", "?!")
_SEPARATORS = frozenset("| > » · • / ›".split())
_BOILERPLATE = re.compile(
    r"(?:we use cookies|this (?:web)?site uses cookies|accept (?:all )?cookies|cookie policy|privacy policy|terms of (?:use|service)"
    r"|all rights reserved|enable javascript|javascript is (?:disabled|required)|click here to|subscribe to our|sign up for our|lorem ipsum)",
    re.I,
)


def line_fails(line: str, words: list[str] | None = None) -> str | None:
    """Name of the first rule that a line fails, None if it passes."""
    words = WORD.findall(line) if words is None else words
    n = len(words)
    if not n:
        return None
    if n <= BOILERPLATE_WORDS and _BOILERPLATE.search(line):
        return "boilerplate"
    if "|" in line or ">" in line or "»" in line or "·" in line or "•" in line or "/" in line or "›" in line:
        if 4 * (k := sum(w in _SEPARATORS for w in words)) >= n and k > 1:
            return "navigation"
    if _DOUBLED.search(line) and 4 * (k := sum(_DOUBLED.search(w) is not None for w in words)) >= n and k > 1:
        return "symbols"
    if "!" in line or "?" in line:
        if 2 * (k := sum(w.endswith(_ENDS) for w in words)) >= n and k > 3:
            return "punctuation"
    if n < LEAST_WORDS:
        return None
    # shouting needs a capital in two fifths of the words
    if 5 * len(_CAPITAL.findall(line)) >= 2 * n:
        small = [_SMALL.search(w) is not None for w in words]
        capital = [_CAPITAL.search(w) is not None for w in words]
        cased = sum(a or b for a, b in zip(small, capital))
        if 2 * cased >= n and 5 * sum(len(w) > 1 and c and not k for w, c, k in zip(words, capital, small)) >= 4 * cased:
            return "shouting"
    return None


def repeat_words(words: list[str]) -> int:
    """Words inside three-word windows whose content occurs at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if v < 1 << 20:
        key = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:
        _, pair = np.unique(a[:-2] * v + a[1:-1], return_inverse=True)
        key = pair * v + a[2:]
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def judge(text: str | None, most_lost: float = MOST_LOST) -> tuple[int, int, int, int, int, bool, bool, int, int, str]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines, n_lost_words, what the text is without its failing lines).

    ``kept`` is the verdict on what is left: false if the whole text fails the
    base measures or has lost more than ``most_lost`` of its words.
    """
    if not text:
        return 0, 0, 0, 0, 0, True, False, 0, 0, ""
    seen: set[str] = set()
    words: list[str] = []
    left: list[str] = []
    dup = failed = lost = 0
    for line in text.split("\n"):
        mine = WORD.findall(line)
        if mine:
            words += mine
            again = line in seen
            dup += again
            seen.add(line)
            if again or line_fails(line, mine) is not None:
                failed += 1
                lost += len(mine)
                continue
        left.append(line)
    n = len(words)
    repeated = repeat_words(words)
    base_failed = n < 50 or 100 * repeated > 50 * n
    kept = not base_failed and lost <= most_lost * n
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeated, base_failed, kept, failed, lost, "\n".join(left) if failed else text


_OUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "n_lost_words", "clean_text"]
_KINDS = {"base_failed": "boolean", "kept": "boolean", "clean_text": "string"}


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of measures, verdicts and cleaned text for every row: the id and the columns of ``judge``.

    Null and empty texts have no words and fail. A text is read whole; repeated
    rows give repeated results; extra columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 1):
            rows = [judge(t.as_py()) for t in b.column(1)]
            cols = list(zip(*rows)) if rows else [[] for _ in _OUT]
            kinds = [{"boolean": pa.bool_(), "string": pa.string()}.get(_KINDS.get(c, ""), pa.int64()) for c in _OUT]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", *_OUT])

    schema = f"doc_id {kind}, " + ", ".join(f"{c} {_KINDS.get(c, 'long')}" for c in _OUT)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", clean: bool = True, chars_col: str | None = None) -> DataFrame:
    """The rows that ``judge`` keeps, with all columns, their texts without failing lines.

    ``clean=False`` leaves texts unchanged. ``chars_col`` follows the texts that lose lines.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, at):
            judged = [judge(t.as_py()) for t in b.column(at)]
            pick = [i for i, j in enumerate(judged) if j[6]]
            if not pick:
                continue
            columns = [c.take(pa.array(pick, pa.int64())) for c in b.columns]
            if clean:
                columns[at] = pa.array([judged[i][9] for i in pick], columns[at].type)
                if chars_col is not None:
                    k = names.index(chars_col)
                    columns[k] = pa.array([len(judged[i][9]) if judged[i][7] else n for n, i in zip(columns[k].to_pylist(), pick)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def _oracle() -> str:
    some = "', '".join(sorted(_SEPARATORS))
    boiler = _BOILERPLATE.pattern
    count = lambda cond: f"len(list_filter(words, lambda w: {cond}))"
    most = lambda cond, part, least: f"({part} * {count(cond)} >= len(words) AND {count(cond)} >= {least})"
    small, capital = f"regexp_matches(w, '{_SMALL.pattern}')", f"regexp_matches(w, '{_CAPITAL.pattern}')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) > 2),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS c FROM g),
q AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h WHERE c > 1) GROUP BY r),
l AS (SELECT r, n, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d)),
m AS (SELECT r, n AS line_no, line, len(words) AS n, len(words) > 0 AND row_number() OVER (PARTITION BY r, line ORDER BY n) > 1 AS again,
  len(words) > 0 AND ((len(words) <= {BOILERPLATE_WORDS} AND regexp_matches(line, '(?i){boiler}')) OR {most(f"w IN ('{some}')", 4, 2)} OR {most(f"regexp_matches(w, '{_DOUBLED.pattern}')", 4, 2)} OR {most("right(w, 2) IN ('!!', '??', '!?', '?!')", 2, 4)}
    OR (len(words) >= {LEAST_WORDS} AND 2 * {count(f"{small} OR {capital}")} >= len(words) AND 5 * {count(f"length(w) > 1 AND {capital} AND NOT {small}")} >= 4 * {count(f"{small} OR {capital}")})) AS fails
  FROM l),
s AS (SELECT r, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(n) FILTER (again OR fails), 0) AS n_lost_words, count(*) FILTER (again OR fails) AS n_failed_lines, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT (again OR fails)) AS clean_text FROM m GROUP BY r),
b AS (SELECT d.r, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(n_lost_words, 0) AS n_lost_words, coalesce(clean_text, '') AS clean_text FROM d LEFT JOIN q ON d.r = q.r LEFT JOIN s ON d.r = s.r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_lost_words <= n_words AS kept,
  CAST(n_failed_lines AS BIGINT) AS n_failed_lines, CAST(n_lost_words AS BIGINT) AS n_lost_words, sha256(clean_text) AS clean_sha256 FROM b
"""


ORACLE_OP8 = _oracle()
