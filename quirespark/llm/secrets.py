"""Secret scans by assignment-aware lexing.

Three base patterns find plain credentials. On top, source and configuration
syntax is lexed into name-literal pairs: ``name = "literal"``, ``name: literal``
(YAML, JSON, headers), ``name => literal``, ``export NAME=literal`` and
``"name": "literal"``. Literals have any length; triple-quoted and back-ticked
ones, PEM keys and YAML blocks go over line breaks. Constants are propagated inside a text: ``a = "x"`` then
``password = a + "y"`` makes ``xy`` the value of ``password``, and a reference
to a constant makes the constant's own literal a secret. A pair is reported if
its target name is sensitive and its value scores at least ``LEAST_SCORE``.

A name's value is a tree of literals and other names' values, so that a chain of
names which each repeat the one before takes linear memory. Values of up to
``WHOLE`` characters are scored by their text, longer concatenations by the
marks of their parts (length, kinds of characters, their frequencies, both ends).

Reported spans are code points of the literal, end exclusive. Spans of the
method are left out only where a base span holds them whole; base spans always
stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm._arrow import slices

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "lexed")
LEAST_SCORE = 4.0
#: characters up to which a concatenation is put together to be scored
WHOLE = 4096

_NAME = re.compile(
    r"(?<![A-Za-z0-9_.$-])[\"']?(?P<name>[A-Za-z_$][A-Za-z0-9_.$-]*+)[\"']?[\x20\t]*(?P<op>:=|=>|=(?![=~>])|:(?![:/=]))[\x20\t]*(?=[\"'A-Za-z0-9+/_$`(|>]|-----BEGIN )",
)
_PEM = r"-----BEGIN (?P<kind>[A-Z0-9 ]+)-----[^-]*+(?:-(?!----)[^-]*+)*+-----END (?P=kind)-----"
_OPERAND = re.compile(
    r"(?P<t>\"\"\"|''')(?P<long>(?:[^\\]|\\(?s:.))*?)(?P=t)|(?P<q>[\"'])(?P<lit>(?:(?!(?P=q))[^\\\n]|\\(?s:.))*+)(?P=q)|`(?P<tick>(?:[^\\`]|\\(?s:.))*+)`"
    rf"|[\"']?\s*(?P<pem>{_PEM})|(?P<ref>\$?\{{?[A-Za-z_$][A-Za-z0-9_.$]*+\}}?)|(?P<bare>[A-Za-z0-9+/_.=~!@#%^&*-])",
)
_LITERALS = ("lit", "long", "tick", "pem")
_JOIN = re.compile(r"[\x20\t]*(?:\+|\.\.|&)[\x20\t]*|[\x20\t]+(?=[\"'])")
_BARE = re.compile(r"[^\s,;\"'`<>(){}\[\]]+")
_WORD = re.compile(r"[A-Za-z0-9_]")
#: the head of a YAML block, and what may stand before its key
_BLOCK, _BEFORE = re.compile(r"[|>][0-9+-]{0,2}[\x20\t]*(?:#[^\n]*)?\r?\n"), re.compile(r"\x20*(?:[-?]\x20+)*")
_ARMOUR = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----")
_SENSITIVE = (
    (re.compile(r"pass(?:word|wd|phrase|code)|(?<![a-z])pwd(?![a-z])"), 3.0),
    (re.compile(r"private_?key|secret|credential|client_?secret|signing_?key|encryption_?key"), 3.0),
    (re.compile(r"api_?key|access_?key|auth_?token|access_?token|refresh_?token|bearer|token(?!i[sz])|webhook|conn(?:ection)?_?str(?:ing)?"), 2.5),
)
_PLACEHOLDER = re.compile(r"^(?:x{3,}|\*{3,}|\.{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|changeme|change_me|example|placeholder|your[_-].*|none|null|nil|true|false|todo|redacted|undefined|string|str|text)$", re.I)


def entropy(value: str) -> float:
    """Shannon bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def sensitive(name: str) -> float:
    """Points of a target name."""
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").replace(".", "_").lower()
    return max((p for pattern, p in _SENSITIVE if pattern.search(plain)), default=0.0)


def score(name: str, value: str | Value, quoted: bool) -> float:
    """Points of a pair: the target name's sensitivity, then the value's length, mixture and entropy."""
    points = sensitive(name)
    n = len(value) if isinstance(value, str) else value.n
    if not points or n < 8:
        return 0.0
    if isinstance(value, str):
        if _PLACEHOLDER.match(value):
            return 0.0
        kinds = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        bits, spaced, letters = entropy(value), _spaced(value), value.isalpha()
    else:
        if value.filler:
            return 0.0
        kinds, bits, spaced, letters = bin(value.kinds).count("1"), value.entropy(), value.spaced, value.letters
    points += 0.5 * (kinds - 1) + (0.5 if n >= 16 else 0.0) + (0.5 if quoted else 0.0)
    points += 0.5 if bits >= 3.0 else -0.5
    if spaced or letters and not quoted:
        points -= 2.0
    return points


def _spaced(value: str) -> bool:
    """Whether blanks stand in the value, a key's armour and the indents of lines aside."""
    if "-----" in value:
        value = _ARMOUR.sub("", value)
    return " " in value and ("\n" not in value or any(" " in x.strip() for x in value.split("\n")))


class Value:
    """A name's value: a span of the text, or the concatenation of other values.

    ``marks`` of a long one are made from its parts' marks, so that they take
    constant memory and no text is put together.
    """

    __slots__ = ("_marks", "n", "parts", "quoted", "span", "told")

    def __init__(self, n: int, quoted: bool, span: tuple[int, int] | None = None, parts: tuple[Value, ...] = ()):
        # a length that doubling would let run away stays a bounded number: only small ones are compared
        self.n, self.quoted, self.span, self.parts, self.told, self._marks = min(n, 1 << 62), quoted, span, parts, False, None

    def spans(self) -> list[tuple[int, int]]:
        """Spans of the value's literals, each once, but those a call has given before."""
        out, todo = [], [self]
        while todo:
            v = todo.pop()
            if not v.told:
                v.told = True
                out += [v.span] if v.span else []
                todo += v.parts
        return out

    def text(self, whole: str) -> str:
        """The value put together, for values of few characters."""
        out, todo = [], [self]
        while todo:
            v = todo.pop()
            if v.span:
                out.append(whole[v.span[0] : v.span[1]])
            todo += reversed(v.parts)
        return "".join(out)

    def weigh(self, whole: str) -> None:
        """Make the marks of this value and of those it is made of."""
        todo = [self]
        while todo:
            v = todo[-1]
            wait = [p for p in v.parts if p._marks is None] if v._marks is None else []
            if wait:
                todo += wait
                continue
            todo.pop()
            if v._marks is None:
                v._marks = v._of_span(whole) if v.span else v._of_parts()

    def _of_span(self, whole: str) -> tuple:
        text = whole[self.span[0] : self.span[1]]
        counts = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & 127, minlength=128)
        kinds = sum(1 << k for k, c in enumerate(("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")) if re.search(c, text))
        return (counts / len(text)).astype(np.float32), kinds, _spaced(text), text.isalpha(), _PLACEHOLDER.match(text) is not None

    def _of_parts(self) -> tuple:
        marks, n = [p._marks for p in self.parts], sum(p.n for p in self.parts)
        shares = sum(m[0] * np.float32(p.n / n) for m, p in zip(marks, self.parts))
        kinds = 0
        for m in marks:
            kinds |= m[1]
        # fillers in a row are one filler
        return shares, kinds, any(m[2] for m in marks), all(m[3] for m in marks), all(m[4] for m in marks)

    def entropy(self) -> float:
        share = self._marks[0][self._marks[0] > 0].astype(float)
        return float(-(share * np.log2(share)).sum())

    kinds = property(lambda self: self._marks[1])
    spaced = property(lambda self: self._marks[2])
    letters = property(lambda self: self._marks[3])
    filler = property(lambda self: self._marks[4])


def _block(text: str, key: int, at: int) -> tuple[int, int] | None:
    """Span of the YAML block whose key starts at ``key`` and whose head is at ``at``."""
    line = text.rfind("\n", 0, key) + 1
    head = _BLOCK.match(text, at)
    if not head or not _BEFORE.fullmatch(text, line, key):
        return None
    start = end = None
    pos = head.end()
    while pos < len(text):
        stop = text.find("\n", pos)
        stop = len(text) if stop < 0 else stop
        row = text[pos:stop]
        if body := row.strip():
            first = pos + len(row) - len(row.lstrip())
            if first - pos <= key - line:
                break
            start = first if start is None else start
            end = first + len(body)
        pos = stop + 1
    return None if start is None else (start, end)


def _joined(parts: list[Value]) -> Value:
    return parts[0] if len(parts) == 1 else Value(sum(p.n for p in parts), any(p.quoted for p in parts), parts=tuple(parts))


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach sensitive names, constants propagated in order of appearance."""
    constants: dict[str, Value] = {}
    found: list[tuple[int, int]] = []
    at = run = word = 0
    while m := _NAME.search(text, at):
        pos, parts, quoted, read = m.end(), [], False, False
        at = m.end()
        if m["op"] == ":" and text[pos] in "|>" and (block := _block(text, m.start(), pos)):
            parts, quoted, read = [Value(block[1] - block[0], True, block)], True, True
        while not (read and pos == at) and (o := _OPERAND.match(text, pos)):
            if part := next((p for p in _LITERALS if o[p] is not None), None):
                a, b = o.span(part)
                parts += [Value(b - a, True, (a, b))] if b > a else []
                quoted, pos, read = True, o.end(), True
            elif o["ref"] is not None and (known := constants.get(o["ref"].strip("${}"))) and not _WORD.match(text, o.end()):
                parts.append(known)
                quoted, pos, read = quoted or known.quoted, o.end(), True
            elif not read and (pos < run or (b := _BARE.match(text, pos))):
                # a name that no constant has is its own text; a run's end is looked for once
                if pos >= run:
                    run = b.end()
                    word = pos + len(b[0].rstrip(".,;:!?"))
                parts += [Value(word - pos, False, (pos, word))] if word > pos else []
                pos = run
                break
            else:
                break
            if not (j := _JOIN.match(text, pos)):
                break
            pos = j.end()
        if not parts:
            continue
        # an unquoted value may itself hold a pair (a URL's query), as may one over lines: go on inside it
        at = pos if quoted and "\n" not in text[at:pos] else at
        value = constants[m["name"]] = _joined(parts)
        if sensitive(m["name"]):
            if value.n > WHOLE and not value.span:
                value.weigh(text)
                points = score(m["name"], value, quoted)
            else:
                points = score(m["name"], value.text(text), quoted)
            if points >= LEAST_SCORE:
                found.extend(value.spans())
    return sorted(set(found))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(text: str | None) -> tuple[int, int, int, str, str]:
    """(n_assign, n_access, n_hex, base_sha256, spans) of one whole text; null counts as empty."""
    text = text or ""
    base = base_spans(text)
    extra: list[tuple[int, int, str]] = []
    if "=" in text or ":" in text:
        taken = [(a, b) for a, b, _ in base]
        extra = [(a, b, "lexed") for a, b in lexed_spans(text) if not any(x <= a and b <= y for x, y in taken)]
    spans = sorted(base + extra, key=lambda s: (s[0], KINDS.index(s[2]))) if extra else base
    kinds = [k for _, _, k in base]
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row.

    Null text counts as empty: zero counts, the digest of the empty string and no
    spans. Texts and literals of any length are scanned whole, in memory linear in
    the text. Repeated rows give repeated results; extra columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, 1):
            rows = list(zip(*(scan(t.as_py()) for t in b.column(1)))) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(rows, kinds)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    out = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced by ``mark``; overlapping spans are replaced once."""
    if not text:
        return text
    spans = [tuple(map(int, s.split(":")[1:])) for s in scan(text)[4].split(",") if s]
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
