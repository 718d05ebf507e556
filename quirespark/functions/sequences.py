"""Decoding of arrays and token sequences.

Decoders of one array are higher-order column functions. Decoders that keep a
grid or a stack are plain functions for use inside pandas functions.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- argmax, top-k and CTC


def argmax(scores: Column) -> Column:
    """Struct (prob, token) of the greatest score; the last of equals, as recognisers pick it."""
    return F.array_max(F.transform(scores, lambda x, i: F.struct(x.alias("prob"), i.alias("token"))))


def argmax_first(scores: Column) -> Column:
    """Struct (prob, token) of the greatest score; the first of equals, as table decoders pick it."""
    best = F.array_max(F.transform(scores, lambda x, i: F.struct(x.alias("prob"), (-i).alias("token"))))
    return F.struct(best["prob"].alias("prob"), (-best["token"]).alias("token"))


def top_k(scores: Column, k: int, names: dict[int, str] | None = None) -> Column:
    """Array of structs (class_id, score, label): the k best by falling score, earlier first on ties.

    k is cut to the array's length; k below 1 and empty arrays raise. Without
    ``names`` labels are null; a class without a name is ``Unknown(id)``.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    filled = F.when(F.size(scores) > 0, scores).otherwise(F.raise_error(F.lit("no predictions in a row")))
    ranked = F.sort_array(F.transform(filled, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    best = F.slice(ranked, F.lit(1), F.least(F.lit(k), F.size(filled)))
    known = F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in names.items())) if names else None
    label = (lambda i: F.coalesce(F.try_element_at(known, i), F.concat(F.lit("Unknown("), i.cast("string"), F.lit(")")))) if names else (lambda i: F.lit(None).cast("string"))
    return F.transform(best, lambda s: F.struct(s["i"].alias("class_id"), (-s["s"]).alias("score"), label(s["i"]).alias("label")))


def _kept_steps(tokens: Column, blank: int, size: int | None) -> Column:
    """Positions (from 0) that CTC keeps: not blank, not the step before's token, inside the dictionary."""
    inside = (lambda t: t < size) if size is not None else (lambda t: F.lit(True))
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)))
    before = lambda i: F.when(i == 0, F.lit(blank)).otherwise(F.get(tokens, i - 1))
    return F.when(F.size(tokens) > 0, F.filter(at, lambda i: (F.get(tokens, i) != blank) & (F.get(tokens, i) != before(i)) & inside(F.get(tokens, i)))).otherwise(F.array().cast("array<int>"))


def ctc_decode(tokens: Column, probs: Column, alphabet: list[str], blank: int = 0) -> Column:
    """Struct (text, score, columns, positions) of a step sequence.

    The alphabet's entry i belongs to token i, that of ``blank`` is unused. The
    score is the mean of the kept steps, 0 when none is; columns are their
    numbers, positions their share of the sequence's length.
    """
    chars = F.array(*[F.lit(c) for c in alphabet])
    steps = _kept_steps(tokens, blank, len(alphabet))
    kept = F.transform(steps, lambda i: F.get(probs, i))
    mean = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, p: s + p) / F.size(kept)).otherwise(0.0)
    text = F.array_join(F.transform(steps, lambda i: F.get(chars, F.get(tokens, i))), "")
    return F.struct(text.alias("text"), mean.alias("score"), steps.alias("columns"), F.transform(steps, lambda i: i / F.size(tokens)).alias("positions"))


def base_decode(tokens: Column, probs: Column | None, alphabet: list[str], ignored: tuple[int, ...] = (0,), drop_repeats: bool = True) -> Column:
    """Struct (text, score) of the plain decoder: equal neighbours collapse first, ignored tokens go after.

    The score counts kept steps even where the dictionary has no character.
    """
    chars = F.array(*[F.lit(c) for c in alphabet])
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)))
    fresh = (lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1))) if drop_repeats else (lambda i: F.lit(True))
    steps = F.when(F.size(tokens) > 0, F.filter(at, lambda i: fresh(i) & ~F.get(tokens, i).isin(*ignored))).otherwise(F.array().cast("array<int>"))
    inside = F.filter(steps, lambda i: F.get(tokens, i) < len(alphabet))
    kept = F.transform(steps, lambda i: F.get(probs, i) if probs is not None else F.lit(1.0))
    mean = F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, p: s + p) / F.size(kept)).otherwise(0.0)
    return F.struct(F.array_join(F.transform(inside, lambda i: F.get(chars, F.get(tokens, i))), "").alias("text"), mean.alias("score"))


def ctc_char_boxes(x1: Column, x2: Column, text: Column, columns: Column, steps: Column, ratio: Column, most_ratio: Column) -> Column:
    """Array of (x1, x2) of each character of a line, from its steps' columns.

    Padding is undone by the line's and the batch's aspect ratios. An ideograph
    has the line's mean width about its centre, any other character reaches to
    the midpoints between its neighbours' centres.
    """
    effective = F.when(most_ratio > 0, steps * ratio / most_ratio).otherwise(0.0)
    cell = F.when(effective > 0, (x2 - x1) / effective)
    centers = F.transform(columns, lambda c: x1 + (c + 0.5) * cell)
    half = (x2 - x1) / F.greatest(F.length(text), F.lit(1)) / 2.0
    last = F.size(columns) - 1

    def one(c: Column, i: Column) -> Column:
        wide = F.coalesce(F.substring(text, i + 1, F.lit(1)), F.lit("?")).rlike(r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B81F}]")
        low = F.when(wide, c - half).when(i == 0, x1).otherwise((F.get(centers, i - 1) + c) / 2.0)
        high = F.when(wide, c + half).when(i == last, x2).otherwise((c + F.get(centers, i + 1)) / 2.0)
        return F.struct(F.greatest(low, x1).alias("x1"), F.least(high, x2).alias("x2"))

    empty = (F.size(columns) == 0) | (F.length(text) == 0) | cell.isNull()
    return F.when(~F.coalesce(empty, F.lit(True)), F.transform(centers, one)).otherwise(F.array().cast("array<struct<x1:double,x2:double>>"))


def position_boxes(x1: Column, x2: Column, positions: Column, n_chars: Column) -> Column:
    """Array of (x1, x2) about each position, as wide as the line's mean character."""
    w = x2 - x1
    half = F.when(n_chars > 0, w / n_chars / 2.0)
    boxes = F.transform(positions, lambda p: F.struct(F.greatest(x1 + p * w - half, x1).alias("x1"), F.least(x1 + p * w + half, x2).alias("x2")))
    return F.when(F.coalesce(n_chars > 0, F.lit(False)), boxes).otherwise(F.array().cast("array<struct<x1:double,x2:double>>"))


def banned_tokens(history: Column, n: int) -> Column:
    """Tokens that would complete an n-gram already in the history, sorted; none for n below 2."""
    none = F.slice(history, F.lit(1), F.lit(0))
    if n <= 1:
        return none
    size = F.size(history)
    tail = F.slice(history, F.greatest(size - (n - 2), F.lit(1)), F.lit(n - 1))
    hits = F.filter(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda i: F.slice(history, i + 1, F.lit(n - 1)) == tail)
    return F.when(size >= n, F.sort_array(F.array_distinct(F.transform(hits, lambda i: F.get(history, i + (n - 1)))))).otherwise(none)


def order_ranks(votes: Column) -> Column:
    """Ranks from a square array of pair logits: by votes received (logistic), ties by position.

    ``votes[i][j]`` above 0 says that i precedes j; more predecessors rank later.
    """
    n = F.size(votes)
    sig = lambda v: 1.0 / (1.0 + F.exp(-v))
    at = F.sequence(F.lit(0), n - 1)
    gained = F.transform(at, lambda j: F.aggregate(at, F.lit(0.0), lambda s, i: s + F.when(i < j, sig(F.get(F.get(votes, i), j))).when(i > j, 1.0 - sig(F.get(F.get(votes, j), i))).otherwise(0.0)))
    ranked = F.sort_array(F.transform(gained, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return F.transform(at, lambda i: F.array_position(F.transform(ranked, lambda r: r["i"]), i).cast("int") - 1)


# -- table structure tokens


def table_vocabulary(lines: list[str]) -> list[str]:
    """Token list of a table model: ``<td>`` merged into ``<td></td>``, ``sos`` first and ``eos`` last."""
    words = [x.rstrip() for x in lines if x.rstrip()]
    if "<td></td>" not in words:
        words.append("<td></td>")
    if "<td>" in words:
        words.remove("<td>")
    return ["sos", *words, "eos"]


def decode_structure(steps: list[tuple[int, float]], boxes: list[list[float]], vocabulary: list[str]) -> tuple[list[str], list[list[float]], float]:
    """(tokens, boxes of cell tokens, mean score) of best (token, score) steps up to the end token."""
    end = len(vocabulary) - 1
    tokens, cells, scores = [], [], []
    for at, (token, score) in enumerate(steps):
        if at and token == end:
            break
        if token in (0, end):
            continue
        word = vocabulary[token] if token < len(vocabulary) else f"UNK_{token}"
        tokens.append(word)
        scores.append(score)
        if word.startswith("<td") and word.removeprefix("<td") in ("", ">", "></td>"):
            cells.append(boxes[at] if at < len(boxes) else [])
    return tokens, cells, sum(scores) / len(scores) if scores else 0.0


_SPAN = {a: re.compile(rf'{a}="(\d+)"') for a in ("colspan", "rowspan")}


def span_attr(token: str, name: str) -> int | None:
    m = _SPAN[name].search(token)
    return int(m[1]) if m else None


def _opening(tokens: Sequence[str], at: int) -> tuple[str, int, int, int]:
    """(attributes, row span, column span, next position) of the cell that opens at ``at``."""
    head = tokens[at][3:].split(">", 1)[0]
    parts, i = [head] if head else [], at + 1
    while i < len(tokens) and tokens[i] not in (">", "</td>", "<tr>", "</tr>") and not tokens[i].startswith("<td"):
        parts.append(tokens[i])
        i += 1
    while i < len(tokens):
        t = tokens[i]
        if t.startswith("<td") or t in ("<tr>", "</tr>"):
            break
        i += 1
        if t == "</td>":
            break
    last = lambda name: next((v for v in (span_attr(p, name) for p in reversed(parts)) if v is not None), 1)
    return "".join(parts), last("rowspan"), last("colspan"), max(i, at + 1)


def cell_grid(tokens: Sequence[str]) -> list[tuple[int, int, int, int]]:
    """(row, column, row span, column span) of each cell; slots that earlier rows span are skipped."""
    out, taken, row, col, at = [], set(), 0, 0, 0
    while at < len(tokens):
        t = tokens[at]
        if t == "<tr>":
            col = 0
        elif t == "</tr>":
            row += 1
        elif t.startswith("<td"):
            rs, cs, after = (1, 1, at + 1) if t == "<td></td>" else _opening(tokens, at)[1:]
            while (row, col) in taken:
                col += 1
            out.append((row, col, rs, cs))
            taken |= {(row + r, col + c) for r in range(1, rs) for c in range(cs)}
            col += cs
            at = after
            continue
        at += 1
    return out


def html_parts(tokens: Sequence[str]) -> tuple[list[tuple[str, bool]], str]:
    """(for each cell the markup up to its text and whether bold marks follow it, the markup after the last cell but its end)."""
    cells, out, at = [], ["<html><body>"], 0
    own = bool(tokens) and "<table" in tokens[0]
    if not own:
        out.append("<table>")
    while at < len(tokens):
        t = tokens[at]
        if t.startswith("<td"):
            attrs, _, _, after = ("", 1, 1, at + 1) if t == "<td></td>" else _opening(tokens, at)
            cells.append(("".join([*out, f"<td{attrs}>"]), after < len(tokens) and tokens[after] == "<b>"))
            out, at = ["</td>"], after
        else:
            out.append(t)
            at += 1
    if not own:
        out.append("</table>")
    return cells, "".join([*out, "</body></html>"])


def html_of_parts(cells: list[tuple[str, bool]], end: str, texts: Sequence[str | None]) -> str:
    out = []
    for n, (head, bold) in enumerate(cells):
        body = texts[n] if n < len(texts) else None
        out += (head, f"<b>{body}</b>" if bold and body is not None else body or "")
    out.append(end)
    return "".join(out)


def table_html(tokens: list[str], texts: list[str | None] | None = None) -> str:
    """The tokens as a document's table, the n-th cell holding the n-th text."""
    return html_of_parts(*html_parts(tokens), texts or ())


def ends_cell(token: str) -> bool:
    return token in ("<td></td>", "</td>") or ("<td" in token and "</td>" in token)


def row_starts(tokens: Sequence[str]) -> list[int]:
    """Number of the first cell of every row that has one."""
    out, n, fresh = [], 0, False
    for t in tokens:
        if t in ("<tr>", "</tr>"):
            fresh = t == "<tr>"
        elif ends_cell(t):
            if fresh:
                out.append(n)
            fresh, n = False, n + 1
    return out


def align_rows(flags: list[int], starts: list[int]) -> list[int]:
    """For each row start the largest of the leading flags up to it; the start itself while there is none."""
    out, i, best = [], 0, None
    for s in starts:
        while i < len(flags) and flags[i] <= s:
            best = flags[i] if best is None else max(best, flags[i])
            i += 1
        out.append(s if best is None else best)
    return out


def cluster_positions(values: list[float], tolerance: float) -> list[float]:
    """Means of runs of sorted values whose neighbours lie within the tolerance."""
    runs: list[list[float]] = []
    for v in sorted(values):
        if runs and abs(v - runs[-1][-1]) <= tolerance:
            runs[-1].append(v)
        else:
            runs.append([v])
    return [sum(r) / len(r) for r in runs]


def nearest_index(positions: list[float], value: float) -> int:
    return min(range(len(positions)), key=lambda i: (abs(positions[i] - value), i), default=0)


def tokens_of_cells(cells: list[tuple[float, float, float, float]], tolerance: float) -> tuple[list[str], list[tuple[int, int, int, int, int]]] | None:
    """(tokens, cells in token order as (source, row, column, row span, column span)) of a grid clustered from edges."""
    xs = cluster_positions([v for c in cells for v in (c[0], c[2])], tolerance)
    ys = cluster_positions([v for c in cells for v in (c[1], c[3])], tolerance)
    cols, rows = len(xs) - 1, len(ys) - 1
    if cols < 1 or rows < 1:
        return None
    spans, slot = [], {}
    for k, c in enumerate(cells):
        a, b = sorted((nearest_index(xs, c[0]), nearest_index(xs, c[2])))
        d, e = sorted((nearest_index(ys, c[1]), nearest_index(ys, c[3])))
        left, top = min(a, cols - 1), min(d, rows - 1)
        span = (k, top, left, max(min(e, rows) - top, 1), max(min(b, cols) - left, 1))
        spans.append(span)
        for r in range(top, min(top + span[3], rows)):
            for q in range(left, min(left + span[4], cols)):
                slot.setdefault((r, q), k)
    tokens, order = ["<table>", "<tbody>"], []
    for r in range(rows):
        tokens.append("<tr>")
        q = 0
        while q < cols:
            if (k := slot.get((r, q))) is None:
                q += 1
                continue
            _, top, left, rs, cs = spans[k]
            if (top, left) == (r, q):
                attrs = (f' rowspan="{rs}"' if rs > 1 else "") + (f' colspan="{cs}"' if cs > 1 else "")
                tokens.append(f"<td{attrs}></td>")
                order.append(spans[k])
            q += max(cs, 1)
        tokens.append("</tr>")
    return ([*tokens, "</tbody>", "</table>"], order) if order else None


# -- OTSL

FULL, EMPTY, LEFT, UP, CROSS, BREAK = "<fcel>", "<ecel>", "<lcel>", "<ucel>", "<xcel>", "<nl>"
_TOKEN = re.compile("<[fluxe]cel>|<nl>")
_ANY = r"([\s\S]*?)"
_ROW, _CELL = re.compile(f"<tr[^>]*>{_ANY}</tr>", re.I), re.compile(f"<t[hd]([^>]*)>{_ANY}</t[hd]>", re.I)
_ATTR = {a: re.compile(rf'(?:^|\s){a}\s*=\s*["]?([0-9]+)', re.I) for a in ("colspan", "rowspan")}


def has_otsl(text: str) -> bool:
    return _TOKEN.search(text) is not None


def _attr(attrs: str, name: str) -> int:
    m = _ATTR[name].search(attrs)
    return int(m[1]) if m and int(m[1]) > 0 else 1


def cell_text(body: str) -> str:
    """A cell's text without tags, five entities decoded, ends stripped."""
    out = re.sub("<[^>]*>", "", body)
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'")):
        out = out.replace(a, b)
    return out.strip()


def html_to_otsl(markup: str) -> str | None:
    """OTSL of a markup table, None if it has no rows or no cells."""
    text = markup.strip()
    if not re.search(r"<tr[\s>]", text, re.I):
        return None
    text = re.sub("<td(?=colspan=|rowspan=)", "<td ", text)
    rows = [[(_attr(a, "rowspan"), _attr(a, "colspan"), cell_text(b)) for a, b in _CELL.findall(r)] for r in _ROW.findall(text)]
    width = max((sum(c[1] for c in r) for r in rows), default=0)
    if not width:
        return None
    grid: list[list[tuple[int, int, str] | None]] = [[None] * width for _ in rows]
    for r, cells in enumerate(rows):
        c = 0
        for rs, cs, body in cells:
            while c < width and grid[r][c] is not None:
                c += 1
            if c >= width:
                break
            for y in range(r, min(r + rs, len(rows))):
                for x in range(c, min(c + cs, width)):
                    grid[y][x] = (r, c, body)
            c += cs

    def mark(r: int, c: int) -> str:
        slot = grid[r][c]
        if slot is None:
            return EMPTY
        if (slot[0], slot[1]) == (r, c):
            return FULL + slot[2] if slot[2] else EMPTY
        return LEFT if slot[0] == r else UP if slot[1] == c else CROSS

    return "".join("".join(mark(r, c) for c in range(width)) + BREAK for r in range(len(rows)))


def otsl_segments(line: str) -> list[str]:
    """A row's parts, one a token; text before the first token stays with it."""
    at = [m.start() for m in _TOKEN.finditer(line)]
    return [line[a:b] for a, b in zip([0, *at[1:]], [*at[1:], len(line)])] if at else []


def otsl_squared(text: str) -> str:
    """Rows cut or padded to the width of least total change, not below the last filled cell."""
    text = text.strip()
    if BREAK not in text:
        return text + BREAK
    rows = [s for s in (otsl_segments(x) for x in text.split(BREAK) if x) if s]
    if not rows:
        return BREAK
    least = max(max((i + 1 for i, s in enumerate(r) if s.startswith(FULL)), default=0) for r in rows)
    most = max(least, max(map(len, rows)))
    width = min(range(least, most + 1), key=lambda w: (sum(abs(len(r) - w) for r in rows), w))
    return "".join("".join((r + [EMPTY] * width)[:width]) + BREAK for r in rows)


def otsl_to_html(text: str) -> str:
    """A markup table of OTSL, of markup (repaired) or of tab-separated lines."""
    text = text.strip()
    if not text:
        return ""
    if "<table" in text:
        return table_repaired(text)
    if not has_otsl(text):
        return tabs_to_html(text)
    rows: list[list[tuple[str, str]]] = [[]]
    padded = otsl_squared(text)
    marks = list(_TOKEN.finditer(padded))
    for m, nxt in zip(marks, [*marks[1:], None]):
        if m[0] == BREAK:
            rows.append([])
        else:
            rows[-1].append((m[0], padded[m.end() : nxt.start() if nxt else len(padded)]))
    rows = [r for r in rows if r]
    if not rows:
        return otsl_plain(text)
    width = max(map(len, rows))
    kind = [[r[c][0] if c < len(r) else EMPTY for c in range(width)] for r in rows]
    body = [[r[c][1] if c < len(r) else "" for c in range(width)] for r in rows]
    owner: dict[tuple[int, int], tuple[int, int]] = {}
    spans: dict[tuple[int, int], tuple[int, int]] = {}
    for r in range(len(rows)):
        for c in range(width):
            if kind[r][c] not in (FULL, EMPTY):
                continue
            cs = rs = 1
            while c + cs < width and kind[r][c + cs] in (LEFT, CROSS):
                cs += 1
            while r + rs < len(rows) and kind[r + rs][c] in (UP, CROSS):
                rs += 1
            spans[r, c] = (rs, cs)
            owner.update({(y, x): (r, c) for y in range(r, r + rs) for x in range(c, min(c + cs, width))})
    out = []
    for r in range(len(rows)):
        cells = []
        for c in range(width):
            if owner.get((r, c)) == (r, c):
                rs, cs = spans[r, c]
                attrs = (f' rowspan="{rs}"' if rs > 1 else "") + (f' colspan="{cs}"' if cs > 1 else "")
                cells.append(f"<td{attrs}>{_html.escape(body[r][c].strip(), quote=False) if kind[r][c] == FULL else ''}</td>")
        out.append(f"<tr>{''.join(cells)}</tr>")
    return f"<table>{''.join(out)}</table>" if spans else otsl_plain(text)


def otsl_plain(text: str) -> str:
    """OTSL without its marks: filled cells after tabs, rows and empty cells on lines, blank lines dropped."""
    for a, b in ((EMPTY, "\n"), (BREAK, "\n"), (FULL, "\t"), (LEFT, ""), (UP, ""), (CROSS, "")):
        text = text.replace(a, b)
    return "\n".join(x.strip() for x in text.split("\n") if x.strip())


def tabs_to_html(text: str) -> str:
    rows = ("".join(f"<td>{_html.escape(c.strip(), quote=False)}</td>" for c in line.split("\t")) for line in text.split("\n") if line.strip())
    return f"<table>{''.join(f'<tr>{r}</tr>' for r in rows)}</table>"


def table_repaired(text: str) -> str:
    for a, b in (("<tdcolspan=", "<td colspan="), ("<tdrowspan=", "<td rowspan="), ("colspan=", " colspan="), ("<|sn|>", ""), ("<|unk|>", ""), ("￿", "")):
        text = text.replace(a, b)
    return text


def table_output(text: str) -> str:
    """Recognised table text as markup where it holds one, else stripped."""
    t = text.strip()
    return otsl_to_html(t) if "<table" in t or has_otsl(t) else t


# -- layout lines of a parser model

_MARK = {m: re.escape(f"<|{m}|>") for m in ("box_start", "box_end", "ref_start", "ref_end")}
_LAYOUT = re.compile("{box_start}%s{box_end}{ref_start}(\\w+?){ref_end}(.*)".format(**_MARK) % r"\s+".join([r"(\d+)"] * 4) + r"\Z")


def layout_lines(text: str) -> list[tuple[str, float, float, float, float, int | None]]:
    """(type, x1, y1, x2, y2, angle) of each valid layout line; boxes in shares of the page."""
    from quirespark.functions.elements import BLOCK_TYPES

    out = []
    for line in text.split("\n"):
        m = _LAYOUT.match(line.rstrip("\r"))
        if not m:
            continue
        x1, y1, x2, y2 = map(int, m.groups()[:4])
        kind = m[5].lower()
        if max(x1, y1, x2, y2) > 1000 or x1 == x2 or y1 == y2 or kind not in BLOCK_TYPES:
            continue
        angle = next((a for n, a in (("up", 0), ("right", 90), ("down", 180), ("left", 270)) if f"<|rotate_{n}|>" in m[6]), None)
        out.append((kind, min(x1, x2) / 1000, min(y1, y2) / 1000, max(x1, x2) / 1000, max(y1, y2) / 1000, angle))
    return out
