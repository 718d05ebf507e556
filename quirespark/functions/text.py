"""Text clean-up for recognised pages.

Rules that are replacements are column expressions. Rules that carry state from
character to character or line to line are plain Python functions; ``as_udf``
makes a pandas function of any of them, which moves Arrow batches and keeps null
as null.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BULLETS = "•●◦▪◆"
#: Java and Python forms of the wide ideograph test, and of the narrower one of word boxes
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}]"
CJK_PY = re.compile("[\u4e00-\u9fff\u3400-\u4dbf\U00020000-\U0002a6df\U0002a700-\U0002ebef]")
CJK_NARROW_PY = re.compile("[\u4e00-\u9fff\u3400-\u4dbf\U00020000-\U0002a6df\U0002a700-\U0002b81f]")
KEYWORDS = ("ABSTRACT", "INTRODUCTION", "REFERENCES", "REFERENCE")
_HAN = "一二三四五六七八九十百千万亿零壹贰叁肆伍陆柒捌玖拾"
_ROMAN = f"(?:{'|'.join('I II III IV V VI VII VIII IX X'.split())})"
_COUNT = "[1-9][0-9]*"
_ARABIC = rf"{_COUNT}(?:[.]{_COUNT})*"
_OPEN, _CLOSE = "[(（]", "[)）]"
_FORMS = (f"{_ARABIC}[.、]?", f"{_OPEN}{_ARABIC}{_CLOSE}", f"[{_HAN}][.、]?", f"{_OPEN}[{_HAN}]+{_CLOSE}", rf"{_ROMAN}(?:[.]|\b)")
_VL_FORMS = (f"{_ARABIC}[.、]?", f"{_OPEN}(?:{_COUNT}|[{_HAN}]+){_CLOSE}", f"[{_HAN}]+[.、]?", rf"{_ROMAN}[.\s]")
_HEAD = rf"^\s*({'|'.join(_FORMS)})" + r"(\s+)(.*)"
NUMBERED = re.compile(_HEAD + r"\Z")
VL_NUMBERED = re.compile(rf"^\s*({'|'.join(_VL_FORMS)})" + r"(\s*)(.*)" + r"\Z")
_JAVA_NUMBERED = _HEAD + "$"


#: texts that are Python objects at one time
SLICE = 256


def by_slices(f: Callable, values):
    """Arrow texts mapped by ``f``, null as null, a slice at a time: beside the Arrow arrays only a slice's texts are in memory."""
    import pyarrow as pa

    out = [pa.array([None if v is None else f(v) for v in values.slice(k, SLICE).to_pylist()], pa.string()) for k in range(0, len(values), SLICE)]
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def as_udf(f: Callable, returns: str = "string"):
    """A function over Arrow texts, or a pandas function where the result is no text, applying ``f`` to each non-null value."""
    if returns == "string":
        import pyarrow as pa

        def run(values: pa.Array) -> pa.Array:
            return by_slices(f, values)

        # types, not their names: annotations of this module are texts
        run.__annotations__ = {"values": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, returns)

    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f(v))

    return run


def strip(text: Column) -> Column:
    """Without white space at either end; Spark's trim removes spaces only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# -- column expressions


def clean_ocr(text: Column) -> Column:
    """Broken words joined, line breaks to spaces."""
    return F.replace(F.replace(text, F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))


def text_block(text: Column) -> Column:
    """Broken words joined, each line a paragraph."""
    joined = F.replace(text, F.lit("-\n"), F.lit(""))
    return F.replace(F.replace(joined, F.lit("\n\n"), F.lit("\n")), F.lit("\n"), F.lit("\n\n"))


footnote_block = text_block


def content_block(text: Column) -> Column:
    """Soft breaks at line ends; a hyphenated end gets two of them, as the second pass sees the first one's break."""
    return F.replace(F.replace(text, F.lit("-\n"), F.lit("  \n")), F.lit("\n"), F.lit("  \n"))


def first_line(text: Column, splitter: str, templates: list[str], prefix: str = "## ", untrimmed: bool = False) -> Column:
    """The first non-blank part turned into a heading if it equals a template in any case.

    ``untrimmed`` compares the part as it stands.
    """
    parts = F.split(text, re.escape(splitter) if splitter != "\n" else "\n", -1)
    at = F.coalesce(F.array_position(F.transform(parts, lambda p: strip(p) != ""), True), F.lit(0))
    key = (lambda p: F.lower(p)) if untrimmed else (lambda p: F.lower(strip(p)))
    head = (lambda p: F.concat(F.lit(prefix), p)) if untrimmed and splitter == "\n" else (lambda p: F.concat(F.lit(prefix), p if untrimmed else strip(p), F.lit("\n")))
    return F.array_join(F.transform(parts, lambda p, i: F.when((i + 1 == at) & key(p).isin(*templates), head(p)).otherwise(p)), splitter)


def has_bullets(text: Column) -> Column:
    return text.rlike(f"[{BULLETS}]")


def bullet_list(text: Column) -> Column:
    """``- item`` lines of the parts between bullet marks."""
    items = F.filter(F.transform(F.split(text, f"[{BULLETS}]"), strip), lambda p: p != "")
    return F.array_join(F.transform(items, lambda p: F.concat(F.lit("- "), p, F.lit("\n"))), "")


def is_cjk(char: Column) -> Column:
    return char.rlike(f"^{CJK}")


def needs_space_after(char: Column) -> Column:
    return char.rlike("^[A-Za-z]")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unwrapped_table(html: Column) -> Column:
    """Table markup without its document wrappers."""
    for tag in ("<html>", "</html>", "<body>", "</body>"):
        html = F.replace(html, F.lit(tag), F.lit(""))
    return html


def merged_words_parted(text: Column) -> Column:
    """Spaces put where words run together: after ``'s`` before a letter, before a capital that starts a word,
    between a digit or percent sign and a capital, between a letter and a digit that a letter follows."""
    return F.regexp_replace(text, r"(?<='[a-z])(?=[a-z])|(?<=[a-z])(?=[A-Z][a-z])|(?<=[0-9%])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9][A-Za-z])", " ")


def title_level(text: Column) -> Column:
    """Heading level of a title by its numbering or keyword; null if neither speaks."""
    cleaned = clean_ocr(text)
    keyword = F.upper(F.regexp_replace(strip(cleaned), ":+$", "")).isin(*KEYWORDS)
    dots = F.length(F.regexp_replace(F.regexp_extract(cleaned, _JAVA_NUMBERED, 1), r"[^.]", ""))
    return F.when(keyword, 2).when(cleaned.rlike(_JAVA_NUMBERED), F.least(F.greatest(dots + 2, F.lit(2)), F.lit(6))).cast("int")


def titled(text: Column, voted: Column | None = None) -> Column:
    """Struct (level, title): by numbering or keyword, else the voted level within 2 and 6, else 2."""
    cleaned = clean_ocr(text)
    keyword = F.upper(F.regexp_replace(strip(cleaned), ":+$", "")).isin(*KEYWORDS)
    number = F.regexp_replace(F.regexp_extract(cleaned, _JAVA_NUMBERED, 1), r"\.+$", "")
    rest = F.regexp_replace(F.regexp_extract(cleaned, _JAVA_NUMBERED, 3), r"^\s+", "")
    numbered = F.when(F.regexp_extract(cleaned, _JAVA_NUMBERED, 3) == "", number).otherwise(F.concat(number, F.lit(" "), rest))
    title = F.when(keyword, strip(cleaned)).when(cleaned.rlike(_JAVA_NUMBERED), numbered).otherwise(cleaned)
    fallback = F.least(F.greatest(F.coalesce(voted if voted is not None else F.lit(None).cast("int"), F.lit(2)), F.lit(2)), F.lit(6))
    return F.struct(F.coalesce(title_level(text), fallback).cast("int").alias("level"), title.alias("title"))


def special_tokens_removed(text: Column) -> Column:
    for a, b in (("-<|sn|>", ""), ("<|sn|>", " "), ("<|unk|>", ""), ("\uffff", "")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def runs_shortened(text: Column) -> Column:
    """Four or more underscores to three, four or more dots to three, ends stripped."""
    return strip(F.regexp_replace(F.regexp_replace(text, "_{4,}", "___"), r"\.{4,}", "..."))


_SIZES = [f"{b}{g}{side}" for b in "bB" for g in ("ig", "igg") for side in ("", "l", "r")]
_BRACKETS = rf"\\({'|'.join(_SIZES)})" + r"\{(\\?[\[\](){}|])\}"


def latex_brackets(text: Column) -> Column:
    """``\\big{(}`` to ``\\big(``."""
    return F.regexp_replace(text, _BRACKETS, r"\\$1$2")


def formula_block(text: Column) -> Column:
    """Display mathematics: delimiters dropped, line breaks doubled, wrapped in ``$$``."""
    out = F.replace(special_tokens_removed(text), F.lit(r"\upmu"), F.lit(r"\mu"))
    for mark in (r"\[", r"\]", r"\(", r"\)"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    out = F.regexp_replace(strip(out), r"^\$+|\$+$", "")
    out = latex_brackets(F.replace(out, F.lit("\n"), F.lit("\\\\\n")))
    return F.concat(F.lit("$$"), strip(out), F.lit("$$"))


def table_block(text: Column) -> Column:
    """Table markup with run-together attributes repaired and line breaks between tags dropped."""
    for a, b in (("<tdcolspan=", "<td colspan="), ("<tdrowspan=", "<td rowspan="), ('"colspan=', '" colspan=')):
        text = F.replace(text, F.lit(a), F.lit(b))
    text = special_tokens_removed(text)
    for a, b in ((r"\(", "$"), (r"\)", "$"), (r"\[", "$$"), (r"\]", "$$")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r">\s*\n+\s*", ">")


def math_tightened(text: Column) -> Column:
    """White space inside single ``$...$`` dropped; ``$$`` and a lone ``$`` stay."""
    return as_udf(tighten_math)(text)


def spaces_collapsed(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def punctuation_tightened(text: Column) -> Column:
    """Without the space before closing punctuation."""
    return F.regexp_replace(text, " ([,.;:!?)])", "$1")


def math_unwrapped(text: Column) -> Column:
    """Without outer ``$$`` and then ``$``, ends stripped."""
    t = strip(text)
    t = F.when((F.length(t) >= 4) & t.startswith("$$") & t.endswith("$$"), F.regexp_extract(t, r"(?s)^\$\$(.*)\$\$$", 1)).otherwise(t)
    t = F.when((F.length(t) >= 2) & t.startswith("$") & t.endswith("$"), F.regexp_extract(t, r"(?s)^\$(.*)\$$", 1)).otherwise(t)
    return strip(t)


def centered(text: Column) -> Column:
    return F.concat(F.lit('<div style="text-align: center;">'), clean_ocr(text), F.lit("</div>\n"))


def centered_table(html: Column) -> Column:
    """Table markup with inline styles: a centred table whose cells are centred and wrap."""
    wrap = "word-wrap: break-word;"
    for tag, attrs in (("table", f"border=1 style='margin: auto; {wrap}'"), ("th", f"style='text-align: center; {wrap}'"), ("td", f"style='text-align: center; {wrap}'")):
        html = F.replace(html, F.lit(f"<{tag}>"), F.lit(f"<{tag} {attrs}>"))
    return html


def block_prompt(kind: Column) -> Column:
    return F.when(kind == "table", "\nTable Recognition:").when(kind == "equation", "\nFormula Recognition:").otherwise("\nText Recognition:")


def image_tags_dropped(text: Column) -> Column:
    """Without paragraphs that open with the tag of a cropped picture."""
    return F.array_join(F.filter(F.split(text, "\n\n", -1), lambda p: ~strip(p).startswith('<img src="images/bbox_')), "\n\n")


def formula_unwrapped(text: Column) -> Column:
    """``\\[`` and ``\\]`` taken off, ``$$`` put on unless it begins and ends with ``$``."""
    t = strip(F.regexp_replace(F.regexp_replace(strip(text), r"^\\\[", ""), r"\\\]$", ""))
    return F.when(t.startswith("$") & t.endswith("$"), t).otherwise(F.concat(F.lit("$$"), t, F.lit("$$")))


def tiny_symbol(text: Column, confidence: Column, width: Column, height: Column) -> Column:
    """A tiny, doubtful ``=`` or ``0`` read as the punctuation that it looks like."""
    w, h = F.greatest(width, F.lit(0.0)), F.greatest(height, F.lit(0.0))
    return (
        F.when((text == "=") & (confidence < 0.45) & (w <= 9.5) & (h <= 7.5), ",")
        .when((text == "=") & (confidence < 0.45) & (w <= 12.5) & (h > 7.5) & (h <= 10.5), "-")
        .when((text == "0") & (confidence < 0.20) & (w <= 14.5) & (h <= 14.5), ";")
        .otherwise(text)
    )


# -- state machines


_SINGLE = re.compile(r"(?<!\$)\$(?!\$)")


def tighten_math(text: str) -> str:
    """White space at either end of single ``$...$`` dropped; ``$$`` and an unmatched ``$`` stay."""
    marks = [m.start() for m in _SINGLE.finditer(text)]
    out, at = [], 0
    for a, b in zip(marks[::2], marks[1::2]):
        out += [text[at : a + 1], text[a + 1 : b].strip()]
        at = b
    return "".join([*out, text[at:]])


_TABLE_TAGS = re.compile(rf"</?(?:{'|'.join('table thead tbody tfoot tr td th'.split())})[^>]*>")


def format_text(text: str) -> str:
    """Recognised text: delimiters of mathematics unified, table tags dropped, spacing tightened."""
    for a, b in (("-<|sn|>", ""), ("<|sn|>", " "), ("<|unk|>", ""), ("\uffff", "")):
        text = text.replace(a, b)
    if r"\(" in text and r"\)" in text:
        text = text.replace(r"\(", " $ ").replace(r"\)", " $ ")
    if r"\[" in text and r"\]" in text:
        text = text.replace(r"\[", " $$ ").replace(r"\]", " $$ ")
    text = text.replace(r"$\bullet$", "•")
    if "<table>" in text:
        text = _TABLE_TAGS.sub("", text)
    text = re.sub(" ([,.;:!?)])", r"\1", re.sub(" +", " ", tighten_math(text)))
    return re.sub(r"\.{4,}", "...", re.sub("_{4,}", "___", text)).strip()


def dehyphenate(text: str) -> str:
    """Without ``-`` and line break before a small letter, unless an address is near."""
    out, at = [], 0
    for m in re.finditer(r"-\n(?=[a-z])", text):
        near = text[max(0, m.start() - 10) : m.start() + 5]
        if not any(mark in near for mark in ("http", "www", "://")):
            out.append(text[at : m.start()])
            at = m.end()
    return "".join([*out, text[at:]])


_MERGED = re.compile(r"(?<='[a-z])(?=[a-z])|(?<=[a-z])(?=[A-Z][a-z])|(?<=[0-9%])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9][A-Za-z])")


def postprocess_text(text: str) -> str:
    """One line of prose: words rejoined and parted, white space collapsed.

    A full stop right after a letter or digit swallows the white space that
    follows it; punctuation in that state replaces the character before it.
    """
    out: list[str] = []
    gap = False
    for c in _MERGED.sub(" ", dehyphenate(text)):
        if c.isspace():
            if not gap and out:
                out.append(" ")
                gap = True
        elif c == "." and out and out[-1].isascii() and out[-1].isalnum():
            out.append(".")
            gap = True
        elif gap and c in ".,!?;:)]}":
            out[-1] = c
        else:
            out.append(c)
            gap = False
    return "".join(out)


def _lines(text: str) -> list[str]:
    """Lines without their ends; a final break starts no further line."""
    parts = text.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]


def empty_formulas_dropped(text: str) -> str:
    """Without empty ``$$`` pairs; of a block of blank lines only the opening mark goes."""
    lines, out, i = _lines(text), [], 0
    fence = [x.strip() == "$$" for x in lines]
    while i < len(lines):
        if fence[i]:
            if i + 1 < len(lines) and fence[i + 1]:
                i += 2
                if i < len(lines) and not lines[i].strip():
                    i += 1
                continue
            j = i + 1
            while j < len(lines) and not fence[j] and not lines[j].strip():
                j += 1
            if j >= len(lines) or fence[j]:
                i += 1
                continue
        # leading blank output takes no separator
        out.append(lines[i] if not out or out == [""] else "\n" + lines[i])
        if out[0] == "" and len(out) > 1:
            out.pop(0)
        i += 1
    return "".join(out)


def sections_deduped(text: str) -> str:
    """Without later repeats of a ``**Header**`` line."""
    seen: set[str] = set()
    out = ""
    for line in _lines(text):
        t = line.strip()
        if t.startswith("**") and t.endswith("**") and len(t.encode()) > 4:
            if t in seen:
                continue
            seen.add(t)
        out = f"{out}\n{line}" if out else line
    return out


def postprocess_markdown(text: str) -> str:
    """Markdown with its prose lines cleaned; code, formulas, headings, lists, quotes and tables stay."""
    out: list[str] = []
    code = formula = False
    for line in _lines(sections_deduped(empty_formulas_dropped(text))):
        t = line.strip()
        if t.startswith("```"):
            code = not code
        elif t == "$$":
            formula = not formula
        elif code:
            pass
        elif formula:
            line = line.replace("$", r"\$")
        elif not t.startswith(("#", "*", ">", "|", "-", "+")):
            line = postprocess_text(line)
        out.append(line + "\n")
    return "".join(out)


def _suffix_unit(chars: str, least: int, repeats: int) -> tuple[str, str, int] | None:
    """(rest, unit, count) of the longest unit that ends the text ``repeats`` times."""
    n = len(chars)
    for size in range(n // repeats, least - 1, -1):
        unit = chars[n - size :]
        if chars.endswith(unit * repeats):
            count = repeats
            while chars.endswith(unit * (count + 1)):
                count += 1
            return chars[: n - size * count], unit, count
    return None


def _tiling_unit(chars: str) -> str | None:
    """The shortest unit of at most half the text that tiles it."""
    k = (chars + chars).find(chars, 1)
    return chars[:k] if 0 < k <= len(chars) // 2 else None


def truncate_repeats(text: str, line_threshold: int = 10, char_threshold: int = 10, min_len: int = 10) -> str:
    """Degenerate output cut short: a repeating tail, one unit repeated throughout, or one line that is 80 % of all."""
    body = text.strip()
    if not body:
        return text
    if "\n" not in body:
        if len(body) > 100 and (found := _suffix_unit(body, 8, 5)) and len(found[1]) * found[2] > len(body) // 2:
            return found[0]
        if len(body) > min_len and (unit := _tiling_unit(body)) and len(body) // len(unit) >= char_threshold:
            return unit
    lines = [x.strip() for x in _lines(text) if x.strip()]
    if len(lines) < line_threshold or not lines:
        return text
    line, n = Counter(lines).most_common(1)[0]
    return line if n >= line_threshold and n / len(lines) >= 0.8 else text


def clean_truncated_tail(text: str, least: int = 8000, most_period: int = 200, repeats: int = 5, least_cut: int = 100) -> str:
    """A long text whose tail has a short period keeps its first period and what the last one left unfinished."""
    n = len(text)
    if n < least:
        return text
    for size in range(1, min(most_period, n - 1) + 1):
        run = 0
        while run < n - size and text[n - 1 - run] == text[n - 1 - run - size]:
            run += 1
        whole = run + size
        if run and whole // size >= repeats and whole >= least_cut:
            return text[: n - whole + size] + (text[n - whole % size :] if whole % size else "")
    return text


def vl_title(text: str) -> str:
    """Heading of a parsed title: depth by its dots, final dots dropped."""
    title = text
    if (m := VL_NUMBERED.match(title)) and m[1].strip():
        title = f"{m[1].strip()} {m[3].lstrip()}"
    title = title.rstrip(".")
    return f"{'#' * (title.count('.') + 2)} {title}".replace("-\n", "").replace("\n", " ")


def split_by_ratio(text: str, ratios: list[float]) -> list[str]:
    """The text cut in shares of its length, each part stripped.

    A cut that falls inside a word moves back, up to five characters, to just
    after white space, a comma or a full stop.
    """
    if len(ratios) <= 1:
        return [text]
    n, total = len(text), sum(ratios)
    if not n:
        return [""] * len(ratios)
    shares = [r / total for r in ratios] if total > 0 else [1 / len(ratios)] * len(ratios)
    out, at = [], 0
    for k, share in enumerate(shares):
        end = n if k == len(shares) - 1 else min(n, at + int(n * share + 0.5))
        if at < end < n:
            for i in range(end, end - min(5, end - at), -1):
                if i > at and (text[i].isspace() or text[i] in ",."):
                    end = i + 1
                    break
        out.append(text[at:end].strip())
        at = end
    return out


_LETTER = "[A-Za-z]"
_WRAPPED = re.compile(rf"\\(?:{'|'.join('mathbf mathrm operatorname text'.split())})" + r"\s?[*]?\s*[{].*?[}]")
_HAN_TEXT = re.compile(r"\\text\s*[{](" + "[^{}]*[\u4e00-\u9fff]+[^{}]*" + ")[}]")


def normalise_latex(latex: str) -> str:
    """Without ideographs' ``\\text{}``, double quotes, and spaces that mathematics ignores.

    White space after anything but a letter goes, as does white space between a
    letter and anything but a letter. A backslash before a space is passed over
    and the space considered next. Repeats until nothing changes, at most ten
    times.
    """
    out = _HAN_TEXT.sub(r"\1", latex).replace('"', "")
    out = _WRAPPED.sub(lambda m: m[0].replace(" ", ""), out)
    for _ in range(10):
        was, parts, i = out, [], 0
        while i < len(out):
            c = out[i]
            parts.append(c)
            i += 1
            if i < len(out) and out[i].isspace() and not (c == "\\" and out[i] == " ") and not (c.isascii() and c.isalpha()):
                j = i
                while j < len(out) and out[j].isspace():
                    j += 1
                i = j if j < len(out) else i
        out = re.sub(rf"(?<={_LETTER})\s+(?!{_LETTER}|\s)(?=.)", "", "".join(parts), flags=re.S)
        if out == was:
            break
    return out.strip()


def reversed_keeping_ascii(text: str) -> str:
    """Characters in reverse order, runs of ASCII letters, digits, space and ``:*./%+-`` kept as they read."""
    return "".join(reversed(re.findall(r"[A-Za-z0-9 :*./%+-]+|.", text, re.S)))
