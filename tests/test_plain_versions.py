"""Queries that SQL cannot express, against plain Python over the same rows; orders against what holds of any of them."""

import statistics
from collections import Counter, defaultdict

import pytest

from quirespark.functions import text as T
from quirespark.plans import inputs, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    out = defaultdict(list)
    for r in inputs.boxes(spark, SF).orderBy("doc_id", "idx").collect():
        out[r["doc_id"]].append(r)
    return out


def plain_truncated(text):
    body = text.strip()
    if not body:
        return text
    n = len(body)
    if "\n" not in body:
        if n > 100:
            for size in range(n // 5, 7, -1):
                unit, k = body[n - size :], 1
                while k < 5 and body[n - (k + 1) * size : n - k * size] == unit:
                    k += 1
                if k == 5:
                    while body[: n - k * size].endswith(unit):
                        k += 1
                    if size * k > n // 2:
                        return body[: n - size * k]
                    break
        if n > 10:
            for size in range(1, n // 2 + 1):
                if n % size == 0 and body == body[:size] * (n // size):
                    if n // size >= 10:
                        return body[:size]
                    break
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    if len(lines) >= 10:
        line, k = Counter(lines).most_common(1)[0]
        if k >= 10 and k / len(lines) >= 0.8:
            return line
    return text


def test_truncated_text_against_plain_rules(spark):
    rows = {r["doc_id"]: r["text"] for r in inputs.hyphened(spark, SF).collect()}
    got = {r["doc_id"]: r["text"] for r in registry.queries()["truncated_text"](spark, SF).collect()}
    # quadratic here: texts of one line are compared where they are short
    assert all(got[i] == plain_truncated(t) for i, t in rows.items() if "\n" in t.strip() or len(t) < 4000)
    for made in ("ab" * 30, "abcabcab", "word " * 40, "Intro. " * 3 + "0123456789" * 40, "x" * 9, "x\n" * 20, "a\nb\n" + "line\n" * 30, "a\nb\nc\nd\n" + "line\n" * 10, "", " \n "):
        assert T.truncate_repeats(made) == plain_truncated(made), made


def plain_means(points, centers, rounds, stop):
    """Lloyd's rounds over tuples; the first of equally near centres."""
    near = [0] * len(points)
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for _ in range(rounds):
        now = [min(range(len(centers)), key=lambda c: (dist(p, centers[c]), c)) for p in points]
        moved = now != near
        near = now
        for c in range(len(centers)):
            mine = [p for p, k in zip(points, near) if k == c]
            if mine:
                centers[c] = tuple(sum(v) / len(mine) for v in zip(*mine))
        if stop and not moved:
            break
    return near, centers


def test_reduced_cells_against_plain_clusters(spark, pages):
    got = defaultdict(list)
    for r in registry.queries()["reduced_cells"](spark, SF).collect():
        got[r["doc_id"]].append((r["idx"], tuple(round(r[c], 6) for c in ("x1", "y1", "x2", "y2"))))
    for doc, rows in pages.items():
        n = sum(r["idx"] % 2 == 1 for r in rows)
        boxes = [(r["x1"], r["y1"], r["x2"], r["y2"]) for r in rows]
        if n < len(boxes):
            points = [((a + c) / 2, (b + d) / 2) for a, b, c, d in boxes]
            chosen = [sorted(points, key=lambda p: p[0])[len(points) // 2]]
            far = lambda p: min((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 for q in chosen)
            while len(chosen) < n and sum(map(far, points)) > 0:
                chosen.append(max(points, key=far))
            near, _ = plain_means(points, list(chosen), 10, True)
            groups = [[b for b, k in zip(boxes, near) if k == c] for c in range(len(chosen))]
            boxes = [(min(b[0] for b in g), min(b[1] for b in g), max(b[2] for b in g), max(b[3] for b in g)) for g in groups if g]
        assert sorted(got[doc]) == [(i, tuple(round(v, 6) for v in b)) for i, b in enumerate(boxes)], doc


def plain_levels(values, falling):
    s = sorted(values)
    k = min(sum(b - a > 1e-3 for a, b in zip(s, s[1:])) + 1, 4, len(s))
    if len(values) < 2 or k <= 1:
        return [None] * len(values)
    centers = [(s[min(int((i + 0.5) / k * len(s)), len(s) - 1)],) for i in range(k)]
    _, centers = plain_means([(v,) for v in values], centers, 16, False)
    near = [min(range(k), key=lambda c: (abs(v - centers[c][0]), c)) for v in values]
    order = sorted(range(k), key=lambda c: -centers[c][0] if falling else centers[c][0])
    return [min(max(order.index(c) + 2, 2), 6) for c in near]


def test_title_levels_against_plain_votes(spark, pages):
    got = {(r["doc_id"], r["idx"]): r["level"] for r in registry.queries()["title_levels"](spark, SF).collect()}
    want = {}
    for doc, rows in pages.items():
        titles = [r for r in rows if r["idx"] % 2 == 0 or r["kind"] == "paragraph_title"]
        numbered = [3 if r["idx"] % 3 == 0 and r["text"] is not None else None for r in titles]
        font = plain_levels([max(max(r["y2"] - r["y1"], 1.0) / r["num_lines"], 1.0) for r in titles], True)
        indent = plain_levels([r["x1"] for r in titles], False)
        for r, *said in zip(titles, numbered, font, indent):
            votes = Counter()
            for level, weight in zip(said, (2, 1, 1)):
                if level:
                    votes[level] += weight
            top = max(votes.values(), default=0)
            best = [v for v, c in votes.items() if c == top]
            want[doc, r["idx"]] = said[0] if said[0] in best else min(best, default=2)
    assert got == want


@pytest.mark.parametrize("name", ["enhanced_order", "region_order"])
def test_orders_are_whole_and_follow_the_page(spark, pages, name):
    """Every box once; pages of boxes one clearly below the other, all plain texts, read from the top."""
    got = defaultdict(dict)
    for r in registry.queries()[name](spark, SF).collect():
        got[r["doc_id"]][r["idx"]] = r["rank"]
    stacked = 0
    for doc, rows in pages.items():
        ranks = got.get(doc, {})
        rows = [r for r in rows if r["idx"] in ranks]
        assert sorted(ranks.values()) == list(range(len(ranks)))
        if name == "enhanced_order":
            assert len(ranks) == len(pages[doc])
            by_top = sorted(rows, key=lambda r: r["y1"])
            apart = all(a["y2"] <= b["y1"] for a, b in zip(by_top, by_top[1:]))
            if apart and len(rows) > 1 and {r["kind"] for r in rows} <= {"text", "reference_content", "formula", "table", "other"}:
                stacked += 1
                assert [r["idx"] for r in by_top] == sorted(ranks, key=ranks.get)
    assert name != "enhanced_order" or stacked > 0


def test_filled_tables_use_each_text_once(spark, pages):
    """Each table has its four cells; the texts in its cells are the page's, and no more regions are used than it has texts."""
    import re

    for r in registry.queries()["filled_tables"](spark, SF).collect():
        texts = [x["text"] for x in pages[r["doc_id"]] if x["text"] is not None]
        cells = re.findall(r"<td[^>]*>(.*?)</td>", r["html"], re.S)
        assert len(cells) == 4 and r["n_used"] <= len(pages[r["doc_id"]])
        numbers = Counter(re.findall(r"\d+", " ".join(cells)))
        whole = Counter(re.findall(r"\d+", " ".join(texts)))
        assert set(re.sub("<[^>]*>", "", "".join(cells))) <= set("".join(texts) + " $\n✓✗,-;")
        assert sum(len(k) * n for k, n in numbers.items()) <= 2 * sum(len(k) * n for k, n in whole.items()) + 8


def test_page_structure_has_every_page(spark, pages):
    got = {r["doc_id"]: r["markdown"] for r in registry.queries()["page_structure"](spark, SF).collect()}
    assert set(got) == set(pages)
    assert statistics.mean(bool(m.strip()) for m in got.values()) > 0.9
