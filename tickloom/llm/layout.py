"""Reading order of scanned pages: columns, headings and adverts from line boxes.

A page's text is its lines in the order the scanner read them. `read_page` returns the blocks of
the page in the order a person reads them, each a list of pieces (first, last + 1) of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from statistics import median

#: Blanks that stand between two columns read as one line.
ACROSS = "   "
#: Share of a page's lines with such blanks that makes it a page read across.
ACROSS_SHARE = 0.3
# Lengths are multiples of the height of the page's own lines, so that they hold at any resolution.
#: A column begins this far or more right of the lines before it.
COLUMN_GAP = 6.8
#: Height of a heading, at least.
HEADING = 1.28
#: Distances by which adverts stand in from their column's edge.
INSET = (1.1, 4.5)
#: How far left of a column's edge its lines may begin.
RAGGED = 1.8

BODY, HEADING_BLOCK, ADVERT = 0, 1, 2

_PIECE = re.compile(r"\S(?:.*\S)?")


class Line:
    __slots__ = ("end", "height", "inset", "kind", "start", "width", "x", "y")

    def __init__(self, start, end, x, y, height, width):
        self.start, self.end, self.x, self.y, self.height, self.width = start, end, x, y, height, width
        self.kind = BODY
        #: Characters by which the line is shorter than its column at both sides together.
        self.inset = 0


def _columns(xs: list[int], gap: float) -> list[int]:
    """Left edges of the columns among the lines' left edges, from left to right."""
    found, group = [], []
    for x in sorted(xs):
        if group and x - group[-1] > gap:
            found.append(group)
            group = []
        group.append(x)
    found.append(group)
    return [min(g) if len(g) < 5 else sorted(g)[len(g) // 10] for g in found]


def _pitch(ys: list[int], usual: float) -> float:
    """The usual distance between lines that follow each other."""
    steps = [b - a for a, b in zip(ys, ys[1:], strict=False) if usual <= b - a <= 3 * usual]
    return median(steps) if steps else 1.5 * usual


def _fill(lines: list[Line], columns: list[int], of: list[int | None], usual: float) -> None:
    """Give lines without a box the place that the lines around them leave."""
    pitch = _pitch([ln.y for ln, c in zip(lines, of, strict=True) if c is not None], usual)
    known = [(ln.y, c) for ln, c in zip(lines, of, strict=True) if c is not None]
    switches = sum(a[1] != b[1] for a, b in zip(known, known[1:], strict=False))
    across = len(columns) > 1 and switches > 2 * len(columns)
    lowest = [0] * len(columns)
    before = None
    for i, c in enumerate(of):
        if c is None:
            if before is None:
                after = next((j for j in range(i, len(of)) if of[j] is not None), None)
                c, y = (of[after], lines[after].y - pitch * (after - i)) if after is not None else (0, pitch * i)
            elif across:
                c = (before + 1) % len(columns)
                y = lowest[c] + pitch
            else:
                c, y = before, lowest[before] + pitch
            of[i] = c
            lines[i].x, lines[i].y = columns[c], y
        lowest[c] = lines[i].y
        before = c


def _is_upper(s: str) -> bool:
    return s.isupper() and sum(ch.isalpha() for ch in s) > 3


def _is_title(s: str) -> bool:
    words = s.split()
    return len(words) > 1 and s[-1] not in ".!?,;" and all(w[0].isupper() for w in words)


def _letter(boxes: list, rows: list[str]) -> float:
    """The usual width of a character."""
    wide = [(b[2] - b[0]) / len(s.strip()) for b, s in zip(boxes, rows, strict=True) if b is not None and len(s.strip()) > 4 and b[2] > b[0]]
    return median(wide) if wide else 1.0


def read_page(text: str, boxes: list | None) -> list[tuple[int, list[Line]]]:
    """Blocks (kind, lines) in reading order. `boxes` holds (x0, y0, x1, y1) or None per line;
    without as many boxes as lines the text's own order stands and headings are the lines in
    capitals that stand alone."""
    rows = text.split("\n")
    if boxes is not None and len(boxes) != len(rows):
        boxes = None
    if ACROSS in text and sum(ACROSS in s.strip() for s in rows) > ACROSS_SHARE * len(rows):
        spans, at = [], 0
        for s in rows:
            spans.append((at, s))
            at += len(s) + 1
        return _read_across(spans, boxes)
    lines, placed, after = [], [], 0
    for k, s in enumerate(rows):
        start = after
        after += len(s) + 1
        t = s.strip()
        if not t:
            continue
        if t is not s and s[0].isspace():
            start += len(s) - len(s.lstrip())
        n = len(t)
        b = boxes[k] if boxes is not None else None
        if b is None:
            lines.append(Line(start, start + n, 0, k, 0, n))
            placed.append(False)
        else:
            lines.append(Line(start, start + n, b[0], b[1], b[3] - b[1], n))
            placed.append(True)
    if not lines:
        return []
    if not any(placed):
        for ln in lines:
            if _is_upper(text[ln.start : ln.end]):
                ln.kind = HEADING_BLOCK
        return _blocks([lines])
    usual = median([ln.height for ln in lines if ln.height > 0] or [1])
    columns = _columns([ln.x for ln, p in zip(lines, placed, strict=True) if p], COLUMN_GAP * usual)
    of: list[int | None] = [max(0, bisect_right(columns, ln.x + RAGGED * usual) - 1) if p else None for ln, p in zip(lines, placed, strict=True)]
    letter = _letter(boxes, rows)
    for ln, c, p in zip(lines, of, placed, strict=True):
        if p:
            aside = ln.x - columns[c]
            if ln.height >= HEADING * usual and aside < 2 * INSET[0] * usual:
                ln.kind = HEADING_BLOCK
            elif INSET[0] * usual < aside < INSET[1] * usual:
                ln.kind, ln.inset = ADVERT, round(2 * aside / letter)
    if not all(placed):
        _fill(lines, columns, of, usual)
        for ln, p in zip(lines, placed, strict=True):
            if not p and _is_upper(text[ln.start : ln.end]):
                ln.kind = ADVERT
    flows: list[list[Line]] = [[] for _ in columns]
    for ln, c in zip(lines, of, strict=True):
        flows[c].append(ln)
    for flow in flows:
        flow.sort(key=lambda ln: ln.y)
        if all(placed):
            continue
        for a, b, c in zip(flow, flow[1:], flow[2:], strict=False):
            if b.height == 0 and a.kind == c.kind and b.kind != a.kind == ADVERT:
                b.kind = a.kind
    return _blocks(flows)


def _read_across(spans: list[tuple[int, str]], boxes: list | None) -> list[tuple[int, list[Line]]]:
    """A page whose lines each hold one line of every column, side by side."""
    flows: list[list[Line]] = []
    known = [b for b in boxes if b is not None] if boxes is not None else []
    edge = sorted(b[0] for b in known)[len(known) // 10] if known else 0
    usual = median([b[3] - b[1] for b in known if b[3] > b[1]] or [1])
    letter = _letter(boxes, [s for _, s in spans]) if known else 1.0
    for k, (start, s) in enumerate(spans):
        at = 0
        for c, part in enumerate(s.split(ACROSS)):
            m = _PIECE.search(part)
            if m:
                while len(flows) <= c:
                    flows.append([])
                ln = Line(start + at + m.start(), start + at + m.end(), 0, k, 0, m.end() - m.start())
                aside = boxes[k][0] - edge if c == 0 and boxes is not None and boxes[k] is not None else 0
                inset = INSET[0] * usual < aside < INSET[1] * usual
                ln.inset = round(2 * aside / letter) if inset else 0
                ln.kind = ADVERT if inset else HEADING_BLOCK if _is_upper(part) or _is_title(part) else BODY
                flows[c].append(ln)
            at += len(part) + len(ACROSS)
    for flow in flows:
        _adverts_within(flow, spans)
    return _blocks(flows)


def _adverts_within(flow: list[Line], spans: list[tuple[int, str]]) -> None:
    """Capitals amid a sentence are an advert rather than a heading, and so are up to two lines
    between such lines."""
    def text(ln):
        start, row = spans[ln.y]
        return row[ln.start - start : ln.end - start]

    before = None
    marked = []
    for i, ln in enumerate(flow):
        if ln.kind == HEADING_BLOCK and before is not None and text(before)[-1] not in ".!?…\"'”»“«)" and _is_upper(text(ln)):
            ln.kind = ADVERT
        if ln.kind == ADVERT:
            marked.append(i)
        elif ln.kind == BODY:
            before = ln
        else:
            before = None
    for a, b in zip(marked, marked[1:], strict=False):
        if 1 < b - a <= 3 and all(flow[j].kind != HEADING_BLOCK for j in range(a + 1, b)):
            for j in range(a + 1, b):
                flow[j].kind = ADVERT


def _blocks(flows: list[list[Line]]) -> list[tuple[int, list[Line]]]:
    """Body lines between two headings are one block, through columns and past adverts."""
    blocks: list[tuple[int, list[Line]]] = []
    body: list[Line] = []
    group: list[Line] = []

    def close():
        nonlocal group
        if group:
            blocks.append((group[0].kind, group))
            group = []

    for flow in flows:
        for ln in flow:
            if group and ln.kind != group[0].kind:
                close()
            if ln.kind == BODY:
                body.append(ln)
            else:
                if ln.kind == HEADING_BLOCK and not group and body:
                    blocks.append((BODY, body))
                    body = []
                group.append(ln)
        # an advert may go on at the top of the next column, a heading doesn't
        if group and group[0].kind == HEADING_BLOCK:
            close()
    close()
    if body:
        blocks.append((BODY, body))
    return blocks
