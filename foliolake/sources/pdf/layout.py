"""Content streams to glyphs, spans, lines and paragraphs, and to ruled lines and placed images."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from .cos import Lexer, Name, Op, PdfError
from .fonts import Font

Box = tuple[float, float, float, float]
Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: Matrix, n: Matrix) -> Matrix:
    """The matrix that applies ``m`` first."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def around(boxes) -> Box:
    boxes = list(boxes)
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def touch(a: Box, b: Box) -> bool:
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def operations(content: bytes) -> list[tuple[str, list]]:
    """(operator, operands) in order; raises where the content makes no sense."""
    lex, held, out = Lexer(content, content=True), [], []
    while True:
        try:
            x = lex.object()
        except EOFError:
            return out
        if isinstance(x, Op):
            out.append((str(x), held))
            held = []
        else:
            held.append(x)


@dataclass
class Glyph:
    code: int
    text: str
    x: float
    y: float
    advance: float
    font: str
    size: float
    rendered: float
    op: int
    block: int

    @property
    def box(self) -> Box:
        h = max(self.rendered, self.size)
        return min(self.x, self.x + self.advance), self.y - 0.2 * h, max(self.x, self.x + self.advance), self.y + 0.8 * h


@dataclass
class State:
    ctm: Matrix = UNIT
    font: str = ""
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    rise: float = 0.0
    fill: tuple = (0.0, 0.0, 0.0)


@dataclass
class Scan:
    glyphs: list[Glyph] = field(default_factory=list)
    rules: list[tuple[str, float, float, float]] = field(default_factory=list)  # axis, place, low, high
    rects: list[Box] = field(default_factory=list)
    draws: list[tuple[str, Matrix]] = field(default_factory=list)
    shows_text: bool = False


#: Fixed value: vectors that a page's tables are sought in.
VECTORS = 8192


def numbers(args: list, n: int) -> list[float] | None:
    own = args[-n:] if n else []
    return [float(x) for x in own] if len(own) == n and all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in own) else None


def scan(ops: list[tuple[str, list]], fonts: dict[str, Font] | None = None, hidden: set[str] = frozenset()) -> Scan:
    """One pass over a page's operations. Text in hidden layers moves on but leaves no glyphs."""
    fonts, out = fonts or {}, Scan()
    s, stack = State(), []
    tm = tlm = UNIT
    marks: list[bool] = []
    at = start = None
    block = 0

    def show(raw: bytes, k: int):
        nonlocal tm
        f = fonts.get(s.font)
        two = f is not None and f.composite
        out.shows_text = True
        for i in range(0, len(raw), 2 if two else 1):
            code = (raw[i] << 8) | (raw[i + 1] if i + 1 < len(raw) else 0) if two else raw[i]
            w = f.width(code) if f else 500.0
            step = (w / 1000 * s.size + s.char + (s.word if code == 32 else 0.0)) * s.scale / 100
            c = s.ctm
            if not any(marks):
                x, y = apply(c, *apply(tm, 0, s.rise))
                trm = times((s.size * s.scale / 100, 0, 0, s.size, 0, s.rise), times(tm, c))
                out.glyphs.append(Glyph(code, f.text(code) if f else chr(code), x, y, step * (tm[0] * c[0] + tm[1] * c[2]), s.font, s.size, math.hypot(trm[2], trm[3]), k, block))
            tm = times((1, 0, 0, 1, step, 0), tm)

    def budget(n: int):
        if len(out.rules) + len(out.rects) + n > VECTORS:
            raise PdfError("SECURITY_LIMIT", f"more than {VECTORS} vectors on a page")

    def line(p, q):
        dx, dy = abs(p[0] - q[0]), abs(p[1] - q[1])
        if dy <= 1.5 and dx >= 6:
            budget(1)
            out.rules.append(("h", (p[1] + q[1]) / 2, min(p[0], q[0]), max(p[0], q[0])))
        elif dx <= 1.5 and dy >= 6:
            budget(1)
            out.rules.append(("v", (p[0] + q[0]) / 2, min(p[1], q[1]), max(p[1], q[1])))

    for k, (op, a) in enumerate(ops):
        if op == "q":
            stack.append(State(**vars(s)))
        elif op == "Q":
            if stack:
                s = stack.pop()
        elif op == "cm":
            if n := numbers(a, 6):
                s.ctm = times(tuple(n), s.ctm)
        elif op == "BT":
            tm = tlm = UNIT
            block += 1
        elif op == "Tf":
            if len(a) >= 2 and isinstance(a[-2], str) and (n := numbers(a, 1)):
                s.font, s.size = str(a[-2]), n[0]
        elif op in ("Tc", "Tw", "Tz", "TL", "Ts"):
            if n := numbers(a, 1):
                setattr(s, {"Tc": "char", "Tw": "word", "Tz": "scale", "TL": "leading", "Ts": "rise"}[op], n[0])
        elif op in ("Td", "TD"):
            if n := numbers(a, 2):
                if op == "TD":
                    s.leading = -n[1]
                tm = tlm = times((1, 0, 0, 1, n[0], n[1]), tlm)
        elif op == "Tm":
            if n := numbers(a, 6):
                tm = tlm = tuple(n)
        elif op == "T*":
            tm = tlm = times((1, 0, 0, 1, 0, -s.leading), tlm)
        elif op == "Tj":
            if a and isinstance(a[-1], bytes):
                show(a[-1], k)
        elif op == "TJ":
            for x in a[-1] if a and isinstance(a[-1], list) else ():
                if isinstance(x, bytes):
                    show(x, k)
                elif isinstance(x, (int, float)):
                    tm = times((1, 0, 0, 1, -x / 1000 * s.size * s.scale / 100, 0), tm)
        elif op in ("'", '"'):
            if op == '"' and len(a) >= 3 and (n := numbers(a[:2], 2)):
                s.word, s.char = n
            tm = tlm = times((1, 0, 0, 1, 0, -s.leading), tlm)
            if a and isinstance(a[-1], bytes):
                show(a[-1], k)
        elif op in ("BDC", "BMC"):
            marks.append(op == "BDC" and len(a) >= 2 and a[0] == "OC" and isinstance(a[1], Name) and str(a[1]) in hidden)
        elif op == "EMC":
            if marks:
                marks.pop()
        elif op == "m":
            if n := numbers(a, 2):
                at = start = apply(s.ctm, *n)
        elif op == "l":
            if n := numbers(a, 2):
                p = apply(s.ctm, *n)
                if at:
                    line(at, p)
                at = p
        elif op in ("h", "s", "b", "B"):
            if at and start and (abs(at[0] - start[0]) > 0.1 or abs(at[1] - start[1]) > 0.1):
                line(at, start)
            at = start
        elif op == "re":
            if n := numbers(a, 4):
                x, y, w, h = n
                corners = [apply(s.ctm, *p) for p in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
                x0, y0, x1, y1 = min(p[0] for p in corners), min(p[1] for p in corners), max(p[0] for p in corners), max(p[1] for p in corners)
                if x1 - x0 >= 6 and y1 - y0 <= 3:
                    budget(1)
                    out.rules.append(("h", (y0 + y1) / 2, x0, x1))
                elif y1 - y0 >= 6 and x1 - x0 <= 3:
                    budget(1)
                    out.rules.append(("v", (x0 + x1) / 2, y0, y1))
                elif x1 - x0 >= 8 and y1 - y0 >= 6:
                    budget(5)
                    out.rules += [("h", y0, x0, x1), ("h", y1, x0, x1), ("v", x0, y0, y1), ("v", x1, y0, y1)]
                    out.rects.append((x0, y0, x1, y1))
        elif op == "Do":
            if a and isinstance(a[-1], str):
                out.draws.append((str(a[-1]), s.ctm))
    return out


@dataclass
class Span:
    glyphs: list[Glyph]

    def __post_init__(self):
        g = self.glyphs[0]
        self.text = "".join(x.text for x in self.glyphs)
        self.box = around(x.box for x in self.glyphs)
        self.font, self.size, self.rendered, self.baseline = g.font, g.size, g.rendered, g.y
        self.visual = max(g.rendered, g.size)


@dataclass
class Line:
    spans: list[Span]

    def __post_init__(self):
        self.spans.sort(key=lambda s: s.box[0])
        self.baseline = self.spans[0].baseline
        self.box = around(s.box for s in self.spans)
        text = ""
        for i, s in enumerate(self.spans):
            if i and s.box[0] - self.spans[i - 1].box[2] > 0.25 * s.visual and not text.endswith(" ") and not s.text.startswith(" "):
                text += " "
            text += s.text
        self.text = text


@dataclass
class Paragraph:
    lines: list[Line]

    def __post_init__(self):
        self.text = "\n".join(x.text for x in self.lines)
        self.box = around(x.box for x in self.lines)
        gaps = [a.baseline - b.baseline for a, b in zip(self.lines, self.lines[1:])]
        self.leading = sum(gaps) / len(gaps) if gaps else 1.2 * (self.lines[0].box[3] - self.lines[0].box[1])
        first = self.lines[0].spans[0]
        self.font, self.rendered = first.font, first.rendered
        self.alignment = alignment([x.box for x in self.lines])


def alignment(boxes: list[Box]) -> str:
    """Edges within three points of the first line's; the last line of three or more doesn't count."""
    if len(boxes) < 2:
        return "left"
    own = boxes[1:-1] if len(boxes) > 2 else boxes[1:]
    even = lambda f: all(abs(f(b) - f(boxes[0])) <= 3 for b in own)
    left, right, centre = even(lambda b: b[0]), even(lambda b: b[2]), even(lambda b: (b[0] + b[2]) / 2)
    return "justified" if left and right else "left" if left else "center" if centre else "right" if right else "left"


def spans_of(glyphs: list[Glyph]) -> list[Span]:
    runs: list[list[Glyph]] = []
    for g in glyphs:
        p = runs[-1][-1] if runs else None
        if p and abs(p.y - g.y) < 1 and p.font == g.font and abs(p.size - g.size) < 0.5 and p.block == g.block and g.x - (p.x + p.advance) < 2.5 * max(p.rendered, p.size):
            runs[-1].append(g)
        else:
            runs.append([g])
    return [Span(r) for r in runs]


def lines_of(spans: list[Span]) -> list[Line]:
    """Top to bottom; a span joins while it is near the baseline of its line's first."""
    groups: list[list[Span]] = []
    for s in sorted(spans, key=lambda s: (-s.baseline, s.box[0])):
        if groups and abs(s.baseline - groups[-1][0].baseline) <= 0.2 * groups[-1][0].visual:
            groups[-1].append(s)
        else:
            groups.append([s])
    return [Line(g) for g in groups]


def paragraphs_of(lines: list[Line]) -> list[Paragraph]:
    groups: list[list[Line]] = []
    for x in lines:
        p = groups[-1][-1] if groups else None
        if p:
            tall = max(p.box[3] - p.box[1], x.box[3] - x.box[1])
            a, b = p.spans[0], x.spans[0]
            face = a.font == b.font and abs(a.rendered - b.rendered) < 0.5
            meets = x.box[0] <= p.box[2] and x.box[2] >= p.box[0]
            if 0 < p.baseline - x.baseline <= 2.2 * tall and face and (meets or len(groups[-1]) < 2):
                groups[-1].append(x)
                continue
        groups.append([x])
    return [Paragraph(g) for g in groups]


def paragraphs(glyphs: list[Glyph]) -> list[Paragraph]:
    return paragraphs_of(lines_of(spans_of(glyphs)))


# --- tables ----------------------------------------------------------------------------------------------------------------

#: Ruled lines on an axis, grid places, cells.
RULES, GRID, CELLS = 192, 8192, 1024


@dataclass
class Table:
    box: Box
    rows: int
    cols: int
    cells: list[tuple[int, int, Box, str]]  # row, column, box, text

    def matrix(self) -> list[list[str]]:
        out = [[""] * self.cols for _ in range(self.rows)]
        for r, c, _, t in self.cells:
            out[r][c] = t
        return out


def levels(values: list[float], tolerance: float) -> list[float]:
    """Means of runs of sorted values that stay within the tolerance of the mean so far."""
    out: list[list[float]] = []
    for v in values:
        if out and abs(v - sum(out[-1]) / len(out[-1])) <= tolerance:
            out[-1].append(v)
        else:
            out.append([v])
    return [sum(g) / len(g) for g in out]


def joined(rules: list[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """Collinear pieces made one: 1.5 apart at most, with gaps of 3 at most."""
    out: list[tuple[float, float, float]] = []
    for place, low, high in sorted(rules):
        if out and abs(place - out[-1][0]) <= 1.5 and low <= out[-1][2] + 3:
            p, a, b = out[-1]
            out[-1] = ((p + place) / 2, min(a, low), max(b, high))
        else:
            out.append((place, low, high))
    return out


def _text_in(box: Box, spans: list[Span]) -> str:
    found = []
    for s in spans:
        b = s.box
        x, y = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
        inside = box[0] - 0.5 <= x <= box[2] + 0.5 and box[1] - 0.5 <= y <= box[3] + 0.5
        w, h = min(b[2], box[2]) - max(b[0], box[0]), min(b[3], box[3]) - max(b[1], box[1])
        size = (b[2] - b[0]) * (b[3] - b[1])
        if inside or (w > 0 and h > 0 and size > 0 and w * h >= 0.5 * size):
            found.append(s)
    found.sort(key=lambda s: (-s.box[3], s.box[0]))
    return " ".join(t for t in (s.text.strip() for s in found) if t)


def tables(page: Scan) -> list[Table]:
    """Ruled tables; without any, one table of aligned text."""
    paras = paragraphs(page.glyphs)
    spans = [s for p in paras for x in p.lines for s in x.spans]
    return ruled(page, spans) or aligned([x for p in paras for x in p.lines], spans)


def ruled(page: Scan, spans: list[Span]) -> list[Table]:
    h, v = (joined([(p, a, b) for axis, p, a, b in page.rules if axis == k]) for k in "hv")
    if max(len(h), len(v)) > RULES:
        raise PdfError("SECURITY_LIMIT", f"more than {RULES} rules on an axis")
    cells: list[Box] = []
    ys, xs = levels(sorted((p for p, *_ in h), reverse=True), 2.5), levels(sorted(p for p, *_ in v), 2.5)
    if len(ys) > 1 and len(xs) > 1:
        if len(ys) * len(xs) > GRID:
            raise PdfError("SECURITY_LIMIT", "the grid is too large")
        for top, low in zip(ys, ys[1:]):
            for left, right in zip(xs, xs[1:]):
                if top - low < 5 or right - left < 8:
                    continue
                across = lambda y: any(abs(p - y) <= 2.5 and a <= left + 3 and b >= right - 3 for p, a, b in h)  # noqa: E731, B023
                down = lambda x: any(abs(p - x) <= 2.5 and a <= low + 3 and b >= top - 3 for p, a, b in v)  # noqa: E731, B023
                if across(top) + across(low) + down(left) + down(right) >= 3:
                    cells.append((left, low, right, top))
    if len(cells) + len(page.rects) > CELLS:
        raise PdfError("SECURITY_LIMIT", f"more than {CELLS} cells")
    for r in page.rects:
        if r[2] - r[0] >= 15 and r[3] - r[1] >= 10 and not any(all(abs(a - b) <= 2 for a, b in zip(r, c)) for c in cells):
            cells.append(r)
    out = []
    for group in _neighbours(cells):
        if len(group) < 2:
            continue
        rows, cols = levels(sorted((c[3] for c in group), reverse=True), 4), levels(sorted(c[0] for c in group), 4)
        near = lambda places, x: next((i for i, p in enumerate(places) if abs(x - p) <= 4), 0)
        own = [(near(rows, c[3]), near(cols, c[0]), c, _text_in(c, spans)) for c in sorted(group, key=lambda c: (-c[3], c[0]))]
        if any(t for *_, t in own) or len(rows) * len(cols) >= 4:
            out.append(Table(around(group), len(rows), len(cols), own))
    return out


def _neighbours(cells: list[Box]) -> list[list[Box]]:
    left, out = list(range(len(cells))), []
    while left:
        todo, group = [left.pop(0)], []
        while todo:
            c = cells[todo.pop()]
            group.append(c)
            for j in list(left):
                o = cells[j]
                x, y = c[0] < o[2] + 3 and c[2] > o[0] - 3, c[1] < o[3] + 3 and c[3] > o[1] - 3
                if (x and (abs(c[1] - o[3]) <= 5 or abs(o[1] - c[3]) <= 5)) or (y and (abs(c[0] - o[2]) <= 5 or abs(o[0] - c[2]) <= 5)):
                    left.remove(j)
                    todo.append(j)
        out.append(group)
    return out


def aligned(lines: list[Line], spans: list[Span]) -> list[Table]:
    if len(lines) < 3:
        return []
    own = sorted((x for x in lines if len(x.spans) > 1 or len([t for t in x.text.split("   ") if t.strip()]) > 1), key=lambda x: -x.baseline)
    if len(own) < 2:
        return []
    cols = levels(sorted(s.box[0] for x in own if len(x.spans) > 1 for s in x.spans), 10)
    if len(cols) < 2:
        return []
    box = around(x.box for x in own)
    edges = [*cols, box[2] + 5]
    cells = []
    for r, x in enumerate(own):
        for c in range(len(cols)):
            b = (edges[c], x.box[1], edges[c + 1], x.box[3])
            cells.append((r, c, b, _text_in(b, spans)))
    return [Table(box, len(own), len(cols), cells)]
