"""Fields that a page draws but does not have: underlines, boxes and squares, with the label beside them."""

from __future__ import annotations

import re

from . import edit, extract
from .cos import Document, PdfError
from .layout import Box, lines_of, spans_of

#: Words in a label that tell what its field is for.
SIGNATURE_WORDS = "sign|firma|rubrica|signature|witness"
KNOWN_WORDS = "date|fecha|dob|birth|dated|name|nombre|email|correo|phone|tel|cell|address|direccion|city|state|zip|postal|ssn|title|notes|comments"


def overlap(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def label_for(box: Box, square: bool, lines) -> str | None:
    """The nearest text to the left, above (half as far again) or, for squares, to the right; the first of equals."""
    best, text = None, None
    middle = (box[1] + box[3]) / 2
    for line in lines:
        b, t = line.box, line.text.strip()
        if not t:
            continue
        apart = abs((b[1] + b[3]) / 2 - middle)
        ways = []
        if -5 <= box[0] - b[2] <= 150 and (apart <= 14 or box[1] - 4 <= line.baseline <= box[3] + 4):
            ways.append(box[0] - b[2])
        if -4 <= b[1] - box[3] <= 28 and box[0] - 30 <= b[0] <= box[2]:
            ways.append((b[1] - box[3]) * 1.5)
        if square and -4 <= b[0] - box[2] <= 160 and apart <= 12:
            ways.append(b[0] - box[2])
        for d in ways:
            if best is None or d < best:
                best, text = d, t
    text = re.sub(r"[\s:_.;-]+$", "", text or "").strip()
    return text or None


def kind_of(box: Box, square: bool, label: str | None) -> tuple[str, float]:
    if square:
        return "checkbox", 0.9 if label else 0.8
    if label:
        low = label.lower()
        return ("signature", 0.92) if re.search(SIGNATURE_WORDS, low) else ("text", 0.88) if re.search(KNOWN_WORDS, low) else ("text", 0.8)
    return "text", 0.65 if box[3] - box[1] >= 12 and box[2] - box[0] >= 40 else 0.55


def candidates(doc: Document, index: int) -> list[dict]:
    """(field_type, suggested_name, label, rect, confidence), top to bottom; none where a field stands already."""
    pages = doc.pages()
    if not 0 <= index < len(pages):
        raise PdfError("INVALID_PAGE", f"there is no page {index}")
    page = extract.page_scan(doc, pages[index])
    lines = lines_of(spans_of(page.glyphs))
    found: list[tuple[Box, bool]] = []
    for r in page.rects:
        w, h = r[2] - r[0], r[3] - r[1]
        if 8 <= w <= 28 and 8 <= h <= 28 and abs(w - h) <= 3:
            found.append((r, True))
        elif w >= 30 and 10 <= h <= 120:
            found.append((r, False))
    edges = [r for r, _ in found]
    for axis, y, a, b in page.rules:
        on_edge = any(a >= r[0] - 2 and b <= r[2] + 2 and min(abs(y - r[1]), abs(y - r[3])) <= 2 for r in edges)
        if axis == "h" and b - a >= 40 and not on_edge:
            found.append(((a, y, b, y + 18), False))
    fields = [f["rect"] for f in extract.form_fields(doc) if f["page_number"] == index + 1]
    kept: list[tuple[Box, bool]] = []
    for box, square in sorted(found, key=lambda x: (-x[0][3], x[0][0])):
        near = any(overlap(box, k) > 0.55 or all(abs(p - q) <= 3 for p, q in zip(box, k)) for k, _ in kept)
        x, y = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
        taken = any(overlap(box, f) > 0.4 or f[0] <= x <= f[2] and f[1] <= y <= f[3] for f in fields)
        if not near and not taken:
            kept.append((box, square))
    out = []
    for i, (box, square) in enumerate(kept):
        label = label_for(box, square, lines)
        kind, sure = kind_of(box, square, label)
        words = re.findall(r"[^\W_]+", label or "")
        out.append({"page_number": index + 1, "candidate_id": i, "field_type": kind, "suggested_name": "".join(w[0].upper() + w[1:] for w in words) or f"Field_{index + 1}_{i + 1}", "label": label, "rect": box, "confidence": sure})
    return out


def apply(doc: Document, index: int, found: list[dict] | None = None) -> int:
    """Makes fields of candidates; names that are taken get a number."""
    names = {f["name"] for f in extract.form_fields(doc)}
    n = 0
    for c in candidates(doc, index) if found is None else found:
        name, k = c["suggested_name"], 2
        while name in names:
            name = f"{c['suggested_name']}_{k}"
            k += 1
        names.add(name)
        tall = c["field_type"] == "text" and c["rect"][3] - c["rect"][1] >= 45
        edit.create_field(doc, index, name, c["field_type"], c["rect"], flags=extract.MULTILINE if tall else 0, tooltip=c["label"])
        n += 1
    return n
