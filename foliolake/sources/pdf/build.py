"""Small documents for tests, examples and writers."""

from __future__ import annotations

from .cos import Document, Name, Ref, Stream, compressed

HELVETICA = {Name("Type"): Name("Font"), Name("Subtype"): Name("Type1"), Name("BaseFont"): Name("Helvetica")}


def add_page(doc: Document, content: bytes, size: tuple[float, float] = (612, 792), resources: dict | None = None, flate: bool = False, at: int | None = None, extra: dict | None = None) -> Ref:
    pages = doc.catalog["Pages"]
    stream = compressed(content) if flate else Stream({}, content)
    font = doc.add(dict(HELVETICA))
    page = doc.add({
        Name("Type"): Name("Page"), Name("Parent"): pages, Name("MediaBox"): [0, 0, *size], Name("Contents"): doc.add(stream),
        Name("Resources"): {Name("Font"): {Name("F1"): font}} | (resources or {}), **(extra or {}),
    })
    kids = doc.dict_of(pages)["Kids"]
    kids.insert(len(kids) if at is None else at, page)
    doc.dict_of(pages)[Name("Count")] = len(kids)
    return page


def text_line(x: float, y: float, text: str, size: float = 12, font: str = "F1") -> bytes:
    raw = text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return b"BT /%s %g Tf 1 0 0 1 %g %g Tm (%s) Tj ET\n" % (font.encode(), size, x, y, raw)


def simple(pages: list[list[tuple[float, float, str, float]]], flate: bool = True, info: dict | None = None, rules: list[bytes] | None = None) -> bytes:
    """A document of text lines (x, y, text, size) by page."""
    doc = Document.empty()
    for i, lines in enumerate(pages):
        add_page(doc, b"".join(text_line(x, y, t, s) for x, y, t, s in lines) + (rules[i] if rules else b""), flate=flate)
    if info:
        doc.trailer["Info"] = doc.add({Name(k): v.encode() for k, v in info.items()})
    return doc.save()
