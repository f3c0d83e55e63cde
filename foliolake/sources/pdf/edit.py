"""Changes to a loaded document, in place. Page indices count from 0."""

from __future__ import annotations

import hashlib
import re

from . import extract
from .build import HELVETICA
from .cos import Document, Name, PdfError, Ref, Stream, compressed, decoded, text_bytes, text_of, written
from .layout import Box, Paragraph, apply, operations, paragraphs, touch

#: The label on redactions, padding around hits, shortest needle, names of page-number positions, limits of texts.
LABEL, PADDING, NEEDLE = "[REDACTADO]", 1.5, 4
POSITIONS = ("top_left", "top_center", "top_right", "bottom_left", "bottom_center", "bottom_right")
REPLACEMENT_LIMIT, PARAGRAPH_LIMIT, BOX_TEXT_LIMIT, COORDINATE, BOX_LIMIT = 4000, 16_000, 4000, 20_000, 14_400
STAMPS = {"approved": "APPROVED", "confidential": "CONFIDENTIAL", "draft": "DRAFT", "final": "FINAL", "reviewed": "REVIEWED", "void": "VOID"}
MARKUP = {"Highlight": (1.0, 1.0, 0.0), "Underline": (0.0, 0.6, 0.0), "StrikeOut": (1.0, 0.0, 0.0)}
ACTIVE_KEYS = ("OpenAction", "AA", "JavaScript", "JS", "Launch", "XFA")
ACTIVE_ACTIONS = ("JavaScript", "Launch", "ImportData", "SubmitForm", "GoToR", "GoToE", "Movie", "Sound", "Rendition", "RichMediaExecute")


def _page(doc: Document, i: int) -> Ref:
    pages = doc.pages()
    if not 0 <= i < len(pages):
        raise PdfError("INVALID_PAGE", f"there is no page {i}")
    return pages[i]


def own_resources(doc: Document, page: Ref) -> dict:
    """The page's resources as its own dictionary."""
    d = doc.dict_of(page)
    d[Name("Resources")] = dict(doc.dict_of(doc.inherited(page, "Resources")))
    return d["Resources"]


def resource(doc: Document, page: Ref, kind: str, name: str, value) -> str:
    res = own_resources(doc, page)
    held = dict(doc.dict_of(res.get(kind)))
    held[Name(name)] = value
    res[Name(kind)] = held
    return name


def set_content(doc: Document, page: Ref, content: bytes) -> None:
    doc.dict_of(page)[Name("Contents")] = doc.add(compressed(content))


def append(doc: Document, page: Ref, content: bytes, behind: bool = False) -> None:
    old = doc.content(page)
    set_content(doc, page, content + b"\n" + old if behind else b"q\n" + old + b"\nQ\n" + content)


def literal(text: str) -> bytes:
    return written(text.encode("cp1252", "replace"))


def helvetica(doc: Document, page: Ref, base: str = "Helvetica", alias: str = "FxH") -> str:
    return resource(doc, page, "Font", alias + base.replace("-", ""), doc.add(dict(HELVETICA) | {Name("BaseFont"): Name(base), Name("Encoding"): Name("WinAnsiEncoding")}))


def width_of(text: str, size: float) -> float:
    """Estimated, at a little over half the size a character."""
    return 0.52 * size * len(text)


# --- pages -----------------------------------------------------------------------------------------------------------------


def _set_pages(doc: Document, refs: list[Ref]) -> None:
    """A flat page tree; what pages inherited becomes their own."""
    root = doc.catalog["Pages"]
    for r in refs:
        d = doc.dict_of(r)
        for k in ("Resources", "MediaBox", "CropBox", "Rotate"):
            v = doc.inherited(r, k)
            if v is not None and k not in d:
                d[Name(k)] = v
        d[Name("Parent")] = root
    top = doc.dict_of(root)
    top[Name("Kids")], top[Name("Count")] = list(refs), len(refs)
    top.pop("Parent", None)


def delete_pages(doc: Document, indices) -> None:
    pages, gone = doc.pages(), set(indices)
    if any(not 0 <= i < len(pages) for i in gone):
        raise PdfError("INVALID_PAGE", "a page to delete does not exist")
    if len(gone) >= len(pages):
        raise PdfError("INVALID_OPERATION", "a document keeps a page at least")
    _set_pages(doc, [p for i, p in enumerate(pages) if i not in gone])


def reorder_pages(doc: Document, order: list[int]) -> None:
    pages = doc.pages()
    if sorted(order) != list(range(len(pages))):
        raise PdfError("INVALID_OPERATION", "the new order is no permutation")
    _set_pages(doc, [pages[i] for i in order])


#: Kinds of objects that may hold others.
_HOLDS = (Ref, list, dict, Stream)


def copied(source: Document, x, dest: Document, done: dict[int, Ref]):
    """An object of one document for another, with all it refers to but its parents."""
    if isinstance(x, Ref):
        if x.num not in done:
            done[x.num] = dest.add(None)
            dest.objects[done[x.num].num] = copied(source, source.get(x.num), dest, done)
        return done[x.num]
    if isinstance(x, list):
        return [copied(source, v, dest, done) if isinstance(v, _HOLDS) else v for v in x]
    if isinstance(x, dict):
        return {k: copied(source, v, dest, done) if isinstance(v, _HOLDS) else v for k, v in x.items() if k != "Parent"}
    if isinstance(x, Stream):
        return Stream(copied(source, x.dict, dest, done), x.raw)
    return x


def insert_pages(dest: Document, source: Document, indices: list[int], at: int) -> int:
    if len(indices) > 200 or len(set(indices)) != len(indices):
        raise PdfError("INVALID_OPERATION", "one insertion copies up to 200 different pages")
    pages, own = source.pages(), dest.pages()
    if not 0 <= at <= len(own) or any(not 0 <= i < len(pages) for i in indices):
        raise PdfError("INVALID_PAGE", "a page or place does not exist")
    new = _copied_pages(dest, source, [pages[i] for i in indices], {})
    _set_pages(dest, [*own[:at], *new, *own[at:]])
    return len(new)


def _copied_pages(dest: Document, source: Document, pages: list[Ref], done: dict[int, Ref]) -> list[Ref]:
    """Pages of one document as objects of another, with what they inherit."""
    new = []
    for p in pages:
        d = dict(source.dict_of(p))
        for k in ("Resources", "MediaBox", "CropBox", "Rotate"):
            v = source.inherited(p, k)
            if v is not None:
                d.setdefault(Name(k), v)
        new.append(dest.add(copied(source, d, dest, done)))
    return new


def merge(docs) -> Document:
    """The page tree is written once, so the time is in proportion to the pages."""
    out, new = Document.empty(), []
    for d in docs:
        pages = d.pages()
        for a in range(0, len(pages), 200):
            new += _copied_pages(out, d, pages[a : a + 200], {})
    _set_pages(out, new)
    return out


def _extracted(doc: Document, pages: list[Ref]) -> Document:
    out = Document.empty()
    _set_pages(out, [r for p in pages for r in _copied_pages(out, doc, [p], {})])
    return out


def extract_pages(doc: Document, indices: list[int]) -> Document:
    pages = doc.pages()
    if any(not 0 <= i < len(pages) for i in indices):
        raise PdfError("INVALID_PAGE", "a page or place does not exist")
    return _extracted(doc, [pages[i] for i in indices])


def split(doc: Document, size: int) -> list[Document]:
    if size < 1:
        raise PdfError("INVALID_OPERATION", "a part has a page at least")
    pages = doc.pages()
    return [_extracted(doc, pages[a : a + size]) for a in range(0, len(pages), size)]


def insert_blank(doc: Document, at: int, width: float = 612, height: float = 792) -> None:
    pages = doc.pages()
    new = doc.add({Name("Type"): Name("Page"), Name("MediaBox"): [0, 0, width, height], Name("Resources"): {}})
    _set_pages(doc, [*pages[:at], new, *pages[at:]])


def duplicate_page(doc: Document, index: int, at: int) -> None:
    pages = doc.pages()
    new = doc.add(dict(doc.dict_of(_page(doc, index))))
    _set_pages(doc, [*pages[:at], new, *pages[at:]])


def set_rotation(doc: Document, i: int, degrees: int) -> int:
    r = extract.normal_rotation(degrees)
    doc.dict_of(_page(doc, i))[Name("Rotate")] = r
    return r


def rotate(doc: Document, delta: int, index: int | None = None) -> None:
    for i in range(len(doc.pages())) if index is None else [index]:
        set_rotation(doc, i, extract.rotation(doc, _page(doc, i)) + delta)


def set_box(doc: Document, i: int, kind: str, corners: list[float] | None) -> None:
    page = _page(doc, i)
    d, key = doc.dict_of(page), Name(extract.BOXES[kind])
    if corners is None:
        if kind == "media":
            raise PdfError("INVALID_OPERATION", "the media box can't be cleared")
        d.pop(key, None)
        return
    if len(corners) != 4 or any(abs(c) > BOX_LIMIT for c in corners):
        raise PdfError("INVALID_OPERATION", "the corners make no sense")
    box = (min(corners[0], corners[2]), min(corners[1], corners[3]), max(corners[0], corners[2]), max(corners[1], corners[3]))
    if box[0] == box[2] or box[1] == box[3] or kind != "media" and not touch(box, extract.page_boxes(doc, page)["media"]):
        raise PdfError("INVALID_OPERATION", "the box is empty or off the page")
    d[key] = [float(c) for c in box]


# --- redaction -------------------------------------------------------------------------------------------------------------


def hits(doc: Document, page: Ref, pattern: re.Pattern) -> list[tuple[Box, str]]:
    """Boxes of matches within lines, padded, and what they hold."""
    out = []
    for p in paragraphs(extract.page_scan(doc, page).glyphs):
        for line in p.lines:
            glyphs, text = [], ""
            for s in line.spans:
                if text and not text.endswith(" ") and line.text[len(text) : len(text) + 1] == " " and not s.text.startswith(" "):
                    text += " "
                    glyphs.append(None)
                for g in s.glyphs:
                    text += g.text
                    glyphs += [g] * len(g.text)
            for m in pattern.finditer(text):
                g = m[1] if pattern.groups and m[1] is not None else m[0]
                a = m.start(1) if pattern.groups and m[1] is not None else m.start()
                own = [x.box for x in glyphs[a : a + len(g)] if x]
                if own:
                    out.append(((min(b[0] for b in own) - PADDING, min(b[1] for b in own) - PADDING, max(b[2] for b in own) + PADDING, max(b[3] for b in own) + PADDING), g))
    return out


def redact(doc: Document, index: int, rects: list[Box], label: str = LABEL) -> dict:
    """Takes out glyphs that touch a rectangle, keeps the rest where it stood, and draws a patch over each."""
    page = _page(doc, index)
    fonts = extract.fonts_.page_fonts(doc, page)
    content = doc.content(page)
    ops = operations(content)
    found = extract.scan(ops, fonts)
    hit = [g for g in found.glyphs if any(touch(g.box, r) for r in rects)]
    by_op: dict[int, list] = {}
    for g in found.glyphs:
        by_op.setdefault(g.op, []).append(g)
    bad = {g.op for g in hit}
    gone = {id(g) for g in hit}
    out = []
    for k, (op, args) in enumerate(ops):
        if k not in bad:
            out.append(b" ".join([*map(written, args), op.encode()]))
            continue
        # Shifts in the place of what is gone keep the rest at its origins.
        parts, raw = [], bytearray()
        for g in by_op[k]:
            f = fonts.get(g.font)
            code = g.code.to_bytes(2 if f and f.composite else 1, "big")
            if id(g) in gone:
                if raw:
                    parts.append(bytes(raw))
                    raw = bytearray()
                parts.append(-(f.width(g.code) if f else 500.0))
            else:
                raw += code
        if raw:
            parts.append(bytes(raw))
        if op in ("'", '"'):
            out.append(b"T*")
        out.append(written(parts) + b" TJ")
    alias = helvetica(doc, page)
    for x0, y0, x1, y1 in rects:
        size = max(4.0, min(8.0, (y1 - y0) * 0.6))
        out.append(b"q 0 0 0 rg %s re f Q" % b" ".join(written(float(v)) for v in (x0, y0, x1 - x0, y1 - y0)))
        if label and width_of(label, size) <= x1 - x0:
            out.append(b"q BT 1 1 1 rg /%s %s Tf 1 0 0 1 %s %s Tm %s Tj ET Q" % (alias.encode(), written(size), written(x0 + 1), written(y0 + (y1 - y0 - size) / 2 + 1), literal(label)))
    set_content(doc, page, b"\n".join(out))
    pruned = prune_annotations(doc, page, rects)
    black_out(doc, page, found, rects)
    doc.dict_of(page).pop("Metadata", None)
    return {"page_index": index, "glyphs": len(hit), "rects": len(rects), "annotations": pruned}


def redact_pattern(doc: Document, pattern: re.Pattern, pages: list[int] | None = None, label: str = LABEL) -> list[dict]:
    """Hits of all pages first; then what was found is purged from the rest of the document too."""
    out, needles = [], set()
    for i in pages if pages is not None else range(len(doc.pages())):
        own = hits(doc, _page(doc, i), pattern)
        if own:
            needles |= {t for _, t in own}
            out.append(redact(doc, i, [b for b, _ in own], label))
    purge(doc, needles)
    return out


def purge(doc: Document, needles: set[str]) -> dict:
    needles = {n for n in needles if len(n) >= NEEDLE}
    holds = lambda t: bool(t) and any(n in t for n in needles)
    gone = [a["name"] for a in extract.attachments(doc) if holds(a["name"]) or holds(a["filename"]) or holds(a["description"]) or any(n.encode() in a["data"] for n in needles)]
    for name in gone:
        delete_attachment(doc, name)
    fields = 0
    for f in extract.form_fields(doc):
        d = doc.dict_of(Ref(f["obj_num"], 0))
        if holds(f["value"]):
            d.pop("V", None), d.pop("AP", None)
            fields += 1
    doc.load_all()
    texts = 0
    for v in doc.objects.values():
        if isinstance(v, dict) and "S" in v and ("K" in v or "P" in v):
            for k in ("ActualText", "Alt", "E", "T"):
                if holds(text_of(doc.resolve(v.get(k)))):
                    del v[k]
                    texts += 1
    return {"attachments": len(gone), "fields": fields, "structure_texts": texts}


def prune_annotations(doc: Document, page: Ref, rects: list[Box]) -> int:
    d = doc.dict_of(page)
    old = doc.resolve(d.get("Annots")) or []
    bad = lambda a: doc.resolve(doc.dict_of(a).get("Subtype")) == "Redact" or any(touch(extract.rect(doc, doc.dict_of(a).get("Rect")) or (1e9,) * 4, r) for r in rects)
    kept = [a for a in old if not bad(a)]
    if len(kept) < len(old):
        d[Name("Annots")] = kept
    return len(old) - len(kept)


def black_out(doc: Document, page: Ref, found, rects: list[Box]) -> int:
    """Samples of 8-bit gray and RGB images under the rectangles; the page gets a copy of its own."""
    done = 0
    objects = dict(doc.dict_of(doc.dict_of(doc.inherited(page, "Resources")).get("XObject")))
    for name, m in found.draws:
        s = doc.resolve(objects.get(name))
        if not isinstance(s, Stream) or doc.resolve(s.dict.get("Subtype")) != "Image":
            continue
        w, h, n = (int(doc.resolve(s.dict.get(k)) or 0) for k in ("Width", "Height", "BitsPerComponent"))
        try:
            raw = bytearray(decoded(s, doc))
        except PdfError:
            continue
        c = len(raw) // max(1, w * h)
        if n != 8 or c not in (1, 3) or len(raw) != w * h * c:
            continue
        changed = False
        for j in range(h):
            for i in range(w):
                x, y = apply(m, (i + 0.5) / w, 1 - (j + 0.5) / h)
                if any(r[0] <= x <= r[2] and r[1] <= y <= r[3] for r in rects):
                    raw[(j * w + i) * c : (j * w + i + 1) * c] = bytes(c)
                    changed = True
        if changed:
            new = compressed(bytes(raw), {k: v for k, v in s.dict.items() if k not in ("Filter", "DecodeParms", "Length")})
            resource(doc, page, "XObject", name, doc.add(new))
            done += 1
    return done


def scrub_metadata(doc: Document) -> bool:
    had = "Info" in doc.trailer or "Metadata" in doc.catalog
    doc.trailer["Info"] = doc.add({Name("Producer"): b"foliolake"})
    doc.catalog.pop("Metadata", None)
    return had


# --- text ------------------------------------------------------------------------------------------------------------------


def reflow(text: str, width: float, measure, alignment: str = "left", leading: float = 14.4) -> list[dict]:
    """Greedy lines: as many words as fit; (text, width, dx, dy, word spacing)."""
    lines, now = [], ""
    for part in text.split("\n"):
        for w in part.split():
            more = f"{now} {w}" if now else w
            if now and measure(more) > width:
                lines.append((now, False))
                now = w
            else:
                now = more
        lines.append((now, True))
        now = ""
    out = []
    for i, (t, last) in enumerate(lines):
        own = measure(t)
        spare, gaps = max(0.0, width - own), t.count(" ")
        dx = spare / 2 if alignment == "center" else spare if alignment == "right" else 0.0
        out.append({"text": t, "width": own, "dx": dx, "dy": -i * leading, "word_spacing": spare / gaps if alignment == "justified" and gaps and not last else 0.0})
    return out


def _drawn(lines: list[dict], x: float, y: float, font: str, size: float, colour=(0, 0, 0), low: float | None = None) -> bytes:
    out = [b"q BT %s rg /%s %s Tf" % (b" ".join(written(float(c)) for c in colour), font.encode(), written(float(size)))]
    for line in lines:
        if low is None or y + line["dy"] >= low:
            out.append(b"%s Tw 1 0 0 1 %s %s Tm %s Tj" % (written(line["word_spacing"]), written(x + line["dx"]), written(y + line["dy"]), literal(line["text"])))
    return b"\n".join([*out, b"ET Q"])


def edit_paragraph(doc: Document, index: int, number: int, text: str, base: str | None = None, size: float | None = None, colour=(0, 0, 0)) -> None:
    """The paragraph's glyphs go; the new text flows into its box."""
    page = _page(doc, index)
    own = paragraphs(extract.page_scan(doc, page).glyphs)
    if not 0 <= number < len(own):
        raise PdfError("INVALID_OPERATION", f"there is no paragraph {number}")
    p = own[number]
    _drop(doc, page, p)
    size = size or p.rendered
    leading = p.leading * size / p.rendered if p.rendered else p.leading
    alias = helvetica(doc, page, base or "Helvetica")
    # The box was measured by the fonts' widths, so the text is too; sums of the same widths may differ in their last digits.
    face = extract.fonts_.page_fonts(doc, page)[alias]
    measure = lambda t: sum(map(face.width, t.encode("cp1252", "replace"))) * size / 1000
    lines = reflow(text, max(50.0, p.box[2] - p.box[0]) + 1e-6, measure, p.alignment, leading)
    append(doc, page, _drawn(lines, p.box[0], p.lines[0].baseline, alias, size, colour))


def _drop(doc: Document, page: Ref, p: Paragraph) -> None:
    gone = {(g.op, round(g.x, 3), round(g.y, 3)) for x in p.lines for s in x.spans for g in s.glyphs}
    fonts = extract.fonts_.page_fonts(doc, page)
    ops = operations(doc.content(page))
    by_op: dict[int, list] = {}
    for g in extract.scan(ops, fonts).glyphs:
        by_op.setdefault(g.op, []).append(g)
    out = []
    for k, (op, args) in enumerate(ops):
        own = by_op.get(k, [])
        if not any((g.op, round(g.x, 3), round(g.y, 3)) in gone for g in own):
            out.append(b" ".join([*map(written, args), op.encode()]))
            continue
        parts = []
        for g in own:
            f = fonts.get(g.font)
            parts.append(-(f.width(g.code) if f else 500.0) if (g.op, round(g.x, 3), round(g.y, 3)) in gone else g.code.to_bytes(2 if f and f.composite else 1, "big"))
        out.append(written(parts) + b" TJ")
    set_content(doc, page, b"\n".join(out))


def replace_text(doc: Document, query: str, replacement: str, ignore_case: bool = True, most: int = 500) -> dict:
    """All pages are planned before any is changed."""
    if len(replacement) > REPLACEMENT_LIMIT or not query:
        raise PdfError("INVALID_OPERATION", "the query or replacement has no allowed length")
    find = re.compile(re.escape(query), re.I if ignore_case else 0)
    plan, done = [], 0
    for i, page in enumerate(doc.pages()):
        for k, p in enumerate(paragraphs(extract.page_scan(doc, page).glyphs)):
            flat = p.text.replace("\n", " ")
            new, n = find.subn(lambda _: replacement, flat, count=max(0, most - done) or -1 if done < most else 0) if done < most else (flat, 0)
            if n:
                if len(new) > PARAGRAPH_LIMIT:
                    raise PdfError("INVALID_OPERATION", "a paragraph would grow too long")
                plan.append((i, k, new))
                done += n
    for i, k, new in reversed(plan):
        edit_paragraph(doc, i, k, new)
    return {"replacements": done, "paragraphs": len(plan), "truncated": done >= most}


def text_box(doc: Document, index: int, rect: Box, text: str, size: float = 12, colour=(0, 0, 0), alignment: str = "left") -> None:
    if len(text) > BOX_TEXT_LIMIT or rect[2] - rect[0] < 8 or rect[3] - rect[1] < 8:
        raise PdfError("INVALID_OPERATION", "the text or its box has no allowed size")
    page = _page(doc, index)
    lines = reflow(text, rect[2] - rect[0], lambda t: width_of(t, size), alignment, 1.2 * size)
    append(doc, page, _drawn(lines, rect[0], rect[3] - size, helvetica(doc, page), size, colour, rect[1]))


def fill_sign(doc: Document, index: int, rect: Box, text: str | None = None, strokes: list[list[tuple[float, float]]] | None = None, image: bytes | None = None) -> None:
    """A typed name, drawn strokes or an image inside a rectangle."""
    page = _page(doc, index)
    if text is not None:
        if not 1 <= len(text) <= 80:
            raise PdfError("INVALID_OPERATION", "a typed name has 1 to 80 characters")
        size = max(6.0, min(rect[3] - rect[1], 1.9 * (rect[2] - rect[0]) / len(text)))
        append(doc, page, _drawn(reflow(text, 1e9, lambda t: 0.0), rect[0], rect[1] + 0.25 * (rect[3] - rect[1]), helvetica(doc, page, "Times-Italic"), size))
    elif strokes:
        if len(strokes) > 30 or sum(map(len, strokes)) > 2000 or any(not (rect[0] <= x <= rect[2] and rect[1] <= y <= rect[3]) for s in strokes for x, y in s):
            raise PdfError("INVALID_OPERATION", "the strokes are too many or leave the rectangle")
        path = b"\n".join(b" ".join(b"%s %s %s" % (written(float(x)), written(float(y)), b"l" if i else b"m") for i, (x, y) in enumerate(s)) + b" S" for s in strokes if len(s) > 1)
        append(doc, page, b"q 1.5 w 1 J 1 j 0 0 0 RG\n" + path + b"\nQ")
    elif image:
        if len(image) > 2_000_000:
            raise PdfError("INVALID_OPERATION", "the image is too large")
        name = resource(doc, page, "XObject", "FxSign", add_image(doc, image))
        append(doc, page, b"q %s cm /%s Do Q" % (b" ".join(written(float(v)) for v in (rect[2] - rect[0], 0, 0, rect[3] - rect[1], rect[0], rect[1])), name.encode()))
    else:
        raise PdfError("INVALID_OPERATION", "nothing to sign with")


# --- page decoration -------------------------------------------------------------------------------------------------------


def paginate(doc: Document, template: str = "Page {page} of {total}", position: str = "bottom_center", size: float = 10, margin: float = 36, start: int = 1, skip_first: bool = False) -> int:
    if position not in POSITIONS:
        raise PdfError("INVALID_OPERATION", f"no position {position}")
    pages, n = doc.pages(), 0
    for i, page in enumerate(pages):
        if skip_first and not i:
            continue
        box = extract.page_boxes(doc, page)["media"]
        text = template.replace("{page}", str(start + i)).replace("{total}", str(len(pages)))
        w = width_of(text, size)
        x = box[0] + margin if position.endswith("left") else box[2] - margin - w if position.endswith("right") else (box[0] + box[2] - w) / 2
        y = box[3] - margin - size if position.startswith("top") else box[1] + margin
        append(doc, page, _drawn(reflow(text, 1e9, lambda t: 0.0), x, y, helvetica(doc, page), size))
        n += 1
    return n


def text_watermark(doc: Document, text: str, size: float = 48, degrees: float = 45, opacity: float = 0.3, colour=(0.5, 0.5, 0.5), behind: bool = True) -> int:
    from math import cos, radians, sin

    for page in doc.pages():
        b = extract.page_boxes(doc, page)["media"]
        gs = resource(doc, page, "ExtGState", "FxGs", doc.add({Name("Type"): Name("ExtGState"), Name("ca"): float(opacity), Name("CA"): float(opacity)}))
        c, s, half = cos(radians(degrees)), sin(radians(degrees)), width_of(text, size) / 2
        x, y = (b[0] + b[2]) / 2 - half * c, (b[1] + b[3]) / 2 - half * s
        body = b"q /%s gs BT %s rg /%s %s Tf %s Tm %s Tj ET Q" % (gs.encode(), b" ".join(written(float(v)) for v in colour), helvetica(doc, page).encode(), written(float(size)), b" ".join(written(float(v)) for v in (c, s, -s, c, x, y)), literal(text))
        append(doc, page, body, behind)
    return len(doc.pages())


def image_watermark(doc: Document, image: bytes, share: float = 0.5, opacity: float = 0.3, behind: bool = False) -> int:
    ref = add_image(doc, image)
    d = doc.dict_of(ref)
    for page in doc.pages():
        b = extract.page_boxes(doc, page)["media"]
        w = (b[2] - b[0]) * share
        h = w * d["Height"] / d["Width"]
        name = resource(doc, page, "XObject", "FxMark", ref)
        gs = resource(doc, page, "ExtGState", "FxGs", doc.add({Name("ca"): float(opacity), Name("CA"): float(opacity)}))
        append(doc, page, b"q /%s gs %s cm /%s Do Q" % (gs.encode(), b" ".join(written(float(v)) for v in (w, 0, 0, h, (b[0] + b[2] - w) / 2, (b[1] + b[3] - h) / 2)), name.encode()), behind)
    return len(doc.pages())


def add_image(doc: Document, data: bytes) -> Ref:
    """JPEG as it is, PNG as samples with its alpha as a soft mask."""
    base = {Name("Type"): Name("XObject"), Name("Subtype"): Name("Image"), Name("BitsPerComponent"): 8}
    if data[:2] == b"\xff\xd8":
        w, h, n = extract.jpeg_header(data)
        space = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(n, "DeviceRGB")
        return doc.add(Stream(base | {Name("Width"): w, Name("Height"): h, Name("ColorSpace"): Name(space), Name("Filter"): Name("DCTDecode")}, data))
    w, h, raw, alpha = extract.png_pixels(data)
    space = Name("DeviceRGB" if len(raw) == 3 * w * h else "DeviceGray")
    d = base | {Name("Width"): w, Name("Height"): h, Name("ColorSpace"): space}
    if alpha is not None:
        d[Name("SMask")] = doc.add(compressed(alpha, base | {Name("Width"): w, Name("Height"): h, Name("ColorSpace"): Name("DeviceGray")}))
    return doc.add(compressed(raw, d))


def replace_image(doc: Document, num: int, data: bytes) -> None:
    if not isinstance(doc.get(num), Stream):
        raise PdfError("IMAGE", f"object {num} is no image")
    doc.objects[num] = doc.get(add_image(doc, data).num)


# --- annotations -----------------------------------------------------------------------------------------------------------


def _annotate(doc: Document, index: int, d: dict) -> Ref:
    page = _page(doc, index)
    ref = doc.add({Name("Type"): Name("Annot"), Name("P"): page, Name("F"): 4} | d)
    own = doc.dict_of(page)
    own[Name("Annots")] = [*(doc.resolve(own.get("Annots")) or []), ref]
    return ref


def _checked(rect: Box) -> list[float]:
    if any(abs(v) > COORDINATE for v in rect):
        raise PdfError("INVALID_OPERATION", "a coordinate is out of range")
    return [float(v) for v in (min(rect[0], rect[2]), min(rect[1], rect[3]), max(rect[0], rect[2]), max(rect[1], rect[3]))]


def _appearance(doc: Document, rect: list[float], body: bytes, resources: dict | None = None) -> dict:
    form = Stream({Name("Type"): Name("XObject"), Name("Subtype"): Name("Form"), Name("BBox"): rect, Name("Resources"): resources or {}}, body)
    return {Name("AP"): {Name("N"): doc.add(form)}}


def markup(doc: Document, index: int, subtype: str, rect: Box, quads: list[float] | None = None, colour=None, opacity: float | None = None, contents: str | None = None) -> Ref:
    if subtype not in MARKUP:
        raise PdfError("INVALID_OPERATION", f"no markup {subtype}")
    r, c = _checked(rect), list(colour or MARKUP[subtype])
    quads = quads if quads and len(quads) >= 8 else [r[0], r[3], r[2], r[3], r[0], r[1], r[2], r[1]]
    rgb = b" ".join(written(float(v)) for v in c)
    n = [written(float(v)) for v in r]
    y = {"Underline": r[1] + 1, "StrikeOut": (r[1] + r[3]) / 2}.get(subtype)
    body = b"%s rg %s %s %s %s re f" % (rgb, n[0], n[1], written(r[2] - r[0]), written(r[3] - r[1])) if y is None else b"%s RG 1 w %s %s m %s %s l S" % (rgb, n[0], written(y), n[2], written(y))
    d = {Name("Subtype"): Name(subtype), Name("Rect"): r, Name("QuadPoints"): [float(q) for q in quads], Name("C"): c, Name("CA"): float(opacity if opacity is not None else 0.4 if subtype == "Highlight" else 1.0)}
    if contents:
        d[Name("Contents")] = text_bytes(contents)
    return _annotate(doc, index, d | _appearance(doc, r, body))


def link(doc: Document, index: int, rect: Box, uri: str | None = None, page: int | None = None, border: bool = False) -> Ref:
    if uri is not None and not extract.web(uri):
        raise PdfError("INVALID_OPERATION", "only web addresses may be linked")
    action = {Name("S"): Name("URI"), Name("URI"): uri.encode()} if uri is not None else {Name("S"): Name("GoTo"), Name("D"): [_page(doc, page or 0), Name("Fit")]}
    return _annotate(doc, index, {Name("Subtype"): Name("Link"), Name("Rect"): _checked(rect), Name("Border"): [0, 0, 1 if border else 0], Name("A"): action})


def stamp(doc: Document, index: int, kind: str = "approved", rect: Box | None = None, text: str | None = None, colour=(0.8, 0.1, 0.1), date: str | None = None) -> Ref:
    r = _checked(rect or (400, 700, 560, 740))
    text = text or STAMPS.get(kind.lower()) or kind.upper()
    size = max(6.0, min((r[3] - r[1]) * 0.5, 1.7 * (r[2] - r[0]) / max(1, len(text))))
    rgb = b" ".join(written(float(v)) for v in colour)
    body = b"%s RG %s rg 2 w %s %s %s %s re S BT /F1 %s Tf 1 0 0 1 %s %s Tm %s Tj ET" % (rgb, rgb, *(written(float(v)) for v in (r[0] + 1, r[1] + 1, r[2] - r[0] - 2, r[3] - r[1] - 2, size, r[0] + 6, (r[1] + r[3] - size * 0.7) / 2)), literal(text))
    d = {Name("Subtype"): Name("Stamp"), Name("Rect"): r, Name("Name"): Name(text.title().replace(" ", "")), Name("Contents"): text_bytes(text), Name("C"): [float(v) for v in colour]}
    if date:
        d[Name("M")] = date.encode()
    return _annotate(doc, index, d | _appearance(doc, r, body, {Name("Font"): {Name("F1"): doc.add(dict(HELVETICA))}}))


def shape(doc: Document, index: int, kind: str, points: list[tuple[float, float]], colour=(0, 0, 0), width: float = 1.0, fill=None) -> Ref:
    """ink, line, square, circle, polygon or polyline."""
    low, high = {"ink": (2, 2000), "line": (2, 2), "square": (2, 2), "circle": (2, 2), "polygon": (3, 200), "polyline": (3, 200)}.get(kind, (1, 0))
    if not low <= len(points) <= high or any(abs(v) > COORDINATE for p in points for v in p):
        raise PdfError("INVALID_OPERATION", f"the points make no {kind}")
    xs, ys, flat = [p[0] for p in points], [p[1] for p in points], [float(v) for p in points for v in p]
    r = [min(xs) - width, min(ys) - width, max(xs) + width, max(ys) + width]
    key = {"ink": {Name("InkList"): [flat]}, "line": {Name("L"): flat}, "polygon": {Name("Vertices"): flat}, "polyline": {Name("Vertices"): flat}}.get(kind, {})
    rgb = b" ".join(written(float(v)) for v in colour)
    path = b" ".join(b"%s %s %s" % (written(float(x)), written(float(y)), b"l" if i else b"m") for i, (x, y) in enumerate(points))
    if kind in ("square", "circle"):
        path = b"%s %s %s %s re" % tuple(written(float(v)) for v in (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)))
    d = {Name("Subtype"): Name({"ink": "Ink", "line": "Line", "square": "Square", "circle": "Circle", "polygon": "Polygon", "polyline": "PolyLine"}[kind]), Name("Rect"): [float(v) for v in r], Name("C"): [float(v) for v in colour], Name("BS"): {Name("W"): float(width)}}
    if fill:
        d[Name("IC")] = [float(v) for v in fill]
    return _annotate(doc, index, d | key | _appearance(doc, d["Rect"], b"%s RG %s w %s %s" % (rgb, written(float(width)), path, b"s" if kind == "polygon" else b"S")))


def delete_annotation(doc: Document, index: int, num: int) -> bool:
    d = doc.dict_of(_page(doc, index))
    old = doc.resolve(d.get("Annots")) or []
    kept = [a for a in old if not (isinstance(a, Ref) and a.num == num)]
    d[Name("Annots")] = kept
    return len(kept) < len(old)


def _burn(doc: Document, page: Ref, annots: list) -> int:
    """Draws appearances into the page."""
    n, body = 0, []
    for a in annots:
        d = doc.dict_of(a)
        ap = doc.resolve(doc.dict_of(d.get("AP")).get("N"))
        if isinstance(ap, dict):
            ap = doc.resolve(ap.get(doc.resolve(d.get("AS"))))
        r = extract.rect(doc, d.get("Rect"))
        if isinstance(ap, Stream) and r and not (doc.resolve(d.get("F")) or 0) & 2:
            b = extract.rect(doc, ap.dict.get("BBox")) or r
            sx, sy = (r[2] - r[0]) / ((b[2] - b[0]) or 1), (r[3] - r[1]) / ((b[3] - b[1]) or 1)
            name = resource(doc, page, "XObject", f"FxA{n}x{page.num}", doc.add(Stream(ap.dict | {Name("Subtype"): Name("Form")}, ap.raw)))
            body.append(b"q %s cm /%s Do Q" % (b" ".join(written(float(v)) for v in (sx, 0, 0, sy, r[0] - b[0] * sx, r[1] - b[1] * sy)), name.encode()))
            n += 1
    if body:
        append(doc, page, b"\n".join(body))
    return n


def flatten_annotations(doc: Document, index: int | None = None, kinds=("Highlight", "Underline", "StrikeOut", "Stamp")) -> int:
    n = 0
    for page in doc.pages() if index is None else [_page(doc, index)]:
        d = doc.dict_of(page)
        own = doc.resolve(d.get("Annots")) or []
        burnt = [a for a in own if kinds is None or doc.resolve(doc.dict_of(a).get("Subtype")) in kinds]
        n += _burn(doc, page, burnt)
        d[Name("Annots")] = [a for a in own if a not in burnt]
    return n


def hard_flatten(doc: Document) -> dict:
    """Forms and all annotations become page content; nothing interactive is left."""
    fields = flatten_forms(doc)
    return {"fields": fields, "annotations": flatten_annotations(doc, None, None)}


# --- forms -----------------------------------------------------------------------------------------------------------------


def acroform(doc: Document) -> dict:
    c = doc.catalog
    if not doc.dict_of(c.get("AcroForm")):
        c[Name("AcroForm")] = doc.add({Name("Fields"): [], Name("DA"): b"/Helv 12 Tf 0 g", Name("DR"): {Name("Font"): {Name("Helv"): doc.add(dict(HELVETICA))}}, Name("NeedAppearances"): True})
    return doc.dict_of(c["AcroForm"])


def create_field(doc: Document, index: int, name: str, kind: str, rect: Box, value: str = "", options: list[str] = (), flags: int = 0, tooltip: str | None = None) -> Ref:
    if any(f["name"] == name for f in extract.form_fields(doc)):
        raise PdfError("INVALID_OPERATION", f"there is a field {name}")
    ft = {"text": "Tx", "checkbox": "Btn", "radio": "Btn", "pushbutton": "Btn", "choice": "Ch", "signature": "Sig"}[kind]
    flags |= {"radio": extract.RADIO, "pushbutton": extract.PUSHBUTTON}.get(kind, 0)
    d = {Name("Subtype"): Name("Widget"), Name("FT"): Name(ft), Name("T"): text_bytes(name), Name("Rect"): _checked(rect), Name("Ff"): flags, Name("DA"): b"/Helv 12 Tf 0 g"}
    if options:
        d[Name("Opt")] = [text_bytes(o) for o in options]
    if tooltip:
        d[Name("TU")] = text_bytes(tooltip)
    ref = _annotate(doc, index, d)
    form = acroform(doc)
    form[Name("Fields")] = [*(doc.resolve(form.get("Fields")) or []), ref]
    if value:
        fill(doc, {name: value})
    return ref


def fill(doc: Document, values: dict[str, str]) -> int:
    """Values by field name or object number; check boxes take yes, true, 1 and on."""
    n = 0
    for f in extract.form_fields(doc):
        v = values.get(f["name"], values.get(str(f["obj_num"])))
        if v is None:
            continue
        d = doc.dict_of(Ref(f["obj_num"], 0))
        if f["field_type"] in ("checkbox", "radio"):
            on = str(v).strip().lower() in ("yes", "true", "1", "on")
            states = [k for k in doc.dict_of(doc.dict_of(d.get("AP")).get("N")) if k != "Off"]
            state = Name((states[0] if states else "Yes") if on else "Off")
            d[Name("V")] = d[Name("AS")] = state
        else:
            d[Name("V")] = text_bytes(str(v))
            d.pop("AP", None)
        n += 1
    return n


def update_field(doc: Document, name: str, rect: Box | None = None, flags: int | None = None, tooltip: str | None = None) -> bool:
    f = next((f for f in extract.form_fields(doc) if f["name"] == name), None)
    if not f:
        return False
    d = doc.dict_of(Ref(f["obj_num"], 0))
    d |= ({Name("Rect"): _checked(rect)} if rect else {}) | ({Name("Ff"): flags} if flags is not None else {}) | ({Name("TU"): text_bytes(tooltip)} if tooltip else {})
    return True


def delete_field(doc: Document, name: str) -> bool:
    f = next((f for f in extract.form_fields(doc) if f["name"] == name), None)
    if not f:
        return False
    gone = {f["obj_num"]} | {k.num for k in doc.resolve(doc.dict_of(Ref(f["obj_num"], 0)).get("Kids")) or [] if isinstance(k, Ref)}
    keep = lambda xs: [x for x in doc.resolve(xs) or [] if not (isinstance(x, Ref) and x.num in gone)]
    form = acroform(doc)
    form[Name("Fields")] = keep(form.get("Fields"))
    for p in doc.pages():
        d = doc.dict_of(p)
        if "Annots" in d:
            d[Name("Annots")] = keep(d["Annots"])
    return True


def flatten_forms(doc: Document) -> int:
    fields = extract.form_fields(doc)
    for f in fields:
        page = _page(doc, f["page_number"] - 1)
        text = "X" if f["field_type"] in ("checkbox", "radio") and f["value"] not in ("", "Off") else f["value"] if f["field_type"] in ("text", "choice") else ""
        if text:
            size = max(6.0, min(12.0, (f["rect"][3] - f["rect"][1]) * 0.7))
            append(doc, page, _drawn(reflow(text, f["rect"][2] - f["rect"][0], lambda t, s=size: width_of(t, s), leading=1.2 * size), f["rect"][0] + 2, f["rect"][3] - size, helvetica(doc, page), size))
    for p in doc.pages():
        d = doc.dict_of(p)
        if "Annots" in d:
            d[Name("Annots")] = [a for a in doc.resolve(d["Annots"]) or [] if doc.resolve(doc.dict_of(a).get("Subtype")) != "Widget"]
    doc.catalog.pop("AcroForm", None)
    return len(fields)


# --- document data ---------------------------------------------------------------------------------------------------------


def set_metadata(doc: Document, values: dict[str, str | None]) -> None:
    """Information dictionary and XMP say the same; a blank removes."""
    from html import escape

    info = dict(doc.dict_of(doc.trailer.get("Info")))
    for k, v in values.items():
        key = Name(extract.INFO[k])
        if v and v.strip():
            info[key] = text_bytes(v)
        else:
            info.pop(key, None)
    doc.trailer["Info"] = doc.add(info)
    own = {k: text_of(info.get(key)) for k, key in extract.INFO.items() if key in info}
    old = doc.resolve(doc.catalog.get("Metadata"))
    kept = re.findall(rb"<pdf(?:a|ua)id:[^>]*>[^<]*</pdf(?:a|ua)id:[^>]*>", decoded(old, doc)) if isinstance(old, Stream) else []
    tags = "".join(f"<{extract._XMP[k]}>{escape(v)}</{extract._XMP[k]}>" for k, v in own.items()) + b"".join(kept).decode()
    xmp = f'<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:pdf="http://ns.adobe.com/pdf/1.3/" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:pdfaid="http://www.aiim.org/pdfa/ns/id/" xmlns:pdfuaid="http://www.aiim.org/pdfua/ns/id/">{tags}</rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end="w"?>'
    doc.catalog[Name("Metadata")] = doc.add(Stream({Name("Type"): Name("Metadata"), Name("Subtype"): Name("XML")}, xmp.encode()))


def set_outlines(doc: Document, items: list[dict]) -> int:
    """Items (path, title, page_number, uri, is_open) in path order; all are checked before any is written."""
    pages = doc.pages()
    for i in items:
        if i.get("uri") and not extract.web(i["uri"]) or i.get("page_number") and not 1 <= i["page_number"] <= len(pages):
            raise PdfError("INVALID_OPERATION", f"the bookmark {i['title']} leads nowhere")
    root = doc.add({Name("Type"): Name("Outlines")})
    refs = {(): root} | {tuple(i["path"]): doc.add({Name("Title"): text_bytes(i["title"])}) for i in items}
    shown = {tuple(i["path"]): i.get("is_open", True) for i in items} | {(): True}
    for i in items:
        d = doc.dict_of(refs[tuple(i["path"])])
        if i.get("uri"):
            d[Name("A")] = {Name("S"): Name("URI"), Name("URI"): i["uri"].encode()}
        elif i.get("page_number"):
            d[Name("Dest")] = [pages[i["page_number"] - 1], Name("XYZ"), i.get("left"), i.get("top"), i.get("zoom")]
    for path, ref in refs.items():
        kids = sorted(p for p in refs if len(p) == len(path) + 1 and p[: len(path)] == path)
        d = doc.dict_of(ref)
        if kids:
            d[Name("First")], d[Name("Last")] = refs[kids[0]], refs[kids[-1]]
            below = sum(1 for p in refs if len(p) > len(path) and p[: len(path)] == path and all(shown[p[:k]] for k in range(len(path) + 1, len(p))))
            d[Name("Count")] = below if shown[path] else -below
        for k, p in enumerate(kids):
            own = doc.dict_of(refs[p])
            own[Name("Parent")] = ref
            if k:
                own[Name("Prev")] = refs[kids[k - 1]]
            if k + 1 < len(kids):
                own[Name("Next")] = refs[kids[k + 1]]
    doc.catalog[Name("Outlines")] = root
    return len(items)


def add_outline(doc: Document, item: dict, parent: list[int] = ()) -> int:
    items = extract.outlines(doc)
    at = [*parent, sum(1 for i in items if i["path"][:-1] == list(parent))]
    return set_outlines(doc, [*items, item | {"path": at}])


def clear_outlines(doc: Document) -> bool:
    return doc.catalog.pop("Outlines", None) is not None


def _set_files(doc: Document, items: list[tuple[str, object]]) -> None:
    names = dict(doc.dict_of(doc.catalog.get("Names")))
    names[Name("EmbeddedFiles")] = doc.add({Name("Names"): [v for k, r in sorted(items, key=lambda x: text_bytes(x[0])) for v in (text_bytes(k), r)]})
    doc.catalog[Name("Names")] = doc.add(names)


def add_attachment(doc: Document, name: str, data: bytes, mime: str = "application/octet-stream", description: str | None = None) -> None:
    name = re.sub(r'[\x00-\x1f/\\:*?"<>|]', "_", name).strip()[:255] or "attachment"
    s = compressed(data, {Name("Type"): Name("EmbeddedFile"), Name("Subtype"): Name(mime), Name("Params"): {Name("Size"): len(data), Name("CheckSum"): hashlib.md5(data).digest()}})
    ref = doc.add(s)
    spec = {Name("Type"): Name("Filespec"), Name("F"): text_bytes(name), Name("UF"): text_bytes(name), Name("EF"): {Name("F"): ref, Name("UF"): ref}}
    if description:
        spec[Name("Desc")] = text_bytes(description)
    old = [(n, r) for n, r in extract.name_tree(doc, doc.dict_of(doc.catalog.get("Names")).get("EmbeddedFiles")) if n != name]
    _set_files(doc, [*old, (name, doc.add(spec))])


def delete_attachment(doc: Document, name: str) -> bool:
    old = extract.name_tree(doc, doc.dict_of(doc.catalog.get("Names")).get("EmbeddedFiles"))
    kept = [(n, r) for n, r in old if n != name]
    if len(kept) < len(old):
        _set_files(doc, kept)
    return len(kept) < len(old)


def add_layer(doc: Document, name: str, visible: bool = True, locked: bool = False, intent: list[str] | None = None) -> Ref:
    ref = doc.add({Name("Type"): Name("OCG"), Name("Name"): text_bytes(name), Name("Intent"): [Name(i) for i in intent or ["View"]]})
    props = dict(doc.dict_of(doc.catalog.get("OCProperties")))
    config = dict(doc.dict_of(props.get("D")))
    props[Name("OCGs")] = [*(doc.resolve(props.get("OCGs")) or []), ref]
    for k, yes in (("ON", visible), ("OFF", not visible), ("Locked", locked)):
        if yes:
            config[Name(k)] = [*(doc.resolve(config.get(k)) or []), ref]
    config[Name("Order")] = [*(doc.resolve(config.get("Order")) or []), ref]
    props[Name("D")] = config
    doc.catalog[Name("OCProperties")] = props
    return ref


def _layer(doc: Document, target: str) -> Ref:
    for x in extract.layers(doc):
        if target in (x["id"], str(x["obj_num"]), x["name"]):
            return Ref(x["obj_num"], 0)
    raise PdfError("INVALID_OPERATION", f"there is no layer {target}")


def show_layer(doc: Document, target: str, visible: bool) -> None:
    ref = _layer(doc, target)
    config = doc.dict_of(doc.dict_of(doc.catalog["OCProperties"]).get("D"))
    for k, yes in (("ON", visible), ("OFF", not visible)):
        own = [r for r in doc.resolve(config.get(k)) or [] if r.num != ref.num]
        config[Name(k)] = [*own, ref] if yes else own


def delete_layer(doc: Document, target: str) -> bool:
    ref = _layer(doc, target)
    props = doc.dict_of(doc.catalog["OCProperties"])
    config = doc.dict_of(props.get("D"))
    for d, k in ((props, "OCGs"), (config, "ON"), (config, "OFF"), (config, "Locked"), (config, "Order")):
        if k in d:
            d[Name(k)] = [r for r in doc.resolve(d[k]) or [] if not (isinstance(r, Ref) and r.num == ref.num)]
    return True


def register_layer(doc: Document, index: int, prop: str, target: str) -> str:
    return resource(doc, _page(doc, index), "Properties", prop, _layer(doc, target))


# --- whole documents -------------------------------------------------------------------------------------------------------


def strip_active(doc: Document) -> int:
    """Scripts, launches and dangerous addresses go."""
    doc.load_all()
    n = 0

    def clean(x):
        nonlocal n
        if isinstance(x, dict):
            kind = doc.resolve(x.get("S"))
            uri = text_of(doc.resolve(x.get("URI"))) or ""
            if kind in ACTIVE_ACTIONS or re.match(r"(?i)[\s\x00-\x1f]*(javascript|jscript|livescript|vbscript|file|data)\s*:", uri):
                x.clear()
                n += 1
                return
            for k in [k for k in x if k in ACTIVE_KEYS and not (k == "OpenAction" and isinstance(doc.resolve(x[k]), list))]:
                del x[k]
                n += 1
            for v in x.values():
                clean(v)
        elif isinstance(x, list):
            for v in x:
                clean(v)
        elif isinstance(x, Stream):
            clean(x.dict)

    for v in list(doc.objects.values()):
        clean(v)
    return n


def collect_garbage(doc: Document) -> int:
    """Objects that the trailer does not reach."""
    doc.load_all()
    seen, todo = set(), [doc.trailer.get(k) for k in ("Root", "Info", "Encrypt", "ID")]
    while todo:
        x = todo.pop()
        if isinstance(x, Ref):
            if x.num not in seen:
                seen.add(x.num)
                todo.append(doc.objects.get(x.num))
        elif isinstance(x, list):
            todo += x
        elif isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, Stream):
            todo.append(x.dict)
    gone = [n for n in doc.objects if n not in seen]
    for n in gone:
        del doc.objects[n]
        doc.xref.pop(n, None)
    return len(gone)


def deduplicate(doc: Document) -> int:
    """Streams with the same dictionary and bytes become one."""
    doc.load_all()
    first: dict[bytes, int] = {}
    to: dict[int, int] = {}
    for num in sorted(doc.objects):
        v = doc.objects[num]
        if isinstance(v, Stream):
            h = hashlib.sha256(written({k: x for k, x in v.dict.items() if k != "Length"}) + v.raw).digest()
            if first.setdefault(h, num) != num:
                to[num] = first[h]

    def moved(x):
        if isinstance(x, Ref):
            return Ref(to.get(x.num, x.num), x.gen)
        if isinstance(x, list):
            return [moved(v) for v in x]
        if isinstance(x, dict):
            return {k: moved(v) for k, v in x.items()}
        return Stream(moved(x.dict), x.raw) if isinstance(x, Stream) else x

    if to:
        doc.objects = {n: moved(v) for n, v in doc.objects.items() if n not in to}
        for n in to:
            doc.xref.pop(n, None)
        doc.trailer = moved(doc.trailer)
    return len(to)


def recompress(doc: Document, most: int = 1 << 20) -> tuple[int, int]:
    """(streams made smaller, bytes saved); images keep their coding."""
    doc.load_all()
    n = saved = 0
    for num, v in list(doc.objects.items()):
        if isinstance(v, Stream) and len(v.raw) <= most and doc.resolve(v.dict.get("Filter")) in (None, "FlateDecode") and "DecodeParms" not in v.dict and v.dict.get("Type") not in ("XRef", "ObjStm", "Metadata"):
            try:
                new = compressed(decoded(v, doc), {k: x for k, x in v.dict.items() if k not in ("Filter", "Length")})
            except PdfError:
                continue
            if len(new.raw) < len(v.raw):
                n, saved = n + 1, saved + len(v.raw) - len(new.raw)
                doc.objects[num] = new
    return n, saved


def optimize(doc: Document) -> dict:
    if "Encrypt" in doc.trailer or any(s["byte_range_valid"] for s in extract.signatures(doc)):
        raise PdfError("INVALID_OPERATION", "encrypted and signed documents stay as they are")
    before = len(doc.data)
    active, streams = strip_active(doc), 0
    streams = deduplicate(doc)
    garbage = collect_garbage(doc)
    smaller, saved = recompress(doc)
    after = len(doc.save())
    return {"size_before": before, "size_after": after, "percent_saved": 100 * (before - after) / before if before else 0.0, "active": active, "garbage": garbage, "duplicates": streams, "recompressed": smaller, "recompressed_bytes": saved}


def attest(doc: Document, name: str, reason: str = "", location: str = "", date: str = "") -> bytes:
    """The saved file with a signature dictionary whose byte range and SHA-256 digest cover all but its own hex string."""
    room = 64
    sig = doc.add({Name("Type"): Name("Sig"), Name("Filter"): Name("foliolake"), Name("SubFilter"): Name("foliolake.sha256"), Name("Name"): text_bytes(name), Name("Reason"): text_bytes(reason), Name("Location"): text_bytes(location), Name("M"): date.encode(), Name("ByteRange"): [0, 2**31 - 1, 2**31 - 1, 2**31 - 1], Name("Contents"): b"@" * room})
    field = create_field(doc, 0, f"Signature{sig.num}", "signature", (0, 0, 0, 0))
    doc.dict_of(field)[Name("V")] = sig
    raw = doc.save().replace(written(b"@" * room), b"<" + b"0" * 2 * room + b">")
    # The hex string is longer than what stood there: offsets after it move, so the table is made again.
    doc.objects[sig.num][Name("Contents")] = b""
    a = raw.index(b"<" + b"0" * 2 * room + b">")
    b = a + 2 * room + 2
    raw = _retabled(raw)
    old = b"[0 2147483647 2147483647 2147483647]"
    new = b"[0 %d %d %d]" % (a, b, len(raw) - b)
    raw = raw.replace(old, new.ljust(len(old)))
    digest = hashlib.sha256(raw[:a] + raw[b:]).hexdigest().encode()
    return raw[: a + 1] + digest.ljust(2 * room, b"0") + raw[b - 1 :]


def _retabled(raw: bytes) -> bytes:
    at = {int(m[1]): m.start(1) for m in re.finditer(rb"(?<=\n)(\d+) 0 obj\n", raw)}
    start = raw.rindex(b"xref\n0 ", 0, raw.rindex(b"startxref"))
    size = max(at) + 1
    table = b"xref\n0 %d\n" % size + b"".join(b"%010d 00000 n \n" % at[n] if n in at else b"%010d %05d f \n" % (0, 65535) for n in range(size))
    trailer = raw[raw.rindex(b"trailer\n") : raw.rindex(b"startxref")]
    return raw[:start] + table + trailer + b"startxref\n%d\n%%%%EOF\n" % start


def attested(data: bytes) -> list[dict]:
    """Signatures with whether the file is what was attested."""
    return [s | {"valid": bool(s["byte_range_valid"]) and s["sub_filter"] == "foliolake.sha256" and bytes.fromhex(s["contents_hex"])[:32].hex() == s["digest"]} for s in extract.signatures(Document.load(data))]


def ocr_layer(doc: Document, index: int, words: list[dict], width_px: int, height_px: int) -> int:
    """Invisible words (text, left, top, width, height in pixels of the page's image) over a scanned page."""
    page = _page(doc, index)
    found = extract.page_scan(doc, page)
    image = extract.scanned_image(doc, page, found)
    if not image:
        return 0
    b, body, n = image["bbox"], [b"q BT 3 Tr"], 0
    sx, sy = (b[2] - b[0]) / width_px, (b[3] - b[1]) / height_px
    font = helvetica(doc, page)
    for w in words[:4000]:
        if w["text"].isascii() and w["text"].strip():
            size = max(1.0, w["height"] * sy)
            scale = 100 * w["width"] * sx / max(1e-6, 0.5 * size * len(w["text"]))
            body.append(b"/%s %s Tf %s Tz 1 0 0 1 %s %s Tm %s Tj" % (font.encode(), written(size), written(scale), written(b[0] + w["left"] * sx), written(b[3] - (w["top"] + w["height"]) * sy), literal(w["text"])))
            n += 1
    append(doc, page, b"\n".join([*body, b"ET Q"]))
    return n


def parse_ocr_tsv(text: str) -> list[dict]:
    """Words (level 5, confidence from 0 up) of an OCR engine's table."""
    out, head = [], None
    for line in text.splitlines():
        cells = line.split("\t")
        if head is None:
            head = cells
            continue
        r = dict(zip(head, cells))
        try:
            if int(r["level"]) == 5 and float(r["conf"]) >= 0 and r["text"].strip():
                out.append({"text": r["text"].strip(), "conf": float(r["conf"])} | {k: int(r[k]) for k in ("left", "top", "width", "height")})
        except (KeyError, ValueError):
            continue
    return out
