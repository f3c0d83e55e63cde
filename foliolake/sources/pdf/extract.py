"""What a document holds besides its text: boxes, images, fields, annotations, outlines, attachments, layers, metadata, structure, signatures."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

from . import fonts as fonts_
from .cos import Document, PdfError, Ref, Stream, decoded, text_of
from .layout import Scan, apply, around, operations, scan

BOXES = {"media": "MediaBox", "crop": "CropBox", "bleed": "BleedBox", "trim": "TrimBox", "art": "ArtBox"}
#: The page where none says its size, the field rectangle where none is given, bits of button and common field flags.
LETTER = (0.0, 0.0, 612.0, 792.0)
FIELD_RECT = (72.0, 700.0, 200.0, 720.0)
PUSHBUTTON, RADIO, READ_ONLY, REQUIRED, MULTILINE = 0x10000, 0x8000, 1, 2, 0x1000


def rect(doc: Document, x) -> tuple | None:
    x = doc.resolve(x)
    if not isinstance(x, list) or len(x) < 4:
        return None
    n = [doc.resolve(v) for v in x[:4]]
    if any(not isinstance(v, (int, float)) or isinstance(v, bool) for v in n):
        return None
    return float(min(n[0], n[2])), float(min(n[1], n[3])), float(max(n[0], n[2])), float(max(n[1], n[3]))


def page_boxes(doc: Document, page: Ref) -> dict[str, tuple | None]:
    out = {k: rect(doc, doc.inherited(page, name)) for k, name in BOXES.items()}
    out["media"] = out["media"] or LETTER
    return out


def normal_rotation(degrees: int) -> int:
    r = degrees % 360
    return 0 if r < 45 or r >= 315 else 90 if r < 135 else 180 if r < 225 else 270


def rotation(doc: Document, page: Ref) -> int:
    r = doc.inherited(page, "Rotate")
    return normal_rotation(int(r)) if isinstance(r, (int, float)) else 0


# --- layers ----------------------------------------------------------------------------------------------------------------


def layers(doc: Document) -> list[dict]:
    props = doc.dict_of(doc.catalog.get("OCProperties"))
    config = doc.dict_of(props.get("D"))
    nums = lambda k: {r.num for r in doc.resolve(config.get(k)) or [] if isinstance(r, Ref)}
    on, off, locked = nums("ON"), nums("OFF"), nums("Locked")
    base_off = doc.resolve(config.get("BaseState")) == "OFF"
    out = []
    for r in doc.resolve(props.get("OCGs")) or []:
        if isinstance(r, Ref):
            d = doc.dict_of(r)
            intent = doc.resolve(d.get("Intent")) or "View"
            out.append({"id": f"{r.num}_0", "obj_num": r.num, "name": text_of(doc.resolve(d.get("Name"))) or "", "visible": r.num in on if base_off else r.num not in off, "intent": [str(x) for x in (intent if isinstance(intent, list) else [intent])], "locked": r.num in locked})
    return out


def hidden_properties(doc: Document, page: Ref) -> set[str]:
    """Names of the page's marked-content properties whose layer is off."""
    state = {x["obj_num"]: x["visible"] for x in layers(doc)}
    if not state:
        return set()
    merged: dict = {}
    node: dict = doc.dict_of(page)
    for _ in range(17):
        for k, v in doc.dict_of(doc.dict_of(node.get("Resources")).get("Properties")).items():
            merged.setdefault(k, v)
        if "Parent" not in node:
            break
        node = doc.dict_of(node["Parent"])

    def seen(ref) -> bool:
        d = doc.dict_of(ref)
        if doc.resolve(d.get("Type")) == "OCMD":
            own = d.get("OCGs")
            own = own if isinstance(own, Ref) and doc.dict_of(own) else doc.resolve(own)
            states = [state.get(r.num, True) for r in (own if isinstance(own, list) else [own]) if isinstance(r, Ref)]
            if not states:
                return True
            return {"AllOn": all(states), "AnyOff": not all(states), "AllOff": not any(states)}.get(str(doc.resolve(d.get("P"))), any(states))
        return state.get(ref.num, True) if isinstance(ref, Ref) else True

    return {str(k) for k, v in merged.items() if not seen(v)}


def page_scan(doc: Document, page: Ref, fonts: dict | None = None) -> Scan:
    return scan(operations(doc.content(page)), fonts_.page_fonts(doc, page) if fonts is None else fonts, hidden_properties(doc, page))


# --- images ----------------------------------------------------------------------------------------------------------------


def jpeg_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, components)."""
    at = 2
    if data[:2] != b"\xff\xd8":
        raise PdfError("IMAGE", "no JPEG")
    while at + 9 < len(data):
        if data[at] != 0xFF:
            raise PdfError("IMAGE", "a JPEG marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h, data[at + 9]
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:
            at += 2
            continue
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise PdfError("IMAGE", "a JPEG has no frame")


def png_pixels(data: bytes) -> tuple[int, int, bytes, bytes | None]:
    """(width, height, gray or RGB samples, alpha samples) of an 8-bit PNG of type 0, 2, 4 or 6."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise PdfError("IMAGE", "no PNG")
    at, idat, head = 8, b"", b""
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        head, idat = (body, idat) if kind == b"IHDR" else (head, idat + body if kind == b"IDAT" else idat)
        at += 12 + n
    if len(head) < 13:
        raise PdfError("IMAGE", "a PNG has no header")
    w, h, bits, kind, *_, lace = struct.unpack(">IIBBBBB", head)
    n = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if bits != 8 or n is None or lace:
        raise PdfError("IMAGE", "only plain 8-bit gray and RGB PNGs are read")
    from .cos import inflate, unpredict

    raw = unpredict(inflate(idat), {"Predictor": 15, "Colors": n, "BitsPerComponent": 8, "Columns": w})
    if n in (1, 3):
        return w, h, raw, None
    colour = bytes(b for i, b in enumerate(raw) if i % n != n - 1)
    return w, h, colour, raw[n - 1 :: n]


def encode_png(width: int, height: int, samples: bytes, rgb: bool) -> bytes:
    row = width * (3 if rgb else 1)
    body = b"".join(b"\0" + samples[i * row : (i + 1) * row] for i in range(height))
    part = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if rgb else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def images(doc: Document, page: Ref, found: Scan) -> list[dict]:
    """A row for each placement, and for images that are declared and not drawn."""
    objects = doc.dict_of(doc.dict_of(doc.inherited(page, "Resources")).get("XObject"))
    out, drawn = [], set()

    def row(name, ref, ctm):
        s = doc.resolve(ref)
        if not isinstance(s, Stream) or doc.resolve(s.dict.get("Subtype")) != "Image":
            return
        space, f = doc.resolve(s.dict.get("ColorSpace")), doc.resolve(s.dict.get("Filter"))
        space = doc.resolve(space[0]) if isinstance(space, list) and space else space
        f = "+".join(map(str, f)) if isinstance(f, list) else str(f or "")
        box = around([(*apply(ctm, x, y), *apply(ctm, x, y)) for x in (0, 1) for y in (0, 1)]) if ctm else (0.0, 0.0, 0.0, 0.0)
        out.append({
            "obj_num": ref.num if isinstance(ref, Ref) else None, "resource": str(name), "width_px": int(doc.resolve(s.dict.get("Width")) or 0), "height_px": int(doc.resolve(s.dict.get("Height")) or 0),
            "color_space": str(space or ""), "bits": int(doc.resolve(s.dict.get("BitsPerComponent")) or 0), "filter": f, "byte_size": len(s.raw), "bbox": box, "ctm": list(ctm) if ctm else [0.0] * 6,
        })

    for name, ctm in found.draws:
        if name in objects:
            drawn.add(name)
            row(name, objects[name], ctm)
    for name, ref in objects.items():
        if name not in drawn:
            row(name, ref, None)
    return out


def image_bytes(doc: Document, num: int) -> tuple[bytes, str]:
    """A JPEG as it is, anything else as PNG of its samples."""
    s = doc.get(num)
    if not isinstance(s, Stream):
        raise PdfError("IMAGE", f"object {num} is no image")
    f = doc.resolve(s.dict.get("Filter"))
    last = f[-1] if isinstance(f, list) and f else f
    if last == "DCTDecode":
        return s.raw, "jpg"
    w, h = int(doc.resolve(s.dict["Width"])), int(doc.resolve(s.dict["Height"]))
    raw = decoded(s, doc)
    if len(raw) not in (w * h, 3 * w * h):
        raise PdfError("IMAGE", "samples are neither gray nor RGB of 8 bits")
    return encode_png(w, h, raw, len(raw) == 3 * w * h), "png"


def scanned_image(doc: Document, page: Ref, found: Scan) -> dict | None:
    """The page's image, if the page shows one image and no text."""
    own = images(doc, page, found)
    placed = [x for x in own if any(x["ctm"])]
    return placed[0] if len(placed) == 1 and len(found.draws) == 1 and not found.shows_text else None


# --- forms -----------------------------------------------------------------------------------------------------------------


def field_value(doc: Document, x) -> str:
    x = doc.resolve(x)
    if isinstance(x, list):
        return ", ".join(field_value(doc, v) for v in x)
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return str(x)
    return text_of(x) or ""


def form_fields(doc: Document) -> list[dict]:
    form = doc.dict_of(doc.catalog.get("AcroForm"))
    pages = doc.pages()
    place = {p.num: i + 1 for i, p in enumerate(pages)}
    of_widget = {}
    for i, p in enumerate(pages):
        for a in doc.resolve(doc.dict_of(p).get("Annots")) or []:
            if isinstance(a, Ref):
                of_widget[a.num] = i + 1
    out: list[dict] = []
    seen: set[int] = set()

    def walk(ref, above: str, kind, flags, depth: int):
        if depth > 32 or not isinstance(ref, Ref) or ref.num in seen:
            return
        seen.add(ref.num)
        d = doc.dict_of(ref)
        own = text_of(doc.resolve(d.get("T")))
        name = f"{above}.{own}" if above and own else own or above
        kind = doc.resolve(d.get("FT")) or kind
        flags = doc.resolve(d.get("Ff")) if doc.resolve(d.get("Ff")) is not None else flags
        kids = [k for k in doc.resolve(d.get("Kids")) or []]
        children = [k for k in kids if "T" in doc.dict_of(k)]
        if children:
            for k in children:
                walk(k, name, kind, flags, depth + 1)
            return
        widget = d if "Rect" in d else doc.dict_of(kids[0]) if kids else d
        bits = int(flags or 0)
        shape = {"Btn": "pushbutton" if bits & PUSHBUTTON else "radio" if bits & RADIO else "checkbox", "Tx": "text", "Ch": "choice", "Sig": "signature"}.get(str(kind), "unknown")
        page = doc.resolve(widget.get("P")) and widget.get("P")
        options = []
        for o in doc.resolve(d.get("Opt")) or []:
            o = doc.resolve(o)
            options.append(field_value(doc, o[-1] if isinstance(o, list) and o else o))
        holder = next((k.num for k in kids if isinstance(k, Ref) and k.num in of_widget), ref.num)
        out.append({
            "obj_num": ref.num, "name": name or f"Field_{ref.num}", "alt_name": text_of(doc.resolve(d.get("TU"))), "field_type": shape, "value": field_value(doc, d.get("V")), "default_value": field_value(doc, d.get("DV")),
            "rect": rect(doc, widget.get("Rect")) or FIELD_RECT, "page_number": place.get(page.num) if isinstance(page, Ref) and page.num in place else of_widget.get(holder, 1), "options": options, "flags": bits,
            "is_read_only": bool(bits & READ_ONLY), "is_required": bool(bits & REQUIRED), "is_multiline": bool(bits & MULTILINE) and shape == "text", "max_length": doc.resolve(d.get("MaxLen")),
        })

    for f in doc.resolve(form.get("Fields")) or []:
        walk(f, "", None, None, 0)
    return out


# --- annotations, outlines -------------------------------------------------------------------------------------------------


def _colour(doc, x) -> list[float] | None:
    x = doc.resolve(x)
    return [float(v) for v in x] if isinstance(x, list) and x and all(isinstance(v, (int, float)) for v in x) else None


def destination(doc: Document, x, pages: list[Ref]) -> dict | None:
    """(page_number, top, left, zoom) of an explicit destination."""
    x = doc.resolve(x)
    x = doc.resolve(x.get("D")) if isinstance(x, dict) else x
    if not isinstance(x, list) or not x:
        return None
    number = next((i + 1 for i, p in enumerate(pages) if isinstance(x[0], Ref) and p.num == x[0].num), x[0] + 1 if type(x[0]) is int else None)
    if number is None:
        return None
    v = [doc.resolve(y) for y in x[1:]]
    n = lambda i: float(v[i]) if i < len(v) and isinstance(v[i], (int, float)) else None
    kind = v[0] if v else None
    return {"page_number": number, "left": n(1) if kind in ("XYZ", "FitV") else None, "top": n(2) if kind == "XYZ" else n(1) if kind == "FitH" else None, "zoom": n(3) if kind == "XYZ" else None}


def web(uri: str | None) -> bool:
    return bool(uri and re.match(r"(?i)https?://", uri) and not re.search(r"[\x00-\x1f\x7f-\x9f]", uri))


def annotations(doc: Document, page: Ref, pages: list[Ref]) -> list[dict]:
    out = []
    for ref in doc.resolve(doc.dict_of(page).get("Annots")) or []:
        d = doc.dict_of(ref)
        kind = str(doc.resolve(d.get("Subtype")) or "")
        if not d or kind == "Widget":
            continue
        action, opacity = doc.dict_of(d.get("A")), doc.resolve(d.get("CA"))
        uri = text_of(doc.resolve(action.get("URI"))) if doc.resolve(action.get("S")) == "URI" else None
        dest = destination(doc, d.get("Dest") if "Dest" in d else action.get("D") if doc.resolve(action.get("S")) == "GoTo" else None, pages)
        ink = doc.resolve(d.get("InkList"))
        flat = [doc.resolve(p) for p in ink] if isinstance(ink, list) else [doc.resolve(d[k]) for k in ("L", "Vertices", "QuadPoints") if k in d][:1]
        points = [[float(p[i]), float(p[i + 1])] for p in flat if isinstance(p, list) for i in range(0, len(p) - 1, 2) if all(isinstance(x, (int, float)) for x in p[i : i + 2])]
        border = doc.resolve(doc.dict_of(d.get("BS")).get("W"))
        ends = doc.resolve(d.get("LE"))
        out.append({
            "obj_num": ref.num if isinstance(ref, Ref) else None, "subtype": kind, "rect": rect(doc, d.get("Rect")) or (0.0, 0.0, 0.0, 0.0), "color": _colour(doc, d.get("C")),
            "opacity": float(opacity) if isinstance(opacity, (int, float)) else 0.4 if kind == "Highlight" else 1.0, "contents": text_of(doc.resolve(d.get("Contents"))), "link_uri": uri,
            "link_page": dest["page_number"] - 1 if dest else None, "stamp": str(doc.resolve(d.get("Name"))) if kind == "Stamp" and "Name" in d else None, "date": text_of(doc.resolve(d.get("M"))),
            "border_width": float(border) if isinstance(border, (int, float)) else None, "fill": _colour(doc, d.get("IC")), "points": points, "line_ending": str(ends[-1]) if isinstance(ends, list) and ends else None,
        })
    return out


def outlines(doc: Document) -> list[dict]:
    pages, out, seen = doc.pages(), [], set()

    def walk(ref, path: list[int]):
        i = 0
        while isinstance(ref, Ref) and ref.num not in seen and len(path) < doc.limits.depth:
            seen.add(ref.num)
            d = doc.dict_of(ref)
            action = doc.dict_of(d.get("A"))
            uri = text_of(doc.resolve(action.get("URI")))
            dest = destination(doc, d.get("Dest") if "Dest" in d else action.get("D"), pages) or {}
            flags, count = doc.resolve(d.get("F")) or 0, doc.resolve(d.get("Count")) or 0
            out.append({
                "path": [*path, i], "title": text_of(doc.resolve(d.get("Title"))) or "", "page_number": dest.get("page_number"), "top": dest.get("top"), "left": dest.get("left"), "zoom": dest.get("zoom"),
                "uri": uri if web(uri) else None, "is_open": count >= 0, "bold": bool(flags & 2), "italic": bool(flags & 1), "color": _colour(doc, d.get("C")),
            })
            walk(d.get("First"), [*path, i])
            ref, i = d.get("Next"), i + 1

    walk(doc.dict_of(doc.catalog.get("Outlines")).get("First"), [])
    return out


# --- attachments, metadata -------------------------------------------------------------------------------------------------


def name_tree(doc: Document, node, depth: int = 0) -> list[tuple[str, object]]:
    d = doc.dict_of(node)
    names = doc.resolve(d.get("Names")) or []
    out = [(text_of(doc.resolve(k)) or "", v) for k, v in zip(names[::2], names[1::2])]
    for kid in doc.resolve(d.get("Kids")) or [] if depth < doc.limits.depth else []:
        out += name_tree(doc, kid, depth + 1)
    return out


def attachments(doc: Document) -> list[dict]:
    """From the name tree, then from file annotations; a file specification counts once."""
    todo = [(n, r, "document", None) for n, r in name_tree(doc, doc.dict_of(doc.catalog.get("Names")).get("EmbeddedFiles"))]
    for i, p in enumerate(doc.pages()):
        for a in doc.resolve(doc.dict_of(p).get("Annots")) or []:
            d = doc.dict_of(a)
            if doc.resolve(d.get("Subtype")) == "FileAttachment":
                todo.append(("", d.get("FS"), "annotation", i + 1))
    out, seen = [], set()
    for name, ref, origin, page in todo:
        if isinstance(ref, Ref):
            if ref.num in seen:
                continue
            seen.add(ref.num)
        spec = doc.dict_of(ref)
        files = doc.dict_of(spec.get("EF"))
        s = doc.resolve(files.get("UF") or files.get("F"))
        if not isinstance(s, Stream):
            continue
        data, params = decoded(s, doc), doc.dict_of(s.dict.get("Params"))
        file = text_of(doc.resolve(spec.get("UF"))) or text_of(doc.resolve(spec.get("F"))) or name
        said = doc.resolve(params.get("CheckSum"))
        out.append({
            "name": name or file, "filename": file, "mime": str(doc.resolve(s.dict.get("Subtype")) or "application/octet-stream"), "size": len(data), "description": text_of(doc.resolve(spec.get("Desc"))),
            "created": text_of(doc.resolve(params.get("CreationDate"))), "modified": text_of(doc.resolve(params.get("ModDate"))), "md5": said.hex() if isinstance(said, bytes) and len(said) == 16 else hashlib.md5(data).hexdigest(),
            "sha256": hashlib.sha256(data).hexdigest(), "origin": origin, "page_number": page, "data": data,
        })
    return out


INFO = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "creation_date": "CreationDate", "mod_date": "ModDate"}
_XMP = {"title": "dc:title", "author": "dc:creator", "subject": "dc:description", "keywords": "pdf:Keywords", "creator": "xmp:CreatorTool", "producer": "pdf:Producer", "creation_date": "xmp:CreateDate", "mod_date": "xmp:ModifyDate"}


def metadata(doc: Document) -> dict[str, str | None]:
    """The information dictionary, then XMP, field by field."""
    from html import unescape

    info = doc.dict_of(doc.trailer.get("Info"))
    s = doc.resolve(doc.catalog.get("Metadata"))
    xmp = decoded(s, doc).decode("utf-8", "replace") if isinstance(s, Stream) else ""
    out = {}
    for k, key in INFO.items():
        v = text_of(doc.resolve(info.get(key)))
        if v is None and xmp:
            tag = re.escape(_XMP[k])
            m = re.search(rf"<{tag}[^>]*>(.*?)</{tag}>", xmp, re.S) or re.search(rf'{tag}="([^"]*)"', xmp)
            v = unescape(re.sub(r"<[^>]*>", "", m[1])).strip() if m else None
        out[k] = v
    return out


# --- structure, conformance, signatures ------------------------------------------------------------------------------------


def structure(doc: Document) -> list[dict]:
    place = {p.num: i + 1 for i, p in enumerate(doc.pages())}
    out, seen = [], set()

    def walk(x, path, page, depth):
        if depth > doc.limits.depth:
            return
        ref, v = x, doc.resolve(x)
        if isinstance(ref, Ref):
            if ref.num in seen:
                return
            seen.add(ref.num)
        if isinstance(v, list):
            for i, y in enumerate(v):
                walk(y, [*path, i], page, depth + 1)
        elif isinstance(v, dict) and "S" in v:
            p = v.get("Pg")
            page = place.get(p.num, page) if isinstance(p, Ref) else page
            kids = doc.resolve(v.get("K"))
            kids = kids if isinstance(kids, list) else [] if kids is None else [v["K"]]
            ids = [k if type(k) is int else doc.dict_of(k).get("MCID") for k in map(doc.resolve, kids)]
            t = lambda k: text_of(doc.resolve(v.get(k)))
            out.append({"path": path, "struct_type": str(doc.resolve(v["S"])), "title": t("T"), "alt": t("Alt"), "actual_text": t("ActualText"), "lang": t("Lang"), "page_number": page, "mcids": [i for i in ids if type(i) is int]})
            for i, k in enumerate(kids):
                walk(k, [*path, i], page, depth + 1)

    root = doc.dict_of(doc.catalog.get("StructTreeRoot"))
    walk(root.get("K"), [0], None, 0)
    return out


def ua_issues(doc: Document) -> list[str]:
    """What keeps a document from being accessible: a code for each thing missing."""
    c = doc.catalog
    found = structure(doc)
    roles = {str(k): str(doc.resolve(v)) for k, v in doc.dict_of(doc.dict_of(c.get("StructTreeRoot")).get("RoleMap")).items()}
    s = doc.resolve(c.get("Metadata"))
    xmp = decoded(s, doc) if isinstance(s, Stream) else b""
    tests = {
        "NOT_MARKED": doc.resolve(doc.dict_of(c.get("MarkInfo")).get("Marked")) is not True, "NO_STRUCTURE": not found, "NO_LANGUAGE": not text_of(doc.resolve(c.get("Lang"))),
        "NO_TITLE": not metadata(doc)["title"], "TITLE_NOT_SHOWN": doc.resolve(doc.dict_of(c.get("ViewerPreferences")).get("DisplayDocTitle")) is not True, "NO_UA_IDENTIFIER": b"pdfuaid:part" not in xmp,
        "FIGURE_WITHOUT_ALT": any(roles.get(e["struct_type"], e["struct_type"]) == "Figure" and not (e["alt"] or e["actual_text"]) for e in found),
    }
    return [k for k, bad in tests.items() if bad]


def archive_issues(doc: Document, part: int = 1) -> list[str]:
    c = doc.catalog
    s = doc.resolve(c.get("Metadata"))
    xmp = decoded(s, doc) if isinstance(s, Stream) else b""
    out = set()
    if "Encrypt" in doc.trailer:
        out.add("ENCRYPTED")
    if b"pdfaid:part" not in xmp:
        out.add("NO_ARCHIVE_IDENTIFIER")
    if not any(doc.resolve(doc.dict_of(i).get("S")) == "GTS_PDFA1" for i in doc.resolve(c.get("OutputIntents")) or []):
        out.add("NO_OUTPUT_INTENT")
    if doc.dict_of(c.get("Names")).get("JavaScript") or doc.dict_of(c.get("OpenAction")).get("JS"):
        out.add("JAVASCRIPT")
    if part == 1 and attachments(doc):
        out.add("EMBEDDED_FILES")
    for p in doc.pages():
        for f in doc.dict_of(doc.dict_of(doc.inherited(p, "Resources")).get("Font")).values():
            d = doc.dict_of(f)
            d = doc.dict_of((doc.resolve(d.get("DescendantFonts")) or [None])[0]) if "DescendantFonts" in d else d
            if not any(k in doc.dict_of(d.get("FontDescriptor")) for k in ("FontFile", "FontFile2", "FontFile3")):
                out.add("FONT_NOT_EMBEDDED")
    return sorted(out)


def signatures(doc: Document) -> list[dict]:
    """Every signature dictionary; its range is valid if it covers the file but for its own hex string. Digests of certificates aren't checked."""
    doc.load_all()
    holder = {}
    for f in form_fields(doc):
        v = doc.dict_of(f["obj_num"] and Ref(f["obj_num"], 0)).get("V")
        if isinstance(v, Ref):
            holder[v.num] = f
    out = []
    for num, d in sorted(doc.objects.items()):
        if not isinstance(d, dict) or doc.resolve(d.get("Type")) != "Sig":
            continue
        r = [int(doc.resolve(x)) for x in doc.resolve(d.get("ByteRange")) or []]
        raw = doc.resolve(d.get("Contents"))
        ok = len(r) == 4 and r[0] == 0 and r[1] < r[2] and r[2] + r[3] == len(doc.data) and doc.data[r[1] : r[1] + 1] == b"<" and doc.data[r[2] - 1 : r[2]] == b">"
        digest = hashlib.sha256(doc.data[: r[1]] + doc.data[r[2] :]).hexdigest() if ok else None
        f, t = holder.get(num, {}), lambda k: text_of(doc.resolve(d.get(k)))  # noqa: B023
        out.append({"field_name": f.get("name"), "signer_name": t("Name"), "reason": t("Reason"), "location": t("Location"), "date": t("M"), "sub_filter": str(doc.resolve(d.get("SubFilter")) or ""), "byte_range": r, "contents_hex": raw.hex() if isinstance(raw, bytes) else "", "byte_range_valid": ok, "digest": digest, "rect": f.get("rect"), "page_number": f.get("page_number") or 1})
    return out

