"""Fonts of a page: widths, ToUnicode maps, faces."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from .cos import Document, PdfError, Ref, Stream, decoded

#: Fixed value: glyphs that a width array may name.
CID_LIMIT = 65_536
#: Average widths of the standard faces where a file has none, in thousandths.
_STANDARD = {"courier": 600.0}


@dataclass
class Font:
    resource: str
    base: str = "Helvetica"
    composite: bool = False
    widths: dict[int, float] = field(default_factory=dict)
    default: float | None = None
    to_unicode: dict[int, str] = field(default_factory=dict)

    @property
    def face(self) -> tuple[str, int, str]:
        return css_face(self.base)

    def width(self, code: int) -> float:
        w = self.widths.get(code)
        if w is not None:
            return w
        return self.default if self.default is not None else 1000.0 if self.composite else 500.0

    def text(self, code: int) -> str:
        found = self.to_unicode.get(code)
        if found is not None:
            return found
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def css_face(base: str) -> tuple[str, int, str]:
    """(family, weight, style) of a font name; a subset tag in front is left out."""
    name = re.sub(r"^[A-Z]{6}\+", "", base)
    low = name.lower()
    family = "monospace" if re.search("courier|mono|consol", low) else "serif" if re.search("times|georgia|garamond|roman|(?<!sans)serif", low) else "sans-serif"
    return family, 700 if re.search("bold|black|heavy", low) else 400, "italic" if re.search("italic|oblique", low) else "normal"


def cmap(data: bytes) -> dict[int, str]:
    """Codes to text from the bfchar and bfrange sections of a ToUnicode map."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode() if len(h) % 4 == 0 else h.decode().zfill(len(h) + (-len(h)) % 4)).decode("utf-16-be", "replace")
    clean = lambda h: re.sub(rb"[^0-9A-Fa-f]", b"", h)
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        hexes = [clean(h) for h in re.findall(rb"<([^>]*)>", part)]
        for a, b in zip(hexes[::2], hexes[1::2]):
            if a and b:
                out[int(a, 16)] = text(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for m in re.finditer(rb"<([^>]*)>\s*<([^>]*)>\s*(?:<([^>]*)>|\[([^\]]*)\])", part):
            low, high = int(clean(m[1]) or b"0", 16), int(clean(m[2]) or b"0", 16)
            if high - low > CID_LIMIT:
                continue
            if m[3] is not None:
                first = text(clean(m[3]))
                for k in range(low, high + 1):
                    if first:
                        last = ord(first[-1]) + k - low
                        out[k] = first[:-1] + (chr(last) if last < 0x110000 else "�")
            else:
                for k, h in zip(range(low, high + 1), re.findall(rb"<([^>]*)>", m[4])):
                    out[k] = text(clean(h))
    return out


def _cid_widths(doc: Document, w) -> dict[int, float]:
    out: dict[int, float] = {}
    w = [doc.resolve(x) for x in doc.resolve(w) or []]
    i = 0
    while i < len(w) and len(out) < CID_LIMIT:
        if i + 1 < len(w) and isinstance(w[i + 1], list):
            for k, x in enumerate(w[i + 1]):
                out[int(w[i]) + k] = float(doc.resolve(x))
            i += 2
        elif i + 2 < len(w):
            for k in range(int(w[i]), min(int(w[i + 1]), int(w[i]) + CID_LIMIT) + 1):
                out[k] = float(w[i + 2])
            i += 3
        else:
            break
    return out


def page_fonts(doc: Document, page: Ref) -> dict[str, Font]:
    resources = doc.dict_of(doc.inherited(page, "Resources"))
    out = {}
    for name, ref in doc.dict_of(resources.get("Font")).items():
        try:
            out[str(name)] = font(doc, str(name), doc.dict_of(ref))
        except (PdfError, ValueError, TypeError):
            out[str(name)] = Font(str(name))
    return out


def font(doc: Document, name: str, d: dict) -> Font:
    base = str(doc.resolve(d.get("BaseFont")) or "Helvetica")
    f = Font(name, base, doc.resolve(d.get("Subtype")) == "Type0")
    tu = doc.resolve(d.get("ToUnicode"))
    if isinstance(tu, Stream):
        f.to_unicode = cmap(decoded(tu, doc))
    if f.composite:
        kid = doc.dict_of((doc.resolve(d.get("DescendantFonts")) or [None])[0])
        f.default = float(doc.resolve(kid.get("DW")) or 1000)
        f.widths = _cid_widths(doc, kid.get("W"))
    else:
        first = doc.resolve(d.get("FirstChar")) or 0
        f.widths = {first + i: float(doc.resolve(x) or 0) for i, x in enumerate(doc.resolve(d.get("Widths")) or [])}
        missing = doc.resolve(doc.dict_of(d.get("FontDescriptor")).get("MissingWidth"))
        f.default = float(missing) if missing else _STANDARD.get(next((k for k in _STANDARD if k in base.lower()), ""), None)
    return f


def embedded(doc: Document, page: Ref) -> dict[str, bytes]:
    """Font files of the page's own resources."""
    out = {}
    for name, ref in doc.dict_of(doc.dict_of(doc.dict_of(page).get("Resources")).get("Font")).items():
        d = doc.dict_of(ref)
        if "DescendantFonts" in d:
            d = doc.dict_of((doc.resolve(d["DescendantFonts"]) or [None])[0])
        fd = doc.dict_of(d.get("FontDescriptor"))
        for key in ("FontFile2", "FontFile3"):
            s = doc.resolve(fd.get(key))
            if isinstance(s, Stream):
                out[str(name)] = decoded(s, doc)
                break
    return out


def sfnt_advances(data: bytes) -> tuple[int, list[int]]:
    """(units an em, advance of each glyph) of an SFNT file."""
    try:
        n = struct.unpack(">H", data[4:6])[0]
        table = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack(">II", data[20 + 16 * i : 28 + 16 * i]) for i in range(n)}
        units = struct.unpack(">H", data[table[b"head"][0] + 18 :][:2])[0]
        count = struct.unpack(">H", data[table[b"hhea"][0] + 34 :][:2])[0]
        at = table[b"hmtx"][0]
        return units, [struct.unpack(">H", data[at + 4 * i : at + 4 * i + 2])[0] for i in range(count)]
    except (struct.error, KeyError):
        raise PdfError("FONT", "the font file makes no sense") from None
