"""PDF objects, files and streams. Objects are Python values: None, bool, int, float, Name, bytes, list, dict, Ref, Stream."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, NamedTuple


class PdfError(Exception):
    """``code`` names the kind of failure; it ends up in a status column."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


@dataclass
class Stream:
    dict: dict
    raw: bytes


class Op(str):
    """An operator of a content stream."""

    __slots__ = ()


@dataclass(frozen=True)
class Limits:
    """What a file may cost."""

    stream_bytes: int = 256 << 20
    ratio: int = 100
    exempt_in: int = 1024
    exempt_out: int = 1 << 20
    depth: int = 64
    objects: int = 500_000

    def inflated(self, size_in: int, size_out: int) -> None:
        if size_out > self.stream_bytes:
            raise PdfError("SECURITY_LIMIT", f"a stream grows beyond {self.stream_bytes} bytes")
        if size_out > max(size_in, 1) * self.ratio and not (size_in <= self.exempt_in and size_out <= self.exempt_out):
            raise PdfError("SECURITY_LIMIT", f"a stream grows more than {self.ratio} times")


LIMITS = Limits()
SPACE = b"\x00\t\n\x0c\r "
_DELIM = b"()<>[]{}/%"
_TOKEN_END = re.compile(rb"[\x00\t\n\x0c\r ()<>\[\]{}/%]")
_SKIP = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
#: What comes next, behind white space and comments (to the end of the line, never less): a name, the begin of a dictionary, a word, another delimiter; none of these at the end.
#: Only one way leads through a run of white space: where a bracket does not follow, a repeated run would be tried in all its parts, twice as many for each space.
_NEXT = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*(?![^\r\n])[\x00\t\n\x0c\r ]*)*(?:/([^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(<<)|([^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(.))?", re.S)
_DICT_END = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*(?![^\r\n])[\x00\t\n\x0c\r ]*)*>>")
_ARRAY_END = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*(?![^\r\n])[\x00\t\n\x0c\r ]*)*(?:(\])|\Z)")
_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_OBJ = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+([nf])(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
_STREAM_END = re.compile(rb"[\r\n \t]{0,2}endstream")
_INT = re.compile(rb"[+-]?\d+\Z")
_REAL = re.compile(rb"[+-]?(?:\d+\.\d*|\.\d+)\Z")
_ESCAPE = {ord("n"): b"\n", ord("r"): b"\r", ord("t"): b"\t", ord("b"): b"\b", ord("f"): b"\f"}


_WORDS = {b"true": True, b"false": False, b"null": None}


@lru_cache(maxsize=4096)
def _name(raw: bytes) -> Name:
    if b"#" in raw:
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)
    return Name(raw.decode("utf-8", "replace"))


class Lexer:
    """Reads objects from bytes; ``content`` leaves words as operators and knows no references."""

    def __init__(self, data: bytes, pos: int = 0, content: bool = False, limits: Limits = LIMITS):
        self.data, self.pos, self.content, self.limits = data, pos, content, limits

    def skip(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos).end()

    def word(self) -> bytes:
        m = _TOKEN_END.search(self.data, self.pos)
        end = m.start() if m else len(self.data)
        out, self.pos = self.data[self.pos : end], end
        return out

    def object(self, depth: int = 0) -> Any:
        """The next object; an Op for a word, EOFError at the end."""
        if depth > (32 if self.content else self.limits.depth):
            raise PdfError("SECURITY_LIMIT", "objects are nested too deeply")
        d = self.data
        m = _NEXT.match(d, self.pos)
        kind, self.pos = m.lastindex, m.end()
        if kind == 3:
            raw = m[3]
            if raw.isdigit() or _INT.match(raw):
                n = int(raw)
                if not self.content and n >= 0:
                    m = _REF.match(d, self.pos)
                    if m:
                        self.pos = m.end()
                        return Ref(n, int(m[1]))
                return n
            if _REAL.match(raw):
                return float(raw)
            return _WORDS[raw] if raw in _WORDS else Op(raw.decode("latin-1"))
        if kind == 1:
            return _name(m[1])
        if kind == 2:
            return self._dict(depth)
        if kind is None:
            raise EOFError
        p = m.start(4)
        c = d[p]
        if c == 0x28:
            self.pos = p
            return self._literal()
        if c == 0x3C:
            end = d.find(b">", p)
            if end < 0:
                raise PdfError("SYNTAX", "a hex string does not end")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[p + 1 : end])
            self.pos = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 0x5B:
            out = []
            while not (m := _ARRAY_END.match(d, self.pos)):
                out.append(self.object(depth + 1))
            self.pos = m.end()
            if not m[1]:
                raise PdfError("SYNTAX", "an array does not end")
            return out
        self.pos = p + (2 if d[p : p + 2] == b">>" else 1)
        return Op(d[p : self.pos].decode("latin-1"))

    def _literal(self) -> bytes:
        d, p, depth, out = self.data, self.pos + 1, 1, bytearray()
        while p < len(d):
            c = d[p]
            if c == 0x5C:
                p += 1
                if p >= len(d):
                    break
                e = d[p]
                if 0x30 <= e <= 0x37:
                    m = re.compile(rb"[0-7]{1,3}").match(d, p)
                    out.append(int(m[0], 8) & 255)
                    p = m.end()
                    continue
                if e in b"\r\n":
                    p += 2 if d[p : p + 2] == b"\r\n" else 1
                    continue
                out += _ESCAPE.get(e, bytes([e]))
                p += 1
                continue
            if c == 0x28:
                depth += 1
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.pos = p + 1
                    return bytes(out)
            out.append(c)
            p += 1
        raise PdfError("SYNTAX", "a string does not end")

    def _dict(self, depth: int) -> dict:
        out: dict = {}
        while True:
            m = _DICT_END.match(self.data, self.pos)
            if m:
                self.pos = m.end()
                return out
            key = self.object(depth + 1)
            if not isinstance(key, Name):
                raise PdfError("SYNTAX", "a dictionary key is no name")
            out[key] = self.object(depth + 1)

    def indirect(self, length_of=None) -> tuple[Ref, Any]:
        """``n g obj … endobj`` at the position, with its stream."""
        m = _OBJ.match(self.data, self.pos)
        if m:
            num, gen, word, self.pos = int(m[1]), int(m[2]), "obj", m.end()
        else:
            num, gen, word = self.object(), self.object(), self.object()
        if type(num) is not int or type(gen) is not int or word != "obj":
            raise PdfError("SYNTAX", f"no object at byte {self.pos}")
        value = self.object()
        self.skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", self.pos):
            p = self.pos + 6
            p += 2 if self.data[p : p + 2] == b"\r\n" else 1 if self.data[p : p + 1] in (b"\n", b"\r") else 0
            n = value.get("Length")
            n = length_of(n) if isinstance(n, Ref) and length_of else n
            # The length counts only if the stream ends there.
            if type(n) is int and n >= 0 and _STREAM_END.match(self.data, p + n):
                raw = self.data[p : p + n]
            else:
                end = self.data.find(b"endstream", p)
                if end < 0:
                    raise PdfError("SYNTAX", "a stream does not end")
                raw = self.data[p:end]
                raw = raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw[-1:] in (b"\n", b"\r") else raw
            value = Stream(value, raw)
        return Ref(num, gen), value


# --- filters ---------------------------------------------------------------------------------------------------------------


def inflate(raw: bytes, limits: Limits = LIMITS) -> bytes:
    d = zlib.decompressobj()
    out = bytearray()
    data = raw
    try:
        while data:
            part = d.decompress(data, 1 << 16)
            out += part
            limits.inflated(len(raw), len(out))
            data = d.unconsumed_tail
            if not part and not data:
                break
        out += d.flush()
    except zlib.error as e:
        if not out:
            raise PdfError("FILTER", f"deflate: {e}") from None
    limits.inflated(len(raw), len(out))
    return bytes(out)


def unpredict(data: bytes, parms: dict) -> bytes:
    predictor = int(parms.get("Predictor", 1) or 1)
    if predictor < 2:
        return data
    colors, bits, columns = (int(parms.get(k, v) or v) for k, v in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if min(colors, bits, columns) < 1 or colors * bits * columns > 1 << 27:
        raise PdfError("FILTER", "predictor parameters make no sense")
    size, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    out = bytearray()
    if predictor == 2:
        if bits != 8:
            raise PdfError("FILTER", "this predictor takes 8 bits only")
        for a in range(0, len(data), row):
            line = bytearray(data[a : a + row])
            for i in range(colors, len(line)):
                line[i] = (line[i] + line[i - colors]) & 255
            out += line
        return bytes(out)
    before = bytearray(row)
    for a in range(0, len(data), row + 1):
        kind, line = data[a], bytearray(data[a + 1 : a + 1 + row])
        if kind > 4:
            raise PdfError("FILTER", f"no row filter {kind}")
        for i in range(len(line)):
            left = line[i - size] if i >= size else 0
            up = before[i]
            if kind == 1:
                line[i] = (line[i] + left) & 255
            elif kind == 2:
                line[i] = (line[i] + up) & 255
            elif kind == 3:
                line[i] = (line[i] + (left + up) // 2) & 255
            elif kind == 4:
                corner = before[i - size] if i >= size else 0
                p = left + up - corner
                near = min(((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner)))
                line[i] = (line[i] + near[2]) & 255
        out += line
        before = line + bytearray(row - len(line))
    return bytes(out)


def ascii_hex(raw: bytes) -> bytes:
    digits = re.sub(rb"[\x00\t\n\x0c\r ]", b"", raw.split(b">")[0])
    if re.search(rb"[^0-9A-Fa-f]", digits):
        raise PdfError("FILTER", "not a hex digit")
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(raw: bytes, limits: Limits = LIMITS) -> bytes:
    out, group = bytearray(), []
    for c in raw.split(b"~>")[0]:
        if c in SPACE:
            continue
        if c == 0x7A and not group:
            out += b"\0\0\0\0"
        elif 0x21 <= c <= 0x75:
            group.append(c - 0x21)
            if len(group) == 5:
                n = 0
                for x in group:
                    n = n * 85 + x
                if n >> 32:
                    raise PdfError("FILTER", "a group of five is too large")
                out += n.to_bytes(4, "big")
                group = []
        else:
            raise PdfError("FILTER", "not a base-85 digit")
    if len(group) == 1:
        raise PdfError("FILTER", "one digit is left over")
    if group:
        n = 0
        for x in group + [84] * (5 - len(group)):
            n = n * 85 + x
        out += (n & 0xFFFFFFFF).to_bytes(4, "big")[: len(group) - 1]
    limits.inflated(len(raw), len(out))
    return bytes(out)


def decoded(stream: Stream, doc=None, limits: Limits = LIMITS) -> bytes:
    """A stream's bytes with all its filters taken off."""
    get = doc.resolve if doc else (lambda x: x)
    filters, parms = get(stream.dict.get("Filter", stream.dict.get("F"))), get(stream.dict.get("DecodeParms", stream.dict.get("DP")))
    filters = [] if filters is None else filters if isinstance(filters, list) else [filters]
    parms = parms if isinstance(parms, list) else [parms]
    data = stream.raw
    for i, f in enumerate(filters):
        p = get(parms[i]) if i < len(parms) else None
        p = {k: get(v) for k, v in p.items()} if isinstance(p, dict) else {}
        f = get(f)
        if f in ("FlateDecode", "Fl"):
            data = unpredict(inflate(data, limits), p)
        elif f in ("ASCIIHexDecode", "AHx"):
            data = ascii_hex(data)
        elif f in ("ASCII85Decode", "A85"):
            data = ascii85(data, limits)
        elif f != "Identity":
            raise PdfError("UNSUPPORTED_FILTER", f"no filter {f}")
    return data


# --- files -----------------------------------------------------------------------------------------------------------------


class Entry(NamedTuple):
    kind: str  # in_use, compressed, free
    offset: int  # or the object stream
    extra: int  # generation, or index within the object stream
    revision: int


@dataclass
class Document:
    data: bytes = b""
    xref: dict[int, Entry] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    objects: dict[int, Any] = field(default_factory=dict)
    limits: Limits = LIMITS
    decrypt: Any = None
    owner: bool = True
    perms: int = -1
    _opening: set = field(default_factory=set)
    _next: int = 0

    @classmethod
    def load(cls, data: bytes, limits: Limits = LIMITS) -> Document:
        if len(data) < 8 or not data.startswith(b"%PDF-"):
            raise PdfError("NOT_PDF", "the file does not begin as a PDF")
        at = data.rfind(b"startxref", max(0, len(data) - 2048))
        if at < 0:
            raise PdfError("XREF", "there is no startxref")
        doc = cls(data, limits=limits)
        try:
            pos = Lexer(data, at + 9).object()
        except EOFError:
            raise PdfError("XREF", "startxref has no number") from None
        seen: set[int] = set()
        todo, revision = [pos], 0
        while todo:
            pos = todo.pop(0)
            if type(pos) is not int or not 0 <= pos < len(data):
                raise PdfError("XREF", "a cross-reference table is not where it should be")
            if pos in seen:
                raise PdfError("XREF", "cross-reference tables form a loop")
            seen.add(pos)
            trailer = doc._section(pos, revision)
            for k, v in trailer.items():
                doc.trailer.setdefault(k, v)
            todo = [trailer[k] for k in ("XRefStm", "Prev") if k in trailer] + todo
            revision += 1
        if "Root" not in doc.trailer:
            raise PdfError("XREF", "the trailer names no catalog")
        return doc

    def _section(self, pos: int, revision: int) -> dict:
        lex = Lexer(self.data, pos, limits=self.limits)
        try:
            lex.skip()
            if self.data.startswith(b"xref", lex.pos):
                lex.pos += 4
                while True:
                    first = lex.object()
                    if first == "trailer":
                        return lex.object()
                    count = lex.object()
                    if type(first) is not int or type(count) is not int or count < 0 or first + count > self.limits.objects * 4:
                        raise PdfError("XREF", "a cross-reference section makes no sense")
                    for i in range(count):
                        m = _ENTRY.match(self.data, lex.pos)
                        if m:
                            offset, gen, kind, lex.pos = int(m[1]), int(m[2]), m[3].decode(), m.end()
                        else:
                            offset, gen, kind = lex.object(), lex.object(), lex.object()
                            if kind not in ("n", "f"):
                                raise PdfError("XREF", "a cross-reference entry makes no sense")
                        self._put(first + i, Entry("in_use" if kind == "n" else "free", offset, gen, revision))
            ref, s = lex.indirect()
        except EOFError:
            raise PdfError("XREF", "the cross-reference table is cut off") from None
        if not isinstance(s, Stream) or s.dict.get("Type") != "XRef":
            raise PdfError("XREF", "no cross-reference stream where one should be")
        raw = decoded(s, limits=self.limits)
        w = s.dict.get("W")
        if not isinstance(w, list) or len(w) < 3 or any(type(x) is not int or not 0 <= x <= 8 for x in w[:3]):
            raise PdfError("XREF", "field widths make no sense")
        index = s.dict.get("Index") or [0, s.dict.get("Size", 0)]
        at = 0
        for first, count in zip(index[::2], index[1::2]):
            for i in range(count):
                row = raw[at : at + sum(w)]
                if len(row) < sum(w):
                    break
                at += sum(w)
                a, b, c = row[: w[0]], row[w[0] : w[0] + w[1]], row[w[0] + w[1] :]
                kind = int.from_bytes(a, "big") if w[0] else 1
                name = {0: "free", 1: "in_use", 2: "compressed"}.get(kind)
                if name:
                    self._put(first + i, Entry(name, int.from_bytes(b, "big"), int.from_bytes(c, "big"), revision))
        return s.dict

    def _put(self, num: int, entry: Entry) -> None:
        self.xref.setdefault(num, entry)  # the newest table comes first
        if len(self.xref) > self.limits.objects:
            raise PdfError("SECURITY_LIMIT", "too many objects")

    def get(self, num: int) -> Any:
        if num in self.objects:
            return self.objects[num]
        e = self.xref.get(num)
        if e is None or e.kind == "free":
            return None
        if num in self._opening:
            raise PdfError("CIRCULAR_REFERENCE", f"object {num} needs itself")
        self._opening.add(num)
        try:
            if e.kind == "in_use":
                try:
                    ref, value = Lexer(self.data, e.offset, limits=self.limits).indirect(lambda r: self.resolve(r))
                except EOFError:
                    raise PdfError("SYNTAX", f"object {num} is cut off") from None
                if ref.num != num:
                    raise PdfError("XREF", f"object {ref.num} stands where {num} should")
                if self.decrypt and not (isinstance(value, Stream) and value.dict.get("Type") == "XRef"):
                    value = self.decrypt(value, ref)
            else:
                value = self._packed(e.offset, e.extra)
        finally:
            self._opening.discard(num)
        self.objects[num] = value
        return value

    def _packed(self, container: int, index: int) -> Any:
        s = self.get(container)
        if not isinstance(s, Stream):
            raise PdfError("OBJECT_STREAM", f"object {container} is no stream")
        n, first = self.resolve(s.dict.get("N")), self.resolve(s.dict.get("First"))
        data = decoded(s, self, self.limits)
        if type(n) is not int or type(first) is not int or not 0 <= n <= self.limits.objects or not 0 <= first <= len(data) or index >= n:
            raise PdfError("OBJECT_STREAM", "an object stream makes no sense")
        head = Lexer(data, limits=self.limits)
        at = [(head.object(), head.object()) for _ in range(n)][index][1]
        try:
            return Lexer(data, first + at, limits=self.limits).object()
        except EOFError:
            raise PdfError("OBJECT_STREAM", "an object stream is cut off") from None

    def resolve(self, x: Any) -> Any:
        for _ in range(self.limits.depth):
            if not isinstance(x, Ref):
                return x
            x = self.get(x.num)
        raise PdfError("CIRCULAR_REFERENCE", "references lead to references without end")

    def dict_of(self, x: Any) -> dict:
        x = self.resolve(x)
        return x.dict if isinstance(x, Stream) else x if isinstance(x, dict) else {}

    @property
    def catalog(self) -> dict:
        return self.dict_of(self.trailer.get("Root"))

    def pages(self) -> list[Ref]:
        """Page objects in order; nodes that say neither Page nor Pages are left out."""
        out: list[Ref] = []
        seen: set[int] = set()

        def walk(ref, depth):
            if depth > self.limits.depth:
                raise PdfError("SECURITY_LIMIT", "the page tree is too deep")
            if isinstance(ref, Ref):
                if ref.num in seen:
                    raise PdfError("CIRCULAR_REFERENCE", "the page tree has a loop")
                seen.add(ref.num)
            node = self.dict_of(ref)
            kind = self.resolve(node.get("Type"))
            if kind == "Page" and isinstance(ref, Ref):
                out.append(ref)
            elif kind == "Pages":
                for kid in self.resolve(node.get("Kids")) or []:
                    walk(kid, depth + 1)

        walk(self.catalog.get("Pages"), 0)
        return out

    def inherited(self, page: Ref | dict, key: str, hops: int = 16) -> Any:
        node = self.dict_of(page)
        for _ in range(hops + 1):
            if key in node:
                return self.resolve(node[key])
            if "Parent" not in node:
                return None
            node = self.dict_of(node["Parent"])
        return None

    def content(self, page: Ref) -> bytes:
        c = self.resolve(self.dict_of(page).get("Contents"))
        parts = c if isinstance(c, list) else [c]
        return b"\n".join(decoded(s, self, self.limits) for s in map(self.resolve, parts) if isinstance(s, Stream))

    # --- writing -----------------------------------------------------------------------------------------------------------

    def load_all(self) -> None:
        for num in list(self.xref):
            if self.xref[num].kind != "free":
                try:
                    self.get(num)
                except PdfError:
                    self.objects[num] = None

    def add(self, value: Any) -> Ref:
        # Numbers only grow: one look at all of them, then the next while it is free.
        num = self._next
        if not num or num in self.objects or num in self.xref:
            num = max(max(self.xref, default=0), max(self.objects, default=0)) + 1
        self._next = num + 1
        self.objects[num] = value
        return Ref(num, 0)

    def save(self) -> bytes:
        """The whole file written anew, with a plain cross-reference table."""
        self.load_all()
        skip = {n for n, v in self.objects.items() if v is None or isinstance(v, Stream) and v.dict.get("Type") in ("XRef", "ObjStm")}
        out, at = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}
        for num in sorted(set(self.objects) - skip):
            at[num] = len(out)
            out += b"%d 0 obj\n" % num + written(self.objects[num]) + b"\nendobj\n"
        start, size = len(out), max(at, default=0) + 1
        out += b"xref\n0 %d\n" % size
        for num in range(size):
            out += b"%010d 00000 n \n" % at[num] if num in at else b"%010d %05d f \n" % (0, 65535)
        trailer = {k: v for k, v in self.trailer.items() if k in ("Root", "Info", "ID", "Encrypt")} | {"Size": size}
        out += b"trailer\n" + written(trailer) + b"\nstartxref\n%d\n%%%%EOF\n" % start
        return bytes(out)

    def save_packed(self, per: int = 100) -> bytes:
        """The whole file written anew: plain objects in compressed containers of at most ``per``, the cross-references in a stream."""
        self.load_all()
        live = {n: v for n, v in sorted(self.objects.items()) if v is not None and not (isinstance(v, Stream) and v.dict.get("Type") in ("XRef", "ObjStm"))}
        plain = [n for n, v in live.items() if not isinstance(v, Stream)]
        last = max(live, default=0)
        entries: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
        whole = {n: v for n, v in live.items() if isinstance(v, Stream)}
        for i in range(0, len(plain), per):
            last += 1
            own = plain[i : i + per]
            bodies = [written(live[n]) for n in own]
            places, at = [], 0
            for k, (n, body) in enumerate(zip(own, bodies)):
                places.append(b"%d %d" % (n, at))
                at += len(body) + 1
                entries[n] = (2, last, k)
            head = b" ".join(places) + b"\n"
            whole[last] = compressed(head + b"\n".join(bodies), {Name("Type"): Name("ObjStm"), Name("N"): len(own), Name("First"): len(head)})
        out = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
        for n, v in whole.items():
            entries[n] = (1, len(out), 0)
            out += b"%d 0 obj\n" % n + written(v) + b"\nendobj\n"
        start, own = len(out), last + 1
        entries[own] = (1, start, 0)
        table = b"".join(kind.to_bytes(1, "big") + a.to_bytes(4, "big") + b.to_bytes(2, "big") for kind, a, b in (entries.get(n, (0, 0, 65535)) for n in range(own + 1)))
        trailer = {k: v for k, v in self.trailer.items() if k in ("Root", "Info", "ID")}
        out += b"%d 0 obj\n" % own + written(compressed(table, trailer | {Name("Type"): Name("XRef"), Name("Size"): own + 1, Name("W"): [1, 4, 2]})) + b"\nendobj\n"
        return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)

    @classmethod
    def empty(cls) -> Document:
        doc = cls()
        pages = doc.add({Name("Type"): Name("Pages"), Name("Kids"): [], Name("Count"): 0})
        doc.trailer["Root"] = doc.add({Name("Type"): Name("Catalog"), Name("Pages"): pages})
        return doc


def number(x: float) -> bytes:
    return (f"{x:.5f}".rstrip("0").rstrip(".") or "0").encode().replace(b"-0", b"0") if abs(x) < 5e-6 else f"{x:.5f}".rstrip("0").rstrip(".").encode()


@lru_cache(maxsize=4096)
def _written_name(x: str) -> bytes:
    return b"/" + re.sub(rb"[^!-~]|[()<>\[\]{}/%#]", lambda m: b"#%02X" % m[0][0], x.encode())


_ESCAPED = re.compile(rb"[\\()]")


def written(x: Any) -> bytes:
    """An object as it stands in a file. References lose their generation, since files are written anew."""
    kind = type(x)
    if kind is Name:
        return _written_name(x)
    if kind is Ref:
        return b"%d 0 R" % x.num
    if kind is int:
        return b"%d" % x
    if isinstance(x, dict):
        return b"<<" + b" ".join([_written_name(k if isinstance(k, str) else Name(k)) + b" " + written(x[k]) for k in sorted(x)]) + b">>"
    if isinstance(x, list):
        return b"[" + b" ".join(map(written, x)) + b"]"
    if x is None:
        return b"null"
    if x is True or x is False:
        return b"true" if x else b"false"
    if isinstance(x, Ref):
        return b"%d 0 R" % x.num
    if isinstance(x, int):
        return b"%d" % x
    if isinstance(x, float):
        return number(x)
    if isinstance(x, str):
        return _written_name(x)
    if isinstance(x, (bytes, bytearray)):
        return b"(" + _ESCAPED.sub(lambda m: b"\\" + m[0], bytes(x)).replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"
    if isinstance(x, Stream):
        return written(x.dict | {Name("Length"): len(x.raw)}) + b"\nstream\n" + x.raw + b"\nendstream"
    raise TypeError(type(x))


def text_of(x: Any) -> str | None:
    """A text string: UTF-16 with its mark, else a byte a character."""
    if isinstance(x, str):
        return str(x)
    if not isinstance(x, bytes):
        return None
    if x.startswith(b"\xfe\xff"):
        return x[2:].decode("utf-16-be", "replace")
    if x.startswith(b"\xef\xbb\xbf"):
        return x[3:].decode("utf-8", "replace")
    return x.decode("latin-1")


def text_bytes(s: str) -> bytes:
    return s.encode() if s.isascii() else b"\xfe\xff" + s.encode("utf-16-be")


def compressed(data: bytes, extra: dict | None = None) -> Stream:
    return Stream({Name("Filter"): Name("FlateDecode"), **(extra or {})}, zlib.compress(data, 9))
