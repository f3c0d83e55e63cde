"""The standard security handler: AES revisions 4, 5 and 6. AES is written out here, since workers have no library for it."""

from __future__ import annotations

import hashlib
import os
import struct
from functools import lru_cache

from .cos import Document, Name, PdfError, Ref, Stream

#: Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


@lru_cache(maxsize=1)
def _tables():
    """The substitution box and its inverse, from inverses in the field of 256 elements."""
    exp, log, x = [0] * 512, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 0xFF
    exp[255:] = [exp[i - 255] for i in range(255, 512)]
    box = []
    for v in range(256):
        b = exp[255 - log[v]] if v else 0
        r = b
        for _ in range(4):
            b = ((b << 1) | (b >> 7)) & 0xFF
            r ^= b
        box.append(r ^ 0x63)
    back = [0] * 256
    for i, v in enumerate(box):
        back[v] = i
    mul = lambda k: [exp[log[v] + log[k]] if v else 0 for v in range(256)]
    return box, back, {k: mul(k) for k in (2, 3, 9, 11, 13, 14)}


@lru_cache(maxsize=64)
def _schedule(key: bytes) -> list[list[int]]:
    box, n = _tables()[0], len(key) // 4
    words, rcon = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
    while len(words) < 4 * (n + 7):
        t = list(words[-1])
        if len(words) % n == 0:
            t = [box[v] for v in t[1:] + t[:1]]
            t[0] ^= rcon
            rcon = (rcon << 1) ^ (0x11B if rcon & 0x80 else 0)
        elif n > 6 and len(words) % n == 4:
            t = [box[v] for v in t]
        words.append([a ^ b for a, b in zip(words[-n], t)])
    return [sum(words[4 * i : 4 * i + 4], []) for i in range(n + 7)]


def _block(key: bytes, x: bytes, back: bool) -> bytes:
    box, inv, mul = _tables()
    ks = _schedule(key)
    s = [a ^ b for a, b in zip(x, ks[-1 if back else 0])]
    for k in reversed(ks[:-1]) if back else ks[1:]:
        last = k is (ks[0] if back else ks[-1])
        if back:
            s = [inv[s[(i - 4 * (i % 4)) % 16]] for i in range(16)]
            s = [a ^ b for a, b in zip(s, k)]
            if not last:
                m9, m11, m13, m14 = mul[9], mul[11], mul[13], mul[14]
                s = [v for c in range(0, 16, 4) for a, b, d, e in [s[c : c + 4]] for v in (m14[a] ^ m11[b] ^ m13[d] ^ m9[e], m9[a] ^ m14[b] ^ m11[d] ^ m13[e], m13[a] ^ m9[b] ^ m14[d] ^ m11[e], m11[a] ^ m13[b] ^ m9[d] ^ m14[e])]
        else:
            s = [box[s[(i + 4 * (i % 4)) % 16]] for i in range(16)]
            if not last:
                m2, m3 = mul[2], mul[3]
                s = [v for c in range(0, 16, 4) for a, b, d, e in [s[c : c + 4]] for v in (m2[a] ^ m3[b] ^ d ^ e, a ^ m2[b] ^ m3[d] ^ e, a ^ b ^ m2[d] ^ m3[e], m3[a] ^ b ^ d ^ m2[e])]
            s = [a ^ b for a, b in zip(s, k)]
    return bytes(s)


@lru_cache(maxsize=1)
def _words():
    """The substitution and the mixing of a column as one word for each byte and row."""
    box, _, mul = _tables()
    one = [(mul[2][v] << 24) | (v << 16) | (v << 8) | mul[3][v] for v in box]
    turned = lambda n: [(w >> n) | ((w << (32 - n)) & 0xFFFFFFFF) for w in one]
    return one, turned(8), turned(16), turned(24), box


@lru_cache(maxsize=64)
def _key_words(key: bytes) -> list[tuple[int, ...]]:
    return [tuple(int.from_bytes(bytes(k[i : i + 4]), "big") for i in range(0, 16, 4)) for k in _schedule(key)]


def cbc_encrypt(key: bytes, iv: bytes, data: bytes, pad: bool = True) -> bytes:
    if pad:
        n = 16 - len(data) % 16
        data += bytes([n]) * n
    t0, t1, t2, t3, box = _words()
    first, *middle, last = _key_words(key)
    a, b, c, d = struct.unpack(">4I", iv)
    plain = struct.unpack(f">{len(data) // 4}I", data)
    out = []
    for i in range(0, len(plain), 4):
        a, b, c, d = a ^ plain[i] ^ first[0], b ^ plain[i + 1] ^ first[1], c ^ plain[i + 2] ^ first[2], d ^ plain[i + 3] ^ first[3]
        for k in middle:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ k[0], t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ k[1],
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ k[2], t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ k[3],
            )
        a, b, c, d = (
            (box[p >> 24] << 24 | box[q >> 16 & 255] << 16 | box[r >> 8 & 255] << 8 | box[s & 255]) ^ k
            for p, q, r, s, k in ((a, b, c, d, last[0]), (b, c, d, a, last[1]), (c, d, a, b, last[2]), (d, a, b, c, last[3]))
        )
        out += (a, b, c, d)
    return struct.pack(f">{len(out)}I", *out)


def cbc_decrypt(key: bytes, iv: bytes, data: bytes, pad: bool = True) -> bytes:
    if len(data) % 16:
        raise PdfError("ENCRYPTION", "encrypted bytes are no whole blocks")
    out = []
    for i in range(0, len(data), 16):
        c = data[i : i + 16]
        out.append(bytes(a ^ b for a, b in zip(_block(key, c, True), iv)))
        iv = c
    plain = b"".join(out)
    return plain[: -plain[-1]] if pad and plain and 1 <= plain[-1] <= 16 else plain


def hash5(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    return hashlib.sha256(password + salt + user).digest()


def hash6(password: bytes, salt: bytes, user: bytes = b"") -> bytes:
    """The hardened hash: rounds of AES and a hash that the AES output chooses, 64 at least."""
    k, i = hash5(password, salt, user), 0
    while True:
        e = cbc_encrypt(k[:16], k[16:32], (password + k + user) * 64, pad=False)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


def key4(password: str, o: bytes, p: int, ident: bytes, encrypt_metadata: bool = True) -> bytes:
    raw = (password.encode("latin-1", "replace") + PAD)[:32]
    h = hashlib.md5(raw + o[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + ident + (b"" if encrypt_metadata else b"\xff" * 4)).digest()
    for _ in range(50):
        h = hashlib.md5(h[:16]).digest()
    return h[:16]


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i, k in enumerate((key * (256 // len(key) + 1))[:256]):
        t = s[i]
        j = (j + t + k) & 255
        s[i] = s[j]
        s[j] = t
    out, i, j = bytearray(), 0, 0
    for c in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(c ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


@lru_cache(maxsize=64)
def user4(key: bytes, ident: bytes) -> bytes:
    x = rc4(key, hashlib.md5(PAD + ident).digest())
    for i in range(1, 20):
        x = rc4(bytes(b ^ i for b in key), x)
    return x


@lru_cache(maxsize=64)
def owner4(owner: str, user: str) -> bytes:
    h = hashlib.md5((owner.encode("latin-1", "replace") + PAD)[:32]).digest()
    for _ in range(50):
        h = hashlib.md5(h).digest()
    x = (user.encode("latin-1", "replace") + PAD)[:32]
    for i in range(20):
        x = rc4(bytes(b ^ i for b in h), x)
    return x


@lru_cache(maxsize=64)
def owner4_user(owner: str, o: bytes) -> str:
    """The user password that an owner password unlocks."""
    h = hashlib.md5((owner.encode("latin-1", "replace") + PAD)[:32]).digest()
    for _ in range(50):
        h = hashlib.md5(h).digest()
    x = o[:32]
    for i in reversed(range(20)):
        x = rc4(bytes(b ^ i for b in h), x)
    return x.split(PAD[:4])[0].decode("latin-1") if PAD[:4] in x else x.decode("latin-1")


def object_key(key: bytes, ref: Ref) -> bytes:
    return hashlib.md5(key + ref.num.to_bytes(3, "little") + ref.gen.to_bytes(2, "little") + b"sAlT").digest()


def _mapped(x, f):
    if isinstance(x, bytes):
        return f(x)
    if isinstance(x, list):
        return [_mapped(v, f) for v in x]
    if isinstance(x, dict):
        return {k: _mapped(v, f) for k, v in x.items()}
    if isinstance(x, Stream):
        return Stream(_mapped(x.dict, f), f(x.raw))
    return x


def revision(doc: Document) -> int | None:
    return doc.resolve(doc.dict_of(doc.trailer.get("Encrypt")).get("R")) if "Encrypt" in doc.trailer else None


def algorithm(doc: Document) -> str | None:
    r = revision(doc)
    return None if r is None else {6: "AES-256 (R6)", 5: "AES-256 (R5)"}.get(r, "AES-128 (R4)")


def authenticate(doc: Document, password: str) -> tuple[bytes, bool]:
    """(file key, whether the owner opened it)."""
    e = doc.dict_of(doc.trailer.get("Encrypt"))
    o, u, p, r = (doc.resolve(e.get(k)) for k in ("O", "U", "P", "R"))
    ident = (doc.resolve(doc.trailer.get("ID")) or [b""])[0]
    if r in (5, 6):
        h, pw = (hash6 if r == 6 else hash5), password.encode()[:127]
        if h(pw, o[32:40], u[:48]) == o[:32]:
            return cbc_decrypt(h(pw, o[40:48], u[:48]), bytes(16), doc.resolve(e["OE"]), pad=False), True
        if h(pw, u[32:40]) == u[:32]:
            return cbc_decrypt(h(pw, u[40:48]), bytes(16), doc.resolve(e["UE"]), pad=False), False
    elif r == 4:
        plain = doc.resolve(e.get("EncryptMetadata")) is not False
        for owner in (False, True):
            pw = owner4_user(password, o) if owner else password
            key = key4(pw, o, p, ident, plain)
            if user4(key, ident) == u[:16]:
                return key, owner
    raise PdfError("BAD_PASSWORD" if r in (4, 5, 6) else "ENCRYPTION", "the password opens nothing" if r in (4, 5, 6) else f"no revision {r}")


def open_with(doc: Document, password: str = "") -> Document:
    """Makes a loaded document readable; strings and streams are decrypted as they are read."""
    key, owner = authenticate(doc, password)
    e = doc.dict_of(doc.trailer["Encrypt"])
    perms = doc.resolve(e.get("P"))
    own = doc.trailer["Encrypt"].num if isinstance(doc.trailer["Encrypt"], Ref) else -1
    old = revision(doc) == 4

    def plain(value, ref: Ref):
        if ref.num == own:
            return value
        k = object_key(key, ref) if old else key
        return _mapped(value, lambda x: cbc_decrypt(k, x[:16], x[16:]) if len(x) >= 32 else x)

    doc.objects.clear()
    doc.decrypt, doc.owner, doc.perms = plain, owner, perms
    return doc


def permitted(perms: int, action: str) -> bool:
    """Whether ``/P`` lets a user do something; numbers are bits of it, counted from 1."""
    has = lambda *bits: all(perms >> (b - 1) & 1 for b in bits)
    ways = {"print": [(3,)], "modify": [(4,)], "copy": [(5,)], "annotate": [(6,)], "fill": [(9,), (6,)], "assemble": [(11,), (4,)], "create_field": [(4, 6)]}[action]
    return any(has(*w) for w in ways)


def encrypt(doc: Document, owner: str, user: str = "", perms: int = -4, rev: int = 6) -> Document:
    """Every string and stream encrypted; the owner password must be there."""
    if not owner:
        raise PdfError("ENCRYPTION", "there is no owner password")
    doc.load_all()
    ident = hashlib.md5(os.urandom(16)).digest()
    doc.trailer["ID"] = [ident, ident]
    cf = {Name("StdCF"): {Name("AuthEvent"): Name("DocOpen"), Name("CFM"): Name("AESV2" if rev == 4 else "AESV3"), Name("Length"): 16 if rev == 4 else 32}}
    e = {Name("Filter"): Name("Standard"), Name("V"): 4 if rev == 4 else 5, Name("R"): rev, Name("Length"): 128 if rev == 4 else 256, Name("P"): perms, Name("CF"): cf, Name("StmF"): Name("StdCF"), Name("StrF"): Name("StdCF")}
    if rev == 4:
        o = owner4(owner, user)
        key = key4(user, o, perms, ident)
        e |= {Name("O"): o, Name("U"): user4(key, ident) + bytes(16)}
    else:
        h, key, salt = (hash6 if rev == 6 else hash5), os.urandom(32), os.urandom(32)
        up, op = user.encode()[:127], owner.encode()[:127]
        u = h(up, salt[:8]) + salt[:16]
        o = h(op, salt[16:24], u) + salt[16:32]
        block = (perms & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + b"Tadb" + os.urandom(4)
        e |= {Name("U"): u, Name("O"): o, Name("UE"): cbc_encrypt(h(up, salt[8:16]), bytes(16), key, pad=False), Name("OE"): cbc_encrypt(h(op, salt[24:32], u), bytes(16), key, pad=False), Name("Perms"): _block(key, block, False)}

    def hide(num: int, value):
        k = object_key(key, Ref(num, 0)) if rev == 4 else key

        def one(x: bytes) -> bytes:
            iv = os.urandom(16)
            return iv + cbc_encrypt(k, iv, x)

        return _mapped(value, one)

    doc.objects = {n: hide(n, v) for n, v in doc.objects.items()}
    doc.trailer["Encrypt"] = doc.add(e)
    doc.decrypt = None
    return doc
