"""Text of PDF files, from the published format: objects, filters, encryption with the empty password, fonts, content.

Everything is bounded: pages, object sizes, nesting, form depth, inflated bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
import zlib
from dataclasses import dataclass

from textrill.extract.common import ENCRYPTED, GAVE_UP, OUT_OF_TIME, Abort, Deadline, Full, Sink

MAX_NEST, MAX_PAGES, MAX_TREE, MAX_FORMS, MAX_MAP, MAX_OBJECTS = 24, 100_000, 64, 8, 65_536, 1_000_000
_SPACE, _DELIM = b"\0\t\n\x0c\r ", b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
_BLANK = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*")
_REF = re.compile(rb"(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+R(?![A-Za-z])")


class Name(str):
    """A name object."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Obj:
    value: object
    stream: bytes | None = None


class Word(str):
    """A keyword or operator."""


class Cursor:
    """Reads PDF objects from bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = _BLANK.match(self.data, self.at).end()

    def done(self) -> bool:
        self.skip()
        return self.at >= len(self.data)

    def value(self, depth: int = 0, refs: bool = True):
        """The next object, or a Word; None at the end."""
        if depth > MAX_NEST:
            raise Abort(GAVE_UP, "objects nested too deep")
        self.skip()
        d, at = self.data, self.at
        if at >= len(d):
            return None
        c = d[at : at + 1]
        if c == b"/":
            m = _REGULAR.match(d, at + 1)
            self.at = m.end() if m else at + 1
            raw = m.group() if m else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self._literal()
        if d[at : at + 2] == b"<<":
            self.at += 2
            out = {}
            while True:
                key = self.value(depth + 1, refs)
                if key is None or (isinstance(key, Word) and key == ">>"):
                    return out
                if isinstance(key, Word):
                    return out
                val = self.value(depth + 1, refs)
                if isinstance(val, Word) and val == ">>":
                    return out
                if isinstance(key, Name):
                    out[str(key)] = val
        if d[at : at + 2] == b">>":
            self.at += 2
            return Word(">>")
        if c == b"<":
            end = d.find(b">", at)
            end = len(d) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while True:
                val = self.value(depth + 1, refs)
                if val is None or (isinstance(val, Word) and val == "]"):
                    return out
                if isinstance(val, Word) and val in ("endobj", "endstream", ">>"):
                    return out
                out.append(val)
        if c in b"]{})>":
            self.at += 1
            return Word(c.decode("latin-1"))
        if refs and c.isdigit() and (m := _REF.match(d, at)):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        m = _REGULAR.match(d, at)
        self.at = m.end()
        raw = m.group()
        if re.fullmatch(rb"[+-]?\d+", raw):
            return int(raw)
        if re.fullmatch(rb"[+-]*\d*\.\d*", raw) and raw.strip(b"+-."):
            return float(b"-" * raw.startswith(b"-") + raw.lstrip(b"+-"))
        return {b"true": True, b"false": False}.get(raw, Word(raw.decode("latin-1")))

    def _literal(self) -> bytes:
        d, at, depth, out = self.data, self.at + 1, 1, bytearray()
        simple = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12}
        while at < len(d):
            c = d[at]
            if c == 92:
                at += 1
                if at >= len(d):
                    break
                e = d[at]
                if e in simple:
                    out.append(simple[e])
                elif 48 <= e <= 55:
                    m = re.compile(rb"[0-7]{1,3}").match(d, at)
                    out.append(int(m.group(), 8) & 255)
                    at = m.end() - 1
                elif e == 13:
                    at += d[at + 1 : at + 2] == b"\n"
                elif e != 10:
                    out.append(e)
            elif c == 40:
                depth += 1
                out.append(c)
            elif c == 41:
                depth -= 1
                if not depth:
                    self.at = at + 1
                    return bytes(out)
                out.append(c)
            else:
                out.append(c)
            at += 1
        self.at = len(d)
        return bytes(out)


# filters


def inflate(data: bytes, cap: int) -> bytes:
    """Deflate, no further than the cap; what was read before an error is kept."""
    for wbits in (15, -15):
        engine = zlib.decompressobj(wbits)
        out = b""
        try:
            out = engine.decompress(data, cap + 1)
        except zlib.error:
            # piece by piece, for what can be recovered
            engine, parts = zlib.decompressobj(wbits), bytearray()
            try:
                for i in range(0, len(data), 256):
                    parts += engine.decompress(data[i : i + 256], cap + 1 - len(parts))
                    if len(parts) > cap:
                        break
            except zlib.error:
                pass
            out = bytes(parts)
        if len(out) > cap:
            raise Abort(GAVE_UP, "a stream inflates past its cap")
        if out:
            return out
    return b""


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    out, group = bytearray(), []
    body = data.split(b"~>")[0]
    for c in body[2:] if body.startswith(b"<~") else body:
        if c == 122 and not group:
            out += b"\0\0\0\0"
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        group += [84] * (5 - n)
        out += (sum(x * 85 ** (4 - i) for i, x in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def unpredict(data: bytes, parms: dict) -> bytes:
    """PNG row predictors."""
    kind = parms.get("Predictor", 1)
    if kind in (None, 1):
        return data
    if not isinstance(kind, int) or kind < 10:
        raise Abort(GAVE_UP, "an unsupported predictor")
    colors, bits, columns = (parms.get(k, d) for k, d in (("Colors", 1), ("BitsPerComponent", 8), ("Columns", 1)))
    if not all(isinstance(x, int) and 0 < x < 1 << 20 for x in (colors, bits, columns)):
        raise Abort(GAVE_UP, "a broken predictor")
    width = (colors * bits * columns + 7) // 8
    step = max(1, colors * bits // 8)
    out, before = bytearray(), bytearray(width)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            a = row[i - step] if i >= step else 0
            b = before[i]
            c = before[i - step] if i >= step else 0
            if kind == 1:
                row[i] = (row[i] + a) & 255
            elif kind == 2:
                row[i] = (row[i] + b) & 255
            elif kind == 3:
                row[i] = (row[i] + (a + b) // 2) & 255
            elif kind == 4:
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[i] = (row[i] + near) & 255
        out += row
        before = row.ljust(width, b"\0") if len(row) < width else row
    return bytes(out)


# encryption with the empty user password

# The padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    """Product in the field of AES."""
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = (a << 1) ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _sbox() -> list[int]:
    inverse = [0] * 256
    for a in range(1, 256):
        x = a
        for _ in range(253):  # a^254
            x = _times(x, a)
        inverse[a] = x
    turn = lambda x, n: ((x << n) | (x >> (8 - n))) & 255
    return [v ^ turn(v, 1) ^ turn(v, 2) ^ turn(v, 3) ^ turn(v, 4) ^ 0x63 for v in inverse]


_aes: dict[str, list] = {}


def aes_cbc_decrypt(key: bytes, data: bytes) -> bytes:
    """AES-128 in CBC mode; the first block is the initial vector, the padding is removed."""
    if len(data) < 32 or len(key) != 16:
        return b""
    if not _aes:
        s = _sbox()
        _aes["s"], _aes["i"] = s, [s.index(x) for x in range(256)]
        _aes["m"] = [[_times(x, k) for x in range(256)] for k in (9, 11, 13, 14)]
    s, inv, (m9, m11, m13, m14) = _aes["s"], _aes["i"], _aes["m"]
    words, rcon = [list(key[i : i + 4]) for i in range(0, 16, 4)], 1
    for i in range(4, 44):
        w = list(words[-1])
        if i % 4 == 0:
            w = [s[w[1]] ^ rcon, s[w[2]], s[w[3]], s[w[0]]]
            rcon = _times(rcon, 2)
        words.append([a ^ b for a, b in zip(words[i - 4], w)])
    rounds = [sum(words[4 * r : 4 * r + 4], []) for r in range(11)]
    order = [0, 13, 10, 7, 4, 1, 14, 11, 8, 5, 2, 15, 12, 9, 6, 3]
    out = bytearray()
    for at in range(16, len(data) - 15, 16):
        b = [x ^ k for x, k in zip(data[at : at + 16], rounds[10])]
        for r in range(9, -1, -1):
            b = [inv[b[i]] ^ k for i, k in zip(order, rounds[r])]
            if r:
                b = [
                    x
                    for c in range(0, 16, 4)
                    for x in (
                        m14[b[c]] ^ m11[b[c + 1]] ^ m13[b[c + 2]] ^ m9[b[c + 3]],
                        m9[b[c]] ^ m14[b[c + 1]] ^ m11[b[c + 2]] ^ m13[b[c + 3]],
                        m13[b[c]] ^ m9[b[c + 1]] ^ m14[b[c + 2]] ^ m11[b[c + 3]],
                        m11[b[c]] ^ m13[b[c + 1]] ^ m9[b[c + 2]] ^ m14[b[c + 3]],
                    )
                ]
        out += bytes(x ^ p for x, p in zip(b, data[at - 16 : at]))
    n = out[-1] if out else 0
    return bytes(out[:-n] if 1 <= n <= 16 else out)


class Crypt:
    """The standard security handler, opened with the empty user password."""

    def __init__(self, entry: dict, first_id: bytes, resolve):
        g = lambda k, d=None: resolve(entry.get(k, d))
        v, r, length = g("V", 0), g("R", 0), g("Length", 40) or 40
        if (v, r) not in ((1, 2), (1, 3), (2, 3), (4, 4)):
            raise Abort(ENCRYPTED, f"PDF: security handler version {v}, revision {r} is not opened")
        self.aes = False
        if v == 4:
            filters = g("CF") or {}
            chosen = resolve(filters.get(str(g("StmF") or "Identity"))) or {}
            self.aes = resolve(chosen.get("CFM")) == "AESV2"
            length = 128
        n = 5 if r == 2 else max(5, min(16, length // 8))
        owner, user, rights = g("O") or b"", g("U") or b"", g("P") or 0
        raw = PAD + owner[:32] + struct.pack("<I", rights & 0xFFFFFFFF) + first_id
        if r >= 4 and g("EncryptMetadata", True) is False:
            raw += b"\xff\xff\xff\xff"
        key = hashlib.md5(raw).digest()
        if r >= 3:
            for _ in range(50):
                key = hashlib.md5(key[:n]).digest()
        self.key = key[:n]
        if r == 2:
            good = rc4(self.key, PAD) == user[:32]
        else:
            x = rc4(self.key, hashlib.md5(PAD + first_id).digest())
            for i in range(1, 20):
                x = rc4(bytes(k ^ i for k in self.key), x)
            good = x == user[:16]
        if not good:
            raise Abort(ENCRYPTED, "PDF: the empty password does not open it")

    def open(self, data: bytes, number: int, generation: int) -> bytes:
        salt = struct.pack("<I", number)[:3] + struct.pack("<I", generation)[:2] + (b"sAlT" if self.aes else b"")
        key = hashlib.md5(self.key + salt).digest()[: min(16, len(self.key) + 5)]
        return aes_cbc_decrypt(key, data) if self.aes else rc4(key, data)


class Document:
    """Objects of a file, over its tables or, where they are broken, over a scan."""

    def __init__(self, data: bytes, deadline: Deadline, cap: int):
        if b"%PDF-" not in data[:1024]:
            raise Abort(GAVE_UP, "PDF: no header in the first kilobyte")
        self.data, self.deadline, self.cap = data, deadline, cap
        self.places: dict[int, tuple] = {}
        self.trailer: dict = {}
        self.cache: dict[int, Obj | None] = {}
        self.packed: dict[int, dict[int, object]] = {}
        self.crypt = None
        try:
            self._tables()
        except (Abort, ValueError, IndexError, struct.error, RecursionError):
            self.places, self.trailer = {}, {}
        self.cache.clear()
        if not isinstance(self.resolve(self.trailer.get("Root")), dict):
            self._scan()
        if isinstance(self.trailer.get("Encrypt"), (dict, Ref)):
            entry, ids = self.resolve(self.trailer["Encrypt"]), self.resolve(self.trailer.get("ID")) or [b""]
            self.cache.clear()
            self.packed.clear()
            if not isinstance(entry, dict):
                raise Abort(ENCRYPTED, "PDF: a security handler other than the standard one")
            self.encrypt_ref = self.trailer["Encrypt"]
            self.crypt = Crypt(entry, ids[0] if ids and isinstance(ids[0], bytes) else b"", self.resolve)
            self.cache.clear()
            self.packed.clear()

    def _tables(self) -> None:
        m = list(re.finditer(rb"startxref\s+(\d+)", self.data[-2048:]))
        at, seen = int(m[-1][1]) if m else -1, set()
        if at < 0:
            raise Abort(GAVE_UP, "no startxref")
        todo = [at]
        while todo:
            at = todo.pop(0)
            if at in seen or not 0 <= at < len(self.data) or len(seen) > 1000:
                continue
            seen.add(at)
            cursor = Cursor(self.data, at)
            cursor.skip()
            if self.data.startswith(b"xref", cursor.at):
                cursor.at += 4
                while True:
                    head = cursor.value(refs=False)
                    if not isinstance(head, int):
                        break
                    count = cursor.value(refs=False)
                    if not isinstance(count, int) or not 0 <= count <= MAX_OBJECTS:
                        raise Abort(GAVE_UP, "a broken cross-reference table")
                    for i in range(count):
                        self.deadline.check()
                        offset, generation, kind = cursor.value(refs=False), cursor.value(refs=False), cursor.value(refs=False)
                        if kind == "n" and isinstance(offset, int):
                            self.places.setdefault(head + i, ("at", offset, generation))
                        elif kind == "f":
                            self.places.setdefault(head + i, ("free",))
                trailer = cursor.value()
                if not isinstance(trailer, dict):
                    raise Abort(GAVE_UP, "no trailer")
                if isinstance(trailer.get("XRefStm"), int):
                    todo.append(trailer["XRefStm"])
            else:
                obj = self._parse(at)
                if obj is None or obj.stream is None or not isinstance(obj.value, dict):
                    raise Abort(GAVE_UP, "no cross-reference stream where one is announced")
                trailer = obj.value
                self._table_stream(trailer, self.decode(trailer, obj.stream, None))
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            if isinstance(trailer.get("Prev"), int):
                todo.append(trailer["Prev"])

    def _table_stream(self, head: dict, raw: bytes) -> None:
        w = head.get("W")
        if not (isinstance(w, list) and len(w) == 3 and all(isinstance(x, int) and 0 <= x <= 8 for x in w) and sum(w)):
            raise Abort(GAVE_UP, "a broken cross-reference stream")
        index = head.get("Index") or [0, head.get("Size", 0)]
        at = 0
        for first, count in zip(index[::2], index[1::2]):
            for i in range(min(count, MAX_OBJECTS)):
                if at + sum(w) > len(raw):
                    return
                self.deadline.check()
                cells, x = [], at
                for n in w:
                    cells.append(int.from_bytes(raw[x : x + n], "big"))
                    x += n
                at = x
                kind = cells[0] if w[0] else 1
                self.places.setdefault(first + i, ("at", cells[1], cells[2]) if kind == 1 else ("in", cells[1], cells[2]) if kind == 2 else ("free",))

    def _scan(self) -> None:
        """Every 'n g obj' of the file, the last of each number; trailers and object streams too."""
        found = {}
        for m in re.finditer(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj", self.data):
            self.deadline.check()
            found[int(m[1])] = ("at", m.start(), int(m[2]))
            if len(found) > MAX_OBJECTS:
                raise Abort(GAVE_UP, "too many objects")
        self.places = found
        self.cache.clear()
        for m in re.finditer(rb"trailer", self.data):
            value = Cursor(self.data, m.end()).value()
            if isinstance(value, dict):
                self.trailer |= value
        for number in list(found):
            obj = self.get(number)
            kind = obj.value.get("Type") if obj and isinstance(obj.value, dict) else None
            if kind == "XRef":
                self.trailer = {**obj.value, **self.trailer}
            elif kind == "ObjStm":
                for inner in self._unpack(number):
                    self.places.setdefault(inner, ("in", number, 0))
        if not isinstance(self.resolve(self.trailer.get("Root")), dict):
            for number in list(self.places):
                obj = self.get(number)
                if obj and isinstance(obj.value, dict) and obj.value.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(number, 0)

    def _parse(self, at: int, number: int | None = None) -> Obj | None:
        m = re.compile(rb"[\0\t\n\x0c\r ]*(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj").match(self.data, at)
        if not m or (number is not None and int(m[1]) != number):
            return None
        cursor = Cursor(self.data, m.end())
        value = cursor.value()
        cursor.skip()
        if not isinstance(value, dict) or not self.data.startswith(b"stream", cursor.at):
            return Obj(value)
        start = cursor.at + 6
        start += 2 if self.data[start : start + 2] == b"\r\n" else 1 if self.data[start : start + 1] in (b"\n", b"\r") else 0
        length = value.get("Length")
        length = self.resolve(length) if isinstance(length, Ref) else length
        if isinstance(length, int) and 0 <= length <= len(self.data) - start and re.compile(rb"\s*endstream").match(self.data, start + length):
            return Obj(value, self.data[start : start + length])
        end = self.data.find(b"endstream", start)
        body = self.data[start : end if end >= 0 else len(self.data)]
        return Obj(value, body[:-2] if body.endswith(b"\r\n") else body[:-1] if body.endswith((b"\n", b"\r")) else body)

    def get(self, number: int) -> Obj | None:
        if number in self.cache:
            return self.cache[number]
        self.cache[number] = None  # a cycle finds nothing
        place = self.places.get(number, ("free",))
        obj = None
        if place[0] == "at":
            obj = self._parse(place[1], number)
            if obj is None and place[1] >= 0:
                near = re.compile(rb"(?<![0-9])%d[\0\t\n\x0c\r ]+\d{1,5}[\0\t\n\x0c\r ]+obj" % number).search(self.data)
                obj = self._parse(near.start(), number) if near else None
            if obj and self.crypt and not (isinstance(self.encrypt_ref, Ref) and self.encrypt_ref.number == number):
                obj = self._decrypted(obj, number, place[2] if isinstance(place[2], int) else 0)
        elif place[0] == "in":
            value = self._unpack(place[1]).get(number)
            obj = Obj(value) if value is not None else None
        if len(self.cache) > 20_000:
            self.cache.clear()
        self.cache[number] = obj
        return obj

    def _decrypted(self, obj: Obj, number: int, generation: int) -> Obj:
        def strings(v):
            if isinstance(v, bytes):
                return self.crypt.open(v, number, generation)
            if isinstance(v, list):
                return [strings(x) for x in v]
            if isinstance(v, dict):
                return {k: strings(x) for k, x in v.items()}
            return v

        plain = isinstance(obj.value, dict) and obj.value.get("Type") == "XRef"
        stream = obj.stream
        if stream is not None and not plain:
            stream = self.crypt.open(stream, number, generation)
        return Obj(obj.value if plain else strings(obj.value), stream)

    def _unpack(self, number: int) -> dict[int, object]:
        """The objects of an object stream."""
        if number in self.packed:
            return self.packed[number]
        self.packed[number] = out = {}
        obj = self.get(number)
        if obj and obj.stream is not None and isinstance(obj.value, dict):
            raw = self.decode(obj.value, obj.stream, None)
            n, first = self.resolve(obj.value.get("N")), self.resolve(obj.value.get("First"))
            if isinstance(n, int) and isinstance(first, int):
                head = Cursor(raw[:first])
                for _ in range(min(n, MAX_OBJECTS)):
                    a, b = head.value(refs=False), head.value(refs=False)
                    if not isinstance(a, int) or not isinstance(b, int) or first + b >= len(raw):
                        break
                    self.deadline.check()
                    out[a] = Cursor(raw, first + b).value()
        return out

    def resolve(self, value):
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            obj = self.get(value.number)
            value = obj.value if obj else None
        return None

    def stream(self, value) -> tuple[dict, bytes] | None:
        """Dictionary and decoded bytes of a stream that a reference names."""
        obj = self.get(value.number) if isinstance(value, Ref) else None
        if obj is None or obj.stream is None or not isinstance(obj.value, dict):
            return None
        return obj.value, self.decode(obj.value, obj.stream, value)

    def decode(self, head: dict, data: bytes, _ref) -> bytes:
        filters, parms = self.resolve(head.get("Filter")), self.resolve(head.get("DecodeParms"))
        filters = filters if isinstance(filters, list) else [] if filters is None else [filters]
        parms = parms if isinstance(parms, list) else [parms]
        for i, f in enumerate(filters):
            f, p = self.resolve(f), self.resolve(parms[i]) if i < len(parms) else None
            if f in ("FlateDecode", "Fl"):
                data = unpredict(inflate(data, self.cap), {k: self.resolve(v) for k, v in p.items()} if isinstance(p, dict) else {})
            elif f in ("ASCIIHexDecode", "AHx"):
                data = ascii_hex(data)
            elif f in ("ASCII85Decode", "A85"):
                data = ascii85(data)
            elif f == "Crypt":
                continue
            else:
                raise Abort(GAVE_UP, f"the filter {f} is not read")
            if len(data) > self.cap:
                raise Abort(GAVE_UP, "a stream is past its cap")
        return data


# fonts

# Glyph names that are no letter with an accent.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "minus": "−", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`",
    "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "section": "§", "quotedblleft": "“", "quotedblright": "”", "guillemotleft": "«",
    "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "endash": "–", "emdash": "—", "dagger": "†", "daggerdbl": "‡", "periodcentered": "·", "paragraph": "¶", "bullet": "•",
    "quotesinglbase": "‚", "quotedblbase": "„", "ellipsis": "…", "perthousand": "‰", "questiondown": "¿", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ", "Oslash": "Ø", "oslash": "ø", "Lslash": "Ł", "lslash": "ł", "germandbls": "ß",
    "ordfeminine": "ª", "ordmasculine": "º", "dotlessi": "ı", "Euro": "€", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "plusminus": "±", "multiply": "×", "divide": "÷", "mu": "µ", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ", "nbspace": " ",
}
_ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌", "breve": "̆", "macron": "̄", "ogonek": "̨", "dotaccent": "̇", "hungarumlaut": "̋"}
# The high half of the standard encoding.
STANDARD_HIGH = {0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA5: "¥", 0xA7: "§", 0xA9: "'", 0xAA: "“", 0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "fi", 0xAF: "fl", 0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚", 0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}


def glyph(name: str) -> str | None:
    if name in GLYPHS:
        return GLYPHS[name]
    if len(name) == 1:
        return name
    if len(name) > 1 and name[1:] in _ACCENTS and name[0].isalpha():
        return unicodedata.normalize("NFC", name[0] + _ACCENTS[name[1:]])
    if m := re.fullmatch(r"(?:uni|u)([0-9A-F]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else None
    if "." in name[1:]:
        return glyph(name.split(".")[0])
    return None


def base_encoding(name: str | None) -> dict[int, str]:
    codec = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}.get(name or "")
    out = {b: chr(b) for b in range(32, 127)}
    if codec:
        for b in range(128, 256):
            c = bytes([b]).decode(codec, "ignore")
            if c:
                out[b] = c
        if codec == "cp1252":
            out |= {b: "•" for b in (127, 129, 141, 143, 144, 157)} | {0xA0: " ", 0xAD: "-"}
    else:
        out |= STANDARD_HIGH | {0x27: "’", 0x60: "‘"}
    return out


def _utf16be(raw: bytes) -> str:
    return raw.decode("utf-16-be", "replace") if len(raw) > 1 else raw.decode("latin-1")


def parse_cmap(data: bytes) -> tuple[dict[int, str], set[int]]:
    """Code to text, and the code widths in bytes, of a ToUnicode map."""
    out, widths, cursor, held = {}, set(), Cursor(data), []
    while not cursor.done() and len(out) < MAX_MAP:
        value = cursor.value(refs=False)
        if not isinstance(value, Word):
            held.append(value)
            if len(held) > 3 * MAX_MAP:
                break
            continue
        if value == "endcodespacerange":
            widths |= {len(x) for x in held if isinstance(x, bytes)}
        elif value == "endbfchar":
            for a, b in zip(held[::2], held[1::2]):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out[int.from_bytes(a, "big")] = _utf16be(b)
                    widths.add(len(a))
        elif value == "endbfrange":
            for a, b, c in zip(held[::3], held[1::3], held[2::3]):
                if not isinstance(a, bytes) or not isinstance(b, bytes):
                    continue
                lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                widths.add(len(a))
                for i in range(min(hi - lo + 1, MAX_MAP - len(out))):
                    if isinstance(c, list):
                        if i < len(c) and isinstance(c[i], bytes):
                            out[lo + i] = _utf16be(c[i])
                    elif isinstance(c, bytes) and c:
                        last = int.from_bytes(c, "big") + i
                        out[lo + i] = _utf16be(last.to_bytes(max(len(c), (last.bit_length() + 7) // 8), "big"))
        held = []
    return out, widths


class Font:
    """Bytes of a shown string to text."""

    def __init__(self, doc: Document, font: dict):
        get = lambda k: doc.resolve(font.get(k))
        self.map, self.width = {}, 1
        self.usable = True
        composite = get("Subtype") == "Type0"
        if composite:
            self.width = 2
        tounicode = doc.stream(font.get("ToUnicode")) if isinstance(font.get("ToUnicode"), Ref) else None
        if tounicode:
            self.map, widths = parse_cmap(tounicode[1])
            if widths and composite:
                self.width = max(1, min(4, max(widths)))
        if composite:
            self.usable = bool(self.map)
            return
        encoding = get("Encoding")
        base = encoding if isinstance(encoding, Name) else None
        simple = base_encoding(base)
        if isinstance(encoding, dict):
            simple = base_encoding(doc.resolve(encoding.get("BaseEncoding")))
            code = 0
            for x in doc.resolve(encoding.get("Differences")) or []:
                x = doc.resolve(x)
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    c = glyph(x)
                    simple.pop(code, None)
                    if c is not None:
                        simple[code] = c
                    code += 1
        self.map = simple | self.map

    def decode(self, raw: bytes) -> str:
        if self.width == 1:
            return "".join(self.map.get(b, "") for b in raw)
        n = self.width
        return "".join(self.map.get(int.from_bytes(raw[i : i + n], "big"), "") for i in range(0, len(raw) - n + 1, n))




def _printable(text: str) -> str:
    return "".join(" " if unicodedata.category(c)[0] == "C" and c not in "\t\n\r" else c for c in text)


class Reader:
    def __init__(self, doc: Document, sink: Sink, deadline: Deadline):
        self.doc, self.sink, self.deadline = doc, sink, deadline
        self.fonts: dict = {}
        self.pages = self.unreadable = self.undecodable = 0
        self.last = ""

    def font_set(self, resources: dict) -> dict:
        out = {}
        for name, value in (self.doc.resolve(resources.get("Font")) or {}).items() if isinstance(resources, dict) and isinstance(self.doc.resolve(resources.get("Font")), dict) else ():
            key = value if isinstance(value, Ref) else None
            if key in self.fonts and key is not None:
                out[name] = self.fonts[key]
                continue
            font = self.doc.resolve(value)
            if isinstance(font, dict):
                out[name] = Font(self.doc, font)
                if key is not None and len(self.fonts) < 4096:
                    self.fonts[key] = out[name]
        return out

    def newline(self) -> None:
        """A line ends once, and never before the page's first text."""
        if self.last not in ("", "\n"):
            self.sink.accept("\n")
            self.last = "\n"

    def show(self, raw, font: Font | None) -> None:
        if not isinstance(raw, bytes) or not raw:
            return
        text = font.decode(raw) if font else ""
        if not text:
            self.undecodable += 1
            return
        text = _printable(text)
        self.sink.accept(text)
        self.last = text[-1]
        if self.sink.full:
            raise Full

    def scan(self, data: bytes, resources, depth: int = 0, visited: frozenset = frozenset()) -> None:
        if depth > MAX_FORMS:
            return
        fonts, font = self.font_set(resources), None
        cursor, held = Cursor(data), []
        while not cursor.done():
            self.deadline.check()
            value = cursor.value(refs=False)
            if not isinstance(value, Word):
                held = [*held[-255:], value]
                continue
            if value == "BI":
                end = re.compile(rb"\sEI(?=[\s]|$)").search(data, cursor.at)
                cursor.at = end.end() if end else len(data)
            elif value == "Tf":
                font = fonts.get(held[-2]) if len(held) > 1 and isinstance(held[-2], Name) else None
            elif value == "Tj" and held:
                self.show(held[-1], font)
            elif value in ("'", '"') and held:
                self.newline()
                self.show(held[-1], font)
            elif value == "TJ" and held and isinstance(held[-1], list):
                for part in held[-1]:
                    self.show(part, font)
            elif value in ("T*", "Td", "TD"):
                self.newline()
            elif value == "Do" and held and isinstance(held[-1], Name):
                self._form(held[-1], resources, depth, visited)
            held = []

    def _form(self, name: str, resources, depth: int, visited: frozenset) -> None:
        objects = self.doc.resolve(resources.get("XObject")) if isinstance(resources, dict) else None
        ref = objects.get(name) if isinstance(objects, dict) else None
        if not isinstance(ref, Ref) or ref.number in visited:
            return
        obj = self.doc.get(ref.number)
        if not obj or obj.stream is None or not isinstance(obj.value, dict) or self.doc.resolve(obj.value.get("Subtype")) != "Form":
            return
        inner = self.doc.resolve(obj.value.get("Resources"))
        self.scan(self.doc.decode(obj.value, obj.stream, ref), inner if isinstance(inner, dict) else resources, depth + 1, visited | {ref.number})

    def page(self, page: dict, resources) -> None:
        self.pages += 1
        self.last = ""
        contents = page.get("Contents")
        parts = self.doc.resolve(contents)
        refs = parts if isinstance(parts, list) else [contents]
        try:
            data = [s[1] for r in refs if (s := self.doc.stream(r))]
            if data:
                self.scan(b"\n".join(data), resources)
        except Abort as abort:
            if str(abort) == OUT_OF_TIME:
                raise
            self.unreadable += 1

    def tree(self, node, resources, depth: int, visited: set) -> None:
        if depth > MAX_TREE or self.pages >= MAX_PAGES:
            return
        if isinstance(node, Ref):
            if node.number in visited:
                return
            visited.add(node.number)
        node = self.doc.resolve(node)
        if not isinstance(node, dict):
            return
        own = self.doc.resolve(node.get("Resources"))
        resources = own if isinstance(own, dict) else resources
        kids = self.doc.resolve(node.get("Kids"))
        if isinstance(kids, list):
            for kid in kids:
                self.tree(kid, resources, depth + 1, visited)
        else:
            self.page(node, resources)


def _walked(data: bytes, sink: Sink, deadline: Deadline) -> Reader:
    doc = Document(data, deadline, max(8 * sink.budget, 8 << 20))
    catalog = doc.resolve(doc.trailer.get("Root"))
    if not isinstance(catalog, dict):
        raise Abort(GAVE_UP, "PDF: its trailer leads to no catalog")
    if not isinstance(doc.resolve(catalog.get("Pages")), dict):
        raise Abort(GAVE_UP, "PDF: its catalog leads to no pages")
    reader = Reader(doc, sink, deadline)
    reader.tree(catalog["Pages"], {}, 0, set())
    return reader


def read_pdf(data: bytes, _extension: str, sink: Sink, deadline: Deadline) -> str | None:
    reader = _walked(data, sink, deadline)
    gaps = []
    if reader.unreadable:
        gaps.append(f"PDF: pages without readable content: {reader.unreadable} of {reader.pages}")
    if reader.undecodable:
        gaps.append(f"PDF: runs of text in fonts that lead to no characters: {reader.undecodable}")
    return "; ".join(gaps) or None


def counters(data: bytes, budget: int = 64 << 20) -> tuple[int, int, int]:
    """Pages, pages that could not be read, and runs of text that could not be decoded; zeros for a broken file."""
    try:
        reader = _walked(data, Sink(budget), Deadline(None))
    except Exception:  # noqa: BLE001 - a broken file has no counters
        return 0, 0, 0
    return reader.pages, reader.unreadable, reader.undecodable
