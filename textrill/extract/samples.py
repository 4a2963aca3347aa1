"""Small writers of the formats that are read, for round trips and tests."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from xml.sax.saxutils import escape

from textrill.extract.ole import DOCUMENT, END, FREE, MAGIC, PERSIST, PERSIST_ATOM, SLIDE, SLIDE_LIST, TEXT_CHARS, USER_EDIT
from textrill.extract.pdf import PAD, rc4

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(entries: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in entries.items():
            z.writestr(name, body)
    return out.getvalue()


def docx(text: str) -> bytes:
    rows = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{rows}</w:body></w:document>"})


def xlsx_shared(text: str) -> bytes:
    rows = "".join(f"<si><t>{escape(line)}</t></si>" for line in text.split("\n"))
    return zipped({"xl/sharedStrings.xml": f"<sst>{rows}</sst>"})


def xlsx_inline(text: str) -> bytes:
    rows = "".join(f'<row><c t="inlineStr"><is><t>{escape(line)}</t></is></c></row>' for line in text.split("\n"))
    return zipped({"xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>"})


def pptx(text: str, per_slide: int = 20) -> bytes:
    lines = text.split("\n")
    slides = {}
    for n, i in enumerate(range(0, len(lines), per_slide), 1):
        rows = "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines[i : i + per_slide])
        slides[f"ppt/slides/slide{n}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a"><p:txBody>{rows}</p:txBody></p:sld>'
    return zipped(slides)


def odt(text: str, encrypted: bool = False) -> bytes:
    rows = "".join(f"<text:p>{escape(line)}</text:p>" for line in text.split("\n"))
    lock = "<manifest:encryption-data/>" if encrypted else ""
    return zipped({"META-INF/manifest.xml": f'<manifest:manifest xmlns:manifest="m">{lock}</manifest:manifest>', "content.xml": f'<office:body xmlns:office="o" xmlns:text="t">{rows}</office:body>'})


def pdf_objects(objects: list[bytes], trailer: bytes = b"") -> bytes:
    """A file with a classic cross-reference table."""
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1)
    out += b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, trailer, start))


def pdf_stream(data: bytes, extra: bytes = b"") -> bytes:
    return b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(data), extra, data)


def _pdf_text(text: str) -> tuple[bytes, bytes]:
    """Content and character map of a page: two-byte codes of its own, mapped back to Unicode."""
    codes = {c: i for i, c in enumerate(sorted(set(text) - {"\n"}), 1)}
    lines = b"".join(b"<%s> Tj T*\n" % "".join(f"{codes[c]:04X}" for c in line).encode() if line else b"T*\n" for line in text.split("\n"))
    rows = [f"<{n:04X}> <{c.encode('utf-16-be').hex()}>" for c, n in codes.items()]
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + "".join(f"{len(rows[i : i + 100])} beginbfchar\n" + "\n".join(rows[i : i + 100]) + "\nendbfchar\n" for i in range(0, len(rows), 100))
    return b"BT /F1 12 Tf\n" + lines + b"ET", cmap.encode()


_CATALOG, _TREE, _PAGE = b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/Count 1>>", b"<</Type/Page/Parent 2 0 R/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>>"
_FONT = b"<</Type/Font/Subtype/Type0/BaseFont/X/Encoding/Identity-H/ToUnicode 6 0 R>>"


def pdf(text: str) -> bytes:
    """Any text on one deflated page."""
    content, cmap = _pdf_text(text)
    return pdf_objects([_CATALOG, _TREE, _PAGE, pdf_stream(zlib.compress(content), b"/Filter/FlateDecode"), _FONT, pdf_stream(cmap)])


def pdf_encrypted(text: str, password: bytes = b"") -> bytes:
    """The same under the standard security handler: RC4, 128 bits, third revision."""
    owner, rights, ident = b"o" * 32, -4, b"0123456789abcdef"
    key = hashlib.md5((password + PAD)[:32] + owner + struct.pack("<i", rights) + ident).digest()
    for _ in range(50):
        key = hashlib.md5(key).digest()
    user = rc4(key, hashlib.md5(PAD + ident).digest())
    for i in range(1, 20):
        user = rc4(bytes(k ^ i for k in key), user)

    def locked(data: bytes, number: int) -> bytes:
        return rc4(hashlib.md5(key + struct.pack("<I", number)[:3] + b"\0\0").digest(), data)

    content, cmap = _pdf_text(text)
    objects = [_CATALOG, _TREE, _PAGE, pdf_stream(locked(zlib.compress(content), 4), b"/Filter/FlateDecode"), _FONT, pdf_stream(locked(zlib.compress(cmap), 6), b"/Filter/FlateDecode")]
    entry = b"<</Filter/Standard/V 2/R 3/Length 128/P %d/O<%s>/U<%s>>>" % (rights, owner.hex().encode(), (user + b"\0" * 16).hex().encode())
    return pdf_objects(objects, b"/Encrypt " + entry + b"/ID[<%s><%s>]" % (ident.hex().encode(), ident.hex().encode()))


def pdf_compressed(text: str) -> bytes:
    """The same with all but the streams in an object stream, and a cross-reference stream with a row predictor."""
    content, cmap = _pdf_text(text)
    inner = {1: _CATALOG, 2: _TREE, 3: _PAGE, 5: _FONT}
    heads, body = [], b""
    for number, data in inner.items():
        heads.append(b"%d %d" % (number, len(body)))
        body += data + b"\n"
    head = b" ".join(heads) + b"\n"
    outer = {
        4: pdf_stream(zlib.compress(content), b"/Filter/FlateDecode"),
        6: pdf_stream(cmap),
        7: pdf_stream(zlib.compress(head + body), b"/Type/ObjStm/N %d/First %d/Filter/FlateDecode" % (len(inner), len(head))),
    }
    out, rows = bytearray(b"%PDF-1.5\n"), {0: (0, 0, 65535), **{n: (2, 7, i) for i, n in enumerate(inner)}}
    for number, data in outer.items():
        rows[number] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, data)
    start = len(out)
    rows[8] = (1, start, 0)
    plain = [struct.pack(">BIH", *rows[n]) for n in range(9)]
    before, filtered = b"\0" * 7, b""
    for row in plain:
        filtered += b"\2" + bytes((a - b) & 255 for a, b in zip(row, before))
        before = row
    out += b"8 0 obj\n%s\nendobj\n" % pdf_stream(zlib.compress(filtered), b"/Type/XRef/Size 9/W[1 4 2]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 7>>")
    return bytes(out + b"startxref\n%d\n%%%%EOF" % start)


def pdf_pages(pages: int, broken: int = 0, unmapped: int = 0) -> bytes:
    """Pages of one word each; the first ones have a content no filter opens, the last ones a font without a way to Unicode."""
    kids = b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(pages))
    fonts = [b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>", b"<</Type/Font/Subtype/Type0/BaseFont/X/Encoding/Identity-H>>"]
    objects = [_CATALOG, b"<</Type/Pages/Kids[%s]/Count %d>>" % (kids, pages), *fonts]
    for i in range(pages):
        font = 4 if i >= pages - unmapped else 3
        objects.append(b"<</Type/Page/Parent 2 0 R/Contents %d 0 R/Resources<</Font<</F1 %d 0 R>>>>>>" % (6 + 2 * i, font))
        objects.append(pdf_stream(b"BT /F1 1 Tf (word) Tj ET", b"/Filter/LZWDecode" if i < broken else b""))
    return pdf_objects(objects)


def ole(streams: dict[str, bytes]) -> bytes:
    """A compound file; every stream in ordinary sectors."""
    sector, fat, body, entries = 512, [], bytearray(), []

    def add(data: bytes) -> int:
        if not data:
            return END
        first, n = len(fat), -(-len(data) // sector)
        fat.extend([first + i + 1 for i in range(n - 1)] + [END])
        body.extend(data.ljust(n * sector, b"\0"))
        return first

    for name, data in streams.items():
        entries.append((name, 2, add(data.ljust(4096, b"\0")), max(4096, len(data))))
    table = [("Root Entry", 5, END, 0), *entries]
    raw = b""
    for name, kind, start, size in table:
        label = (name + "\0").encode("utf-16-le")
        raw += struct.pack("<64sHBBIII16sI8s8sIII", label, len(label), kind, 1, FREE, FREE, FREE, b"", 0, b"", b"", start, size, 0)
    directory = add(raw.ljust(-(-len(raw) // sector) * sector, b"\0"))
    n_fat = -(-(len(fat) + 1) // (sector // 4 - 1))
    first_fat = len(fat)
    fat += [0xFFFFFFFD] * n_fat
    body += struct.pack(f"<{n_fat * sector // 4}I", *fat, *[FREE] * (n_fat * sector // 4 - len(fat)))
    head = MAGIC + b"\0" * 16 + struct.pack("<HHHHH6sIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, b"", 0, n_fat, directory, 0, 4096, END, 0, END, 0)
    return head + struct.pack("<109I", *range(first_fat, first_fat + n_fat), *[FREE] * (109 - n_fat)) + bytes(body)


def _record(kind: int, data: bytes) -> bytes:
    return struct.pack("<HH", kind, len(data)) + data


def xls(rows: list[list[str | float]], password: bool = False) -> bytes:
    """A workbook with shared strings; numbers are numbers."""
    strings = sorted({x for row in rows for x in row if isinstance(x, str)})
    place = {s: i for i, s in enumerate(strings)}
    out = _record(0x809, struct.pack("<HH", 0x600, 5) + b"\0" * 12)
    if password:
        out += _record(0x2F, b"\0" * 6)
    # shared strings; what does not fit a record goes on in the next one, after a flag of its width
    most, parts, now = 8000, [], struct.pack("<II", len(strings), len(strings))
    for s in strings:
        if len(now) + 5 > most:
            parts.append(now)
            now = b""
        now += struct.pack("<HB", len(s.encode("utf-16-le")) // 2, 1)
        raw = s.encode("utf-16-le")
        while raw:
            room = (most - len(now)) // 2 * 2
            now += raw[:room]
            raw = raw[room:]
            if raw:
                parts.append(now)
                now = b"\1"
    parts.append(now)
    out += b"".join(_record(0x3C if i else 0xFC, part) for i, part in enumerate(parts))
    out += _record(0x0A, b"") + _record(0x809, struct.pack("<HH", 0x600, 0x10) + b"\0" * 12)
    for r, row in enumerate(rows):
        for c, x in enumerate(row):
            if isinstance(x, str):
                out += _record(0xFD, struct.pack("<HHHI", r, c, 0, place[x]))
            else:
                out += _record(0x203, struct.pack("<HHHd", r, c, 0, x))
    return ole({"Workbook": out + _record(0x0A, b"")})


def _ppt_record(kind: int, data: bytes, version: int = 0, instance: int = 0) -> bytes:
    return struct.pack("<HHI", version | instance << 4, kind, len(data)) + data


def ppt(slides: list[list[str]], password: bool = False) -> bytes:
    """A presentation, one text box a paragraph list."""
    texts = [_ppt_record(SLIDE, _ppt_record(0x040C, _ppt_record(0xF00D, _ppt_record(TEXT_CHARS, "\r".join(p).encode("utf-16-le")), 15), 15), 15) for p in slides]
    order = b"".join(_ppt_record(PERSIST_ATOM, struct.pack("<IIIII", i + 2, 0, 0, 256 + i, 0)) for i in range(len(slides)))
    document = _ppt_record(DOCUMENT, _ppt_record(SLIDE_LIST, order, 15), 15)
    stream, places = b"", []
    for part in (document, *texts):
        places.append(len(stream))
        stream += part
    directory = len(stream)
    stream += _ppt_record(PERSIST, struct.pack("<I", 1 | len(places) << 20) + struct.pack(f"<{len(places)}I", *places))
    edit = len(stream)
    stream += _ppt_record(USER_EDIT, struct.pack("<IIIIIII", 0, 0, 0, directory, 1, len(places), 0))
    user = _ppt_record(0x0FF6, struct.pack("<III", 20, 0xF3D1C4DF if password else 0xE391C05F, edit) + b"\0" * 8)
    return ole({"Current User": user, "PowerPoint Document": stream})


def doc(text: str, encrypted: bool = False) -> bytes:
    """A Word 97 document with one wide piece."""
    body = text.replace("\n", "\r")
    start = 1024
    fib = bytearray(start)
    struct.pack_into("<H", fib, 0, 0xA5EC)
    struct.pack_into("<H", fib, 10, 0x0200 | (0x0100 if encrypted else 0))
    struct.pack_into("<II", fib, 24, start, start + 2 * len(body))
    struct.pack_into("<I", fib, 0x4C, len(body))
    plc = struct.pack("<II", 0, len(body)) + struct.pack("<HIH", 0, start, 0)
    clx = b"\x02" + struct.pack("<I", len(plc)) + plc
    struct.pack_into("<II", fib, 0x1A2, 0, len(clx))
    return ole({"WordDocument": bytes(fib) + body.encode("utf-16-le"), "1Table": clx})
