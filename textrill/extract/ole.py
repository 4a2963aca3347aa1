"""OLE compound files and the old binary office formats in them: ppt, xls, doc.

Read from the published format descriptions (MS-CFB, MS-PPT, MS-XLS, MS-DOC).
Every length a file states is held against the bytes there are.
"""

from __future__ import annotations

import struct

from textrill.extract.common import ENCRYPTED, GAVE_UP, Abort, Deadline, Sink

SIZE_CAP = 32 << 20
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
MAX_DEPTH, MAX_RECORDS = 64, 250_000


class OleFile:
    """Streams of a compound file by name."""

    def __init__(self, data: bytes):
        if len(data) < 512 or not data.startswith(MAGIC):
            raise Abort(GAVE_UP, "OLE: the file has no compound-file signature")
        if len(data) > SIZE_CAP:
            raise Abort(GAVE_UP, f"OLE: {len(data):,} bytes, more than the {SIZE_CAP:,} that are read")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise Abort(GAVE_UP, "OLE: sector size neither 512 nor 4,096")
        self.sector = 1 << shift
        n_fat, first_dir, _, self.cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        fat_at = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while first_difat not in (FREE, END) and len(seen) <= n_difat:
            if first_difat in seen:
                raise Abort(GAVE_UP, "OLE: the chain of table sectors runs in a circle")
            seen.add(first_difat)
            block = self._raw(first_difat)
            *more, first_difat = struct.unpack(f"<{self.sector // 4}I", block)
            fat_at += more
        self.fat: list[int] = []
        for s in fat_at[: max(n_fat, 0)]:
            if s not in (FREE, END):
                self.fat += struct.unpack(f"<{self.sector // 4}I", self._raw(s))
        directory = self._chain(first_dir)
        self.entries: dict[str, tuple[int, int]] = {}
        root = (END, 0)
        for at in range(0, len(directory) - 127, 128):
            length, kind = struct.unpack_from("<H", directory, at + 64)[0], directory[at + 66]
            start, size = struct.unpack_from("<II", directory, at + 116)
            name = directory[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
            if kind == 5:
                root = (start, size)
            elif kind == 2:
                self.entries.setdefault(name, (start, size))
        self.mini_fat = list(struct.unpack(f"<{len(m := self._chain(first_mini)) // 4}I", m[: len(m) // 4 * 4])) if first_mini not in (FREE, END) else []
        self.mini = self._chain(root[0]) if root[0] not in (FREE, END) else b""

    def _raw(self, sector: int) -> bytes:
        at = (sector + 1) * self.sector
        block = self.data[at : at + self.sector]
        if not block:
            raise Abort(GAVE_UP, "OLE: a sector number points past the file's end")
        return block.ljust(self.sector, b"\0")

    def _chain(self, start: int) -> bytes:
        out, seen = bytearray(), set()
        while start not in (FREE, END):
            if start in seen or start >= len(self.fat):
                raise Abort(GAVE_UP, "OLE: a chain of sectors breaks off or runs in a circle")
            seen.add(start)
            out += self._raw(start)
            start = self.fat[start]
        return bytes(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        start, size = self.entries[name]
        if size > len(self.data):
            raise Abort(GAVE_UP, "OLE: a stream claims more bytes than the file has")
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = bytearray(), set()
        while start not in (FREE, END) and len(out) < size:
            if start in seen or start >= len(self.mini_fat):
                raise Abort(GAVE_UP, "OLE: a chain of small sectors breaks off or runs in a circle")
            seen.add(start)
            out += self.mini[start * 64 : start * 64 + 64]
            start = self.mini_fat[start]
        return bytes(out[:size])


def _utf16(raw: bytes) -> str:
    return raw[: len(raw) // 2 * 2].decode("utf-16-le", "replace")


# PowerPoint

PPT_ENCRYPTED = 0xF3D1C4DF
TEXT_CHARS, TEXT_BYTES, SLIDE, SLIDE_LIST, DRAWING_TEXT = 0x0FA0, 0x0FA8, 0x03EE, 0x0FF0, 0xF00D
USER_EDIT, PERSIST, DOCUMENT, PERSIST_ATOM, TEXT_REF = 0x0FF5, 0x1772, 0x03E8, 0x03F3, 0x0F9E


class _Records:
    """A bounded walk over the records of a stream."""

    def __init__(self, data: bytes, deadline: Deadline):
        self.data, self.deadline, self.left = data, deadline, MAX_RECORDS

    def children(self, start: int, end: int):
        at = start
        while at + 8 <= end:
            self.deadline.check(256)
            self.left -= 1
            if self.left < 0:
                raise Abort(GAVE_UP, "PPT: more records than are walked")
            info, kind, length = struct.unpack_from("<HHI", self.data, at)
            if at + 8 + length > end:
                raise Abort(GAVE_UP, "PPT: a record is longer than what holds it")
            yield info & 15, info >> 4, kind, at + 8, at + 8 + length
            at += 8 + length


def read_ppt(data: bytes, _extension: str, sink: Sink, deadline: Deadline) -> None:
    ole = OleFile(data)
    user = ole.stream("Current User")
    if user is None or len(user) < 20:
        raise Abort(GAVE_UP, "PPT: stream Current User expected, not found")
    token, edit = struct.unpack_from("<II", user, 12)
    if token == PPT_ENCRYPTED:
        raise Abort(ENCRYPTED, "PPT: the token of an encrypted file")
    doc = ole.stream("PowerPoint Document")
    if doc is None:
        raise Abort(GAVE_UP, "PPT: stream PowerPoint Document expected, not found")
    records = _Records(doc, deadline)
    places = _persisted(doc, edit)
    root = next((at for at in (places.get(p) for p in sorted(places)) if at is not None and at + 8 <= len(doc) and struct.unpack_from("<H", doc, at + 2)[0] == DOCUMENT), None)
    order, lists = [], {}
    if root is not None:
        length = struct.unpack_from("<I", doc, root + 4)[0]
        if root + 8 + length > len(doc):
            raise Abort(GAVE_UP, "PPT: a record is longer than what holds it")
        for _, instance, kind, a, b in records.children(root + 8, root + 8 + length):
            if kind == SLIDE_LIST and instance == 0:
                current = None
                for _, _, k, x, y in records.children(a, b):
                    if k == PERSIST_ATOM and y - x >= 4:
                        current = struct.unpack_from("<I", doc, x)[0]
                        order.append(current)
                    elif k in (TEXT_CHARS, TEXT_BYTES) and current is not None:
                        lists.setdefault(current, []).append((k, x, y))
    slides = [(p, places[p]) for p in order if p in places]
    if not slides:
        slides = [(None, a - 8) for _, _, kind, a, _ in records.children(0, len(doc)) if kind == SLIDE]
    for persist, at in slides:
        if sink.full:
            return
        if at + 8 > len(doc):
            raise Abort(GAVE_UP, "PPT: the directory places a slide past the stream's end")
        length = struct.unpack_from("<I", doc, at + 4)[0]
        if at + 8 + length > len(doc):
            raise Abort(GAVE_UP, "PPT: a record is longer than what holds it")
        _slide(records, at + 8, at + 8 + length, lists.get(persist, []), sink, 0)


def _persisted(doc: bytes, edit: int) -> dict[int, int]:
    """Where the objects lie: the newest edit's directory first, then those before it."""
    places: dict[int, int] = {}
    seen = set()
    while edit and edit not in seen and edit + 8 + 28 <= len(doc):
        seen.add(edit)
        if struct.unpack_from("<H", doc, edit + 2)[0] != USER_EDIT:
            break
        last, directory = struct.unpack_from("<I", doc, edit + 8 + 8)[0], struct.unpack_from("<I", doc, edit + 8 + 12)[0]
        if directory + 8 <= len(doc):
            length = struct.unpack_from("<I", doc, directory + 4)[0]
            at, end = directory + 8, min(len(doc), directory + 8 + length)
            while at + 4 <= end:
                head = struct.unpack_from("<I", doc, at)[0]
                first, count = head & 0xFFFFF, head >> 20
                at += 4
                for i in range(count):
                    if at + 4 > end:
                        break
                    places.setdefault(first + i, struct.unpack_from("<I", doc, at)[0])
                    at += 4
        edit = last
    return places


def _slide(records: _Records, start: int, end: int, outline: list, sink: Sink, depth: int) -> None:
    """The text of a slide's shapes, groups included; a shape may refer to the outline's text."""
    if depth > MAX_DEPTH:
        raise Abort(GAVE_UP, "PPT: groups of shapes nested deeper than is followed")
    for version, _, kind, a, b in records.children(start, end):
        if sink.full:
            return
        if kind in (TEXT_CHARS, TEXT_BYTES):
            _paragraphs(records.data, kind, a, b, sink)
        elif kind == TEXT_REF and b - a >= 4:
            i = struct.unpack_from("<I", records.data, a)[0]
            if i < len(outline):
                _paragraphs(records.data, *outline[i], sink)
        elif version == 15:
            _slide(records, a, b, outline, sink, depth + 1)


def _paragraphs(data: bytes, kind: int, a: int, b: int, sink: Sink) -> None:
    raw = data[a:b]
    text = _utf16(raw) if kind == TEXT_CHARS else raw.decode("latin-1")
    for paragraph in text.split("\r"):
        sink.accept(paragraph.replace("\x0b", "\n"))
        sink.accept("\n")


# Excel

BOF, EOF, FILEPASS, SST, CONTINUE, LABEL, LABELSST, RSTRING, BOUNDSHEET, STRING_CELL = 0x809, 0x0A, 0x2F, 0xFC, 0x3C, 0x204, 0xFD, 0xD6, 0x85, 0x207


def read_xls(data: bytes, _extension: str, sink: Sink, deadline: Deadline) -> None:
    ole = OleFile(data)
    book = ole.stream("Workbook") or ole.stream("Book")
    if book is None:
        raise Abort(GAVE_UP, "XLS: neither stream Workbook nor Book found")
    records, at = [], 0
    while at + 4 <= len(book):
        deadline.check()
        kind, length = struct.unpack_from("<HH", book, at)
        if kind == FILEPASS:
            raise Abort(ENCRYPTED, "XLS: a FILEPASS record, so the cells are enciphered")
        records.append((kind, at + 4, min(len(book), at + 4 + length)))
        at += 4 + length
    strings: list[str] = []
    row_now, wrote = None, False
    for i, (kind, a, b) in enumerate(records):
        deadline.check()
        if sink.full:
            return
        if kind == SST:
            parts = [book[a:b]]
            for k, x, y in records[i + 1 :]:
                if k != CONTINUE:
                    break
                parts.append(book[x:y])
            strings = _shared_strings(parts)
        elif kind in (LABEL, LABELSST, RSTRING) and b - a >= 6:
            row = struct.unpack_from("<H", book, a)[0]
            if kind == LABELSST:
                at_ = struct.unpack_from("<I", book, a + 6)[0] if b - a >= 10 else -1
                value = strings[at_] if 0 <= at_ < len(strings) else ""
            else:
                value = _label(book[a + 6 : b])
            if row != row_now and wrote:
                sink.accept("\n")
                wrote = False
            row_now = row
            if value:
                sink.accept(value)
                wrote = True
        elif kind in (BOF, EOF):
            if wrote:
                sink.accept("\n")
            row_now, wrote = None, False
    if wrote:
        sink.accept("\n")


def _label(raw: bytes) -> str:
    if len(raw) < 3:
        return ""
    n, flags = struct.unpack_from("<HB", raw)
    return _utf16(raw[3 : 3 + 2 * n]) if flags & 1 else raw[3 : 3 + n].decode("latin-1")


def _shared_strings(parts: list[bytes]) -> list[str]:
    """The shared strings; a string's characters may go on in the next record, which begins with its width flag."""
    out: list[str] = []
    k, at = 0, 8

    def take(n: int) -> bytes:
        nonlocal k, at
        got = b""
        while n and k < len(parts):
            piece = parts[k][at : at + n]
            got += piece
            at += len(piece)
            n -= len(piece)
            if n:
                k, at = k + 1, 0
        return got

    total = struct.unpack_from("<I", parts[0], 4)[0] if len(parts[0]) >= 8 else 0
    for _ in range(min(total, 2_000_000)):
        head = take(3)
        if len(head) < 3:
            break
        n, flags = struct.unpack("<HB", head)
        runs = struct.unpack("<H", take(2).ljust(2, b"\0"))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4).ljust(4, b"\0"))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while n and k < len(parts):
            width = 2 if wide else 1
            here = min(n, (len(parts[k]) - at) // width)
            raw = parts[k][at : at + here * width]
            text += _utf16(raw) if wide else raw.decode("latin-1")
            at += here * width
            n -= here
            if n:
                k, at = k + 1, 0
                if k < len(parts):
                    wide = parts[k][0] & 1 if parts[k] else 0
                    at = 1
        out.append(text)
        take(4 * runs + extra)
    return out


# Word

WORD_MAGIC, WORD_ENCRYPTED, WORD_TABLE1 = 0xA5EC, 0x0100, 0x0200
# Characters of the stored text that stand for something else.
WORD_SPECIAL = {"\r": "\n", "\x0b": "\n", "\x0c": "\n", "\x07": "\n", "\x1e": "-", "\x1f": "", "\xa0": " ", "\x01": "", "\x02": "", "\x05": "", "\x08": ""}


def read_doc(data: bytes, _extension: str, sink: Sink, deadline: Deadline) -> None:
    ole = OleFile(data)
    word = ole.stream("WordDocument")
    if word is None:
        raise Abort(GAVE_UP, "DOC: stream WordDocument expected, not found")
    if len(word) < 32 or struct.unpack_from("<H", word)[0] != WORD_MAGIC:
        raise Abort(GAVE_UP, "DOC: stream WordDocument does not begin with 0xA5EC")
    flags = struct.unpack_from("<H", word, 10)[0]
    if flags & WORD_ENCRYPTED:
        raise Abort(ENCRYPTED, "DOC: the header's encryption bit is set")
    table = ole.stream("1Table" if flags & WORD_TABLE1 else "0Table")
    if table is None:
        raise Abort(GAVE_UP, "DOC: the table stream that the header names was not found")
    if (text := _pieces(word, table, deadline)) is None:
        first, last = struct.unpack_from("<II", word, 24)
        if not first <= last <= len(word):
            raise Abort(GAVE_UP, "DOC: the text ends past its stream")
        text = word[first:last].decode("cp1252", "replace")
    lines = _without_fields("".join(WORD_SPECIAL.get(c, c) for c in text)).split("\n")
    for line in lines:
        deadline.check()
        if sink.full:
            return
        if line:
            sink.accept(line)
            sink.accept("\n")


def _pieces(word: bytes, table: bytes, deadline: Deadline) -> str | None:
    """The main text over the piece table, or None where the file has none."""
    if len(word) < 0x1AA:
        return None
    length, main = struct.unpack_from("<I", word, 0x1A6)[0], struct.unpack_from("<I", word, 0x4C)[0]
    start = struct.unpack_from("<I", word, 0x1A2)[0]
    if not length:
        return None
    if start + length > len(table):
        raise Abort(GAVE_UP, "DOC: the piece table ends past its stream")
    at, end = start, start + length
    while at < end and table[at] == 1:
        at += 3 + struct.unpack_from("<H", table, at + 1)[0]
    if at + 5 > end or table[at] != 2:
        raise Abort(GAVE_UP, "DOC: the header points to a piece table, but none is there")
    size = struct.unpack_from("<I", table, at + 1)[0]
    at += 5
    n = (size - 4) // 12
    if n < 1 or at + size > len(table):
        raise Abort(GAVE_UP, "DOC: the piece table has no whole number of pieces")
    places = struct.unpack_from(f"<{n + 1}I", table, at)
    out = []
    for i in range(n):
        deadline.check(64)
        count = min(places[i + 1], main) - places[i]
        if count <= 0:
            continue
        offset = struct.unpack_from("<I", table, at + 4 * (n + 1) + 8 * i + 2)[0]
        if offset & 0x40000000:
            first = (offset & 0x3FFFFFFF) // 2
            out.append(word[first : first + count].decode("cp1252", "replace"))
        else:
            out.append(_utf16(word[offset : offset + 2 * count]))
    return "".join(out)


def _without_fields(text: str) -> str:
    """Field codes left out, their results kept."""
    if "\x13" not in text:
        return text.replace("\x14", "").replace("\x15", "")
    out, stack = [], []
    for c in text:
        if c == "\x13":
            stack.append(True)
        elif c == "\x14" and stack:
            stack[-1] = False
        elif c == "\x15" and stack:
            stack.pop()
        elif not any(stack):
            out.append(c)
    return "".join(out)
