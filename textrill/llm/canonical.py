"""One consistent form for text that looks the same (problem 4).

Canonical form: NFC, with full-width forms and joined letter forms written as
ordinary letters, invisible characters removed, every space character written
as U+0020, and look-alike letters of other scripts inside Latin words written
as the Latin letter. Ordinary typography (quotes, dashes, fractions, ordinals,
sub- and superscripts, symbols) and whole words of another script stay.

The text is scanned once for runs of characters whose normalization quick-check
value is not "yes" or that belong to the classes above. Only such runs, each with
the starter before it as boundary context, are normalized and spliced back, so
stable text is never rewritten. Letters of other scripts have the word they stand
in as context and are judged in a second scan, over words, if there are any. A
letter counts as a look-alike by its base letter, so accents above it stay.

Letters of another script in a Latin word that look like no Latin letter are told
(kind ``foreign_letter``) and kept, as there is no form to bring them to.

Null stays null, empty stays empty; a text of any length and shape costs two linear scans.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Letters of other scripts drawn like a Latin letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v", "ї": "ï", "ё": "ë",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "Ү": "Y", "У": "Y", "Ԝ": "W", "Ї": "Ï", "Ё": "Ë", "Ӏ": "I",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "ό": "ó", "ί": "í", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ք": "p", "յ": "j", "Տ": "S", "Օ": "O", "Լ": "L",
    "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲙ": "M", "Ⲛ": "N", "Ⲏ": "H", "Ⲕ": "K", "Ⲧ": "T",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}

KINDS = ("fullwidth", "ligature", "decomposed", "invisible", "space", "foreign_letter")


def _ranges(points: list[int]) -> str:
    """A regular-expression class body for sorted code points."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(re.escape(chr(points[i])) + (f"-{re.escape(chr(points[j]))}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache(None)
def _classes() -> dict[str, object]:
    """Character classes, derived from the Unicode database by rule."""
    wide, joined, mark, invisible, space, foreign, unstable = [], [], [], [], [], [], []
    for p in range(0x80, sys.maxunicode + 1):
        c = chr(p)
        cat = unicodedata.category(c)
        if cat in ("Cn", "Co", "Cs"):
            continue
        kind = unicodedata.decomposition(c).partition(">")[0]
        if cat == "Zs" or p in (0x2028, 0x2029):
            space.append(p)
        elif cat == "Cf" or p in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= p <= 0xFE0F or 0xE0100 <= p <= 0xE01EF:
            invisible.append(p)
        elif kind == "<wide" and p > 0xFF00:
            wide.append(p)
        elif kind == "<compat" and cat in ("Ll", "Lu", "Lt", "Lo") and len(unicodedata.normalize("NFKC", c)) > 1 and (0xFB00 <= p <= 0xFB17 or p < 0x250):
            joined.append(p)
        elif unicodedata.combining(c):
            mark.append(p)
        elif unicodedata.normalize("NFC", c) != c or 0x1161 <= p <= 0x1175 or 0x11A8 <= p <= 0x11C2:
            unstable.append(p)
        elif cat in ("Ll", "Lu", "Lt") and p >= 0x370 and not unicodedata.name(c, "").startswith("LATIN") and p not in (0x2126, 0x212A, 0x212B) and not 0x2100 <= p <= 0x214F and not 0x1D00 <= p <= 0x1DBF and p < 0x1D400:
            foreign.append(p)
    every = sorted({*wide, *joined, *mark, *invisible, *space, *foreign, *unstable})
    body = {k: _ranges(v) for k, v in (("wide", wide), ("joined", joined), ("mark", mark), ("invisible", invisible), ("space", space), ("foreign", foreign))}
    latin = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ"
    return {
        "body": body,
        "any": re.compile(f"[{_ranges(every)}]"),
        "run": re.compile(f"[{_ranges(every)}]+"),
        "letters": re.compile(f"[{latin}{body['foreign']}{body['mark']}]+"),
        "latin": re.compile(f"[{latin}]"),
        "foreign": re.compile(f"[{body['foreign']}]"),
        "wide": re.compile(f"[{body['wide']}]+"),
        "joined": re.compile(f"[{body['joined']}]"),
        "invisible": re.compile(f"[{body['invisible']}]+"),
        "space": re.compile(f"[{body['space']}]"),
        "mark": re.compile(f"[{body['mark']}]"),
    }


_LOOK = str.maketrans(LOOKALIKES)


@lru_cache(4096)
def _latin_form(c: str) -> str:
    """The Latin letter a letter of another script looks like: that of its base letter, with its accents; else itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    base, *marks = unicodedata.normalize("NFD", c)
    return unicodedata.normalize("NFC", LOOKALIKES[base] + "".join(marks)) if base in LOOKALIKES else c


def _fix_word(m: re.Match) -> str:
    """A word with letters of two scripts, Latin among them, in Latin letters."""
    w, k = m.group(), _classes()
    if w.isascii() or not k["foreign"].search(w) or not k["latin"].search(w):
        return w
    return k["foreign"].sub(lambda x: _latin_form(x.group()), w)


def _segment(text: str, found: set[str]) -> str:
    """Canonical form of one unstable segment; adds the kinds of change to ``found``."""
    k = _classes()
    if k["space"].search(text):
        found.add("space")
        text = k["space"].sub(" ", text)
    if k["invisible"].search(text):
        found.add("invisible")
        text = k["invisible"].sub("", text)
    if k["wide"].search(text):
        found.add("fullwidth")
        text = k["wide"].sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if k["joined"].search(text):
        found.add("ligature")
        text = k["joined"].sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    if k["mark"].search(text):
        composed = unicodedata.normalize("NFC", text)
        if len(composed) < len(text):
            found.add("decomposed")
        return composed
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def _one_script(text: str, found: set[str]) -> str:
    """Latin words without letters of another script; accents compose with the letter they now stand on."""
    k = _classes()
    out, at = [], 0
    for m in k["letters"].finditer(text):
        w = m.group()
        if w.isascii() or not k["foreign"].search(w) or not k["latin"].search(w):
            continue
        found.add("foreign_letter")
        out += [text[at : m.start()], unicodedata.normalize("NFC", _fix_word(m))]
        at = m.end()
    return "".join([*out, text[at:]]) if at else text


def canonicalize(text: str | None) -> tuple[str | None, tuple[str, ...]]:
    """The canonical form and the kinds of change that were needed."""
    if not text or text.isascii():
        return text, ()
    k = _classes()
    if not k["any"].search(text):
        return text, ()
    found: set[str] = set()
    out, at = [], 0
    for m in k["run"].finditer(text):
        # boundary context: the starter before the run, which its marks may compose with
        start = max(m.start() - 1, at)
        out += [text[at:start], _segment(text[start : m.end()], found)]
        at = m.end()
    out.append(text[at:])
    text = "".join(out)
    if k["foreign"].search(text):
        text = _one_script(text, found)
    return text, tuple(x for x in KINDS if x in found)


def plain_marks(text: str) -> str:
    """Without invisible characters, with ordinary spaces and composed accents."""
    if text.isascii():
        return text
    k = _classes()
    return unicodedata.normalize("NFC", k["space"].sub(" ", k["invisible"].sub("", text)))


def letters_map(text: str) -> tuple[str, list[int]]:
    """Character-wise canonical text with the offset of each character in ``text``.

    For finders that work on canonical text but must report the stored piece.
    """
    k = _classes()
    out, at = [], []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c.isascii():
            out.append(c)
            at.append(i)
            i += 1
            continue
        j = i + 1
        if k["invisible"].match(c):
            i = j
            continue
        new = " " if k["space"].match(c) else c
        if k["wide"].match(c) or k["joined"].match(c):
            new = unicodedata.normalize("NFKC", c)
        elif unicodedata.combining(c) and out:
            pair = unicodedata.normalize("NFC", out[-1] + c)
            if len(pair) == 1:
                out[-1] = pair
                i = j
                continue
        for x in new:
            out.append(x)
            at.append(i)
        i = j
    plain = "".join(out)
    if k["foreign"].search(plain):
        plain = k["letters"].sub(_fix_word, plain)
    at.append(n)
    return plain, at


if sys.maxunicode < 0x10FFFF:  # pragma: no cover
    raise ImportError("a Python with full Unicode is needed")
