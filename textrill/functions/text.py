"""Text functions as columns: folding, tokens, byte budget, plain-text gate, excerpts.

Everything here stays inside the JVM. Each function has a twin ``sql_*`` giving
the same expression as DuckDB SQL for the oracle queries.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folds of one letter to two.
FOLD_MANY = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Þ": "TH", "þ": "th", "ß": "ss", "Ĳ": "IJ", "ĳ": "ij"}
# Letters that fold to one letter without having a decomposition, and those that keep their accent.
_STROKES = {"Ð": "D", "ð": "d", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ŀ": "L", "ŀ": "l", "Ł": "L", "ł": "l", "ŉ": "n", "Ŧ": "T", "ŧ": "t"}
_KEPT = "ŨũŪū"


def _one_to_one() -> dict[str, str]:
    """Latin-1 Supplement and Latin Extended-A letters by their base letter."""
    out = {}
    for p in range(0xC0, 0x180):
        c = chr(p)
        base = unicodedata.normalize("NFD", c)[0]
        if c in _STROKES:
            out[c] = _STROKES[c]
        elif base != c and base.isascii() and c not in _KEPT:
            out[c] = base
    return out


FOLD_ONE = _one_to_one()
_FROM, _TO = "".join(FOLD_ONE), "".join(FOLD_ONE.values())
SEPARATOR = r"[^\p{L}\p{N}]+"


def fold_text(text: str) -> str:
    """Accent folding of a Python string."""
    return "".join(FOLD_MANY.get(c) or FOLD_ONE.get(c, c) for c in text)


def fold(c: Column | str) -> Column:
    """Accent folding; null stays null."""
    out = F.translate(c, _FROM, _TO)
    for a, b in FOLD_MANY.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold_keeping_length(c: Column | str) -> Column:
    """Lower case with the one-to-one folds only, so positions stay those of the stored text."""
    return F.lower(F.translate(c, _FROM, _TO))


def normalise(c: Column | str, profile: str = "fts5") -> Column:
    """The indexed form of a text under a profile."""
    return fold(c) if profile == "tsquery" else F.lower(fold(c))


def tokens(c: Column | str) -> Column:
    """Words of a text, folded and in lower case; null and empty give an empty array."""
    return F.filter(F.split(F.lower(fold(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))), SEPARATOR), lambda x: x != "")


def token_list(text: str) -> list[str]:
    """``tokens`` of a Python string."""
    return [t for t in re.split(r"[\W_]+", fold_text(text).lower()) if t]


def padded(c: Column | str) -> Column:
    """A text as ' word  word ': each word between blanks of its own, so words, prefixes and phrases can be counted as substrings."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(fold(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))), SEPARATOR, "  "), F.lit(" "))


def padded_words(p: Column) -> Column:
    """How many words a padded text has: two blanks each, and two more at an end that began or ended with a separator."""
    blanks = F.length(p) - F.length(F.replace(p, F.lit(" "), F.lit("")))
    edges = F.when(F.startswith(p, F.lit("   ")), 2).otherwise(0) + F.when(F.endswith(p, F.lit("   ")), 2).otherwise(0)
    return F.when(F.trim(p) == "", 0).otherwise(((blanks - edges) / 2).cast("int"))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(F.lower(fold(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))), F.lit(r"[\p{L}\p{N}]+"))


def occurrences(haystack: Column, needle: str) -> Column:
    """How often a string occurs, without overlap."""
    return ((F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


def budget_cut(c: Column, budget: int) -> Column:
    """At most ``budget`` bytes of UTF-8, cut at a character, then at the last blank that is not the first byte, then trimmed."""
    raw = F.encode(c, "UTF-8")
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, budget - k).cast("string")) for k in range(min(4, budget + 1))])
    last = F.length(cut) - F.locate(" ", F.reverse(cut))  # 0-based place of the last blank
    shorter = F.when((F.locate(" ", cut) > 0) & (last > 0), F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.octet_length(c) <= budget, c).otherwise(F.regexp_replace(shorter, r"[ \t\n\r\x00\x0B]+$", ""))


def overflows(c: Column, budget: int) -> Column:
    return F.octet_length(c) > budget


def is_plain(c: Column) -> Column:
    """No character of category C besides tab, line feed and carriage return."""
    return ~F.rlike(c, F.lit(r"[\p{C}&&[^\t\n\r]]"))


def path_extension(title: Column) -> Column:
    """What follows the last dot of the last path component, lower-case; '' if there is none."""
    return F.lower(F.regexp_extract(F.element_at(F.split(F.coalesce(title, F.lit("")), "/"), -1), r"\.([^.]*)$", 1))


def scrub(c: Column) -> Column:
    """Valid UTF-8: each invalid sequence becomes a replacement character."""
    return F.make_valid_utf8(c)


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def decode_base64(c: Column) -> Column:
    """Bytes of strict base64, null where it does not decode."""
    return F.try_to_binary(c, F.lit("base64"))


EXCERPT_LENGTH = 200
EXCERPT_BEFORE = 40


def excerpt(content: Column, search: str) -> Column:
    """200 characters of the stored text from 40 before the first hit: of the needle as it is in any case, else without accents; else from the start."""
    needle = re.sub(r'[+\-"]', " ", search).strip()
    text = F.coalesce(content, F.lit(""))
    if not needle:
        return F.substring(text, 1, EXCERPT_LENGTH)
    exact = F.locate(needle.lower(), F.lower(text))
    folded = F.locate("".join(FOLD_ONE.get(c, c) for c in needle).lower(), fold_keeping_length(text))
    at = F.when(exact > 0, exact).otherwise(folded)
    start = F.greatest(F.lit(1), at - EXCERPT_BEFORE)
    return F.substring(text, start, F.lit(EXCERPT_LENGTH))


# DuckDB twins


def sql_fold(c: str) -> str:
    out = f"translate({c}, '{_FROM}', '{_TO}')"
    for a, b in FOLD_MANY.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({sql_fold(f"coalesce({c}, '')")}), '{SEPARATOR}'), lambda x: x <> '')"


def sql_excerpt(c: str, search: str) -> str:
    needle = re.sub(r'[+\-"]', " ", search).strip()
    plain = "".join(FOLD_ONE.get(x, x) for x in needle).lower()
    q = lambda s: s.replace("'", "''")
    text = f"coalesce({c}, '')"
    return f"substr({text}, greatest(1, CASE WHEN strpos(lower({text}), '{q(needle.lower())}') > 0 THEN strpos(lower({text}), '{q(needle.lower())}') ELSE strpos(lower(translate({text}, '{_FROM}', '{_TO}')), '{q(plain)}') END - {EXCERPT_BEFORE}), {EXCERPT_LENGTH})"
