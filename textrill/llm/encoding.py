"""Finding and undoing wrong character decoding (problem 3).

Round-trip repair. Text is re-encoded under a candidate legacy encoding and
strictly decoded as the intended one, layer after layer, and the result is kept
only when a garbling cost drops.

* Intended UTF-8: each maximal piece whose characters, as bytes of the legacy
  encoding, are one well-formed multi-byte UTF-8 sequence is replaced by the
  character it encodes, if that character is one of the expected ones. Repeated
  for nested layers. Such pieces are part of the cost, ``SEQUENCE`` each.
* Intended single-byte encodings: every byte decodes, so the cost is corpus
  evidence: minus the logarithm of a word's count over *all* rows, and of its
  distinct contexts (the words beside it, up to ``CONTEXTS``), which copies
  cannot raise. A token is repaired when one of the two costs drops by
  log ``RATIO``; where no token of a text alone does, the drops of its distinct
  tokens under one cause are added up.
* Letters that were apostrophes or closing quotes are judged by the word they
  stand in or at, ASCII words included. A lone dash or opening quote is no
  evidence of its own; it follows the cause found for the text.

Counts are exact, those of the words in a token and in its candidate repairs,
so a judgement is the same however large the vocabulary of the corpus is. Words
with fewer than ``LEAST`` occurrences count as none.

Null and empty texts are returned unchanged with no layers. Characters lost for
good (U+FFFD) mark the row as garbled; the mark stays where the corpus holds no
single word that fits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from functools import lru_cache
from typing import NamedTuple

import xxhash

from textrill.llm import canonical

RATIO = 12.0
SEQUENCE = 4.0
LEAST = 4
CONTEXTS = 256
MAX_LAYERS = 4
LEGACY = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_15", "cp1254", "cp1257", "koi8_r", "cp866")
# (decoded as, should have been)
PAIRS = tuple((b, a) for b in ("cp1252", "cp850", "cp437", "cp1251", "mac_roman", "cp1250") for a in ("cp1252", "mac_roman", "cp850") if a != b)
# Characters that garbled text is expected to have held, besides Latin letters.
TYPOGRAPHY = "–—‘’‚“”„†‡•…‰‹›€™ \xa0¡¢£¤¥¦§¨©ª«¬\xad®¯°±²³´µ¶·¸¹º»¼½¾¿×÷"


def _table(encoding: str) -> dict[int, str]:
    """Byte to character; bytes the encoding leaves open stand for themselves, as lenient decoders do."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def _expected(c: str) -> bool:
    return c in TYPOGRAPHY or "À" <= c <= "ſ" or c in "ȘșȚț"


@lru_cache(None)
def _utf8_rules() -> list[tuple[re.Pattern, dict[int, int]]]:
    """Per legacy encoding: a pattern of UTF-8 sequences seen as its characters, and its way back to bytes."""
    rules = []
    for name in (*LEGACY, "latin_1"):
        t = _table(name)
        cls = lambda lo, hi: "[" + "".join(re.escape(t[b]) for b in range(lo, hi + 1)) + "]"  # noqa: B023, E731
        tail = cls(0x80, 0xBF)
        rules.append((re.compile(f"{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{tail}|{cls(0xF0, 0xF4)}{tail}{tail}{tail}"), {ord(c): b for b, c in t.items()}))
    return rules


def _undo_utf8(text: str, pattern: re.Pattern, back: dict[int, int]) -> tuple[str, int]:
    changed = 0

    def one(m: re.Match) -> str:
        nonlocal changed
        try:
            c = bytes(back[ord(x)] for x in m.group()).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return m.group()
        if len(c) == 1 and (_expected(c) or any(_deeper(c, m.group()))):
            changed += 1
            return c
        return m.group()

    return pattern.sub(one, text), changed


@lru_cache(1)
def _any_sequence() -> re.Pattern:
    return re.compile("|".join(pattern.pattern for pattern, _ in _utf8_rules()))


def sequences(text: str) -> int:
    """How many pieces of a text are well-formed UTF-8 of an expected character, seen as legacy characters."""
    n = 0
    for m in _any_sequence().finditer(text):
        n += any(_undo_utf8(m.group(), pattern, back)[1] for pattern, back in _utf8_rules() if pattern.fullmatch(m.group()))
    return n


def _deeper(c: str, was: str) -> list[bool]:
    """A character that is itself part of another garbled layer, such as those of Latin-1 bytes."""
    return ["\x80" <= c <= "ÿ" and len(was) > 1]


@lru_cache(None)
def _pair_tables() -> list[tuple[str, str, dict[int, str]]]:
    out = []
    for wrong, right in PAIRS:
        w, r = _table(wrong), _table(right)
        moves = {ord(w[b]): r[b] for b in w if w[b] != r[b]}
        out.append((wrong, right, moves))
    return out


@lru_cache(None)
def _moves() -> dict[str, dict[int, str]]:
    return {f"{wrong}>{right}": moves for wrong, right, moves in _pair_tables()}


_WORD = re.compile(r"[^\W\d_]+(?:['’·][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
# tokens with a character that is not ASCII; looked for at token starts only, so that any text costs one scan
_TOKEN = re.compile(r"(?<![^ \t\r\n])[^ \t\r\n\x80-\U0010ffff]*+[^\x00-\x7f][^ \t\r\n]*+")


def words_in(text: str) -> set[tuple[bool, str]]:
    """The words of a text as they are counted: (plain, word), plain being ASCII words and those with an apostrophe."""
    low = text.lower()
    out = {(False, w) for w in _LETTERS.findall(low) if not w.isascii()}
    out.update((True, w) for w in _WORD.findall(low.replace("’", "'")) if w.isascii() or "'" in w)
    return out


class WordCounts:
    """Occurrences and distinct contexts of words, by (plain, word); words it does not hold have none."""

    def __init__(self, counts: Mapping[tuple[bool, str], tuple[int, int]]):
        self.counts = counts

    def of(self, word: str) -> int:
        return self.counts.get((False, word.lower()), (0, 0))[0]

    def contexts_of(self, word: str) -> int:
        return self.counts.get((False, word.lower()), (0, 0))[1]

    def plain_of(self, word: str) -> int:
        return self.counts.get((True, word), (0, 0))[0]

    def plain_contexts_of(self, word: str) -> int:
        return self.counts.get((True, word), (0, 0))[1]

    def typography(self, before: str, after: str) -> tuple[float, bool]:
        """(drop, evidence) where letters of ``before`` were typography; 0 where a mark stands in no place of its own.

        Opening quotes and dashes are no evidence, as a word may well begin with such a letter.
        """
        best, evidence = 0.0, False
        for i, (b, c) in enumerate(zip(before, after)):
            if not b.isalpha() or c.isalpha():
                continue
            left, right = after[i - 1 : i] if i else "", after[i + 1 : i + 2]
            if c in "’”»":
                inside = c == "’" and left.isalpha() and right.isalpha()
                if not (inside or (left and not left.isspace() and not right.isalpha())):
                    return 0.0, False
                sure = inside or (c == "”" and left.isalpha() and (b.islower() or left.islower()))
            elif c in "‘“«":
                if left.isalpha() or not right.isalnum():
                    return 0.0, False
                sure = False
            elif c in "–—…" and not (left.isalpha() and right.isalpha()):
                sure = False
            else:
                return 0.0, False
            old = next((m.group() for m in _LETTERS.finditer(before) if m.start() <= i < m.end()), "")
            new = next((m.group() for m in _WORD.finditer(after) if m.start() - 1 <= i <= m.end()), "").lower().replace("’", "'")
            if len(new) < 3:
                continue
            plain = new.isascii() or "'" in new
            if (self.plain_of(new) if plain else self.of(new)) < LEAST:
                return 0.0, False
            capitals = 2.0 if old[1:] not in (old[1:].lower(), old[1:].upper()) else 0.0
            pairs = ((self.of, self.plain_of if plain else self.of), (self.contexts_of, self.plain_contexts_of if plain else self.contexts_of))
            best = max(best, *(math.log(now(new) + 0.5) - math.log(was(old) + 0.5) + capitals for was, now in pairs))
            evidence = evidence or sure
        if any(self.of(w) < LEAST for w in _LETTERS.findall(after) if not w.isascii()):
            return 0.0, False
        return best, evidence

    def cost(self, text: str) -> float:
        """Garbling cost of a token: that of its words and characters, plus a charge for each UTF-8 sequence in it."""
        return self.word_cost(text) + SEQUENCE * sequences(text)

    def word_cost(self, text: str, of=None) -> float:
        """Minus log counts of the non-ASCII words of a token, plus a charge for misplaced characters."""
        total, of = 0.0, of or self.of
        for w in _LETTERS.findall(text):
            if w.isascii():
                continue
            total -= math.log(of(w) + 0.5)
            inner = w[1:]
            if inner != inner.lower() and inner != inner.upper():
                total += 2.0  # capitals inside a word
        odd = {c for c in set(text) if not (c.isascii() or c.isalpha() or c in "“”‘’«»–—…¿¡·")}
        for i, c in enumerate(text) if odd else ():
            if c in odd:
                total += 3.0 if text[i - 1 : i].isalpha() or text[i + 1 : i + 2].isalpha() else 0.5
        return total

    def all_known(self, text: str) -> bool:
        """Whether the text has non-ASCII words and the corpus has them all, none of them a lone letter."""
        words = [w for w in _LETTERS.findall(text) if not w.isascii()]
        return bool(words) and all(len(w) > 2 and w[1:] in (w[1:].lower(), w[1:].upper()) and self.of(w) >= LEAST for w in words)


def count_contexts(text: str | None, into: dict[tuple[bool, str], list]) -> int:
    """Add the words of a text to a map of (plain, word) to [count, hashes of contexts]; returns how many contexts came.

    Plain words are ASCII ones and those with an apostrophe. Of each word the
    ``CONTEXTS`` smallest hashes are enough to tell their number up to that.
    """
    words = _WORD.findall(text.lower().replace("’", "'")) if text else ()
    came = 0
    for i, w in enumerate(words):
        context = xxhash.xxh3_64_intdigest(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode("utf-8", "surrogatepass")) >> 1
        keys = [(True, w)] if w.isascii() or "'" in w else []
        if not w.isascii():
            keys += [(False, x) for x in _LETTERS.findall(w) if not x.isascii()]
        for key in keys:
            entry = into.get(key)
            if entry is None:
                entry = into[key] = [0, set(), 1 << 63]
            entry[0] += 1
            if context < entry[2] and context not in entry[1]:
                entry[1].add(context)
                came += 1
                if len(entry[1]) >= 2 * CONTEXTS:
                    least = sorted(entry[1])[:CONTEXTS]
                    came -= len(entry[1]) - CONTEXTS
                    entry[1], entry[2] = set(least), least[-1]
    return came


class Evidence(NamedTuple):
    """What is known of a token: its repair and the cause, or neither; and by cause how far the garbling cost
    drops if that is undone, whether the corpus has its words, and the drop by rows alone."""

    fixed: str | None
    how: str | None
    causes: dict[str, tuple[float, bool, float]]

    @property
    def suspicious(self) -> bool:
        """Whether the token alone can make a text count as garbled."""
        return self.fixed is not None or any(known and drop > 0 for drop, known, _ in self.causes.values())


def undone(token: str) -> list[str]:
    """Every text that layers of UTF-8 read as a legacy encoding can have come from."""
    seen, now = [], {token}
    for _ in range(MAX_LAYERS):
        now = {new for t in now for pattern, back in _utf8_rules() for new, n in [_undo_utf8(t, pattern, back)] if n} - set(seen)
        if not now:
            break
        seen += sorted(now)
    return seen


def words_to_judge(token: str) -> set[tuple[bool, str]]:
    """The words whose counts decide about a token: its own and those of all its candidate repairs."""
    plain = canonical.plain_marks(token)
    out = words_in(token) | words_in(plain)
    for new in (*undone(token), *(plain.translate(moves) for _, _, moves in _pair_tables())):
        out |= words_in(new)
    return out


class Judge:
    """Decides about tokens from counts."""

    def __init__(self, counts: WordCounts):
        self.counts = counts

    def _nested(self, token: str) -> tuple[str, str] | None:
        """Layers of UTF-8 read as a legacy encoding undone, if the garbling cost drops."""
        text, layers = token, []
        for _ in range(MAX_LAYERS):
            best = None
            for (pattern, back), name in zip(_utf8_rules(), (*LEGACY, "latin_1")):
                new, n = _undo_utf8(text, pattern, back)
                if n:
                    # what is still a sequence may be undone by the next layer, so it costs nothing here
                    rank = (self.counts.word_cost(new), len(new))
                    if best is None or rank < best[0]:
                        best = (rank, new, name)
            if best is None:
                break
            text, layers = best[1], [*layers, f"{best[2]}>utf-8"]
        if layers and self.counts.cost(text) < self.counts.cost(token):
            return text, "+".join(layers)
        return None

    def _pairs(self, token: str) -> dict[str, tuple[float, bool, float]]:
        """By cause, how far the cost of the token drops if that is undone, whether the corpus has its words, and the drop by rows."""
        plain = canonical.plain_marks(token)
        letters, counts = set(plain), self.counts
        before = (counts.word_cost(plain), counts.word_cost(plain, counts.contexts_of))
        out = {}
        for wrong, right, moves in _pair_tables():
            new = plain.translate(moves)
            if new == plain or any("\x80" <= c <= "\x9f" for c in set(new)):
                continue
            rows = before[0] - counts.word_cost(new)
            drop = max(rows, before[1] - counts.word_cost(new, counts.contexts_of))
            if any(ord(c) in moves and c.isalpha() and not moves[ord(c)].isalpha() for c in letters):
                at_marks, known = counts.typography(plain, new)
                out[f"{wrong}>{right}"] = (at_marks if at_marks > 0 else min(0.0, drop), known, rows)
            else:
                out[f"{wrong}>{right}"] = (drop, counts.all_known(new), rows)
        return out

    def evidence(self, token: str) -> Evidence:
        found = self._nested(token)
        if found or "\ufffd" in token:
            return Evidence(*(found or (None, None)), {})
        pairs = self._pairs(token)
        best = max(((drop, cause) for cause, (drop, known, _) in pairs.items() if known and drop > math.log(RATIO)), key=lambda x: x[0], default=None)
        return Evidence(token.translate(_moves()[best[1]]), best[1], pairs) if best else Evidence(None, None, pairs)


def tokens_of(text: str | None) -> list[str]:
    """The tokens of a text that are not ASCII."""
    return [] if not text or text.isascii() else _TOKEN.findall(text)


def _together(evidence: list[Evidence]) -> str | None:
    """The cause under which the distinct tokens of a text together drop enough; tokens that rise speak against it."""
    if not any(e.suspicious for e in evidence):
        return None
    total: dict[str, float] = {}
    for e in evidence:
        for cause, (drop, known, _) in e.causes.items():
            if known or drop < 0:
                total[cause] = total.get(cause, 0.0) + drop
    best = max(sorted(total), key=total.get)
    return best if total[best] > math.log(RATIO) else None


def repair(text: str | None, evidence: Callable[[str], Evidence]) -> tuple[str | None, list[str], int]:
    """The repaired text, the layers undone, and how many tokens were garbled (lost characters included)."""
    if not text or text.isascii():
        return text, [], 0
    spans = [(m.start(), m.end(), m.group(), evidence(m.group())) for m in _TOKEN.finditer(text)]
    how: dict[str, int] = {}
    for *_, e in spans:
        if e.fixed is not None:
            how[e.how] = how.get(e.how, 0) + 1
    lost = sum("\ufffd" in t for _, _, t, e in spans if e.fixed is None)
    # a passage decoded wrongly has one cause: it also explains tokens without evidence of their own
    cause = max(sorted(how), key=how.get) if how else _together(list({t: e for _, _, t, e in spans}.values()))
    if cause is None:
        return text, [], lost
    moves = _moves().get(cause)
    out, at, more = [], 0, 0
    for start, end, token, e in spans:
        fixed = e.fixed
        if fixed is None and moves is not None:
            new = token.translate(moves)
            drop, _, rows = e.causes.get(cause, (0.0, False, 0.0))
            if new != token and all(_expected(c) or c.isascii() for c in set(new)) and (drop > 0 or rows > 0):
                fixed = new
                more += 1
        if fixed is not None:
            out += [text[at:start], fixed]
            at = end
    out.append(text[at:])
    if not how and not more:
        return text, [], lost
    return "".join(out), sorted(how) or [cause], (sum(how.values()) or more) + lost
