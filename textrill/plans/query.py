"""Search strings parsed into terms, and terms compiled for a ranking profile. Pure Python; nothing here touches data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from textrill.errors import UnsupportedCapability
from textrill.functions.text import fold_text, token_list

MAX_TERMS = 64
MAX_OFFSET = 100_000
SHOULD, MUST, MUST_NOT = "should", "must", "must_not"
_SIGNS = {"+": MUST, "-": MUST_NOT, "": SHOULD}
# a quoted phrase first, with or without a sign, then a bare word; an open quote belongs to the bare word
_PIECES = re.compile(r'(?P<phrase_sign>[+-]?)"(?P<phrase>[^"]*)"|(?P<sign>[+-]?)(?P<word>\S+)')


@dataclass(frozen=True)
class Term:
    value: str
    phrase: bool = False
    occur: str = SHOULD


def repair_utf8(search: str | bytes) -> str:
    """Invalid bytes become '?', never nothing: a query that parsed as empty would show every document."""
    if isinstance(search, bytes):
        return search.decode("utf-8", "replace").replace("�", "?")
    return "".join("?" if 0xD800 <= ord(c) <= 0xDFFF else c for c in search)


def parse(search: str | bytes | None) -> list[Term]:
    """The terms of a search string, the last 64 of them; empty for a browse."""
    terms = []
    for m in _PIECES.finditer(repair_utf8(search or "")):
        phrase = m["word"] is None
        value = re.sub(r"\s+", " ", m["phrase"]) if phrase else m["word"]
        if value.strip():
            terms.append(Term(value, phrase, _SIGNS[m["phrase_sign"] if phrase else m["sign"]]))
    return terms[-MAX_TERMS:]


def prefix_candidate(terms: list[Term]) -> Term | None:
    """The last unquoted optional term: it also matches as a prefix."""
    return next((t for t in reversed(terms) if not t.phrase and t.occur == SHOULD), None)


@dataclass(frozen=True)
class Unit:
    """What is looked for: words in succession, the last perhaps only begun."""

    words: tuple[str, ...]
    prefix: bool
    occur: str


@dataclass(frozen=True)
class Compiled:
    """A query for one profile. ``text`` is the profile's own query language; ``units`` are matched."""

    profile: str
    units: tuple[Unit, ...]
    text: str
    browse: bool = False


def _lexemes(value: str) -> list[str]:
    """Cut at every character the tsquery language reads as an operator."""
    return [x for x in re.split(r"[\s&|!()<>:*'\\]", fold_text(value)) if x]


def _boolean_token(value: str) -> str:
    """Without the operators of the boolean language."""
    return fold_text(re.sub(r"\s+", " ", re.sub(r'[+\-><()~*"@]', "", value)).strip()).lower()


def compile_fts5(terms: list[Term]) -> Compiled:
    last = prefix_candidate(terms)
    parts: dict[str, list[str]] = {SHOULD: [], MUST: [], MUST_NOT: []}
    units = []
    for t in terms:
        literal = '"' + t.value.replace('"', '""') + '"' + ("*" if t is last else "")
        parts[t.occur].append(literal)
        units.append(Unit(tuple(token_list(t.value)), t is last, t.occur))
    positive = ([f"({' OR '.join(parts[SHOULD])})"] if parts[SHOULD] else []) + parts[MUST]
    text = " AND ".join(positive or ['""']) + "".join(f" NOT {x}" for x in parts[MUST_NOT])
    return Compiled("fts5", tuple(units), text)


def compile_tsquery(terms: list[Term]) -> Compiled:
    last = prefix_candidate(terms)
    parts: dict[str, list[str]] = {SHOULD: [], MUST: [], MUST_NOT: []}
    units = []
    for t in terms:
        lexemes = _lexemes(t.value)
        if not lexemes:
            continue
        operand = " <-> ".join(lexemes) + (":*" if t is last else "")
        shown = {SHOULD: operand, MUST: operand if len(lexemes) == 1 else f"({operand})", MUST_NOT: f"!({operand})"}
        parts[t.occur].append(shown[t.occur])
        words = tuple(w for x in lexemes for w in token_list(x))
        if words:
            units.append(Unit(words, t is last, t.occur))
    operands = ([f"({' | '.join(parts[SHOULD])})"] if parts[SHOULD] else []) + parts[MUST] + parts[MUST_NOT]
    return Compiled("tsquery", tuple(units), " & ".join(operands))


def compile_boolean(terms: list[Term]) -> Compiled:
    last = prefix_candidate(terms)
    shown, units = [], []
    for t in terms:
        text = _boolean_token(t.value)
        if not text:
            continue
        body = f'"{text}"' if t.phrase else text + ("*" if t is last else "")
        shown.append({MUST: "+", MUST_NOT: "-", SHOULD: ""}[t.occur] + body)
        words = tuple(token_list(text))
        if words:
            units.append(Unit(words, t is last and not t.phrase, t.occur))
    return Compiled("boolean", tuple(units), " ".join(shown))


_COMPILERS = {"fts5": compile_fts5, "tsquery": compile_tsquery, "boolean": compile_boolean}


def compile_query(search: str | bytes | None, profile: str = "fts5") -> Compiled:
    terms = parse(search)
    if not terms:
        return Compiled(profile, (), "", browse=True)
    return _COMPILERS[profile](terms)


@dataclass(frozen=True)
class Request:
    """A search request as it is asked."""

    search: str = ""
    page: int = 1
    size: int = 20
    provider: str | None = None
    meta_tags: tuple = ()
    limit_fields: tuple = ()
    since: str | int | None = None
    until: str | int | None = None
    regex_filters: tuple = ()
    wildcard_filters: tuple = ()
    sub_tags: tuple = ()
    simple_queries: tuple = ()
    widening: dict = field(default_factory=dict)  # parts, wildcard fields, fields: noted and skipped

    def checked(self) -> Request:
        """Refuses what would narrow the result in ways not on offer."""
        for name in ("regex_filters", "wildcard_filters", "sub_tags", "simple_queries"):
            if getattr(self, name):
                raise UnsupportedCapability(name)
        fields = set(self.limit_fields)
        if fields and not {"title", "content"} <= fields:
            raise UnsupportedCapability(f"limit_fields {sorted(map(str, fields))}")
        return self

    @property
    def tags(self) -> list[str]:
        return [t for t in self.meta_tags if isinstance(t, str)]

    @property
    def limit(self) -> int:
        return max(1, int(self.size))

    @property
    def offset(self) -> int:
        return max(0, (int(self.page) - 1) * self.limit)

    @property
    def beyond(self) -> bool:
        """Past the deepest page served: the result and the total are empty."""
        return self.offset > MAX_OFFSET


_NUMERIC = re.compile(r"[ \t\n\r\v\f]*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?[ \t\n\r\v\f]*")


def numeric_option(value) -> int | None:
    """A number or numeric string as an integer, anything else as no option."""
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return int(value)
    return int(float(value)) if isinstance(value, str) and _NUMERIC.fullmatch(value) else None
