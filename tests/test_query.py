import pytest

from textrill.config import Config, offered
from textrill.errors import UnsupportedCapability, UnsupportedEngine
from textrill.plans.query import MUST, MUST_NOT, SHOULD, Request, Term, compile_query, numeric_option, parse, prefix_candidate

EXAMPLE = '+museu "sortida escolar" -pis mun'


def test_compiled_forms():
    assert compile_query(EXAMPLE, "tsquery").text == "(sortida <-> escolar | mun:*) & museu & !(pis)"
    assert compile_query(EXAMPLE, "boolean").text == '+museu "sortida escolar" -pis mun*'
    assert compile_query(EXAMPLE, "fts5").text == '("sortida escolar" OR "mun"*) AND "museu" NOT "pis"'


def test_exclusions_only():
    assert compile_query("-a -b", "fts5").text == '"" NOT "a" NOT "b"'
    assert compile_query("-a -b", "tsquery").text == "!(a) & !(b)"
    assert compile_query("-a -b", "boolean").text == "-a -b"


@pytest.mark.parametrize(
    ("search", "terms"),
    [
        ('"sortida   escolar"', [Term("sortida escolar", True)]),
        ('+"a b" -"a b"', [Term("a b", True, MUST), Term("a b", True, MUST_NOT)]),
        ('foo"bar', [Term('foo"bar')]),
        ('"" +"" "  "', []),
        ("+", [Term("+")]),
        ("  ", []),
        (b"a\xc3\x28b", [Term("a?(b")]),
        (None, []),
        ("-x +y z", [Term("x", False, MUST_NOT), Term("y", False, MUST), Term("z", False, SHOULD)]),
    ],
)
def test_parse(search, terms):
    assert parse(search) == terms


def test_only_the_last_terms_count():
    assert [t.value for t in parse(" ".join(f"w{i}" for i in range(70)))] == [f"w{i}" for i in range(6, 70)]


def test_prefix_goes_to_the_last_unquoted_optional_term():
    assert prefix_candidate(parse('a b "c" +d -e')).value == "b"
    assert prefix_candidate(parse('"c" +d')) is None
    assert compile_query("report.pdf", "fts5").units[0].words == ("report", "pdf")
    assert compile_query("a-b", "boolean").text == "ab*"
    assert compile_query("l'estel", "tsquery").text == "(l <-> estel:*)"


def test_request_limits():
    assert Request(size=0).limit == 1
    assert Request(page=2, size=20).offset == 20
    assert Request(page=-3).offset == 0
    assert not Request(page=5001, size=20).beyond
    assert Request(page=5002, size=20).beyond
    assert Request(meta_tags=("a", 1, None)).tags == ["a"]


def test_refused_capabilities():
    for name in ("regex_filters", "wildcard_filters", "sub_tags", "simple_queries"):
        with pytest.raises(UnsupportedCapability):
            Request(**{name: ("x",)}).checked()
    with pytest.raises(UnsupportedCapability):
        Request(limit_fields=("title",)).checked()
    Request(limit_fields=("title", "content"), widening={"parts": 1}).checked()


@pytest.mark.parametrize(("value", "n"), [("15", 15), (" 15", 15), ("1e3", 1000), ("-2.9", -2), (7, 7), (7.9, 7), ("abc", None), ("", None), ("0x10", None), (None, None), (True, None), ("1 2", None)])
def test_numeric_option(value, n):
    assert numeric_option(value) == n


def test_config():
    assert Config(language="klingon").language == "simple"
    assert Config(content_bytes=-4).content_bytes == 1
    with pytest.raises(ValueError):
        Config().with_language("catalan")
    with pytest.raises(ValueError):
        Config().with_content_bytes(0)
    with pytest.raises(UnsupportedEngine):
        Config(profile="x")
    assert offered(["b", "simple", "a"]) == ["simple", "a", "b"]
