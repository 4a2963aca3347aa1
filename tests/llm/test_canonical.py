import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textrill.llm import canonical as C
from textrill.llm import repair


@pytest.mark.parametrize(
    ("text", "form", "kinds"),
    [
        ("ｆｕｌｌ　ｗｉｄｔｈ１", "full width1", ("fullwidth", "space")),
        ("aﬁche oﬃce", "afiche office", ("ligature",)),
        ("cafe\u0301", "caf\u00e9", ("decomposed",)),
        ("a​b­c﻿", "abc", ("invisible",)),
        ("a\xa0b c d", "a b c d", ("space",)),
        ("tassа fοis", "tassa fois", ("foreign_letter",)),
        ("ISВN", "ISBN", ("foreign_letter",)),
        ("проект Ж-1 σύνθεση", "проект Ж-1 σύνθεση", ()),
        ("½ ² ₂ º ª … – — “x” ‘y’ « » € ™ © ☺ 5 × 3 µm", "½ ² ₂ º ª … – — “x” ‘y’ « » € ™ © ☺ 5 × 3 µm", ()),
        ("tab\tline\nend", "tab\tline\nend", ()),
        ("plain", "plain", ()),
        ("", "", ()),
        (None, None, ()),
        ("x̱", "x̱", ()),
        ("ｔｈéâｔｒｅ", "théâtre", ("fullwidth",)),
    ],
)
def test_cases(text, form, kinds):
    assert C.canonicalize(text) == (form, kinds)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ae\u0301\u200b\xa0\u3000ﬁｂ\u043e\n.ñ\u0391\u0308 "), max_size=40))
def test_one_form_and_stable(text):
    form, _ = C.canonicalize(text)
    assert C.canonicalize(form)[0] == form or C.canonicalize(C.canonicalize(form)[0])[0] == C.canonicalize(form)[0]
    assert unicodedata.is_normalized("NFC", form)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x17F), max_size=60))
def test_offsets_lead_back(text):
    plain, at = C.letters_map(text)
    assert len(at) == len(plain) + 1
    for i, c in enumerate(plain):
        if c not in C.LOOKALIKES.values() and not unicodedata.decomposition(c):
            assert c == text[at[i]] or text[at[i]] in "\xa0ĳĲŀĿŉ"


def test_table(spark):
    rows = [(1, "Ｔitle", "cafe\u0301", "k"), (2, None, "", None), (3, "ok", "recepciÃ³ ﬁn", "k"), (4, "a\xa0b", None, "k"), (4, "a\xa0b", None, "k")]
    df = spark.createDataFrame(rows, "id long, t string, c string, field string")
    got = sorted((r["id"], r["field"], r["canonical"], tuple(r["kinds"]), r["garbled"]) for r in repair.canonical_text(df, "id", ["t", "c"], "c").collect() if r["kinds"])
    assert got == [(1, "c", "café", ("decomposed",), False), (1, "t", "Title", ("fullwidth",), False), (3, "c", "recepciÃ³ fin", ("ligature",), True), (4, "t", "a b", ("space",), False), (4, "t", "a b", ("space",), False)]
    assert repair.canonical_text(df.limit(0), "id", ["t", "c"], "c").count() == 0


def test_invisible_characters_of_the_last_planes():
    for c in ("\U000e0001", "\U000e0041", "\U000e007f", "\U000e0100", "\U000e01ef"):
        assert C.canonicalize(f"ca{c}fé") == ("café", ("invisible",))


@pytest.mark.parametrize(
    "text",
    ["x" * 2_000_000, "x" * 2_000_000 + "\xa0", "aB3+/" * 400_000 + "é", "é" * 1_000_000, "é" * 500_000, "a​" * 500_000, "abсd" * 250_000, "́" * 500_000],
)
def test_long_texts_take_two_scans(text):
    import time

    started = time.time()
    C.canonicalize(text)
    C.letters_map(text)
    assert time.time() - started < 20


def test_boundary_context_and_look_alikes_with_accents():
    assert C.canonicalize("cafe​́ x") == ("café x", ("decomposed", "invisible"))
    assert C.canonicalize("pάhа")[0] == "páha"  # Greek alpha with tonos, Cyrillic a
    assert C.canonicalize("aжb") == ("aжb", ("foreign_letter",))  # looks like no Latin letter: told and kept
    assert C.canonicalize("а́bc")[0] == "ábc"
