"""Round-trip repair against texts garbled on purpose."""

import pytest

from textrill.llm import encoding as E
from textrill.llm import repair

CLEAN = ["La recepció neteja la cançó fràgil després de dinar", "Die Müllabfuhr schließt die kleine Tür", "L'équipe répare la clôture à côté de l'école", "El árbol pequeño está en el rincón"]


class Fixer:
    """Repairs single texts by given counts."""

    def __init__(self, counts):
        self.judge = E.Judge(E.WordCounts(counts))

    def repair(self, text):
        return E.repair(text, self.judge.evidence)


def counts_of(texts, times=20):
    counts = {}
    for t in texts:
        for key in E.words_in(t):
            if not key[0]:
                n = counts.get(key, (0, 0))[0] + times
                counts[key] = (n, n)
    return counts


@pytest.fixture(scope="module")
def fixer():
    return Fixer(counts_of(CLEAN))


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize(("right", "wrong"), [("utf-8", "cp1252"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "latin-1"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("mac_roman", "cp1252")])
def test_exact_round_trip(fixer, text, right, wrong):
    table = E._table("latin_1" if wrong == "latin-1" else wrong)
    garbled = "".join(chr(b) if b < 128 else table[b] for b in text.encode(right))
    fixed, layers, n = fixer.repair(garbled)
    assert fixed == text
    assert n and layers


def test_nested(fixer):
    table = E._table("cp1252")
    once = lambda s: "".join(chr(b) if b < 128 else table[b] for b in s.encode("utf-8"))
    assert fixer.repair(once(once(CLEAN[0])))[0] == CLEAN[0]
    assert fixer.repair("vor dem Haus, das Ma" + once(once("ß")) + "e, schlie" + once(once("ß")) + "t")[0] == "vor dem Haus, das Maße, schließt"
    assert fixer.repair("say " + once(once("“other”")) + " word")[0] == "say “other” word"


@pytest.mark.parametrize("text", [*CLEAN, "", "plain ascii", "“ÂGE” 20 SÃO", "проект Ж-1 σύνθεση", "½ 10 m² 5 × 3 © 12 °C …", "n.º 6 l’élève «é»", "fοis tassа", "ｆｕｌｌ ﬁn", "a​b"])
def test_clean_text_is_kept(fixer, text):
    assert fixer.repair(text) == (text, [], 0)


def test_lost_characters_are_found(fixer):
    assert fixer.repair("La recepci� neteja")[2] == 1
    assert fixer.repair(None) == (None, [], 0)


def test_over_a_table(spark):
    rows = [(i, CLEAN[i % 4], "x") for i in range(40)] + [(100, "La recepciÃ³ neteja", None), (101, None, "y"), (102, "", "z"), (103, "La recepciÃ³ neteja", None), (104, "b�d", None), (105, "é" * 200_000, None)]
    df = spark.createDataFrame(rows, "id long, t string, repaired string")
    got = {r["id"]: r for r in repair.repaired(df, "id", "t").collect()}
    assert len(got) == len(rows)
    assert got[100]["repaired"] == "La recepció neteja" == got[103]["repaired"]
    assert {i for i, r in got.items() if r["garbled_tokens"]} == {100, 103, 104}
    assert (got[101]["repaired"], got[102]["repaired"]) == (None, "")
    assert sorted(r["id"] for r in repair.garbled(df, "id", "t").collect()) == [100, 103, 104]
    assert repair.repaired(df.limit(0), "id", "t").count() == 0


def decoded(text, right, wrong):
    table = E._table(wrong)
    return "".join(chr(b) if b < 128 else table[b] for b in text.encode(right))


def test_a_hot_group_of_garbled_copies_and_quotes_only(spark):
    said = ["früh", "heute", "morgen", "gern", "allein", "zuletzt", "bald", "wieder"]
    clean = [f"{a} wird für die {b} geöffnet und {a} für alle {c}" for i, a in enumerate(said) for b in said for c in said[i:]]
    hot = decoded("Wir müssen für die Tür früh geöffnet lassen", "cp1252", "cp850")
    mac = decoded("Wir sind für alle da und haben für die Tür geöffnet", "mac_roman", "cp1252")
    quotes = decoded("the teacher said “open the garden” and left", "mac_roman", "cp1252")
    apostrophe = decoded("they don’t open it", "cp1252", "cp850")
    plain = ["we open the garden, they don't", "the garden is open and they don't mind"] * 40
    rows = [*clean, *plain, *[hot] * 200, *[mac + f" {w}" for w in said * 25], quotes, apostrophe]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, t string")
    got = {r["id"]: r["repaired"] for r in repair.repaired(df, "id", "t").filter("garbled_tokens > 0").collect()}
    first = len(clean) + len(plain)
    assert set(got) == set(range(first, len(rows)))
    assert "für" in got[first] and "für" in got[first + 200]
    assert got[len(rows) - 2] == "the teacher said “open the garden” and left"
    assert got[len(rows) - 1] == "they don’t open it"


def test_contexts_are_exact_up_to_their_limit(spark):
    df = spark.createDataFrame([(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} über b",) for i in range(1000)] + [("x für y",)] * 500 + [(None,), ("",)], "t string")
    got = {r["word"]: (r["n"], r["contexts"]) for r in repair.word_counts(df.repartition(5), "t").filter("NOT plain").collect()}
    assert got == {"über": (1000, E.CONTEXTS), "für": (500, 1)}


@pytest.mark.parametrize("text", ["Òpera i camí", "BAILÓ el día", "ôter la pièce", "le bail", "CAMIÓ"])
def test_words_that_only_look_like_typography_are_kept(text):
    counts = {(w.isascii(), w): (500, 500) for w in "día camí pièce pera bail ter cami d'a".split()}
    assert Fixer(counts).repair(text) == (text, [], 0)


def test_both_ways_to_pick_texts_are_the_same(spark):
    garbled = [decoded(t, "utf-8", "cp1252") for t in CLEAN] + [decoded(t, "cp1252", "cp850") for t in CLEAN]
    rows = list(enumerate([*CLEAN * 10, *garbled, None, "", "plain", garbled[0]]))
    df = spark.createDataFrame(rows, "id long, t string")
    a = sorted(map(tuple, repair.repaired(df, "id", "t").collect()))
    assert a == sorted(map(tuple, repair.repaired(df, "id", "t", broadcast_tokens=-1).collect()))
    assert sum(n > 0 for _, n, _, _ in a) == len(garbled) + 1


def test_every_word_a_judgement_asks_for_is_joined():
    class Recording(E.WordCounts):
        asked = set()

        def of(self, word):
            self.asked.add((False, word.lower()))
            return 9

        contexts_of = of

        def plain_of(self, word):
            self.asked.add((True, word))
            return 9

        plain_contexts_of = plain_of

    for text in CLEAN:
        for right, wrong in [("utf-8", "cp1252"), ("utf-8", "cp850"), ("cp1252", "cp850"), ("mac_roman", "cp1252")]:
            for token in decoded(text + " don’t “l’élève” col·legi", right, wrong).split(" "):
                Recording.asked = set()
                E.Judge(Recording({})).evidence(token)
                assert {k for k in Recording.asked if not k[1].isascii() or k[0]} <= E.words_to_judge(token), token


@pytest.mark.parametrize("text", ["x" * 300_000, "é" * 100_000, "x" * 300_000 + "é", "é," * 50_000, "»" * 100_000])
def test_unbroken_texts_take_one_scan(fixer, text):
    import time

    started = time.time()
    fixer.repair(text)
    E.words_to_judge(text)
    assert time.time() - started < 10
