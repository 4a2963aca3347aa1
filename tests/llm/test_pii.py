"""Personal information: grammars on fixtures, names against a corpus with known ones."""

import random

import pytest

from textrill.llm import pii as P

NONE = P.Names({})


def kinds(text, names=NONE):
    return [(k, text[s:e]) for s, e, k in P.pieces(text, names)]


@pytest.mark.parametrize(
    ("text", "piece"),
    [
        ("Escriviu a <jolmene.nabnet@example.org>.", "jolmene.nabnet@example.org"),
        ("mailto:a_b@mail.x.example", "a_b@mail.x.example"),
        ("e-mail: efris72(arroba)vilsugran.example fins", "efris72(arroba)vilsugran.example"),
        ("sundod.t [at] mail [dot] valvemont [dot] example The", "sundod.t [at] mail [dot] valvemont [dot] example"),
        ("kendrn+escola @ ternaques.test.", "kendrn+escola @ ternaques.test"),
        ("X@Y.TEST", "X@Y.TEST"),
        ("ann at mail dot example dot org now", "ann at mail dot example dot org"),
    ],
)
def test_email(text, piece):
    assert kinds(text) == [("email", piece)]


@pytest.mark.parametrize("number", "+34 996 45 99 79|0034 996-356-706|997 951 012|997768075|01 99 00 59 57|01.99.00.66.61|+33 1 99 00 71 39|+33 (0)1 99 00 11 90|030/23125-001|(030) 23125 049|+49 30 23125 591|+49 (0)30 23125362|(01632) 960-196|+44 1632 960316|07700 900555|(302) 555-0177".split("|"))
def test_phone(number):
    assert kinds(f"Call {number} in the morning.") == [("phone", number)]
    assert kinds(f"Telèfon: {number}.") == [("phone", number)]
    assert kinds(f"In urgent cases, {number} ext. 88.") == [("phone", number)]


@pytest.mark.parametrize("number", "99.735.283-S|99101372-F|99890709F|z9068350f|Z-9858958-J|Z 9879357 B|99708778 Y|QQ 87 39 36 C|000-44-5273|000 81 9076|09 494 681 814|07707939973|273179954789096|2 32 15 99 607 088 08".split("|"))
def test_identity(number):
    assert kinds(f"The form names document {number} as proof.") == [("identity", number)]


@pytest.mark.parametrize(
    "place",
    "carrer de Saltagran, 175|plaça de Galdodrau 135|av. Morlebosc, núm. 109|Avda. Vildonet, nº 90|C/ Terveques 94|C/ Bruriques 175b|calle Lamsuques, 159|170, rue de Casvedrau|33 bis, avenue Casdomar|98 boulevard Lamdomont|Brumaquesweg 156|Galdomarstr. 5|Lamgogran-Allee 3|Galvenetstraße 139|172 Gallemar Lane|57 Lamnanet Street|placa de brunagran 145|120 belnanet road".split("|"),
)
def test_address(place):
    assert kinds(f"Lives at {place}. The teacher") == [("address", place)]
    assert kinds(f"Domicili: {place} (Vallemar)") == [("address", place)]


@pytest.mark.parametrize(
    "text",
    ["Ref. 2376-3068-292.", "INV-00535909.", "ISBN 000-0-5147-263-0", "build 20241124-9365", "on 2025-10-15 and 13/10/2021", "2025-09-13T17:16:17", "413.2115, 2.473", "4464,17 €", "@Torberac", "MV-8763/19", "5.27 × 31.5 cm", "", None, "room 115 on page 91", "La troupe place la table rouge dans la salle 84"],
)
def test_nothing(text):
    assert P.pieces(text, NONE) == []


def test_stored_piece_of_odd_characters():
    text = "Escriviu a jol­mene@exa​mple.org. Ｃａｒｒｅｒ x"
    (s, e, kind), *_ = P.pieces(text, NONE)
    assert (kind, text[s:e], P.value_of(text[s:e])) == ("email", "jol­mene@exa​mple.org", "jolmeneexampleorg")


GIVEN = ["Isbéi", "Orrine", "Tandrl", "Kebéva", "Milian", "Ruril", "Velrira", "Sunris"]
FAMILY = ["Nablosk", "Havnést", "Croflosk", "Zorvibch", "Murtiù", "Quinmox", "Wemrask", "Talmot"]
PLACES = ["Morsubosc", "Ternanet", "Lamgomar"]


PHRASES = ["Signat: {}.", "Ask for Mrs {} at the front desk.", "{} | 997 951 012", "La tutora és {}.", "{} porta la cadira gran."]
# said in ways that no list of phrases foresees
OTHER_PHRASES = ["Clau lliurada a: {}.", "The boiler was checked with Dr {} on site.", "{} | 997 951 012", "Vertreten durch {}.", "{} porta la cadira gran."]


def corpus(phrases=PHRASES):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        a, b, c = rng.choice(GIVEN), rng.choice(FAMILY), rng.choice(FAMILY)
        name = rng.choice([f"{a} {b}", f"{a} de {b}", f"{a} {b}-{c}", f"{b.upper()} {a}", f"{b}, {a}", f"{a[0]}. {b}"])
        line = rng.choice(phrases).format(name)
        rest = f"La mestra porta la tassa a {rng.choice(PLACES)}. Per a urgències, 991 221 318. El xofer vol la cadira gran a {rng.choice(PLACES)}."
        text = f"{rest}\n{line}"
        low = i % 6 == 0
        rows.append((i, text.lower() if low else text, name.lower() if low else name))
    return rows


@pytest.mark.parametrize("phrases", [PHRASES, OTHER_PHRASES])
def test_names_in_a_corpus(spark, phrases):
    rows = corpus(phrases)
    df = spark.createDataFrame([*rows, (1000, None, ""), (1001, "", "")], "id long, t string, kind string")
    terms = P.materialize(P.disclosing_terms(P.materialize(P.term_statistics(df, "t"), "s")), "t")
    found = {r["term"] for r in terms.collect()}
    assert {x.lower() for x in GIVEN + FAMILY} <= found
    assert not found & {"mestra", "xofer", "urgencies", "urgències", "cadira", *map(str.lower, PLACES)}

    def emit(i, text, names):
        return [(i, k, text[s:e]) for s, e, k in P.pieces(text, names)]

    schema = "id long, kind string, value string"
    a = sorted(map(tuple, P.with_names(df, "id", "t", terms, emit, schema).collect()))
    b = sorted(map(tuple, P.with_names(df, "id", "t", terms, emit, schema, broadcast_terms=0).collect()))
    assert a == b
    got = {}
    for i, k, v in a:
        if k == "person":
            got.setdefault(i, []).append(v)
    right = sum(got.get(i) == [name] for i, _, name in rows)
    assert right / len(rows) > 0.97
    assert all("Morsubosc" not in v for vs in got.values() for v in vs)


def test_sanitised(spark):
    names = P.Names({"isbei": 2, "isbéi": 2, "nablosk": -2})
    assert P.sanitise("Signat: Isbéi Nablosk, 997 951 012; C/ Tortamar 15 a@b.example fi", names) == "Signat: [PERSON], [PHONE]; [ADDRESS] [EMAIL] fi"
    assert P.sanitise(None, names) is None and P.sanitise("", names) == ""
    long = "La casa és gran. " * 50_000 + "Isbéi Nablosk"
    assert P.sanitise(long, names).endswith("[PERSON]")


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, t string")
    assert P.disclosing_terms(P.term_statistics(df, "t")).count() == 0
    assert P.entity_statistics(spark.createDataFrame([(None,), ("Isbéi  Nablosk ",)], "n string"), "n").count() == 3


@pytest.mark.parametrize("number", ["2 85 05 2A 123 456 78", "2 85 05 2B 123 456", "185052A12345678", "185052b123456"])
def test_identity_with_a_lettered_department(number):
    assert kinds(f"The form names document {number} as proof.") == [("identity", number)]


def test_broadcast_and_join_learn_the_same(spark):
    df = spark.createDataFrame([r[:2] for r in corpus()], "id long, t string")
    people = spark.createDataFrame([(f"{a} {b}",) for a, b in zip(GIVEN[:6], FAMILY[:6])], "name string")
    a = sorted(map(tuple, P.term_statistics(df, "t", people).collect()))
    assert a == sorted(map(tuple, P.term_statistics(df, "t", people, broadcast_terms=-1).collect()))
    assert {"mrs", "for", "tutora"} & {r[0] for r in a if r[-1]} == {"for", "tutora"}


def test_terms_that_give_one_entity_away(spark):
    rows = [(i, f"Avisos del dia {i}. Truqueu al rellotger {'991 221 318' if i % 4 == 0 else '991 555 101'} pel {'carilló' if i % 4 == 0 else 'timbre'} avariat. La porta és tancada.") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string")
    statistics = P.materialize(P.term_statistics(df, "t"), "s")
    terms = P.materialize(P.disclosing_terms(statistics), "t")
    got = {(r["entity"], r["term"]) for r in P.entity_disclosures(df, "id", "t", terms, statistics).collect()}
    assert ("991221318", "carilló") in got and ("991555101", "timbre") in got
    assert not any(e == "991221318" and t in ("porta", "rellotger", "truqueu") for e, t in got)


@pytest.mark.parametrize("text", ["\n".join(f"Telèfon: 991 {i % 900 + 100} {i * 7 % 900 + 100}." for i in range(20_000)), "Straße Signat: Isbéi Nablosk. æ\n" * 20_000, "x" * 2_000_000, "aB3+/" * 400_000])
def test_long_texts_take_one_scan(text):
    import time

    names = P.Names({"isbei": 2, "isbéi": 2, "nablosk": -2})
    started = time.time()
    P.pieces(text, names)
    list(P._contexts(text, {}))
    assert time.time() - started < 10
