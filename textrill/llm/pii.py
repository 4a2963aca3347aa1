"""Personal information inside free text (problem 2).

Grammars give the *protected entities* that have a form of their own: e-mail
addresses, phone numbers, identity numbers and street addresses. People have none,
so information-theoretic sanitisation finds what discloses them, from co-occurrence
over all rows. A *disclosure* is the pointwise mutual information of an observation
with a protected entity as a share of the bits that certainty would give,

    log2( P(entity | observation) / P(entity) ) / -log2 P(entity).

1. *Contexts*: the two tokens before a word. Of each context that stands before
   ``LEAST_NAMES`` or more different names of protected people (a given list, or what
   stands beside addresses and numbers), it is counted how often it occurs and how
   often such a name follows. Contexts that disclose a person by ``CONTEXT_SHARE``
   ("signed :", "ask for", in whatever language and wording the corpus has) open slots.
2. *Terms*: how often each term stands in a slot, beside an address or number in a
   list, or, as a weaker sign, in a run of capitalised words, and how often at all.
   Terms that disclose a person by ``DISCLOSURE`` are removed wherever they stand, in
   slots or not, together with the particles and initials that tie them into one name.
   Which of given name and surname a term is, follows from its places in slots. Texts
   without capitals are counted apart and decide only about terms that no other text has.
3. *Other terms of an entity* (``entity_disclosures``): terms in the window of a piece
   that give this one entity away, as the name of a flat or a post may. They are
   reported; the texts keep them, as problem 2 of the test tables asks.

Contexts, protected names and disclosing terms grow with the corpus. They are
broadcast only up to ``BROADCAST_TERMS`` rows; beyond, they are joined.

Null and empty texts hold nothing. Texts with look-alike, full-width or invisible
characters are searched in plain form; pieces are reported as stored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textrill.llm import canonical
from textrill.llm.common import fold, materialize, spread, table

DISCLOSURE = 0.85
CONTEXT_SHARE = 0.7
LEAST_NAMES = 5
WINDOW = 12
BROADCAST_TERMS = 500_000
KINDS = ("person", "email", "phone", "identity", "address")

# Signs of an address written as words, in the languages in use.
AT_WORDS = "at|arroba|chez|bei|ät"
DOT_WORDS = "dot|punt|punto|point|punkt"
_local = r"[^\W_](?:[\w.%+\-]*[^\W_])?"
_label = r"[^\W_](?:[\w\-]*[^\W_])?"
EMAIL = re.compile(
    rf"(?<![\w.+\-])(?:{_local}(?:\s?@\s?|\s?[(\[{{]\s?(?:{AT_WORDS})\s?[)\]}}]\s?){_label}(?:(?:\.|\s?[(\[{{]\s?(?:{DOT_WORDS})\s?[)\]}}]\s?){_label})*"
    rf"(?:\.|\s?[(\[{{]\s?(?:{DOT_WORDS})\s?[)\]}}]\s?)[^\W\d_]{{2,}}"
    rf"|{_local}\s(?:{AT_WORDS})\s{_label}(?:\s(?:{DOT_WORDS})\s{_label})+)(?!\w)",
    re.I,
)
_EMAIL_SIGN = re.compile(rf"@|[(\[{{]\s?(?:{AT_WORDS})\s?[)\]}}]|\s(?:{AT_WORDS})\s(?=[\w\-]+\s(?:{DOT_WORDS})\s)", re.I)

_before, _after = r"(?<![\w.,/\-+(])", r"(?![\w]|[/\-]\w|\.\d)"
PHONE = re.compile(
    _before
    + r"(?:\(?(?:\+|00(?!0))\d{1,3}\)?[ .\-]?(?:\(0\)[ .\-]?)?\d(?:[ .\-/]?\d){6,11}"
    + r"|\(0?\d{2,4}\)[ \-/]?\d{3,6}(?:[ \-]?\d{2,4}){0,2}"
    + r"|0\d{2,4}/\d{4,8}(?:[ \-]\d{1,4})?"
    + r"|0\d(?:[ .\-]\d\d){4}|0\d{9}"
    + r"|0\d{4}[ \-]\d{3}[ \-]?\d{3}|0[27]\d{2,3}[ \-]\d{4,6}|0\d{2}[ \-]\d{4}[ \-]\d{4}"
    + r"|[6-9]\d\d([ .\-]?)\d{3}\1\d{3}|[6-9]\d\d(?:[ .\-]\d\d){3}"
    + r"|[2-9]\d\d([.\-])\d{3}\2\d{4})"
    + _after
)
IDENTITY = re.compile(
    r"(?<![\w.,/\-+(])(?:"
    r"(?:[XYZ][ .\-]?\d{7}|\d{8}|\d{2}\.\d{3}\.\d{3})[ \-]?[A-Z]"  # NIF and NIE
    r"|[12] \d\d \d\d (?:\d\d|2[AB]) \d{3} \d{3}(?: \d\d)?|[12]\d{4}(?:\d\d|2[AB])\d{6}(?:\d\d)?"  # numéro de sécurité sociale
    r"|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]"  # National Insurance
    r"|\d{3}([ \-])\d\d\1\d{4}"  # Social Security
    r"|\d\d \d{3} \d{3} \d{3}|\d{11}"  # Steuer-Identifikationsnummer
    r")(?![\w]|[/\-]\w|\.\d)",
    re.I,
)

# Street types that stand before the name, after it, and at its end.
TYPE_FIRST = (
    r"carrer|calle|c/|cl\.|avinguda|avenida|avda\.?|avgda\.?|av\.?|plaça|placa|plaza|pl\.|pça\.|pza\.|passeig|paseo|pg\.|p\.º|pº|camí|cami|camino|cno\.|rambla|rbla\.|ronda|rda\.|travessera|travessia|travesía|travesia|carretera|ctra\.|passatge|pasaje|baixada|pujada|torrent|via|vía"
)
TYPE_FRENCH = r"rue|avenue|av\.|boulevard|bd\.?|boul\.|chemin|ch\.|allée|allee|allées|impasse|quai|cours|place|pl\.|route|rte|square|passage|sentier|villa|ruelle|faubourg|fg"
TYPE_ENGLISH = r"street|st\.?|lane|ln\.?|road|rd\.?|avenue|ave\.?|drive|dr\.?|square|sq\.?|close|way|court|ct\.?|terrace|place|crescent|gardens|hill|row|walk|boulevard|blvd\.?"
TYPE_GERMAN = r"straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm|steig|pfad|chaussee"
_link = r"(?:(?:de la|de les|de los|de las|de l['’]|dels|del|des|du|de|d['’]|la|les|el|els) ?)?"
_name = r"[^\W\d_]+(?:[-'’·][^\W\d_]+)*"
_sign = r"(?:núm\.?|num\.?|n\.?[º°]|nro\.?|n\.|no\.|nr\.)"
# every address has a house number; what stands before or after it decides
HOUSE = re.compile(r"(?<![\w.,/\-+:])\d{1,4}(?:(?: ?(?:bis|ter|quater)|[a-z])(?!\w))?(?![\w]|[/\-.:,]\d)", re.I)
_ADDRESS_BEFORE = re.compile(
    rf"(?<![\w@])(?:(?:{TYPE_FIRST}) ?(?<![a-zç]){_link}{_name}(?: {_name}){{0,2}}?(?:, ?| )(?:{_sign} ?)?|{_name}(?:[- ])?(?:{TYPE_GERMAN}) )$", re.I
)
_ADDRESS_AFTER = re.compile(rf",? (?:(?:{TYPE_FRENCH}) {_link}{_name}|{_name}(?: {_name})?? (?:{TYPE_ENGLISH})(?!\w))", re.I)
_TYPE_BEFORE = re.compile(rf"(?:(?<!\w)(?:{TYPE_FIRST})|(?:{TYPE_GERMAN}))(?!\w)", re.I)
# runs of digits long enough for a number that identifies someone
# (2A and 2B are departments inside a numéro de sécurité sociale)
_RUN = re.compile(r"\d(?: ?2[ABab](?= ?\d)|[ .\-/()]{0,3}\d){5,}")
_DATE = re.compile(r"\d{4}-\d\d-\d\d|\d{1,2}([/.])\d{1,2}\1\d{4}")

# Forms of address and words that end a slot; particles inside names.
TITLES = frozenset(
    "sr sra srta dr dra mr mrs ms miss mx herr herrn frau fraulein docteur doktor professorin senorita senyoreta maitre maestro maestra mestre mestra m mme mlle me don dona dna d professor professora profesor profesora senyor senyora senor senora professeur professeure monsieur madame mademoiselle prof doctor doctora lehrer lehrerin el la le en na al dem der die das the".split()
)
STOPS = frozenset("i y e and et und a al an am at per por para pour fur de until fins hasta avant bis dues dos two deux zwei persones personas others autres personnes weitere".split())
PARTICLES = frozenset("de del dels d da do dos das di du des von van der den zu vom zum la le i y".split())
_LEADING = frozenset("de del d da di du von van vom zu".split())

# Articles and pronouns that begin a sentence before a noun, lower-case without accents.
FUNCTION = frozenset("el la els les los las lo un una uno unos unas l en na le du des une the a an our any this that der die das den dem ein eine einen unser unsere jede jeder jedes kein nuestra nuestro cualquier qualsevol notre toute tout cada cette ce este esta aquest aquesta".split())

_TOKEN = re.compile(r"[^\W\d_]+")


class _Taken:
    """Pieces without overlap, in order of their start; asking and adding cost a search, not a scan."""

    def __init__(self, pieces=()):
        self.pieces: list[tuple[int, int, str]] = sorted(pieces)

    def free(self, start: int, end: int) -> bool:
        i = bisect_left(self.pieces, (end,))
        return i == 0 or self.pieces[i - 1][1] <= start

    def add(self, piece: tuple[int, int, str]) -> bool:
        if not self.free(piece[0], piece[1]):
            return False
        insort(self.pieces, piece)
        return True


def _emails(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for m in _EMAIL_SIGN.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        for e in EMAIL.finditer(text, max(out[-1][1] if out else 0, m.start() - 80), min(len(text), m.end() + 160)):
            if e.start() <= m.start() and e.end() >= m.end():
                out.append((*e.span(), "email"))
    return out


def _numbers(text: str, both: bool = True) -> list[tuple[int, int, str]]:
    """Identity and phone numbers, each looked for around long runs of digits."""
    out = _Taken()
    for run in _RUN.finditer(text):
        if _DATE.fullmatch(run.group()):
            continue
        lo, hi = max(0, run.start() - 5), min(len(text), run.end() + 3)
        for pattern, kind in ((IDENTITY, "identity"), (PHONE, "phone")) if both else ((PHONE, "phone"),):
            for m in pattern.finditer(text, lo, hi):
                # the pattern must also hold where the window does not end the text
                if out.free(*m.span()) and (whole := pattern.match(text, m.start())) and whole.end() == m.end():
                    out.add((*m.span(), kind))
    return out.pieces


def _addresses(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for n in HOUSE.finditer(text):
        s, e = n.span()
        lo = max(0, s - 80)
        m = None
        window = text[lo:s]
        if _TYPE_BEFORE.search(window):
            m = _ADDRESS_BEFORE.search(window)
        if m:
            out.append((lo + m.start(), e, "address"))
        elif after := _ADDRESS_AFTER.match(text, e):
            out.append((s, after.end(), "address"))
    return out


def _grammar(text: str) -> list[tuple[int, int, str]]:
    """Non-overlapping pieces of the kinds with a form of their own, in the order e-mail, address, identity, phone."""
    out = _Taken()
    for find in (_emails, _addresses, _numbers):
        for piece in find(text):
            out.add(piece)
    return out.pieces


_STEP = re.compile(r"[^\W\d_]+|\S|\s+")


def _slot_after(text: str, at: int, cased: bool) -> list[str]:
    """The name words after a cue, with ',' where the surname stands first."""
    out: list[str] = []
    for m in _STEP.finditer(text, at, min(len(text), at + 90)):
        w = m.group()
        if w[0].isspace():
            if "\n" in w or "\t" in w:
                break
            continue
        if w[0].isalpha():
            low = fold(w)
            if (low in TITLES or len(w) == 1) and not out:
                continue  # a form of address or an initial
            if low in PARTICLES and out and (not cased or w.islower()):
                if low in STOPS and low not in _LEADING:
                    break
                continue
            if low in STOPS or (cased and not w[0].isupper()):
                break
            out.append(w)
            if len([x for x in out if x != ","]) == 4:
                break
        elif w == "," and out and "," not in out and len(out) <= 2:
            out.append(w)
        elif w in "-.'’‐‑" and (out or w == "."):
            if w == "." and out:
                break
            continue
        else:
            break
    return out[:-1] if out and out[-1] == "," else out


_TAIL = re.compile(r"(?<![.@\w])([^\n\t|;:.!?<>()\d]{2,60})\s?[|;,\t]\s?(?:<|mailto:)?$")


def _slot_before(text: str, start: int, cased: bool) -> list[str]:
    """The name words before an address or number in a list."""
    m = _TAIL.search(text, max(0, start - 80), start)
    if not m:
        return []
    words: list[str] = []
    for w in re.findall(r"[^\W\d_]+|,", m.group(1)):
        low = fold(w)
        if w == ",":
            words.append(w)
        elif not cased and (low in STOPS or low in ("en", "in", "cas")) and low not in PARTICLES:
            return []  # an adverbial before a number, not a name
        elif low in PARTICLES and w.islower():
            continue
        elif cased and not w[0].isupper():
            words = []
        else:
            words.append(w)
    names = [w for w in words if w != ","]
    if not names or len(names) > 4 or words.count(",") > 1 or words[0] == "," or words[-1] == ",":
        return []
    return words


def _roles(slot: list[str]) -> list[tuple[str, int]]:
    """Each word of a slot with +1 for a given name, -1 for a surname, 0 unknown."""
    if "," in slot:
        k = slot.index(",")
        return [(w, -1) for w in slot[:k]] + [(w, 1) for w in slot[k + 1 :]]
    if len(slot) == 1:
        return [(slot[0], 0)]
    if len(slot[0]) > 2 and slot[0].isupper() and not slot[-1].isupper():
        upper = [w for w in slot if w.isupper()]
        return [(w, -1) for w in upper] + [(w, 1) for w in slot if not w.isupper()]
    return [(slot[0], 1)] + [(w, -1) for w in slot[1:]]


def plain_form(text: str) -> tuple[str, list[int] | None]:
    """The text to search and, where it differs, the stored offset of each character."""
    if text.isascii() or not canonical._classes()["any"].search(text):
        return text, None
    return canonical.letters_map(text)


_CAP = "[A-ZÀ-ÖØ-Þ][^\\W\\d_]{2,}"
_CAPITALS = re.compile(rf"(?<![\w'’@./&«-])(?:{_CAP}|[A-ZÀ-Þ]\.)(?:[ -]{_CAP}| (?:de|von|van|di|da|del|d['’]) ?{_CAP})+(?![\w@])")
STATISTICS = ("n", "lower", "slots", "pairs", "given", "surname", "plain_n", "plain_slots")
_COUNTS = (*STATISTICS, "total", "first")
_CONTEXT_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")


def _contexts(text: str, folded: dict[str, str]) -> Iterator[tuple[int, str, str]]:
    """(start, folded word, context) of the words that do not begin a sentence; forms of address and initials are looked through."""
    a = b = "\n"
    skipped = False
    for m in _CONTEXT_TOKEN.finditer(text):
        t = m.group()
        f = folded.get(t)
        if f is None:
            f = fold(t) or t  # a lone accent folds to nothing
            if len(folded) < 400_000:
                folded[t] = f
        if f[0].isalpha():
            if len(f) == 1 or f in TITLES:
                skipped = True
                continue
            if b[0].isalpha() or b == ":":
                yield m.start(), f, f"{a} {b}"
        elif f == "." and skipped:
            continue
        skipped = False
        a, b = b, f


def _few(rows: DataFrame, column: str, most: int):
    """A broadcast set of the values of a column, or None where there are more than ``most`` of them."""
    values = rows.select(column).distinct()
    if values.count() > most:
        return None
    return rows.sparkSession.sparkContext.broadcast({r[0] for r in values.collect()})


def protected_names(docs: DataFrame, column: str, people: DataFrame | None) -> DataFrame:
    """(term): words of the names of protected people, folded; without a list, what stands beside addresses and numbers twice or more."""

    def listed(batches):
        for batch in batches:
            terms = {fold(w) for name in batch.column(0).to_pylist() if name for w in _TOKEN.findall(name) if len(w) > 2 and (w[0].isupper() or name.islower())} - TITLES - PARTICLES
            yield pa.RecordBatch.from_pydict({"term": pa.array(sorted(terms), pa.string()), "n": pa.array([2] * len(terms), pa.int64())})

    def beside(batches):
        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    text, _ = plain_form(text)
                    for s, _, _ in (*_emails(text), *_numbers(text, both=False)):
                        seen.update(f for w in _slot_before(text, s, text != text.lower()) if len(f := fold(w)) > 2 and f not in TITLES and f not in PARTICLES)
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = people.select(people.columns[0]).mapInArrow(listed, "term string, n long") if people is not None else spread(docs.select(column)).mapInArrow(beside, "term string, n long")
    return rows.groupBy("term").agg(F.sum("n").alias("n")).filter("n > 1").select("term")


def candidate_contexts(docs: DataFrame, column: str, names: DataFrame, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(context): what stands before ``LEAST_NAMES`` or more different protected names."""
    shared = _few(names, "term", broadcast_terms)

    def run(batches):
        wanted, seen, folded = shared.value if shared else None, Counter(), {}

        def flush():
            keys = list(seen)
            yield pa.RecordBatch.from_pydict({"context": pa.array([k[0] for k in keys], pa.string()), "term": pa.array([k[1] for k in keys], pa.string())})
            seen.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                text, _ = plain_form(text)
                if wanted is not None and wanted.isdisjoint(map(fold, set(_TOKEN.findall(text)))):
                    continue
                for _, word, context in _contexts(text, folded):
                    if wanted is None or (word in wanted and context.partition(" ")[2] not in wanted):
                        seen[context, word] = 1
                if len(seen) > 300_000:
                    yield from flush()
        yield from flush()

    rows = spread(docs.select(column)).mapInArrow(run, "context string, term string").distinct()
    if shared is None:
        last = names.select(F.col("term").alias("last"))
        rows = rows.join(names, "term", "left_semi").withColumn("last", F.substring_index("context", " ", -1)).join(last, "last", "left_anti")
    return rows.groupBy("context").agg(F.count("*").alias("names")).filter(F.col("names") >= LEAST_NAMES).select("context")


def term_statistics(docs: DataFrame, column: str, people: DataFrame | None = None, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(term, *STATISTICS, cue) over all rows, the totals under term ''.

    Of texts with capitals: ``n`` occurrences, ``lower`` those in lower case, ``slots`` those in
    slots of disclosing contexts and beside addresses and numbers, ``pairs`` those in runs of
    capitalised words. ``given`` and ``surname``: roles in slots. ``plain_n`` and ``plain_slots``: the
    same of texts without capitals. ``cue``: in how many disclosing contexts the term is a word.
    Counted per task before the shuffle.
    """
    names = materialize(protected_names(docs, column, people), "p2-names")
    candidates = materialize(candidate_contexts(docs, column, names, broadcast_terms), "p2-candidates")
    shared = _few(candidates, "context", broadcast_terms)

    def run(batches):
        wanted, folded = shared.value if shared else None, {}
        words, c = (Counter(), Counter()), {}

        def counters(context):
            if context not in c:
                c[context] = {k: Counter() for k in _COUNTS}
            return c[context]

        def flush():
            own = counters("")
            for w, n in words[0].items():
                for t in _forms(w):
                    own["n"][t] += n
                    if w[0].islower():
                        own["lower"][t] += n
            for w, n in words[1].items():
                for t in _forms(w):
                    own["plain_n"][t] += n
            own["n"][""], own["plain_n"][""] = sum(words[0].values()), sum(words[1].values())
            rows = [(context, t, counts) for context, counts in c.items() for t in set().union(*counts.values())]
            yield pa.RecordBatch.from_pydict({"context": pa.array([r[0] for r in rows], pa.string()), "term": pa.array([r[1] for r in rows], pa.string()), **{k: pa.array([r[2][k][r[1]] for r in rows], pa.int64()) for k in _COUNTS}})
            words[0].clear()
            words[1].clear()
            c.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                text, _ = plain_form(text)
                cased = text != text.lower()
                slot = "slots" if cased else "plain_slots"
                for at, word, context in _contexts(text, folded):
                    if wanted is None or context in wanted:
                        mine = counters(context)
                        mine["total"][""] += 1
                        mine["first"][word] += 1
                        _count_name(mine, _slot_after(text, at, cased), slot)
                mails = _emails(text)
                for s, _, _ in (*mails, *_numbers(text, both=False)):
                    _count_name(counters(""), _slot_before(text, s, cased), slot)
                kept, at = [], 0
                for s, e, _ in mails:  # parts of addresses are no occurrences of a term
                    kept += [text[at:s], " "]
                    at = e
                text = "".join([*kept, text[at:]])
                words[not cased].update(_TOKEN.findall(text))
                if cased:
                    for m in _CAPITALS.finditer(text):
                        run_ = _TOKEN.findall(m.group())
                        run_ = [w for w in run_ if w[0].isupper() and fold(w) not in TITLES]
                        if run_ and fold(run_[0]) in FUNCTION:
                            run_ = run_[1:]
                        if len(run_) > 1:
                            _count_name(counters(""), run_, "pairs")
            if len(words[0]) + len(words[1]) > 300_000:
                yield from flush()
        yield from flush()

    columns = ", ".join(f"{k} long" for k in _COUNTS)
    counted = spread(docs.select(column)).mapInArrow(run, f"context string, term string, {columns}").groupBy("context", "term").agg(*[F.sum(k).alias(k) for k in _COUNTS])
    if shared is None:
        counted = counted.join(candidates.unionByName(candidates.sparkSession.createDataFrame([("",)], "context string")), "context", "left_semi")
    counted = materialize(counted, "p2-counted")
    contexts = disclosing_contexts(counted, names)
    chosen = counted.join(contexts.select("context").unionByName(contexts.sparkSession.createDataFrame([("",)], "context string")), "context", "left_semi")
    rows = chosen.filter("context = '' OR term <> ''").select("term", *STATISTICS, F.lit(0).cast("long").alias("cue"))
    rows = rows.unionAll(contexts.select(F.explode(F.split("context", " ")).alias("term"), *[F.lit(0).cast("long").alias(k) for k in STATISTICS], F.lit(1).cast("long").alias("cue")))
    if people is not None:
        rows = rows.unionAll(entity_statistics(people, people.columns[0]).withColumn("cue", F.lit(0).cast("long")))
    return rows.groupBy("term").agg(*[F.sum(k).alias(k) for k in (*STATISTICS, "cue")])


def disclosing_contexts(counted: DataFrame, names: DataFrame, share: float = CONTEXT_SHARE) -> DataFrame:
    """(context, total, people): the contexts that disclose a protected person by ``share`` or more."""
    own = counted.filter("context = ''")
    seen = own.filter("term = ''").agg(F.sum(F.col("n") + F.col("plain_n"))).first()[0] or 0
    people = own.join(names, "term", "left_semi").agg(F.sum(F.col("n") + F.col("plain_n"))).first()[0] or 0
    prior = min(max(people, 1) / max(seen, 2), 0.5)
    total = counted.filter("context <> '' AND term = ''").select("context", "total")
    followed = counted.filter("context <> '' AND first > 0").join(names, "term", "left_semi").groupBy("context").agg(F.sum("first").alias("people"))
    return total.join(followed, "context").filter(F.log2(F.col("people") / F.col("total") / F.lit(prior)) >= share * -F.log2(F.lit(prior)))


def _count_name(counters: dict[str, Counter], name: list[str], kind: str) -> None:
    for w, role in _roles(name) if name else ():
        if len(w) < 3 or fold(w) in TITLES or fold(w) in PARTICLES:
            continue
        for t in _forms(w):
            counters[kind][t] += 1
            counters["given"][t] += role > 0
            counters["surname"][t] += role < 0


def entity_statistics(people: DataFrame, column: str) -> DataFrame:
    """The statistics of a list of protected people: each name is one more protected slot."""

    def run(batches):
        c = {k: Counter() for k in STATISTICS}
        for batch in batches:
            for name in batch.column(0).to_pylist():
                words = _TOKEN.findall(name) if name else []
                _count_name(c, [w for w in words if w[0].isupper() or name.islower()], "slots")
        for k in ("n", "slots"):
            c[k] = Counter(c["slots"])
        terms = list(c["slots"])
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), **{k: pa.array([v[t] for t in terms], pa.int64()) for k, v in c.items()}})

    return people.select(column).mapInArrow(run, "term string, " + ", ".join(f"{k} long" for k in STATISTICS))


def _forms(word: str) -> tuple[str, ...]:
    """The forms a word is counted under: lower case, and without accents where that differs."""
    low = word.lower()
    plain = fold(word)
    return (low,) if low == plain else (low, plain)


def disclosing_terms(statistics: DataFrame, share: float = DISCLOSURE) -> DataFrame:
    """(term, role, bits) of the terms that disclose a person.

    The role is 1 for a given name, -1 for a surname, and twice that where a slot other than a run
    of capitals named the person, so that the term alone is enough. A term mostly written in lower
    case where texts have capitals is no name.
    """
    totals = statistics.agg(F.sum(F.when(F.col("term") == "", F.col("n") + F.col("plain_n"))), *[F.sum(F.when(F.col("term") != "", F.col(k))) for k in ("slots", "pairs", "plain_slots")]).first()
    seen, slots = totals[0] or 0, sum(x or 0 for x in totals[1:])
    prior = F.lit(min(max(slots, 1) / max(seen, 2), 0.5))
    rows = statistics.filter("term <> '' AND slots + pairs + plain_slots > 0")
    # what announces names stands at their beginning in runs of capitals, but in no slot itself
    rows = rows.filter("cue = 0 OR slots + plain_slots >= 0.1 * (n + plain_n)")
    in_slot = F.when(F.col("n") > 0, F.least(F.col("slots") + F.col("pairs"), "n") / F.col("n")).otherwise(F.least("plain_slots", "plain_n") / F.greatest("plain_n", F.lit(1)))
    scored = rows.withColumn("bits", F.log2(in_slot / prior)).withColumn("full", -F.log2(prior))
    named = F.col("slots") + F.col("plain_slots")
    strong = F.when((named > 1) | ((named == 1) & (F.col("n") + F.col("plain_n") <= 3)), 2).otherwise(1)
    role = (F.when(F.col("given") > F.col("surname"), 1).otherwise(-1) * strong).cast("int")
    return scored.filter((F.col("bits") >= share * F.col("full")) & (F.col("lower") <= 0.2 * F.col("n"))).select("term", role.alias("role"), "bits")


class Names:
    """Finds names by a lexicon of folded terms with their roles."""

    def __init__(self, lexicon: dict[str, int]):
        self.lexicon = lexicon
        self.seen: dict[str, int] = {}

    def role(self, word: str) -> int:
        r = self.seen.get(word)
        if r is None:
            r = self.lexicon.get(word.lower(), 0) or self.lexicon.get(fold(word), 0)
            if len(self.seen) < 400_000:
                self.seen[word] = r
        return r

    def find(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
        words = _TOKEN.findall(text)
        if not any(map(self.role, set(words))):
            return []
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
        roles = [self.role(w) for _, _, w in tokens]
        held = _Taken(taken)
        for i, (s, e, _) in enumerate(tokens):
            if roles[i] and not held.free(s, e):
                roles[i] = 0
        out, i = [], 0
        while i < len(tokens):
            if not roles[i]:
                i += 1
                continue
            j = self._name(text, tokens, roles, i)
            if max(map(abs, roles[i : j + 1])) < 2:
                i += 1
                continue
            start, end = tokens[i][0], tokens[j][1]
            # an initial and a particle before a lone surname
            before = re.search(r"(?<![\w.])(?:[^\W\d_]\. ?-?)+$", text[max(0, start - 8) : start])
            if before and roles[i] < 0 and (before.group()[0].isupper() or tokens[i][2].islower()):
                start -= len(before.group())
            out.append((start, end))
            i = j + 1
        return out

    def _name(self, text, tokens, roles, i) -> int:
        """The last token of the name that starts at token i."""
        k, had_given, had_surname, comma = i, roles[i] > 0, roles[i] < 0, False
        shouting = tokens[i][2].isupper() and len(tokens[i][2]) > 1
        if shouting:
            had_given, had_surname = False, True
        while k + 1 < len(tokens):
            gap = text[tokens[k][1] : tokens[k + 1][0]]
            nxt = k + 1
            if gap == " " and fold(tokens[nxt][2]) in _LEADING and not had_surname:
                # particles: de, de la, von der
                p = nxt
                while p + 1 < len(tokens) and fold(tokens[p][2]) in PARTICLES and text[tokens[p][1] : tokens[p + 1][0]] in (" ", "'", "’"):
                    p += 1
                if p > nxt and p < len(tokens) and roles[p] and text[tokens[p - 1][1] : tokens[p][0]] in (" ", "'", "’"):
                    k, had_surname = p, True
                    continue
                break
            if not roles[nxt]:
                break
            upper = tokens[nxt][2].isupper()
            given = roles[nxt] > 0 and not (shouting is False and upper and not text.isupper() and had_given)
            if gap in ("-", "‐", "‑"):
                k = nxt
                had_surname = had_surname or not given
                continue
            if gap == ", " and not comma and had_surname and not had_given and given:
                k, comma, had_given = nxt, True, True
                break
            if gap != " ":
                break
            if given and had_given and had_surname:
                break
            if comma:
                break
            if given and not had_given and had_surname and not shouting and k > i + 2:
                break
            k = nxt
            had_given, had_surname = had_given or given, had_surname or not given
            if shouting and given:
                break
        return k


def pieces(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal information in a stored text, in order, without overlap."""
    if not text:
        return []
    plain, at = plain_form(text)
    found = _grammar(plain)
    found = sorted(found + [(s, e, "person") for s, e in names.find(plain, found)])
    if at is not None:
        found = [(at[s], at[e] if e < len(at) else len(text), k) for s, e, k in found]
    return found


def value_of(piece: str) -> str:
    """Lower case, letters and digits only."""
    return "".join(c for c in piece.lower() if c.isalnum())


def sanitise(text: str | None, names: Names) -> str | None:
    """The text with each piece replaced by its typed placeholder."""
    if not text:
        return text
    out, at = [], 0
    for s, e, kind in pieces(text, names):
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


_names: dict[int, Names] = {}


def with_names(docs: DataFrame, key: str, column: str, terms: DataFrame, emit, schema: str, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Runs ``emit(id, text, names)`` -> rows over every row, each with the lexicon or its part of it."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(column).alias("text"))
    columns = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def batch_of(out):
        return pa.RecordBatch.from_pydict(dict(zip(columns, zip(*out))) if out else {c: [] for c in columns}, fields)

    if terms.count() <= broadcast_terms:
        shared = docs.sparkSession.sparkContext.broadcast({r["term"]: r["role"] for r in terms.select("term", "role").collect()})

        def run(batches):
            lexicon = shared.value
            if id(lexicon) not in _names:
                _names.clear()
                _names[id(lexicon)] = Names(lexicon)
            for batch in batches:
                yield batch_of([r for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in emit(i, t, _names[id(lexicon)])])

        return spread(rows).mapInArrow(run, schema)

    def words(batches):
        for batch in batches:
            out = [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for w in {f for x in set(_TOKEN.findall(plain_form(t)[0])) for f in _forms(x)}]
            yield pa.RecordBatch.from_pydict({"id": pa.array([a for a, _ in out], pa.int64()), "term": pa.array([b for _, b in out], pa.string())})

    own = spread(rows).mapInArrow(words, "id long, term string").join(terms, "term").groupBy("id").agg(F.collect_list(F.struct("term", "role")).alias("lexicon"))
    joined = rows.join(own, "id", "left").select("id", "text", F.coalesce("lexicon", F.expr("array()").cast("array<struct<term:string,role:int>>")).alias("lexicon"))

    def run_own(batches):
        for batch in batches:
            yield batch_of([r for i, t, lex in zip(*(batch.column(c).to_pylist() for c in range(3))) for r in emit(i, t, Names({x["term"]: x["role"] for x in lex}))])

    return joined.mapInArrow(run_own, schema)


def entity_disclosures(docs: DataFrame, key: str, column: str, terms: DataFrame, statistics: DataFrame, share: float = DISCLOSURE, least: int = 3) -> DataFrame:
    """(kind, entity, term, together, disclosure): terms within ``WINDOW`` words of a piece that give away this entity.

    Disclosure as above, of the entity (a piece's value) by the term, over all rows. Terms that
    are part of a name are left out, as they are removed anyway.
    """

    def emit(i, text, names):
        if not text:
            return []
        seen = Counter()
        tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
        starts = [t[0] for t in tokens]
        for s, e, kind in pieces(text, names):
            value = value_of(text[s:e])
            lo, hi = bisect_left(starts, s), bisect_right(starts, e)
            near = {w.lower() for _, _, w in (*tokens[max(0, lo - WINDOW) : lo], *tokens[hi : hi + WINDOW]) if len(w) > 2 and not names.role(w)}
            seen[kind, value, ""] += 1
            seen.update((kind, value, w) for w in near)
        return [(*k, n) for k, n in seen.items()]

    pairs = with_names(docs, key, column, terms, emit, "kind string, entity string, term string, n long").groupBy("kind", "entity", "term").agg(F.sum("n").alias("together"))
    pairs = materialize(pairs, "p2-pairs")
    known = statistics.select("term", (F.col("n") + F.col("plain_n")).alias("occurs"))
    tokens = known.filter("term = ''").agg(F.sum("occurs")).first()[0] or 2
    often = pairs.filter(F.col("together") >= least)
    entities = often.filter("term = ''").select("kind", "entity", (F.col("together") / F.lit(tokens)).alias("prior"))
    joined = often.filter("term <> ''").join(known, "term").join(entities, ["kind", "entity"])
    bits = F.log2(F.least(F.col("together") / F.col("occurs"), F.lit(1.0)) / F.col("prior")) / -F.log2("prior")
    return joined.withColumn("disclosure", bits).filter(F.col("disclosure") >= share).select("kind", "entity", "term", "together", "disclosure")


def _statistics(spark, sf_dir) -> DataFrame:
    docs, people = table(spark, sf_dir, "index_documents"), table(spark, sf_dir, "accounts")
    return materialize(term_statistics(docs, "content_norm", people.select("display_name")), "p2-statistics")


def _terms(spark, sf_dir) -> DataFrame:
    return materialize(disclosing_terms(_statistics(spark, sf_dir)), "p2-terms")


def p2_found(spark, sf_dir):
    """(id, kind, value): the distinct pieces of personal information of each row."""
    docs = table(spark, sf_dir, "index_documents")

    def emit(i, text, names):
        return sorted({(i, k, v) for s, e, k in pieces(text, names) if (v := value_of(text[s:e]))})

    return with_names(docs, "id", "content_norm", _terms(spark, sf_dir), emit, "id long, kind string, value string")


def p2_sanitised(spark, sf_dir):
    """Every row's text with typed placeholders in place of personal information."""
    docs = table(spark, sf_dir, "index_documents")
    return with_names(docs, "id", "content_norm", _terms(spark, sf_dir), lambda i, text, names: [(i, sanitise(text, names))], "id long, text string")


def p2_terms(spark, sf_dir):
    """The disclosing terms with their bits."""
    return _terms(spark, sf_dir)


def p2_disclosures(spark, sf_dir):
    """Terms that, though no part of a piece, give one entity away."""
    statistics = _statistics(spark, sf_dir)
    return entity_disclosures(table(spark, sf_dir, "index_documents"), "id", "content_norm", materialize(disclosing_terms(statistics), "p2-terms"), statistics)
