"""Surrogates for personal data, in DataFrame operations alone.

Detected: e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment
card and bank account numbers, access keys, secrets (``token = "..."``,
``password: ...``) and names that follow a title in either case, with every bare
repeat of such a name in the same document, capitalised or in capitals.  Each entity
gets a replacement that is keyed (nothing can be reversed without the key), of
its own type, and of its format: digits stay digits in the same groups,
hexadecimal stays hexadecimal, letters stay letters of their script and case.

Runs of digits, hexadecimal digits and letters go through a keyed Feistel
permutation of their own alphabet and length, an address through one of its 32
bits, and a card's last digit keeps its distance from the check digit (valid
stays valid).  So different entities can't meet, and the same entity is replaced
alike wherever it stands: distinctness and coreference hold by construction.
Letters of scripts without an alphabet below become keyed Latin letters.

Names are drawn part by part: the last part is a family name, those before it are
given names of the title's gender.  A part's surrogate is built of keyed
syllables in the part's script and follows its case, so ``Mr John SMITH``,
``Mr. Smith`` and a later ``John`` agree wherever they stand.  Initials are
permuted, particles (``van``, ``de``) and titles stay.

A collision check over the distinct entities and name parts of all documents
follows: where two share a surrogate, or a surrogate is itself an entity of the
corpus, the later ones are drawn again under a further key (a name grows by a
syllable).  After ``DRAWS`` rounds a format is taken to be full: its entities
keep the first permutation, which is distinct, though it may be an entity of the
corpus too.

Defined results: a null text stays null; a text without entities stays as it is,
byte for byte; repeated rows are treated alike; other columns are carried along,
whatever their names; an empty table stays empty; texts have any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.store import documents, written

#: The key of runs that bring none of their own; surrogates made under it can be tested by anyone who has this text.
KEY = "parley-surrogates"
_key: ContextVar[str] = ContextVar("key", default=KEY)
#: Fixed titles by gender, and the particles inside names.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Lady", "Señora", "Sra", "Госпожа"]
MALE_TITLES = ["Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Господин"]
OTHER_TITLES = ["Dr", "Prof", "Mx", "Captain", "Capt", "Rev"]
PARTICLES = ["van", "von", "der", "den", "de", "da", "di", "del", "la"]
_any = "|".join
_titles = lambda names: _any([*names, *(n.upper() for n in names)])
_FEMALE = rf"^(?:{_titles(FEMALE_TITLES)})\b"
_MALE = rf"^(?:{_titles(MALE_TITLES)})\b"
_TITLE = rf"(?:{_titles(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)})\.?"
#: White space after a title, and between the parts of a name.
_AFTER, _BETWEEN = r"\s{1,4}", r"[ \t\u00A0]{1,4}"
_PART = r"\p{Lu}(?:\.|[\p{L}\p{M}]*+(?:['’-]\p{L}++)*)"
_FULL = rf"(?:(?:{_any(PARTICLES)}){_BETWEEN})*{_PART}"
_BOX = r"[A-Za-z0-9._%+\-\p{L}\p{N}]"
#: Fixed patterns of the entity types, tried in this order at each place; a lookahead names what one can begin with.
PATTERNS = {
    "email": rf"(?<!{_BOX}){_BOX}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}",
    "secret": r"(?=[tpsaTPSA])(?i:token|password|passwd|secret|api_?key)\s*[=:]\s*\"?(?:[A-Za-z0-9_\-]{8,}|(?=[a-z]*[0-9])[A-Za-z0-9_\-]{6,7}(?![A-Za-z0-9_\-]))\"?",
    "key": r"(?=A)(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ip": r"(?=[0-9])(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "phone": r"(?=[0-9+(])(?:(?<!\+)\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\()\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-]))",
    "ssn": r"(?=[0-9])(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=[0-9])(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d)",
    "name": rf"(?=[MDPHFSCLRГ])(?<![\p{{L}}\p{{N}}]){_TITLE}{_AFTER}{_FULL}(?:{_BETWEEN}{_FULL})*",
}
ENTITY = _any(f"(?:{p})" for p in PATTERNS.values())
_but = lambda *names: _any(f"(?:{p})" for k, p in PATTERNS.items() if k not in names)
#: Types that few texts hold, and what a text must have to hold one; without that, and without an @, most of the time is spared.
RARE = ("key", "iban", "ip6")
_HOLDS_RARE = [r"[A-Z]{2}[0-9]{2}", r":[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:"]
#: Bounds of entities in a marked text: two MARKs; a MARK of the text itself is followed by NOT.
MARK, NOT = "", ""
SYLLABLES = ["ba", "ber", "bin", "da", "del", "dor", "fa", "fel", "fin", "ga", "gor", "ha", "hel", "jan", "ka", "kel", "la", "len", "lor", "ma", "mer", "min", "na", "nel", "nor", "pa", "per", "ra", "ren", "sal", "tor", "ven"]
#: Fixed letter-by-letter spellings of the syllables in other scripts.
SPELLINGS = {r"\p{IsCyrillic}": ("abdefghijklmnoprstv", "абдефгхийклмнопрств"), r"\p{IsGreek}": ("abdefghijklmnoprstv", "αβδεφγχιικλμνοπρστβ")}
_range = lambda a, b, but="": "".join(chr(i) for i in range(ord(a), ord(b) + 1) if chr(i) not in but)
#: Alphabets whose runs are permuted in themselves, of 36 letters at most.
ALPHABETS = [_range("0", "9"), _range("a", "z"), _range("A", "Z"), _range("à", "ÿ", "÷"), _range("À", "Þ", "×"), _range("α", "ω"), _range("Α", "Ω", "΢"), _range("а", "я"), _range("А", "Я"), _range("א", "ת"), _range("ء", "غ") + _range("ف", "ي")]
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
#: Rounds of the permutation, the longest run that one permutation covers, and rounds of the collision check.
ROUNDS, RUN, DRAWS = 4, 16, 8


@contextmanager
def keyed(key: str) -> Iterator[None]:
    """Expressions that are built inside draw under ``key``."""
    if not key:
        raise ValueError("surrogates need a key")
    before = _key.set(key)
    try:
        yield
    finally:
        _key.reset(before)


def _hash(*parts: Column) -> Column:
    """60 keyed bits as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(_key.get()), *parts), 256), 1, 15), 16, 10).cast("long")


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _feistel(left: Column, right: Column, left_mod: Column, right_mod: Column, tweak: Column) -> Column:
    """Struct (a, b): a keyed permutation of the pairs below the two moduli."""

    def one(state: Column, i: Column) -> Column:
        a = F.pmod(state["a"] + F.pmod(_hash(tweak, i.cast("string"), state["b"].cast("string")), left_mod), left_mod)
        b = F.pmod(state["b"] + F.pmod(_hash(tweak, i.cast("string"), state["a"].cast("string")), right_mod), right_mod)
        even = i % 2 == 0
        return F.struct(F.when(even, a).otherwise(state["a"]).alias("a"), F.when(even, state["b"]).otherwise(b).alias("b"))

    start = F.struct(left.alias("a"), right.alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, one)


def _permute(run: Column, alphabet: Column, tweak: Column) -> Column:
    """A keyed permutation of the strings of ``run``'s length over an alphabet."""
    radix, size = F.length(alphabet), F.length(run)
    half = F.floor(size / 2).cast("int")
    known = F.substr(F.lit(DIGITS), F.lit(1), radix)
    plain = F.call_function("translate", run, alphabet, known)
    value = lambda x: F.coalesce(F.call_function("conv", x, radix, F.lit(10)).cast("long"), F.lit(0).cast("long"))
    modulus = lambda n: F.round(F.pow(radix.cast("double"), n)).cast("long")
    state = _feistel(value(F.substr(plain, F.lit(1), half)), value(F.substr(plain, half + 1, size - half)), modulus(half), modulus(size - half), F.concat_ws(":", tweak, alphabet, size.cast("string")))
    digits = lambda x, n: F.when(n == 0, F.lit("")).otherwise(F.lpad(F.lower(F.call_function("conv", x.cast("string"), F.lit(10), radix)), n, "0"))
    return _bind(state, lambda s: F.call_function("translate", F.concat(digits(s["a"], half), digits(s["b"], size - half)), known, alphabet))


def _hidden(run: Column, tweak: Column) -> Column:
    """Two keyed Latin letters for each character."""
    letters = F.translate(F.sha2(F.concat_ws("|", F.lit(_key.get()), tweak, run), 256), "0123456789", "ghijklmnop")
    return F.substr(letters, F.lit(1), 2 * F.length(run))


def _runs(text: Column, tweak: Column, hexed: Column | None = None) -> Column:
    """Permute each run of digits or letters of one alphabet (hexadecimal digits where ``hexed``); other characters stay."""
    classes = [f"[{a}]" for a in ALPHABETS]
    plain = _any(f"{c}{{1,{RUN}}}" for c in classes) + rf"|[\p{{L}}\p{{N}}&&[^{''.join(ALPHABETS)}]]{{1,{RUN}}}|[^\p{{L}}\p{{N}}]+"
    pattern = F.lit(plain) if hexed is None else F.when(hexed, rf"[0-9a-f]{{1,{RUN}}}|[^0-9a-f]+").otherwise(F.lit(plain))
    cases = [F.when(hexed, F.lit(DIGITS[:16]))] if hexed is not None else []
    place = lambda run: F.coalesce(*[F.when(run.rlike(f"^{c}"), F.lit(a)) for c, a in zip(classes, ALPHABETS, strict=True)])
    alphabet = lambda run: F.when(run.rlike(r"^[\p{L}\p{N}]"), F.coalesce(*cases, place(run), F.lit("")))

    def one(run: Column, i: Column) -> Column:
        own = F.concat_ws("/", tweak, i.cast("string"))
        return _bind(alphabet(run), lambda a: F.when(a.isNull(), run).when(a == "", _hidden(run, own)).otherwise(_permute(run, a, own)))

    return F.array_join(F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), one), "")


def _digit_sum(body: Column) -> Column:
    """What the check digit must be for a card's first digits."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(digits, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def _card(e: Column, tweak: Column) -> Column:
    shape = r"^(\d{4})([ -]?)(\d{4})([ -]?)(\d{4})([ -]?)(\d{4})$"
    digits = F.regexp_replace(e, "[ -]", "")
    old = F.substring(digits, 1, 15)

    def build(new: Column) -> Column:
        check = F.pmod(F.substring(digits, 16, 1).cast("int") - _digit_sum(old) + _digit_sum(new), F.lit(10))
        full = F.concat(new, check.cast("string"))
        parts = [F.substring(full, 4 * i + 1, 4) for i in range(4)]
        gaps = [F.regexp_extract(e, shape, k) for k in (2, 4, 6)]
        return F.concat(parts[0], gaps[0], parts[1], gaps[1], parts[2], gaps[2], parts[3])

    return _bind(_permute(old, F.lit(DIGITS[:10]), tweak), build)


def _address(e: Column, tweak: Column) -> Column:
    octet = lambda k: F.split(e, r"\.")[k].cast("long")
    side = F.lit(65536).cast("long")
    state = _feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), side, side, tweak)
    return _bind(state, lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]))


def _part_name(kind: Column, part: Column, again: Column) -> Column:
    """A capitalised name for a name part (lower case), in its script; hyphens and apostrophes stay."""
    pick = lambda h: F.element_at(F.array(*[F.lit(n) for n in SYLLABLES]), (F.pmod(h, F.lit(len(SYLLABLES))) + 1).cast("int"))
    ending = F.when(kind == "given_f", "a").when(kind == "given_m", "o").otherwise("")

    def one(word: Column, i: Column) -> Column:
        many = F.sequence(F.lit(1), F.when(kind == "family", 4).otherwise(3) + again)
        syllables = F.transform(many, lambda k: pick(_hash(kind, again.cast("string"), i.cast("string"), k.cast("string"), part)))
        latin = F.concat(F.array_join(syllables, ""), ending)
        out = latin
        for script, (plain, letters) in SPELLINGS.items():
            out = F.when(part.rlike(script), F.translate(latin, plain, letters)).otherwise(out)
        return F.initcap(out)

    words = F.transform(F.split(part, r"['’-]"), one)
    marks = F.concat(F.array(F.lit("")), F.regexp_extract_all(part, F.lit(r"['’-]"), F.lit(0)))
    return F.array_join(F.zip_with(marks, words, lambda m, w: F.concat(m, w)), "")


def entity_type(e: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(e.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


NAME_KINDS = ("family", "given_f", "given_m", "given_n")


def surrogate(kind: Column, e: Column, again: Column) -> Column:
    """The replacement of an entity, or of a name part in lower case; ``again`` counts how often it was drawn before."""
    tweak = F.concat_ws("#", kind, again.cast("string"))
    # What stays before and after the part that is permuted.
    head = F.when(kind == "secret", F.regexp_extract(e, r"^(.*?[=:]\s*\"?)", 1)).when(kind == "phone", F.regexp_extract(e, r"^(\+\d{1,3})", 1)).when(kind == "iban", F.left(e, F.lit(2))).when(kind == "key", F.left(e, F.lit(4))).otherwise("")
    tail = F.when(kind == "email", F.regexp_extract(e, r"(\.[A-Za-z]+)$", 1)).otherwise("")
    hexed = (kind == "ip6") | (kind == "secret") & e.rlike(r"[=:]\s*\"?[0-9a-f]+\"?$")

    def permuted(ends: Column) -> Column:
        body = F.substr(F.when(kind == "ip6", F.lower(e)).otherwise(e), F.length(ends["head"]) + 1, F.length(e) - F.length(ends["head"]) - F.length(ends["tail"]))
        return F.concat(ends["head"], _runs(body, tweak, ends["hexed"]), ends["tail"])

    runs = _bind(F.struct(head.alias("head"), tail.alias("tail"), hexed.alias("hexed")), permuted)
    return F.when(kind.isin(*NAME_KINDS), _part_name(kind, e, again)).when(kind == "ip", _address(e, tweak)).when(kind == "card", _card(e, tweak)).otherwise(runs)


# Names.


def _tokens(e: Column) -> Column:
    """The words of a name after its title."""
    return F.split(_untitled(e), r"[\s\u00A0]+")


def _untitled(e: Column) -> Column:
    return F.regexp_replace(e, rf"^{_TITLE}{_AFTER}", "")


def _folded(part: Column) -> Column:
    """What makes two parts of names the same: case and the form of apostrophes do not count."""
    return F.replace(F.lower(part), F.lit("’"), F.lit("'"))


def _gender(e: Column) -> Column:
    return F.when(e.rlike(_FEMALE), "given_f").when(e.rlike(_MALE), "given_m").otherwise("given_n")


_INITIAL = r"^\p{Lu}\.?$"
_PARTICLE = rf"^(?:{_any(PARTICLES)})$"


def _name_parts(e: Column) -> Column:
    """Array of (kind, part) of a name's parts, without initials and particles."""
    tokens = _tokens(e)
    every = F.transform(tokens, lambda t, i: F.struct(F.when(i == F.size(tokens) - 1, F.lit("family")).otherwise(_gender(e)).alias("kind"), t.alias("part")))
    return F.filter(every, lambda p: ~p["part"].rlike(_INITIAL) & ~p["part"].rlike(_PARTICLE))


def _cased(old: Column, new: Column) -> Column:
    return F.when((F.upper(old) == old) & (F.length(old) > 1), F.upper(new)).otherwise(new)


def _new_part(kind: Column, part: Column, draw) -> Column:
    value = _folded(part)
    new = _cased(part, _part_name(kind, value, draw(kind, value)))
    return F.when(F.contains(part, F.lit("’")), F.replace(new, F.lit("'"), F.lit("’"))).otherwise(new)


def _new_name(e: Column, draw) -> Column:
    tokens = _tokens(e)
    title = F.regexp_extract(e, rf"^({_TITLE}{_AFTER})", 1)
    gaps = F.concat(F.array(F.lit("")), F.regexp_extract_all(_untitled(e), F.lit(r"[\s\u00A0]+"), F.lit(0)))

    def one(t: Column, i: Column) -> Column:
        kind = F.when(i == F.size(tokens) - 1, F.lit("family")).otherwise(_gender(e))
        return F.when(t.rlike(_PARTICLE), t).when(t.rlike(_INITIAL), _runs(t, F.lit("initial"))).otherwise(_bind(kind, lambda k: _new_part(k, t, draw)))

    return F.concat(title, F.array_join(F.zip_with(gaps, F.transform(tokens, one), lambda g, t: F.concat(g, t)), ""))


# Documents.


def _split(marked: Column) -> Column:
    """Texts between bounds, those at odd places being entities."""
    return F.split(marked, MARK + MARK, -1)


def _pieces(text: Column) -> Column:
    around = f"{MARK}{MARK}$0{MARK}{MARK}"
    safe = F.when(F.contains(text, F.lit(MARK)), F.replace(text, F.lit(MARK), F.lit(MARK + NOT))).otherwise(text)
    cut = lambda pattern: _split(F.regexp_replace(safe, pattern, around))
    rare = F.contains(text, F.lit("::")) | F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("ASIA")) | text.rlike(_HOLDS_RARE[0]) | text.rlike(_HOLDS_RARE[1])
    mail = F.contains(text, F.lit("@"))
    return F.when(mail & rare, cut(ENTITY)).when(mail, cut(_but(*RARE))).when(rare, cut(_but("email"))).otherwise(cut(_but("email", *RARE)))


def _entities(pieces: Column) -> Column:
    """(kind, entity) of the odd places."""
    odd = F.filter(pieces, lambda p, i: i % 2 == 1)
    return F.transform(odd, lambda e: F.struct(entity_type(e).alias("kind"), e.alias("entity")))


def _unit(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), value)


def _units(found: Column) -> Column:
    """What is drawn for a document: its entities, and the parts of its names."""
    one = lambda f: F.when(f["kind"] == "name", F.transform(_name_parts(f["entity"]), lambda p: _unit(p["kind"], _folded(p["part"])))).otherwise(F.array(_unit(f["kind"], f["entity"])))
    return F.array_distinct(F.flatten(F.transform(found, one)))


def _rebuilt(pieces: Column, found: Column, draw) -> Column:
    names = F.flatten(F.transform(F.filter(found, lambda f: f["kind"] == "name"), lambda f: _name_parts(f["entity"])))

    def bare(piece: Column, parts: Column) -> Column:
        """Repeats of the document's name parts outside of entities."""
        wanted = F.array_distinct(F.flatten(F.transform(parts, lambda p: F.array(p["part"], F.upper(p["part"]), F.initcap(p["part"])))))
        # Longer parts first, so that a double name is met whole.
        ordered = F.transform(F.array_sort(F.transform(wanted, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p")))), lambda x: x["p"])
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(ordered, "|"), F.lit(r")(?![\p{L}\p{N}])"))
        same = lambda x, p: _folded(x["part"]) == _folded(p)
        family = lambda p: F.exists(parts, lambda x: same(x, p) & (x["kind"] == "family"))
        kind = lambda p: F.when(family(p), "family").otherwise(F.filter(parts, lambda x: same(x, p))[0]["kind"])
        cut = _split(F.call_function("regexp_replace", piece, pattern, F.lit(f"{MARK}{MARK}$0{MARK}{MARK}")))
        return F.array_join(F.transform(cut, lambda p, i: F.when(i % 2 == 0, p).otherwise(_bind(kind(p), lambda k: _new_part(k, p, draw)))), "")

    def one(piece: Column, i: Column, parts: Column) -> Column:
        kind = found[F.floor(i / 2).cast("int")]["kind"]
        new = _bind(kind, lambda k: F.when(k == "name", _new_name(piece, draw)).otherwise(surrogate(k, piece, draw(k, piece))))
        return F.when(i % 2 == 1, new).when(F.size(parts) == 0, piece).otherwise(bare(piece, parts))

    whole = _bind(names, lambda parts: F.array_join(F.transform(pieces, lambda p, i: one(p, i, parts)), ""))
    return F.when(F.contains(whole, F.lit(MARK)), F.replace(whole, F.lit(MARK + NOT), F.lit(MARK))).otherwise(whole)


def _shape(kind: Column, value: Column) -> Column:
    """The set that a unit's permutation stays in."""
    out = value
    for a in ALPHABETS:
        out = F.regexp_replace(out, f"[{a}]", a[0])
    hexed = value.rlike(r"[=:]\s*\"?[0-9a-f]+\"?$")
    return F.concat(kind, F.lit(":"), F.when(kind == "ip", F.lit("")).when(kind == "ip6", F.regexp_replace(F.lower(value), "[0-9a-f]", "0")).when((kind == "secret") & hexed, F.regexp_replace(value, r"[0-9a-f](?=[0-9a-f]*\"?$)", "0")).otherwise(out))


def _collisions(table: DataFrame) -> DataFrame:
    """Units whose surrogate another unit of the kind keeps, or is a unit of the kind itself."""
    shared = table.groupBy("kind", "low").agg(F.min(F.struct("again", "value")).alias("keeper"), F.count("*").alias("n")).where("n > 1")
    twice = table.join(shared, ["kind", "low"]).where(F.struct("again", "value") != F.col("keeper")).select("kind", "value")
    real = table.join(table.select("kind", F.lower("value").alias("low")).distinct(), ["kind", "low"], "left_semi").select("kind", "value")
    return twice.unionByName(real).distinct()


def _drawn(units: DataFrame, again: Column) -> DataFrame:
    """(kind, value, again, low): units with their surrogates, in lower case for comparison."""
    made = units.select("kind", "value", again.alias("again")).withColumn("low", surrogate(F.col("kind"), F.col("value"), F.col("again")))
    return made.withColumn("low", F.lower("low"))


def redrawn(units: DataFrame, most: int = DRAWS) -> DataFrame | None:
    """(unit, again) of the units (kind, value) that the collision check has drawn again; None if there are none."""
    table = written(_drawn(units, F.lit(0)), "surrogates")
    for left in range(most, -1, -1):
        bad = written(_collisions(table), "collisions")
        if bad.isEmpty():
            break
        if left:
            marked = table.drop("low").join(bad.withColumn("bad", F.lit(1)), ["kind", "value"], "left")
            table = written(_drawn(marked, F.col("again") + F.coalesce("bad", F.lit(0))), "surrogates")
        else:  # full formats keep their first permutation
            full = bad.select(_shape(F.col("kind"), F.col("value")).alias("shape")).distinct()
            shaped = table.drop("low").withColumn("shape", _shape(F.col("kind"), F.col("value")))
            kept = shaped.join(full.withColumn("full", F.lit(True)), "shape", "left")
            table = kept.select("kind", "value", F.when(F.col("full") & ~F.col("kind").isin(*NAME_KINDS), 0).otherwise(F.col("again")).alias("again"))
    out = table.where("again > 0").select(_unit(F.col("kind"), F.col("value")).alias("unit"), "again")
    return None if out.isEmpty() else out


def _free(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def replace_entities(docs: DataFrame, text: str = "text", types: str | None = None, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``; ``types``, if given, names a new column for the types found, in order.

    ``key`` decides every surrogate: under another key all are others; who does not have it can't test a guess.
    """
    with keyed(key):
        return _replaced(docs, text, types)


def _replaced(docs: DataFrame, text: str, types: str | None) -> DataFrame:
    if types and types.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has a column named {types}")
    columns = docs.columns
    pieces, found, mine, draws = _free(docs, "pieces", "found", "mine", "draws")
    marked = docs.withColumn(pieces, _pieces(F.col(text))).withColumn(found, F.when(F.size(pieces) > 1, _entities(F.col(pieces))))
    units = marked.where(F.size(pieces) > 1).select(F.explode(_units(F.col(found))).alias("unit")).distinct()
    again = redrawn(units.select(F.substring_index("unit", ":", 1).alias("kind"), F.expr("substr(unit, instr(unit, ':') + 1)").alias("value")))
    draw = lambda kind, value: F.lit(0)
    if again is not None:
        # Rows meet their units that were drawn again by the units' own text: no row number, no copy of the table.
        marked = marked.withColumn(mine, F.when(F.size(pieces) > 1, F.array_join(_units(F.col(found)), "\n")).otherwise(F.concat(F.lit("\n"), F.pmod(F.xxhash64(text), F.lit(1024)).cast("string"))))
        lists = marked.where(F.size(pieces) > 1).select(F.col(mine).alias("mine"), F.explode(_units(F.col(found))).alias("unit")).distinct()
        maps = lists.join(again, "unit").groupBy("mine").agg(F.map_from_entries(F.collect_set(F.struct("unit", "again"))).alias(draws)).withColumnRenamed("mine", mine)
        marked = marked.join(maps, mine, "left")
        draw = lambda kind, value: F.coalesce(F.col(draws)[_unit(kind, value)], F.lit(0))
    body = F.when(F.size(pieces) > 1, _rebuilt(F.col(pieces), F.col(found), draw)).otherwise(F.col(text))
    kinds = [F.coalesce(F.transform(found, lambda f: f["kind"]), F.when(F.col(text).isNotNull(), F.array().cast("array<string>"))).alias(types)] if types else []
    return marked.select(*[body.alias(c) if c == text else F.col(c) for c in columns], *kinds)


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace_entities(documents(spark, sf_dir).select("doc_id", "text"), types="types")
    return done.select("doc_id", "text", F.coalesce(F.size("types"), F.lit(0)).alias("n_entities"), "types")


QUERIES = {"op7_surrogates": op7_surrogates}
ORACLE_SQL: dict[str, str] = {}
