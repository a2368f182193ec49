"""PII by surrogate generation, with DataFrame operations only.

Detected entities are brought to a canonical form, and each distinct one gets a
surrogate that keeps its type, format and script, and for names the gender.
Parts that entities share (given names, surnames, mail domains) get one
surrogate each, so that mentions of one person or host stay together. What may
grow (names, mailboxes, domains) and what is long (keys, accounts) is drawn from
a keyed digest, and collisions, with another surrogate or with something real,
are drawn again, longer, until none is left. Formats of a fixed number of digits
(phones, cards, social security numbers, addresses) are shuffled by a keyed
permutation of the whole format, which cannot collide however full it is.
All mentions of an entity share its surrogate in the mention's own format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_prefix, need, stored, text_or_empty

# What introduces a name and tells its gender.
MALE_TITLES = ("Mr", "Mister", "Herr", "Señor", "Sr", "Monsieur", "Signor", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mlle", "Signora", "Госпожа")
NEUTRAL_TITLES = ("Dr", "Prof", "Доктор")
# Syllables of surrogate names, by script, and endings by script and gender (f, m, n).
SYLLABLES = {"latin": "ba be bo da de do fa fe ga ge ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va ve".split(), "cyrillic": "ба бе бо ва ве да де до за зе ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се та те".split()}
ENDINGS = {"latin": {"f": ["lia", "nna", "ra", "tta"], "m": ["lo", "n", "rt", "s"], "n": ["l", "m", "r", "nd"]}, "cyrillic": {"f": ["лия", "нна", "ра", "ва"], "m": ["лан", "в", "р", "н"], "n": ["к", "л", "м", "ц"]}}

# Titles that are other words or units in capitals or in small letters ("MS DOS", "miss the bus", "20 ms"), and such that names without capitals follow.
NOT_CAPITAL, NOT_SMALL, BEFORE_SMALL = ("Ms", "Sr"), ("Miss", "Ms", "Sr"), ("mr", "mrs")
_TITLES = sorted((*MALE_TITLES, *FEMALE_TITLES, *NEUTRAL_TITLES), key=len, reverse=True)


def _names() -> str:
    """One or two names behind a title: written as such behind a title with or without a capital, all in capitals
    behind one in capitals, and one name in small letters behind ``mr`` and ``mrs``."""
    usual, capital = r"\p{Lu}[\p{L}'\-]+", r"\p{Lu}[\p{Lu}'\-]+"
    titles = "|".join((*_TITLES, *(x.lower() for x in _TITLES if x not in NOT_SMALL)))
    capitals = "|".join(x.upper() for x in _TITLES if x not in NOT_CAPITAL)
    initials = "".join(sorted({c for x in _TITLES for c in (x[0], x[0].lower())}))
    small = rf"(?:{'|'.join(BEFORE_SMALL)})\.? (?!(?:and|or|und|y|et) )\p{{Ll}}[\p{{Ll}}'\-]+(?!\p{{L}})"
    return rf"(?=[{initials}])(?<![\p{{L}}])(?:(?:{titles})\.? {usual}(?: {usual})?|(?:{capitals})\.? {capital}(?: {capital})?(?!\p{{L}})|{small})"


#: Types in the order in which they are looked for. No pattern has a group that captures, or repeats a group without
#: a small bound: classes of characters are matched in a loop, so that no text is too long.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9\-][A-Za-z0-9.\-]*\.[A-Za-z]{2,}",
    "key": r"(?<![0-9A-Za-z])(?:A[KS]IA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36,251}|sk-[0-9A-Za-z_\-]{20,200})(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
    "ip6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{2,4}\) ?[0-9]{3,4}[ .\-][0-9]{3,4}(?![0-9])|(?<![0-9.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9\-])(?!\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ \-]){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "name": _names(),
}
ANY = rf"(?<![A-Za-z0-9])(?:{'|'.join(PATTERNS.values())})"
DIGITS = ("phone", "ssn", "card")
#: Types of a fixed number of digits, and those drawn from a digest.
SHUFFLED = (*DIGITS, "ip")
DRAWN = ("email", "secret", "key", "iban", "ip6")
#: Steps of the keyed permutation.
STEPS = 8
#: Permutations of a format that are tried for one whose results are no real entities; beyond it only an entity's own value is refused.
TRIES = 4


def type_of(mention: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        hit = mention.rlike(f"^(?:{pattern})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def canonical(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common: digits, or lower case; a name keeps its title."""
    return F.when(kind.isin(*DIGITS), F.regexp_replace(mention, "[^0-9]", "")).when(kind == "key", mention).otherwise(F.lower(mention))


def real(kind: Column, mention: Column) -> Column:
    """Whether a mention can be what it looks like: a card's check digit, an address's range."""
    octets = F.split(mention, r"\.")
    return F.when(kind == "card", luhn(F.regexp_replace(mention, "[^0-9]", "")) == 0).when(kind == "ip", F.forall(octets, lambda x: x.cast("int") < 256)).otherwise(True)


def _stream(key: str, kind: Column, what: Column, attempt: Column) -> Column:
    """256 keyed hex digits for an entity."""
    said = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), what)
    return F.concat(F.sha2(said, 512), F.sha2(F.concat(said, F.lit("|2")), 512))


def _draw(stream: Column, i: Column, n: Column | int) -> Column:
    """The i-th number below ``n`` of a stream (i from 0)."""
    four = F.substring(stream, ((i * 4) % 253 + 1).cast("int"), F.lit(4))
    return F.pmod(F.conv(four, 16, 10).cast("long") + i, n if isinstance(n, Column) else F.lit(n))


def _like(text: Column, stream: Column) -> Column:
    """Digits to digits and letters to letters of the same script and case; all else as it is."""
    pick = lambda letters, i: F.substring(F.lit(letters), (_draw(stream, i, len(letters)) + 1).cast("int"), F.lit(1))

    def one(c: Column, i: Column) -> Column:
        letter = pick("abcdefghijklmnopqrstuvwxyz", i)
        return F.when(c.rlike("[0-9]"), pick("0123456789", i)).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя", i)).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hex_like(text: Column, stream: Column) -> Column:
    """Hexadecimal digits to such digits; all else as it is."""
    one = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), (_draw(stream, i, 16) + 1).cast("int"), F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _more(stream: Column, attempt: Column) -> Column:
    """As many letters as there were attempts: room for all."""
    return F.when(attempt == 0, "").otherwise(F.substring(F.translate(stream, "0123456789", "ghijklmnop"), F.lit(1), attempt))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, x: a + x) % 10


def _pick(choices: list[str], stream: Column, i: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in choices]), (_draw(stream, F.lit(i), len(choices)) + 1).cast("int"))


def _gender(title: Column) -> Column:
    low = lambda names: [x.lower() for x in names]
    return F.when(title.isin(*low(MALE_TITLES)), "m").when(title.isin(*low(FEMALE_TITLES)), "f").otherwise("n")


def _spelled(choices: Column, n: int, stream: Column, times: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), times), lambda i: F.element_at(choices, (_draw(stream, i, n) + 1).cast("int"))), "")


def _name_part(part: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """A name of the same script, a syllable longer with each attempt; ``gender`` picks the ending."""
    made = {}
    for script, syllables in SYLLABLES.items():
        some = F.array(*[F.lit(x) for x in syllables])
        body = _spelled(some, len(syllables), stream, attempt + 3)
        ending = F.when(gender == "f", _pick(ENDINGS[script]["f"], stream, 0)).when(gender == "m", _pick(ENDINGS[script]["m"], stream, 0)).otherwise(_pick(ENDINGS[script]["n"], stream, 0))
        made[script] = F.concat(body, ending)
    return F.when(part.rlike(r"\p{IsCyrillic}"), made["cyrillic"]).otherwise(made["latin"])


def _settled(rows: DataFrame, draw: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(kind, canon, made) for distinct (kind, canon; more columns are for ``draw``), no ``made`` of a kind twice or real.

    ``draw`` adds ``made`` to rows with an ``attempt``. A row draws again while
    its result is that of a row before it (by attempt, then by form) or itself
    real. Only rows that collide take part in the next round, and later
    attempts have more room, so the rounds end.
    """
    extra = rows.columns
    there = rows.select("kind", F.col("canon").alias("made"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Few bytes but much to compute: dealt over all tasks, whatever the size.
    now = stored(draw(rows.repartition(parts, "kind", "canon").withColumn("attempt", F.lit(0))).select(*extra, "attempt", "made"), "pii-drawn")
    while True:
        keeps = now.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        doubled = now.join(keeps, ["kind", "made"]).where("struct(attempt, canon) <> first").select("kind", "canon")
        taken = now.join(there, ["kind", "made"], "left_semi").select("kind", "canon")
        again = stored(doubled.union(taken).distinct(), "pii-again")
        if again.isEmpty():
            return now.select("kind", "canon", "made")
        fixed = now.join(again, ["kind", "canon"], "left_anti")
        redrawn = draw(now.join(again, ["kind", "canon"], "left_semi").select(*extra, (F.col("attempt") + 1).alias("attempt")))
        now = stored(fixed.unionByName(redrawn.select(*extra, "attempt", "made")), "pii-drawn")


def _named(entities: DataFrame) -> DataFrame:
    """(canon, title, given, last, role) of the names: ``role`` is the kind of part that the given name is.

    It follows the title's gender. A neutral title takes the gender of the
    titles that the same full name has elsewhere, so that one person stays one;
    where there are none, or both, it stays neutral. A full name has no more
    forms than there are titles, so no group of the join is large.
    """
    names = entities.where("kind = 'name'").withColumn("p", F.split("canon", " ")).withColumn("title", F.element_at("p", 1))
    names = names.select("canon", "title", F.when(F.size("p") > 2, F.get("p", F.lit(1))).alias("given"), F.element_at("p", -1).alias("last"), _gender(F.regexp_replace("title", r"\.$", "")).alias("told"))
    genders = names.where("given is not null and told <> 'n'").groupBy("given", "last").agg(F.min("told").alias("low"), F.max("told").alias("high")).where("low = high").select("given", "last", F.col("low").alias("seen"))
    gender = F.when(F.col("told") == "n", F.coalesce("seen", "told")).otherwise(F.col("told"))
    return names.join(genders, ["given", "last"], "left").select("canon", "title", "given", "last", F.concat(F.lit("name-"), gender).alias("role"))


def _shared_parts(entities: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """(kind, canon, made) of the parts that entities share: ``name-f``, ``name-m``, ``name-n`` (surnames too) and ``domain``."""
    given = F.when(F.col("given").isNotNull(), F.struct(F.col("role").alias("kind"), F.col("given").alias("canon")))
    names = named.select(F.explode(F.array(F.struct(F.lit("name-n").alias("kind"), F.col("last").alias("canon")), given)).alias("x")).where("x is not null").select("x.kind", "x.canon")
    hosts = entities.where("kind = 'email'").select(F.lit("domain").alias("kind"), F.substring_index("canon", "@", -1).alias("canon"))

    def draw(rows: DataFrame) -> DataFrame:
        kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
        keyed = rows.withColumn("stream", _stream(key, kind, canon, attempt))
        top = F.concat(F.lit("."), F.substring_index(canon, ".", -1))
        host = F.concat(_like(F.substring(canon, F.lit(1), F.length(canon) - F.length(top)), F.col("stream")), _more(F.col("stream"), attempt), top)
        name = _name_part(canon, F.substring(kind, F.lit(6), F.lit(1)), F.col("stream"), attempt)
        return keyed.withColumn("made", F.when(kind == "domain", host).otherwise(name))

    return _settled(names.union(hosts).distinct(), draw)


def _drawn(entities: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(kind, canon, made) of the types in DRAWN."""
    hosts = parts.where("kind = 'domain'").select(F.col("canon").alias("domain"), F.col("made").alias("host"))
    rows = entities.where(F.col("kind").isin(*DRAWN)).withColumn("domain", F.when(F.col("kind") == "email", F.substring_index("canon", "@", -1)))
    rows = rows.join(hosts, "domain", "left").select("kind", "canon", "host")

    def draw(rows: DataFrame) -> DataFrame:
        kind, canon, stream = F.col("kind"), F.col("canon"), F.col("stream")
        keyed = rows.withColumn("stream", _stream(key, kind, canon, F.col("attempt")))
        # The country stays with an account, the issuer's mark with a key.
        kept = F.when(kind == "iban", 2).when(kind == "key", 4).otherwise(0)
        body = F.when(kind == "email", F.substring_index(canon, "@", 1)).otherwise(F.substring(canon, kept + 1, F.length(canon)))
        alike = keyed.withColumn("like", F.when(kind.isin("secret", "ip6"), _hex_like(body, stream)).otherwise(_like(body, stream)))
        return alike.withColumn("made", F.when(kind == "email", F.concat(F.col("like"), _more(stream, F.col("attempt")), F.lit("@"), F.col("host"))).otherwise(F.concat(F.substring(canon, F.lit(1), kept), F.col("like"))))

    return _settled(rows, draw)


def _halves(kind: Column, canon: Column) -> tuple[Column, Column, Column, Column, Column]:
    """What is shuffled of a value: (format, left, right, sizes of both).

    The first digit stays with a phone and a card, and a card's check digit
    follows from the others. Of an address the octets from 1 to 254 are
    shuffled among such, 0 and 255 stay.
    """
    kept = F.when(kind == "ssn", 0).otherwise(1)
    inner = F.substring(canon, kept + 1, F.length(canon) - kept - F.when(kind == "card", 1).otherwise(0))
    cut = F.expr("0") + (F.length(inner) / 2).cast("int")
    tens = lambda n: F.pow(F.lit(10.0), n).cast("long")
    digits = (F.concat_ws("-", kind, F.length(canon), F.substring(canon, F.lit(1), kept)), F.substring(inner, F.lit(1), cut), F.substring(inner, cut + 1, F.length(inner)), tens(cut), tens(F.length(inner) - cut))
    octet = [F.get(F.split(canon, r"\."), F.lit(i)).cast("long") for i in range(4)]
    ends = [x.isin(0, 255) for x in octet]
    form = F.concat_ws(".", kind, *[F.when(e, x.cast("string")).otherwise("x") for x, e in zip(octet, ends, strict=True)])
    place = [F.when(e, 0).otherwise(x - 1) for x, e in zip(octet, ends, strict=True)]
    room = [F.when(e, 1).otherwise(254).cast("long") for e in ends]
    address = (form, place[0] * room[1] + place[1], place[2] * room[3] + place[3], room[0] * room[1], room[2] * room[3])
    return tuple(F.when(kind == "ip", a).otherwise(d if i == 0 else d.cast("long")) for i, (a, d) in enumerate(zip(address, digits, strict=True)))


def _whole(kind: Column, canon: Column, form: Column, left: Column, right: Column, sizes: tuple[Column, Column]) -> Column:
    """The value with the shuffled halves."""
    log = lambda n: F.length(n.cast("string")) - 1
    digits = F.concat(F.element_at(F.split(form, "-"), -1), F.when(log(sizes[0]) > 0, F.lpad(left.cast("string"), log(sizes[0]), "0")).otherwise(""), F.lpad(right.cast("string"), log(sizes[1]), "0"))
    check = (10 - luhn(F.concat(digits, F.lit("0")))) % 10
    marks = F.split(form, r"\.")
    spread = []
    for half, two in ((left, (1, 2)), (right, (3, 4))):
        room = F.when(F.get(marks, F.lit(two[1])) == "x", 254).otherwise(1)
        spread += [F.floor(half / room), half % room]
    octets = [F.when(F.get(marks, F.lit(i + 1)) == "x", (x + 1).cast("long").cast("string")).otherwise(F.get(marks, F.lit(i + 1))) for i, x in enumerate(spread)]
    return F.when(kind == "ip", F.concat_ws(".", *octets)).when(kind == "card", F.concat(digits, check.cast("string"))).otherwise(digits)


def _shuffled(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, made) of the types in SHUFFLED, by a keyed permutation of each format.

    A format whose permutation leaves a value as it is, or makes a real one,
    takes another permutation as a whole, so distinct values stay distinct. In
    a format so full that results must be real, only a value's own is refused;
    the only value of its format (0.0.0.0) stays.
    """
    kind, canon = F.col("kind"), F.col("canon")
    form, left, right, *sizes = _halves(kind, canon)
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = entities.where(kind.isin(*SHUFFLED)).repartition(parts, "kind", "canon").select("kind", "canon", form.alias("form"), left.alias("left"), right.alias("right"), sizes[0].alias("m"), sizes[1].alias("n"))
    rows = stored(rows, "pii-fixed")
    there = rows.select("kind", F.col("canon").alias("made"))

    def step(pair: Column, i: Column) -> Column:
        size = F.when(i % 2 == 1, F.col("m")).otherwise(F.col("n"))
        said = F.sha2(F.concat_ws("|", F.lit(key), "form", "attempt", i.cast("string"), pair["b"].cast("string")), 256)
        more = F.conv(F.substring(said, 1, 15), 16, 10).cast("long")
        return F.struct(pair["b"].alias("a"), F.pmod(pair["a"] + F.pmod(more, size), size).alias("b"))

    def made(rows: DataFrame) -> DataFrame:
        pair = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.col("left").alias("a"), F.col("right").alias("b")), step)
        mixed = rows.withColumn("pair", pair)
        return stored(mixed.withColumn("made", _whole(kind, canon, F.col("form"), F.col("pair.a"), F.col("pair.b"), (F.col("m"), F.col("n")))), "pii-fixed")

    now = made(rows.withColumn("attempt", F.lit(0)))
    while True:
        met = now.where("made = canon and m * n > 1").select("form")
        if not now.where(f"attempt < {TRIES}").isEmpty():
            met = met.union(now.where(f"attempt < {TRIES}").join(there, ["kind", "made"], "left_semi").select("form"))
        again = stored(met.distinct(), "pii-again")
        if again.isEmpty():
            return now.select("kind", "canon", "made")
        fixed = now.join(again, "form", "left_anti")
        now = stored(fixed.unionByName(made(now.join(again, "form", "left_semi").drop("pair", "made").withColumn("attempt", F.col("attempt") + 1))), "pii-fixed")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, made) for distinct (kind, canon): within a kind no surrogate twice."""
    named = stored(_named(entities), "pii-named")
    parts = stored(_shared_parts(entities, named, key), "pii-parts")
    firsts = parts.select(F.col("kind").alias("role"), F.col("canon").alias("given"), F.col("made").alias("first"))
    lasts = parts.where("kind = 'name-n'").select(F.col("canon").alias("last"), F.col("made").alias("surname"))
    names = named.join(firsts, ["role", "given"], "left").join(lasts, "last").select(F.lit("name").alias("kind"), "canon", F.concat_ws(" ", "title", "first", "surname").alias("made"))
    return names.unionByName(_drawn(entities, parts, key)).unionByName(_shuffled(entities, key))


def _cased(mention: Column, made: Column) -> Column:
    """``made`` with capitals where ``mention`` has them, letter by letter."""
    return F.array_join(F.zip_with(F.split(mention, ""), F.split(made, ""), lambda m, c: F.when(m.rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")


def _rendered(kind: Column, mention: Column, made: Column) -> Column:
    """A surrogate in the format of a mention: its punctuation, its case; both sides of an address have their own."""
    marks = F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), lambda i: F.when(F.substring(mention, i, F.lit(1)).rlike("[0-9]"), F.substring(made, F.length(F.regexp_replace(F.substring(mention, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(F.substring(mention, i, F.lit(1)))), "")
    behind = lambda text: F.substring(text, F.instr(text, " ") + 1, F.length(text))
    names = F.when(behind(mention) == F.upper(behind(mention)), F.upper(behind(made))).when(behind(mention) == F.lower(behind(mention)), behind(made)).otherwise(F.initcap(behind(made)))
    title = F.concat(F.substring_index(mention, " ", 1), F.lit(" "), names)
    sides = [_cased(F.substring_index(mention, "@", i), F.substring_index(made, "@", i)) for i in (1, -1)]
    mixed = F.when(kind == "email", F.concat_ws("@", *sides)).otherwise(_cased(mention, made))
    cased = F.when((kind == "key") | (mention == F.lower(mention)), made).when(mention == F.upper(mention), F.upper(made)).otherwise(mixed)
    return F.when(kind.isin(*DIGITS), marks).when(kind == "name", title).otherwise(cased)


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (text; other columns come back as they are) with each detected entity replaced by its surrogate.

    Adds ``pii_count``, the entities replaced in the row (instead of a column of that name). Null text stays null
    with 0. Equal texts get equal replacements, repeated rows come back each; an
    empty table gives no rows. A different ``key`` gives different surrogates.
    """
    need(docs, ["text"])
    p = free_prefix(docs)
    found = F.regexp_extract_all(text_or_empty(), F.lit(f"({ANY})"), F.lit(1))
    # What no entity can do without is looked for first; it is far cheaper than the patterns.
    has = (F.contains("text", F.lit("@")) | F.col("text").rlike("[0-9]") | F.col("text").rlike(PATTERNS["name"])) & F.col("text").rlike(ANY)
    has = F.coalesce(has, F.lit(False))
    texts = stored(docs.where(has).select(F.md5("text").alias("text_key"), found.alias("found")).dropDuplicates(["text_key"]), "pii-found")
    mentions = texts.select("text_key", F.posexplode("found").alias("pos", "mention")).withColumn("kind", type_of(F.col("mention")))
    # What only looks like an entity stays as it is.
    mentions = mentions.withColumn("kind", F.when(real(F.col("kind"), F.col("mention")), F.col("kind"))).withColumn("canon", canonical(F.col("kind"), F.col("mention")))
    mentions = stored(mentions, "pii-mentions")
    made = surrogates(mentions.where("kind is not null").select("kind", "canon").distinct(), key)
    shown = mentions.join(made, ["kind", "canon"], "left").select("text_key", "pos", "kind", F.coalesce(_rendered(F.col("kind"), F.col("mention"), F.col("made")), "mention").alias("shown"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "shown")))
    lists = shown.groupBy("text_key").agg(F.transform(listed, lambda x: x["shown"]).alias(f"{p}shown"), F.count("kind").cast("int").alias(f"{p}count")).withColumnRenamed("text_key", f"{p}key")
    lists = stored(lists, "pii-shown")
    clean = docs.where(~has).withColumn("pii_count", F.lit(0))
    dirty = docs.where(has).withColumn(f"{p}text", F.md5("text")).join(lists, F.col(f"{p}text") == F.col(f"{p}key"))
    pieces = F.split("text", F.lit(f"(?:{ANY})"), -1)
    woven = F.array_join(F.zip_with(pieces, f"{p}shown", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    dirty = dirty.withColumn("pii_count", F.col(f"{p}count")).withColumn("text", woven).select(*clean.columns)
    return clean.unionByName(dirty)
