"""Operator 5: personal data gets surrogates.

Detected: e-mail addresses, phone numbers, payment card numbers, IPv4 addresses,
US social security numbers, IBANs, long hexadecimal secrets, and names after a
title (Mrs., Herr, Señora, г-н, ...) of up to five parts, with hyphens,
apostrophes, particles and initials (particles and initials stay as they are);
in a document that titles a name, its bare mentions too. Each entity is replaced
by one of its own type, made by a keyed hash of its normal form: letters stay
letters of their script and case, digits digits, separators and lengths stay; a
card number stays valid if it was; a given name keeps the gender that its titles
tell, if they agree. The same entity has the same surrogate in every document
and spelling (phone and card numbers are known by their digits, IBANs without
spaces, addresses without case, names whatever their title and place).

Collision checks make that one-to-one: a surrogate that equals another one of
its type, or any entity really found, is made anew with the next attempt number
until none is left; the entity with the smallest hash keeps a contested one.
The checks are aggregations over the table of distinct entities.

Texts are matched where they stand; only occurrences and documents that have
any are shuffled. Occurrences of a hot entity meet its single surrogate row in
an equi-join whose large side may be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from progscan.llm.common import let, table, temp_names, text_or_empty, written
from progscan.llm.registry import job

#: Titles that tell a gender, and titles that do not.
MALE = ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "Senhor", "Господин", "Г-н", "г-н", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Signora", "Senhora",
          "Госпожа", "Г-жа", "г-жа", "Κυρία"]
NEUTRAL = ["Dr", "Prof", "Professor"]
_TITLE = "(?:" + "|".join(MALE + FEMALE + NEUTRAL) + ")"
_NAME = "\\p{Lu}(?:[\\p{L}\\p{M}]|['’-](?=\\p{Lu}))++"
_PARTICLE = "(?:von|van|vom|zu|zur|de|del|della|der|den|da|di|do|dos|du|la|le|el|al|bin|ibn|ter|y)"
#: What may stand between a title and a part of the name: other parts, initials, particles.
_ONE = f"(?:\\p{{Lu}}[\\p{{L}}\\p{{M}}'’-]{{1,30}}|\\p{{Lu}}\\.|{_PARTICLE}) "
_BEFORE = "(?:" + "|".join(_ONE * k for k in range(5)) + ")"
#: Length of an IBAN -> countries; these may be written in groups.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC"}
_IBAN = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[ -]?[A-Z0-9]){{{n - 4}}}(?![0-9A-Za-z])"
                 for n, c in IBAN_COUNTRIES.items())
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Entity type -> pattern, tried in this order. Runs of name or digit characters are entered at their start only,
#: so that long texts without spaces take linear time; what repeats is possessive, so none recurses on a long entity.
#: A secret has up to 4,096 hex digits (a key of 16,384 bits); a longer run is data.
PATTERNS = {
    "email": "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]++@[\\p{L}\\p{N}-]++(?:\\.[\\p{L}\\p{N}-]++)++",
    "secret": "(?<![0-9A-Za-z])(?:[0-9a-f]{32,4096}+|[0-9A-F]{32,4096}+)(?![0-9A-Za-z])",
    "iban": f"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN}|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}+(?![0-9A-Za-z]))",
    "phone": ("(?<![0-9])(?:\\+1[ .-]?\\(?[0-9]{3}\\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
              "|\\+[2-9][0-9]{0,2}(?:[ .-]?\\(?[0-9]{2,4}\\)?){2,4}"
              "|\\([0-9]{3}\\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"),
    "card": ("(?<![0-9])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}"
             "|3[0689][0-9]{2}[ -][0-9]{6}[ -][0-9]{4}|[0-9]{13,19})(?![0-9])"),
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": f"(?<![0-9.]){_OCTET}(?:\\.{_OCTET}){{3}}(?![0-9])(?!\\.[0-9])",
    "name": (f"(?=\\p{{Lu}})(?<= )(?!{_TITLE}(?![\\p{{L}}]))(?<=(?<![\\p{{L}}]){_TITLE}\\.? {_BEFORE}){_NAME}"),
}
ANY = "|".join(PATTERNS.values())
#: No entity without one of these: a quick look before the full patterns.
HINT = "[0-9@]|[0-9A-Fa-f]{32}|" + _TITLE + "\\.? "

#: Letters by script and case; a letter is replaced by one of its own row. Other characters stay.
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщыэюя",
             "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
             "àáâäçèéêëìíîïñòóôöùúûüß", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"]
#: Last letters of given names by gender, per script (Latin, Cyrillic, Greek); others have none.
ENDINGS = {"given_f": [("abcdefghijklmnopqrstuvwxyzàáâäçèéêëìíîïñòóôöùúûüß", "a"), (ALPHABETS[2], "а"), (ALPHABETS[4], "α")],
           "given_m": [("abcdefghijklmnopqrstuvwxyzàáâäçèéêëìíîïñòóôöùúûüß", "o"), (ALPHABETS[2], "н"), (ALPHABETS[4], "ς")]}
DIGITS = "0123456789"
HEX = "0123456789abcdef"
MAX_ROUNDS = 64
NAMES = ("given_m", "given_f", "given_n", "family")


def _type(raw: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in PATTERNS.items():
        if name != "name":
            out = out.when(raw.rlike(f"^(?:{pattern})$"), name)
    return out.otherwise("name")


def _by_pattern(text: Column, body) -> Column:
    """``body(pattern)`` with ANY, or with ANY and the bare mentions of the names that the text has a title for."""
    def mentions(names: Column) -> Column:
        longest = F.array_sort(F.transform(names, lambda n: F.struct((-F.char_length(n)).alias("l"), n.alias("n"))))["n"]
        return F.when(F.size(names) == 0, body(F.lit(ANY))).otherwise(let(
            F.concat(F.lit(ANY + "|(?=\\p{Lu})(?<![\\p{L}\\p{M}])(?:"), F.array_join(longest, "|"),
                     F.lit(")(?![\\p{L}\\p{M}])")), body))

    return let(F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))), mentions)


def gaps(text: Column) -> Column:
    """What stands before, between and behind the entities of a text."""
    return _by_pattern(text, lambda p: F.split(text, p, -1))


def occurrences(text: Column) -> Column:
    """array<struct<raw, type, norm>> of a text's entities in order; [] for none. Between them stand its ``gaps``.

    Types: those of PATTERNS, with name told apart as given_m, given_f, given_n
    (a title before it and a name behind it) and family.
    """
    ends = lambda titles: "(?:" + "|".join(titles) + ")\\.? $"

    def name_type(gap: Column, then: Column, following: Column) -> Column:
        given = then.rlike(f"^ (?:(?:\\p{{Lu}}\\.|{_PARTICLE}) )*$") & following.rlike("^\\p{Lu}")
        return (F.when(gap.rlike(ends(MALE)) & given, "given_m").when(gap.rlike(ends(FEMALE)) & given, "given_f")
                .when(gap.rlike(ends(NEUTRAL)) & given, "given_n").otherwise("family"))

    def norm(kind: Column, raw: Column) -> Column:
        return (F.when(kind.isin("phone", "card"), F.regexp_replace(raw, "[^0-9]", ""))
                .when(kind == "iban", F.regexp_replace(raw, "[ -]", ""))
                .when(kind.isin("ip", "ssn"), raw).otherwise(F.lower(raw)))

    def all_of(raws: Column, between: Column) -> Column:
        def one(raw: Column, i: Column) -> Column:
            kind = let(_type(raw), lambda t: F.when(t == "name", name_type(
                F.get(between, i), F.get(between, i + 1), F.coalesce(F.get(raws, i + 1), F.lit("")))).otherwise(t))
            return let(kind, lambda k: F.struct(raw.alias("raw"), k.alias("type"), norm(k, raw).alias("norm")))

        return F.transform(raws, one)

    found = let(_by_pattern(text, lambda p: F.regexp_extract_all(text, p, F.lit(0))),
                lambda raws: F.when(F.size(raws) > 0, let(gaps(text), lambda g: all_of(raws, g))))
    none = F.array().cast("array<struct<raw:string,type:string,norm:string>>")
    return F.when(text.rlike(HINT), F.coalesce(found, none)).otherwise(none)


def _pick(hexes: Column, i: Column, alphabet: str) -> Column:
    """The alphabet's character that 8 of the 512 bits of the hash choose for position i."""
    at = F.conv(F.substring(hexes, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int") % len(alphabet)
    return F.substring(F.lit(alphabet), at + 1, F.lit(1))


def _masked(part: Column, hexes: Column) -> Column:
    """Each letter and digit replaced by one of its own sort, as the hash says."""
    def one(ch: Column, i: Column) -> Column:
        out = F.when(F.instr(F.lit(DIGITS), ch) > 0, _pick(hexes, i, DIGITS))
        for a in ALPHABETS:
            out = out.when(F.instr(F.lit(a), ch) > 0, _pick(hexes, i, a))
        return out.otherwise(ch)

    return F.array_join(F.transform(F.split(part, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits, every second one from the right doubled (9 taken off above 9)."""
    n = F.char_length(digits)
    parts = F.transform(F.split(digits, ""), lambda c, i: let(
        c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(parts, F.lit(0), lambda a, v: a + v)


def _mod97(iban: Column) -> Column:
    """The remainder that an IBAN's check digits make 1: the first four characters last, letters as two digits."""
    turned = F.concat(_from(iban, 5), F.substring(iban, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _from(text: Column, start: int) -> Column:
    return F.substring(text, F.lit(start), F.char_length(text))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity's normal form, in normal form."""
    hexes = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")), 512)

    def email(h: Column) -> Column:
        # one surrogate domain for all addresses of a domain; its last label stays
        domain = F.substring_index(norm, "@", -1)
        top = F.substring_index(domain, ".", -1)
        labels = F.substring(domain, F.lit(1), F.char_length(domain) - F.char_length(top))
        wider = F.when(attempt >= 4, F.concat(F.lit("x"), attempt.cast("string"))).otherwise(F.lit(""))
        return F.concat(_masked(F.substring_index(norm, "@", 1), h), wider, F.lit("@"),
                        let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), labels), 512),
                            lambda d: _masked(labels, d)), top)

    def number(h: Column) -> Column:
        return F.concat(F.substring(norm, 1, 1), _from(_masked(norm, h), 2))

    def card(h: Column) -> Column:
        def checked(n: Column) -> Column:
            body = F.substring(n, F.lit(1), F.char_length(n) - 1)
            return F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))

        return let(number(h), lambda n: F.when(_luhn(norm) % 10 == 0, checked(n)).otherwise(n))

    def iban(h: Column) -> Column:
        def checked(n: Column) -> Column:
            country, body = F.substring(n, 1, 2), _from(n, 5)
            return F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body)

        made = F.concat(F.substring(norm, 1, 2), _from(_masked(norm, h), 3))
        return let(made, lambda n: F.when(_mod97(norm) == 1, checked(n)).otherwise(n))

    def ip(h: Column) -> Column:
        def octet(o: Column, i: Column) -> Column:
            low = F.when(attempt >= 4, 1).when(F.length(o) == 3, 100).when(F.length(o) == 2, 10).otherwise(1)
            high = F.when(attempt >= 4, 254).when(F.length(o) == 3, 254).when(F.length(o) == 2, 99).otherwise(9)
            n = F.conv(F.substring(h, i * 6 + 1, F.lit(6)), 16, 10).cast("int")
            return (low + n % (high - low + 1)).cast("string")

        return F.array_join(F.transform(F.split(norm, "\\."), octet), ".")

    def secret(h: Column) -> Column:
        return F.array_join(F.transform(F.split(norm, ""), lambda c, i: _pick(h, i, HEX)), "")

    def person(h: Column) -> Column:
        # short names have few others of their length: later attempts are longer
        longer = F.concat(norm, F.repeat(F.substring(norm, 1, 1), F.greatest(attempt - 1, F.lit(0)).cast("int")))

        def ended(made: Column) -> Column:
            out = F.when(kind == "none", made)
            for gender, endings in ENDINGS.items():
                for letters, end in endings:
                    out = out.when((kind == gender) & (F.instr(F.lit(letters), F.substring(norm, 1, 1)) > 0),
                                   F.concat(F.substring(made, F.lit(1), F.char_length(made) - 1), F.lit(end)))
            return out.otherwise(made)

        return let(_masked(longer, h), ended)

    return let(hexes, lambda h: (
        F.when(kind == "email", email(h)).when(kind == "card", card(h)).when(kind == "ip", ip(h))
        .when(kind == "phone", number(h)).when(kind == "secret", secret(h)).when(kind == "ssn", _masked(norm, h))
        .when(kind == "iban", iban(h)).otherwise(person(h))))


def spelled(raw: Column, kind: Column, made: Column) -> Column:
    """A surrogate in the spelling of an occurrence: its separators, its capitals."""
    def in_place(sort: str) -> Column:
        def one(ch: Column, i: Column) -> Column:
            before = F.char_length(F.regexp_replace(F.substring(raw, F.lit(1), i), f"[^{sort}]", ""))
            return F.when(ch.rlike(f"[{sort}]"), F.substring(made, before + 1, F.lit(1))).otherwise(ch)

        return F.array_join(F.transform(F.split(raw, ""), one), "")

    def capital(ch: Column, i: Column) -> Column:
        return F.when(F.substring(raw, i + 1, F.lit(1)).rlike("\\p{Lu}"), F.upper(ch)).otherwise(ch)

    shouted = (raw == F.upper(raw)) & (raw != F.lower(raw)) & (F.char_length(raw) > 1)
    named = F.array_join(F.transform(F.split(made, ""), capital), "")
    return (F.when(kind.isin("phone", "card"), in_place("0-9")).when(kind == "iban", in_place("0-9A-Z"))
            .when(kind.isin("ip", "ssn"), made)
            .when(shouted, F.upper(made)).when(kind.isin("email", "secret"), made).otherwise(named))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(type, norm, made) for distinct (type, norm): one-to-one within a type, and no surrogate is an entity.

    The types of names are one type here: a name has one surrogate, of the gender
    that its titles tell if they tell one.

    Round by round, contested surrogates are made anew by all but one holder:
    that of the earliest attempt and smallest hash; by all, if an entity of the
    corpus has that form. Only the question whether any is left comes to the
    driver; each round is written to the shared folder.
    """
    entities = entities.withColumn("space", F.when(F.col("type").isin(*NAMES), "name").otherwise(F.col("type")))
    tells = lambda t: F.max((F.col("type") == t).cast("int")) == 1
    one = (entities.groupBy("space", "norm").agg(tells("given_m").alias("m"), tells("given_f").alias("f"))
           .withColumn("kind", F.when(F.col("space") != "name", F.col("space")).when(F.col("m") & ~F.col("f"), "given_m")
                       .when(F.col("f") & ~F.col("m"), "given_f").otherwise("given_n")))
    fresh = surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)
    made = written(one.select("space", "kind", "norm", F.lit(0).alias("attempt")).withColumn("made", fresh), "surrogates")
    order = F.struct("attempt", F.xxhash64(F.lit(key), F.col("norm")).alias("h"), "norm")
    real = made.select("space", F.col("norm").alias("made"), F.lit(True).alias("real"))
    for _ in range(MAX_ROUNDS):
        held = made.groupBy("space", "made").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
        contested = (held.join(real, ["space", "made"], "left").where("n > 1 or real")
                     .select("space", "made", F.when(F.col("real").isNull(), F.col("first.norm")).alias("keeper"),
                             F.lit(True).alias("hit")))
        redo = (made.join(contested, ["space", "made"], "left")
                .withColumn("redo", F.col("hit").isNotNull() & ~F.col("norm").eqNullSafe(F.col("keeper"))))
        redo = written(redo.select("space", "kind", "norm", (F.col("attempt") + F.col("redo").cast("int")).alias("attempt"),
                                   "made", "redo"), "surrogates")
        if redo.where("redo").isEmpty():
            return entities.join(redo.select("space", "norm", "made"), ["space", "norm"]).select("type", "norm", "made")
        made = written(redo.select("space", "kind", "norm", "attempt",
                                   F.when(F.col("redo"), fresh).otherwise(F.col("made")).alias("made")), "surrogates")
    raise RuntimeError("surrogates still collide: an entity type has too few forms")


def replace_entities(docs: DataFrame, key_secret: str, key: str = "doc_id", text: str = "text",
                     n_entities: str = "n_entities") -> DataFrame:
    """All rows and columns of docs with surrogates in the text, and the number of occurrences as n_entities.

    Texts without entities are returned as they are (null stays null). The
    secret key decides all surrogates: same key and same set of entities, same
    result. Repeated rows and null keys are handled by key and text. A clashing
    column n_entities is replaced; an empty table gives an empty result.
    """
    o, tid, got = temp_names(docs, "o", "tid", "got")
    ids = {o: F.coalesce(F.col(key).cast("string"), F.lit("null")), tid: F.xxhash64(text_or_empty(text))}
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    mine = docs.where(hinted).withColumns(ids)
    # one row per document text, however often it is repeated under one key
    spots = (mine.select(F.col(o).alias("o"), F.col(tid).alias("tid"), F.posexplode(occurrences(F.col(text))))
             .select("o", "tid", "pos", "col.*").dropDuplicates(["o", "tid", "pos"]))
    spots = written(spots, "entities")
    made = assign(spots.select("type", "norm").distinct(), key_secret)
    new = (spots.join(made, ["type", "norm"])
           .select("o", "tid", "pos", spelled(F.col("raw"), F.col("type"), F.col("made")).alias("new"))
           .groupBy("o", "tid").agg(F.array_sort(F.collect_list(F.struct("pos", "new"))).alias("got"))
           .select(F.col("o").alias(o), F.col("tid").alias(tid), F.col("got.new").alias(got)))
    filled = F.array_join(F.transform(gaps(F.col(text)), lambda g, i: F.concat(g, F.coalesce(F.get(F.col(got), i), F.lit("")))), "")
    changed = (mine.join(new, [o, tid], "left")
               .withColumn(text, F.when(F.col(got).isNotNull(), filled).otherwise(F.col(text)))
               .withColumn(n_entities, F.coalesce(F.size(got), F.lit(0)).cast("long")))
    columns = [*[c for c in docs.columns if c != n_entities], n_entities]
    rest = docs.where(~hinted).withColumn(n_entities, F.lit(0).cast("long"))
    return changed.select(*columns).unionByName(rest.select(*columns))


@job("op5_surrogates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, key_secret="progscan")
