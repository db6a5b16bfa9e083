"""PII (1): surrogate generation for detected entities, with DataFrame functions only.

Entities (mail addresses, phone and card numbers, IP addresses, IBANs, social security
numbers, secrets, street addresses, and names after a form of address or with a known given
name, capitalised or in capitals) are found by one pattern in one pass. Second given names and particles go with their
name; four numbers after a word such as ``version`` are no address; mails of a domain share a
domain. Mentions of one entity share a canonical form,
whatever their punctuation; each distinct entity gets a surrogate from a keyed hash: letters
become letters of the same script and case, digits digits, octets octets; card and IBAN
numbers that pass their check get surrogates that pass it.

A person is a given name, a surname and a gender (told by the form of address or the given
name; a mention that tells none is the person of that name if there is just one). The surname
gets one surrogate in the whole corpus, so a mention by surname alone stays with its
namesakes; the given name gets one within its surname, of the person's gender and script.

A collision check over all entities of a type (equal surrogates, or a surrogate that is
itself someone's real value) sends the losers to another round with the next attempt number,
so distinct entities stay distinct and equal ones stay equal. Mentions get the surrogate in
their own format.

Edge cases: a null text stays null and an empty one empty; texts are read whole; rows that
repeat an id and text give equal rows; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

# Forms of address and given names by gender and script, syllables of surnames.
TITLES_F = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Mademoiselle|Mlle|Signora|Госпожа|Κυρία"
TITLES_M = "Mr|Herr|Señor|Sr|Monsieur|Signor|Господин|Κύριος"
TITLES_N = "Dr|Prof|Professor"
TITLES_F, TITLES_M, TITLES_N = (f"{x}|{x.upper()}" for x in (TITLES_F, TITLES_M, TITLES_N))
GIVEN = {
    ("latin", "f"): ["Alma", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sonia"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leon", "Marco", "Oscar", "Paul", "Simon", "Victor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Инна", "Мария", "Нина", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Денис", "Игорь", "Михаил", "Олег", "Павел"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Νίκη", "Σοφία", "Χλόη", "Ζωή"],
    ("greek", "m"): ["Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Μάριος", "Νίκος", "Πέτρος", "Στέφανος"],
}
SYLLABLES = {
    "latin": ["bar", "cor", "del", "fen", "gal", "hol", "jan", "kel", "lam", "mor", "nel", "pal", "ros", "sim", "tor", "val"],
    "cyrillic": ["бар", "вин", "гал", "дон", "жар", "зор", "кол", "лен", "мар", "нор", "пол", "рос", "сам", "тим", "фел", "хар"],
    "greek": ["βαρ", "γαλ", "δεν", "ζορ", "θαν", "καλ", "λεμ", "μαρ", "νικ", "παλ", "ραν", "σιμ", "τορ", "φαν", "χαλ", "ψαρ"],
}
STREETS = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd"
STREET_ENDS = "straße|strasse|weg|platz|gasse"
STREET_STARTS = "Calle|Avenida|Rue|rue|Via|Viale"
_NAME = r"\p{Lu}[\p{L}'’\-]+"
# Further given names that are detected, by gender.
MORE = {
    "f": [
        "Anna", "Anne", "Mary", "Sarah", "Marie", "Emma", "Emily", "Carmen", "Sofia", "Isabel", "Lucia", "Ana", "Susan", "Linda", "Karen", "Jessica", "Jennifer", "Elizabeth", "Patricia", "Barbara",
        "Ingrid", "Katarina", "Natalia", "Fatima", "Aisha", "Amina", "Leila", "Priya", "Mei", "Yuki",
    ],
    "m": [
        "John", "Peter", "James", "Thomas", "Michael", "Robert", "William", "Richard", "Joseph", "Charles", "Daniel", "Matthew", "Andrew", "Hans", "Stefan", "Andreas", "José", "Juan", "Luis", "Carlos",
        "Miguel", "Pedro", "Pierre", "Giovanni", "Luca", "Ahmed", "Mohammed", "Ali", "Omar", "Ravi", "Raj", "Amit", "Wei", "Kenji", "Hiroshi",
    ],
}
#: Words between given name and surname that belong to neither.
PARTICLES = "von|van|de|da|di|del|della|der|den|la|le|ter|dos|bin|al"
KNOWN = {g: sorted({n for (_, x), names in GIVEN.items() if x == g for n in names} | set(MORE[g])) for g in "fm"}
_KNOWN = "|".join(KNOWN["f"] + KNOWN["m"])
_SURNAME = rf"(?:(?:{PARTICLES}) ){{0,2}}(?:[dDlLO]['’])?{_NAME}"
#: A second given name or an initial.
_MIDDLE = rf"(?: (?:(?:{_KNOWN})(?=[ \-])|\p{{Lu}}\.))?"
_HEX = "[0-9A-Fa-f]{1,4}"
TYPES = {
    "email": r"(?<![.%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*\.[A-Za-z]{2,}+",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk[\-_][A-Za-z0-9]{20,}+)(?![A-Za-z0-9])",
    "ip": r"(?<!\.)(?<![Vv]ersion )(?<![Rr]elease )(?<![Bb]uild )(?<!\b[vV])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ipv6": rf"(?<![:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}|{_HEX}:(?::{_HEX}){{2,6}})(?![\p{{L}}\p{{N}}:])",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!-)\d(?:[ \-]?\d){12,18}(?![\d\-])",
    "phone": r"(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]?\d{3,4}(?!\d)|\+\d{8,15}(?!\d)",
    "address": rf"\d{{1,5}} {_NAME}(?: {_NAME})? (?:{STREETS})\b|\p{{Lu}}\p{{L}}*?(?:{STREET_ENDS}) \d{{1,4}}(?!\d)|(?:{STREET_STARTS}) (?:de |del |la |des ){{0,2}}{_NAME},? \d{{1,4}}(?!\d)",
    "name": rf"(?:(?:{TITLES_F}|{TITLES_M}|{TITLES_N})\b\.? (?:{_NAME}{_MIDDLE} {_SURNAME}|{_SURNAME})|(?:{_KNOWN}){_MIDDLE} {_SURNAME}|(?:{_KNOWN.upper()}) \p{{Lu}}{{3,}}+(?![\p{{L}}\p{{N}}]))",
}
#: Inside a word nothing begins, but for a number after letters.
PATTERN = r"(?:(?<![\p{L}\p{N}_])|(?<=\p{L})(?=\d))(?:" + "|".join(TYPES.values()) + ")"
MAX_ROUNDS = 50


def _type(m: Column) -> Column:
    """Which alternative the whole match is, in the order of the pattern."""
    out = F.lit("name")
    for name, p in reversed([x for x in TYPES.items() if x[0] != "name"]):
        out = F.when(m.rlike(f"^(?:{p})$"), name).otherwise(out)
    return out


def _title(m: Column) -> Column:
    return F.regexp_extract(m, rf"^((?:{TITLES_F}|{TITLES_M}|{TITLES_N})\b\.? )", 1)


def _canonical(kind: Column, m: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind.isin("card", "ssn", "phone"), F.regexp_replace(m, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind.isin("address", "ipv6"), F.lower(m))
        .otherwise(m)
    )


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t, digest, found): every text with all matches, from the only pass over all texts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    found = F.coalesce(F.regexp_extract_all("t", F.lit(f"({PATTERN})"), F.lit(1)), F.array().cast("array<string>"))
    return rows.select("id", "t", F.xxhash64("t").alias("digest"), found.alias("found"))


def mentions(scanned: DataFrame) -> DataFrame:
    """(id, digest, at, raw, kind, canon, given, gender): every mention, numbered in its text.

    A name's canon is its surname; given is null for a name by surname alone."""
    found = scanned.where(F.size("found") > 0).select("id", "digest", F.posexplode("found").alias("at", "raw")).distinct()
    found = found.withColumn("kind", _type(F.col("raw")))
    is_name = F.col("kind") == "name"
    bare = F.substr("raw", F.length(_title(F.col("raw"))) + F.lit(1))
    bare = F.trim(F.regexp_replace(bare, rf"(?:(?:^| )(?:{PARTICLES})(?= ))+", ""))
    given = F.when(is_name & bare.contains(" "), F.lower(F.substring_index(bare, " ", 1)))
    known = {g: [n.lower() for n in names] for g, names in KNOWN.items()}
    gender = F.when(F.col("raw").rlike(rf"^(?:{TITLES_F})\b"), "f").when(F.col("raw").rlike(rf"^(?:{TITLES_M})\b"), "m").when(given.isin(known["f"]), "f").when(given.isin(known["m"]), "m")
    canon = F.when(is_name, F.lower(F.substring_index(bare, " ", -1))).otherwise(_canonical(F.col("kind"), F.col("raw")))
    return found.withColumn("canon", canon).withColumn("given", given).withColumn("gender", F.when(is_name, gender))


def persons(found: DataFrame) -> DataFrame:
    """Names with given name, with the gender that their mentions settle on: told by the mention
    itself, or by all others of that name if they agree, or n."""
    names = found.where("kind = 'name' and given is not null")
    told = names.groupBy(F.col("given").alias("pg"), F.col("canon").alias("pc")).agg(F.min("gender").alias("lo"), F.max("gender").alias("hi"))
    settled = F.coalesce("gender", F.when(F.col("lo") == F.col("hi"), F.col("lo")), F.lit("n"))
    return names.join(told, (F.col("given") == F.col("pg")) & (F.col("canon") == F.col("pc"))).drop("pg", "pc").withColumn("person", F.concat_ws(" ", "given", "canon", settled)).withColumn("gender", settled)


def _script(x: Column) -> Column:
    return F.when(x.rlike(r"\p{IsCyrillic}"), "cyrillic").when(x.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _nibble(h: Column, i: Column) -> Column:
    """Number 0..255 from two hex digits of h, which is read in a circle."""
    return F.conv(F.substr(h, (i * 2) % F.length(h) + F.lit(1), F.lit(2)), 16, 10).cast("int")


def _same_format(x: Column, h: Column, alphabet: str = "") -> Column:
    """Every letter and digit of x replaced by one of its kind (or of the alphabet), from the hash h."""
    az, cap = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def pick(letters: str, n: Column) -> Column:
        return F.substr(F.lit(letters), n % len(letters) + F.lit(1), F.lit(1))

    def one(c: Column, i: Column) -> Column:
        n = _nibble(h, i)
        if alphabet:
            return pick(alphabet, n)
        return (
            F.when(c.rlike("[0-9]"), pick("0123456789", n)).when(c.rlike("[a-z]"), pick(az, n)).when(c.rlike("[A-Z]"), pick(cap, n))
            .when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчшэюя", n)).when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω", n))
            .when(c.rlike(r"\p{L}"), pick("àáâäçèéêëíîïñóôöùúûü", n)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(x, ""), one), "")


def _pick(options: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), n % len(options) + 1)


def _syllable(syllables: list[str], h: Column):
    return lambda i: _pick(syllables, _nibble(h, i))


def _luhn(digits: Column) -> Column:
    """The check digit that follows ``digits``."""
    def worth(c: Column, i: Column) -> Column:
        d = c.try_cast("int")
        return F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda s, x: s + x)
    return ((10 - total % 10) % 10).cast("string")


def _mod97(text: Column) -> Column:
    def step(r: Column, c: Column) -> Column:
        return F.when(F.rlike(c, F.lit("[0-9]")), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _checked_card(canon: Column, made: Column) -> Column:
    head = F.substr(made, F.lit(1), F.length(made) - 1)
    valid = _luhn(F.substr(canon, F.lit(1), F.length(canon) - 1)) == F.substring(canon, -1, 1)
    return F.when(valid, F.concat(head, _luhn(head))).otherwise(made)


def _checked_iban(canon: Column, made: Column) -> Column:
    country, body = F.substring(made, 1, 2), F.substring(made, 5, 100)
    valid = _mod97(F.concat(F.substring(canon, 5, 100), F.substring(canon, 1, 4))) == 1
    check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(valid, F.concat(country, check, body)).otherwise(made)


def _surrogate(key: str) -> Column:
    kind, canon, attempt, script = F.col("kind"), F.col("canon"), F.col("attempt"), F.col("script")
    parts = [F.lit(key), kind, canon, attempt.cast("string")]
    h = F.concat(*(F.sha2(F.concat_ws("|", F.lit(str(k)), *parts), 256) for k in range(2)))
    octets = F.array_join(F.transform(F.split(canon, r"\."), lambda c, i: (_nibble(h, i) % 254 + 1).cast("string")), ".")
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    # mails of one domain stay together; where many short names use the supply up, the domain gives way
    of_domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain, F.floor(attempt / 8).cast("string")), 256)
    mail = F.concat(_same_format(local, h), F.lit("@"), _same_format(F.regexp_extract(domain, r"^([^.]*)", 1), of_domain), F.regexp_extract(domain, r"^[^.]*(.*)$", 1))
    groups = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substr(F.lit("0123456789abcdef"), _nibble(h, i) % 16 + F.lit(1), F.lit(1))).otherwise(c)), "")
    # a phone number keeps its country code, a card number the network digit, an IBAN country
    phone = F.when(F.length(canon) > 10, F.concat(F.substr(canon, F.lit(1), F.length(canon) - F.lit(10)), _same_format(F.substr(canon, F.length(canon) - F.lit(9)), h))).otherwise(_same_format(canon, h))
    card = _checked_card(canon, F.concat(F.substring(canon, 1, 1), _same_format(F.substring(canon, 2, 100), h)))
    iban = _checked_iban(canon, F.concat(F.substring(canon, 1, 2), _same_format(F.substring(canon, 3, 100), h)))
    surname, given = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s, syllables in SYLLABLES.items():
        made = F.concat(*(_pick(syllables, _nibble(h, F.lit(i))) for i in range(3)))
        # more syllables with every attempt: the supply of names has no end
        more = F.array_join(F.transform(F.sequence(F.lit(3), 2 + attempt), _syllable(syllables, h)), "")
        surname = F.when(script == s, F.when(attempt > 0, F.concat(made, more)).otherwise(made)).otherwise(surname)
    told = F.substring_index(canon, " ", -1)
    gender = F.when(told == "n", F.when(_nibble(h, F.lit(40)) % 2 == 0, "f").otherwise("m")).otherwise(told)
    for (s, g), names in GIVEN.items():
        # names with a hyphen once single ones collide: one more part with every second attempt
        parts_of = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((attempt + 1) / 2).cast("int")), _syllable(names, h)), "-")
        given = F.when((script == s) & (gender == g), parts_of).otherwise(given)
    address = F.concat(_same_format(F.regexp_extract(canon, r"(\d+)", 1), h), F.lit("|"), surname)
    prefix = F.regexp_extract(canon, r"^(AKIA|ASIA|gh[pousr]_|sk[\-_])?", 0)
    secret = F.when(canon.rlike("^[0-9a-f]+$"), _same_format(canon, h, "0123456789abcdef")).when(canon.rlike("^[0-9A-F]+$"), _same_format(canon, h, "0123456789ABCDEF")).otherwise(F.concat(prefix, _same_format(F.substr(canon, F.length(prefix) + F.lit(1)), h)))
    made = {"email": mail, "ip": octets, "ipv6": groups, "phone": phone, "card": card, "iban": iban, "name": surname, "given": given, "address": address, "secret": secret}
    out = _same_format(canon, h)
    for name, column in made.items():
        out = F.when(kind == name, column).otherwise(out)
    return out


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of entities (kind, canon, scope): distinct within kind and scope,
    and never a real value of that kind."""
    if "scope" not in entities.columns:
        entities = entities.withColumn("scope", F.lit(""))
    todo = entities.select("kind", "canon", "scope").distinct().withColumn("script", _script(F.col("canon"))).withColumn("attempt", F.lit(0))
    real = materialize(todo.select(F.col("kind").alias("rk"), F.col("canon").alias("rc")), "real")
    done = None
    for _ in range(MAX_ROUNDS):
        tried = materialize(todo.withColumn("surrogate", _surrogate(key)), "tried")
        clash = tried.join(real, (F.col("kind") == F.col("rk")) & (F.col("surrogate") == F.col("rc")), "left_semi").select("kind", "canon")
        first = Window.partitionBy("kind", "scope", "surrogate").orderBy("canon")
        again = tried.withColumn("n", F.row_number().over(first)).where("n > 1").select("kind", "canon")
        if done is not None:
            d = done.select(F.col("kind").alias("dk"), F.col("scope").alias("dc"), F.col("surrogate").alias("ds"))
            again = again.union(tried.join(d, (F.col("kind") == F.col("dk")) & (F.col("scope") == F.col("dc")) & (F.col("surrogate") == F.col("ds")), "left_semi").select("kind", "canon"))
        lost = materialize(clash.union(again).distinct(), "lost")
        good = tried.join(lost, ["kind", "canon"], "left_anti").select("kind", "canon", "scope", "surrogate")
        done = good if done is None else done.union(good)
        if not lost.take(1):
            return done.select("kind", "canon", "surrogate")
        todo = tried.drop("surrogate").join(lost, ["kind", "canon"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
    raise RuntimeError("surrogates still collide; use another key")


def _in_format(raw: Column, kind: Column, surrogate: Column, given: Column) -> Column:
    """The surrogate as this mention writes it: punctuation, blanks, case, form of address."""
    chars = F.split(raw, "")
    keep = F.when(kind == "iban", F.lit("[A-Z0-9]")).otherwise(F.lit("[0-9]"))

    def laid(c: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: F.rlike(x, keep)))
        return F.when(F.rlike(c, keep), F.substr(surrogate, before + F.lit(1), F.lit(1))).otherwise(c)

    digits = F.array_join(F.transform(chars, laid), "")
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    cased = F.when(upper & kind.isin("email", "ipv6"), F.upper(surrogate)).otherwise(surrogate)
    title = _title(raw)
    surname = F.initcap(surrogate)
    name = F.when(given.isNotNull(), F.concat(given, F.lit(" "), surname)).otherwise(surname)
    bare = F.substr(raw, F.length(title) + F.lit(1))
    person = F.concat(title, F.when(bare == F.upper(bare), F.upper(name)).otherwise(name))
    where = rf"(?<=\d ){_NAME}(?: {_NAME})?(?= (?:{STREETS})$)|^\p{{Lu}}\p{{L}}*?(?=(?:{STREET_ENDS}) \d)|{_NAME}(?=,? \d+$)"
    street = F.regexp_replace(F.regexp_replace(raw, F.lit(where), F.initcap(F.substring_index(surrogate, "|", -1))), F.lit(r"\d+"), F.substring_index(surrogate, "|", 1))
    return F.when(kind == "name", person).when(kind == "address", street).when(kind.isin("phone", "card", "ssn", "iban"), digits).otherwise(cased)


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_entities, kinds) for every row, entities replaced by their surrogates."""
    scanned = materialize(scan(docs, id_col, text_col), "scanned")
    found = materialize(mentions(scanned), "mentions")
    people = materialize(persons(found), "people")
    entities = found.select("kind", "canon", F.lit("").alias("scope")).union(people.select(F.lit("given").alias("kind"), F.col("person").alias("canon"), F.col("canon").alias("scope")))
    table = materialize(surrogates(entities, key), "surrogates").select(F.col("kind").alias("k"), F.col("canon").alias("c"), "surrogate")
    mine = lambda rows: rows.join(table, (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c"))).drop("k", "c")
    firsts = table.where("k = 'given'").select(F.col("c").alias("p"), F.col("surrogate").alias("first"))
    named = mine(people).join(firsts, F.col("person") == F.col("p")).select("id", "digest", "at", "raw", "kind", "surrogate", "first")
    rest = mine(found.where("given is null")).select("id", "digest", "at", "raw", "kind", "surrogate", F.lit(None).cast("string").alias("first"))
    named = named.union(rest).select("id", "digest", "at", "kind", _in_format(F.col("raw"), F.col("kind"), F.col("surrogate"), F.col("first")).alias("new"))
    per_text = named.groupBy(F.col("id").alias("i"), F.col("digest").alias("d")).agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("all"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    clean = scanned.where(F.size("found") == 0).select("id", F.col("t").alias("text"), F.lit(0).alias("n_entities"), F.lit("").alias("kinds"))
    dirty = scanned.where(F.size("found") > 0).join(per_text, F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")))
    between = F.split("t", PATTERN, -1)
    new = F.concat(F.transform("all", lambda x: x["new"]), F.array(F.lit("")))
    text = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, b)), "")
    return clean.union(dirty.select("id", text.alias("text"), F.size("all").alias("n_entities"), F.array_join("kinds", ",").alias("kinds")))
