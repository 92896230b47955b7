"""PII: detected entities get keyed, type-consistent surrogates, checked to be distinct. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stage

# Forms of address by gender and without one, and names to draw from by gender and script.
TITLES = {"m": r"Mr|Sir|Herr|Herrn|M(?=\.)|Monsieur|Señor|Sr|Don|Signor|г-н|господин|κύριος", "f": "Mrs|Ms|Miss|Madam|Frau|Mme|Mlle|Madame|Señora|Señorita|Sra|Srta|Doña|Signora|г-жа|госпожа|κυρία"}
#: Forms of address that don't tell a gender; they may also follow one that does.
NEUTRAL = "Dr|Prof|Professor|Professeur|Profesor|Profesora|Doctor|Doctora|Docteur|Doktor"
GIVEN = {
    ("m", "latin"): "Adam Alan Albert Anton Bruno Carl Daniel David Edgar Felix Frank Georg Hugo Ivan Jonas Julian Karl Leo Louis Lukas Marco Martin Max Nils Oscar Otto Paul Peter Ralf Robert Simon Victor".split(),
    ("f", "latin"): "Ada Alice Anna Berta Carla Clara Diana Edith Ella Emma Eva Flora Greta Hanna Helen Ida Irene Julia Karen Laura Lena Linda Lucia Maria Nina Nora Olga Paula Rosa Sara Sonia Vera".split(),
    ("m", "cyrillic"): "Алексей Андрей Антон Борис Виктор Глеб Денис Иван Игорь Кирилл Лев Максим Никита Олег Павел Пётр".split(),
    ("f", "cyrillic"): "Алла Анна Вера Галина Дарья Елена Жанна Зоя Инна Ирина Лариса Мария Нина Ольга Софья Юлия".split(),
    ("m", "greek"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Πέτρος".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}
FAMILY = {
    "latin": "Abel Adler Baker Bauer Berg Brandt Brook Castel Clarke Conti Dahl Dorn Ebert Ferrer Fischer Garner Graf Hagen Hansen Ibarra Jansen Keller Klein Lambert Lange Marten Moreno Nolan Olsen Parker Perrin Quint Ramos Richter Romero Sander Stein Torres Vogel Weber".split(),
    "cyrillic": "Бондаренко Гончаренко Данченко Кравченко Лысенко Марченко Науменко Павленко Романенко Савченко Тимченко Шевченко".split(),
    "greek": "Αναγνώστου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Οικονόμου Παπαδοπούλου Χρήστου".split(),
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
# A word of a name (O'Brien, McDonald, Jean-Luc, SMITH) or initials (J. or J.R.), without a possessive 's; a name has up to eight, with particles between them.
_PART = r"(?:[dDlL]['’])?\p{Lu}(?:\.(?:-?\p{Lu}\.)*+|[\p{L}\p{M}]*+(?:(?:-|['’](?![sS](?![\p{L}\p{M}])))\p{L}[\p{L}\p{M}]*+){0,4}+)"
_PARTICLE = r"(?:de|del|la|las|los|von|van|zu|der|den|da|di|du|bin|ibn|y) "
_NAME = rf"{_PART}(?:(?: |(?<=\.))(?:{_PARTICLE}){{0,3}}{_PART}){{0,7}}+"
_TITLE = rf"(?:(?:{TITLES['m']}|{TITLES['f']})\.? (?:(?:{NEUTRAL})\.? )?|(?:{NEUTRAL})\.? )"
# Country calling codes of one and two digits; all others have three.
_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Java regular expressions by type, in order of precedence; each can only begin where its run of characters begins. What repeats without a bound is
#: one class of characters or possessive, which Java matches without recursion, however long a run is.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,48})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9A-Za-z])(?:(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{9,19})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}}){_TITLE}{_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_DIGIT_TYPES = ("phone", "ssn", "number")


def _kind(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(mention.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _canonical(kind: Column, mention: Column) -> Column:
    """What all mentions of one entity have in common: digits of a number, else the lower-cased text without title or spaces."""
    return (
        F.when(kind.isin(*_DIGIT_TYPES), F.concat(F.regexp_extract(mention, r"^\+", 0), F.regexp_replace(mention, "[^0-9]", "")))
        .when(kind == "name", F.lower(F.regexp_replace(mention, f"^{_TITLE}", "")))
        .when(kind == "iban", F.lower(F.replace(mention, F.lit(" "), F.lit(""))))
        .otherwise(F.lower(mention))
    )


def _gender(mention: Column) -> Column:
    """f, m, or n where the form of address doesn't tell."""
    return F.when(mention.rlike(rf"^(?:{TITLES['f']})\.? "), "f").when(mention.rlike(rf"^(?:{TITLES['m']})\.? "), "m").otherwise("n")


def _stream(key: str, kind: Column, canonical: Column, gender: Column, attempt: int) -> Column:
    """128 keyed hexadecimal digits for an entity."""
    seed = F.concat_ws("|", F.lit(key), kind, canonical, F.when(kind == "name", gender), F.lit(str(attempt)))
    return F.concat(F.sha2(F.concat(seed, F.lit("|a")), 256), F.sha2(F.concat(seed, F.lit("|b")), 256))


def _shaped(canonical: Column, stream: Column) -> Column:
    """The characters of `canonical` with digits and letters drawn anew, the rest kept; Cyrillic and Greek letters stay in their script."""

    def drawn(stream: Column) -> Column:
        digits, letters = F.translate(stream, "abcdef", "274916"), F.translate(stream, "0123456789abcdef", "aeioubdfklmnprst")
        cyrillic, greek = F.translate(letters, "aeioubdfklmnprst", "аеиоубдфклмнпрст"), F.translate(letters, "aeioubdfklmnprst", "αειουβδφκλμνπρστ")
        return F.array(digits, letters, cyrillic, greek)

    def draw(c: Column, i: Column, from_: Column) -> Column:
        at = F.pmod(i, F.lit(128)) + 1
        one = lambda k: F.substr(F.get(from_, F.lit(k)), at, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), F.when((i == 0) & (c != "0") & (one(0) == "0"), "5").otherwise(one(0)))
            .when(c.rlike(r"\p{IsCyrillic}"), one(2))
            .when(c.rlike(r"\p{IsGreek}"), one(3))
            .when(c.rlike(r"\p{L}"), one(1))
            .otherwise(c)
        )

    # the array of one holds what all characters draw from, so that it is worked out once
    return F.get(F.transform(F.array(drawn(stream)), lambda x: F.array_join(F.transform(F.split(canonical, ""), lambda c, i: draw(c, i, x)), "")), F.lit(0))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10, its last digit being the check digit."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """The number that digits and lower-case letters (a is 10) spell, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 87)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(F.when(value(c) < 10, a * 10).otherwise(a * 100) + value(c), F.lit(97)))


def _draw(names: list[str], stream: Column, at: int) -> Column:
    number = F.conv(F.substr(stream, F.lit(at + 1), F.lit(8)), 16, 10).cast("long")
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def _surrogate(kind: Column, canonical: Column, gender: Column, key: str, attempt: int) -> Column:
    """A replacement in canonical form. Each attempt draws anew; names get one more family name every second attempt, and local parts of addresses two more letters each attempt from the fifth on."""
    stream = _stream(key, kind, canonical, gender, attempt)
    shaped = _shaped(canonical, stream)
    # a changed last digit keeps the Luhn sum of a number, valid or not
    moved = (F.right(shaped, F.lit(1)).cast("int") + _luhn(canonical) - _luhn(shaped) + 10) % 10
    number = F.concat(F.substr(shaped, F.lit(1), F.length(shaped) - 1), moved.cast("string"))
    octets = F.concat_ws(".", *(((F.conv(F.substr(stream, F.lit(4 * i + 1), F.lit(4)), 16, 10).cast("int") % 254) + 1).cast("string") for i in range(4)))
    secret = F.when(canonical.rlike("^[0-9a-f]+$"), F.substr(stream, F.lit(1), F.length(canonical))).otherwise(F.concat(F.regexp_extract(canonical, "^(?:akia|gh[a-z]_|sk-)", 0), _shaped(F.regexp_replace(canonical, "^(?:akia|gh[a-z]_|sk-)", ""), stream)))
    # an account number of valid check digits gets others that are valid
    country, rest = F.left(canonical, F.lit(2)), F.substr(shaped, F.lit(5), F.length(shaped))
    valid = _mod97(F.concat(F.substr(canonical, F.lit(5), F.length(canonical)), F.left(canonical, F.lit(4)))) == 1
    check = F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(valid, check).otherwise(F.substr(shaped, F.lit(3), F.lit(2))), rest)
    host = F.element_at(F.split(canonical, "@"), 2)
    longer = F.translate(F.right(stream, F.lit(2 * max(attempt - 3, 0))), "0123456789abcdef", "aeioubdfklmnprst")
    email = F.concat(_shaped(F.element_at(F.split(canonical, "@"), 1), stream), longer, F.lit("@"), _shaped(F.regexp_replace(host, r"\.[a-z]+$", ""), F.sha2(F.concat(F.lit(key), host), 512)), F.regexp_extract(host, r"\.[a-z]+$", 0))
    name = F.lit(None).cast("string")
    script = F.when(canonical.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canonical.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    # where the form of address doesn't tell a gender, the key decides
    gender = F.when(gender == "n", F.when(F.substr(stream, F.lit(121), F.lit(1)) < "8", "f").otherwise("m")).otherwise(gender)
    for (g, s), given in GIVEN.items():
        families = lambda names: F.concat_ws("-", *(_draw(names, stream, 8 * (2 + i)) for i in range(1 + attempt // 2)))
        # every second family name each, so that the last word of a whole name is never another entity's name alone
        whole = F.concat_ws(" ", _draw(given, stream, 0), families(FAMILY[s][::2]))
        alone = families(FAMILY[s][1::2])
        name = F.when((gender == g) & (script == s), F.when(F.instr(canonical, " ") > 0, whole).otherwise(alone)).otherwise(name)
    return F.when(kind == "email", email).when(kind == "ip", octets).when(kind == "number", number).when(kind == "secret", secret).when(kind == "iban", iban).when(kind == "name", name).otherwise(F.concat(F.regexp_extract(canonical, _CODE, 0), _shaped(F.regexp_replace(canonical, _CODE, ""), stream)))


def _rendered(kind: Column, mention: Column, surrogate: Column) -> Column:
    """A surrogate in the format of a mention: its separators, its case, its title."""
    digits = F.regexp_replace(surrogate, "[^0-9]", "")
    spread = F.array_join(
        F.transform(F.split(mention, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, F.length(F.regexp_replace(F.substr(mention, F.lit(1), i), "[^0-9]", "")) + 1, F.lit(1))).otherwise(c)), ""
    )
    grouped = F.array_join(F.transform(F.split(mention, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substr(F.upper(surrogate), F.length(F.replace(F.substr(mention, F.lit(1), i), F.lit(" "), F.lit(""))) + 1, F.lit(1)))), "")
    title, own = F.regexp_extract(mention, f"^{_TITLE}", 0), F.regexp_replace(mention, f"^{_TITLE}", "")
    named = F.when((own == F.upper(own)) & own.rlike(r"\p{Lu}{2}"), F.upper(surrogate)).otherwise(surrogate)
    cased = F.when((mention == F.upper(mention)) & (mention != F.lower(mention)), F.upper(surrogate)).otherwise(surrogate)
    mixed = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substr(mention, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return (
        F.when(kind.isin(*_DIGIT_TYPES), spread).when(kind == "iban", grouped).when(kind == "name", F.concat(title, named)).when(kind == "secret", mixed).otherwise(cased)
    )


def surrogates(entities: DataFrame, key: str, attempts: int = 64) -> DataFrame:
    """(kind, canonical, gender, surrogate) for distinct (kind, canonical, gender): no two of one kind share a surrogate, and none is itself an entity.

    Of entities that draw one surrogate the first keeps it and the others draw again; so do those that drew an entity, and names that drew their own family name.
    """
    todo, accepted, n = entities, [], entities.count()
    for attempt in range(attempts):
        if not n:
            break
        drawn = todo.withColumn("surrogate", _surrogate(F.col("kind"), F.col("canonical"), F.col("gender"), key, attempt))
        drawn = stage(drawn.withColumn("low", F.lower("surrogate")), "drawn")
        known = entities.select("kind", F.col("canonical").alias("low"))
        for x in accepted:
            known = known.unionByName(x.select("kind", "low"))
        last = lambda c: F.element_at(F.split(c, "[ -]"), -1)
        changed = drawn.filter((F.col("kind") != "name") | (last("low") != last("canonical")))
        first = changed.groupBy("kind", "low").agg(F.min(F.struct("canonical", "gender")).alias("e")).select("kind", "low", "e.canonical", "e.gender").join(known, ["kind", "low"], "left_anti")
        won = stage(drawn.join(first, ["kind", "low", "canonical", "gender"], "left_semi"), "won")
        accepted.append(won)
        todo = drawn.drop("surrogate", "low").join(won, ["kind", "canonical", "gender"], "left_anti")
        n -= won.count()
    if n:
        raise RuntimeError(f"{n} entities found no surrogate of their own in {attempts} attempts")
    out = entities.select("kind", "canonical", "gender", F.lit("").alias("surrogate")).limit(0) if not accepted else accepted[0]
    for x in accepted[1:]:
        out = out.unionByName(x)
    return out.select("kind", "canonical", "gender", "surrogate")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_entities, kinds, text), one row per row of `docs`, each mention of an entity replaced by its surrogate.

    Found are e-mail addresses, secrets, IBANs, IPv4 addresses, telephone and social security numbers, long numbers such as those of cards, and
    names after a form of address. The gender that a form of address tells is part of a name's identity: Mr. and Mrs. Robin Smith are two people. A name of one word that ends a longer one
    of that gender in the same text, as in "Mr. John Smith ... Mr. Smith", is the same entity and gets the last word of its surrogate; in the text of another document it is an entity of its own. A surrogate keeps the type, script, gender, length and separators of what it replaces
    (a number also its Luhn sum, an IBAN valid check digits, a name in capitals its capitals, a telephone number its country code, an address its top-level domain); mentions of one
    entity, whatever their format, get the same one everywhere, different entities different ones. It follows from the key, so that
    it can't be undone without it; keep the key secret. kinds holds the distinct types found, in order. Null texts stay null with no entity; repeated
    rows are replaced alike; other columns are ignored; an empty table gives an empty result.
    """
    hints = F.col("text").rlike("[0-9@]")
    words = sorted({w for t in (*TITLES.values(), NEUTRAL) for w in t.split("|")})
    for word in words:
        if word.endswith(r"(?=\.)"):
            hints = hints | F.col("text").contains(f"{word.removesuffix(r'(?=\.)')}. ")
        elif not any(word != w and word.startswith(w) for w in words):
            hints = hints | F.col("text").contains(word)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("mentions", F.when(hints, F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))))
    some = F.coalesce(F.size("mentions") > 0, F.lit(False))
    found = stage(rows.filter(some).withColumn("parts", F.split("text", ANY, -1)).drop("text"), "mentions")

    each = found.select("row", F.posexplode("mentions").alias("pos", "mention")).withColumn("kind", _kind(F.col("mention")))
    each = stage(each.withColumns({"canonical": _canonical(F.col("kind"), F.col("mention")), "gender": F.when(F.col("kind") == "name", _gender(F.col("mention"))).otherwise("m")}), "each")
    whole = each.filter((F.col("kind") == "name") & (F.instr("canonical", " ") > 0)).select(F.col("row").alias("row_"), F.element_at(F.split("canonical", " "), -1).alias("last"), F.col("gender").alias("of"), "pos", F.col("canonical").alias("owner"))
    whole = whole.groupBy("row_", "last", "of").agg(F.min_by("owner", "pos").alias("owner"))  # the first name of a text that ends so
    short = (F.col("kind") == "name") & (F.col("row") == F.col("row_")) & (F.col("canonical") == F.col("last")) & (F.col("gender") == F.col("of"))
    each = each.join(whole, short, "left").select("row", "pos", "mention", "kind", "gender", F.col("owner").isNotNull().alias("short"), F.coalesce("owner", "canonical").alias("canonical"))
    each = stage(each, "named")
    entities = stage(each.select("kind", "canonical", "gender").distinct(), "entities")
    drawn = stage(surrogates(entities, key), "surrogates")
    surrogate = F.when(F.col("short"), F.element_at(F.split("surrogate", " "), -1)).otherwise(F.col("surrogate"))
    given = each.join(maybe_broadcast(drawn, drawn.count()), ["kind", "canonical", "gender"]).select("row", "pos", "kind", _rendered(F.col("kind"), F.col("mention"), surrogate).alias("new"))
    by_row = given.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("new"), F.array_sort(F.collect_set("kind")).alias("kinds"))  # of one document
    joined = found.join(by_row, "row")
    text = F.concat(F.array_join(F.transform("new", lambda x, i: F.concat(F.get("parts", i), x["new"])), ""), F.element_at("parts", -1))
    changed = joined.select("doc_id", F.size("mentions").cast("long").alias("n_entities"), "kinds", text.alias("text"))
    clean = rows.filter(~some).select("doc_id", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"), "text")
    return clean.unionByName(changed)
