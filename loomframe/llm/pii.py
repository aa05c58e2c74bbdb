"""PII surrogates, in DataFrame operations only.

Detection. One alternation of patterns finds e-mail, IPv4 and IPv6 addresses,
phone numbers, IBANs and card numbers (both by their check digits too), social
security numbers, names led by a title, access keys and secrets that are
assigned. Texts without a match are left as they are. Names without a title
aren't found.

Replacement. Every entity has a canonical form (case, separators, titles and
the country code 1 aside), so spellings of one entity share one surrogate
(coreference): one number or address in the spelling's separators and case.
A family name has one surrogate wherever it stands, alone or behind given
names; given names have one for each family and gender that titles name. What
spellings tell about the entity (the country code, the gender) is gathered
before it is drawn. The surrogate is drawn from SHA-512 of (key, type,
canonical form, attempt) and written in the entity's own format: digits for
digits, letters of the same case and script for letters, separators as they
were. Names keep their title and their number of words, given names being of
the gender and the script; card numbers keep the first digit, IBANs the
country, both with valid check digits. What could exist is avoided where a
reserved range is there: numbers of the plan of country code 1 get 555 as their
exchange, public IPv4 addresses become ones of 240.0.0.0/4 and private ones of
10.0.0.0/8, IPv6 ones of 2001:db8::/32, e-mail domains end in .example, social
security numbers begin with 9. Phone numbers of other countries keep their
code and may exist.

Collisions. Surrogates that two entities share in any of their spellings, or
that some text contains as an entity, are drawn again with the next attempt
until there are none; given names come from lists at first (LISTED attempts)
and are made of syllables then. After RELAXED attempts the format grows by
eight digits, so this ends even where it has fewer values than entities.

Hits are extracted once and stored with their row; only texts with entities
are joined with their surrogates (skewed entities are split by adaptive
execution), and only they are shuffled while the list of their rows is short.

Defined results: null text stays null, empty text stays empty; texts of any
length work. Rows that repeat are treated alike. Extra columns play no part;
null keys do no harm. An empty table gives an empty table.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut

#: Attempts after which surrogates may be longer than their entities, and those that take given names from the lists.
RELAXED, LISTED = 16, 3
#: Rows with entities up to which their list is broadcast (8 bytes each); beyond, all texts are joined by shuffling.
BROADCAST_ROWS = 500_000

# Titles by gender, and given names by script and gender.
MALE = ("Mr", "Herr", "Señor", "Sr", "Don", "Monsieur", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "Mlle", "Госпожа")
NEUTRAL = ("Mx", "Dr", "Prof")
GIVEN = {
    ("latin", "m"): "Adam Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Lukas Martin Nils Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Alice Berta Clara Diana Emma Frida Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split(),
    ("latin", "n"): "Alex Ariel Charlie Dana Eden Finley Jamie Jordan Kim Lee Morgan Noel Quinn Robin Sam Sasha Taylor Toni Val Wren".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Максим Олег".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Мария Ольга Софья".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава Шура".split(),
    ("greek", "m"): "Ανδρέας Βασίλης Γιώργος Δημήτρης Κώστας Λευτέρης Μιχάλης Νίκος Πέτρος Σπύρος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Μαρία Νίκη Σοφία".split(),
    ("greek", "n"): "Χρυσή Ρένα Αγάπη Φώτη Τζένη".split(),
    ("armenian", "m"): "Արամ Գևորգ Դավիթ Հայկ Կարեն Նարեկ Տիգրան Վահան".split(),
    ("armenian", "f"): "Աննա Գայանե Լիլիթ Մարիամ Նարինե Սոնա Շուշան Անահիտ".split(),
    ("armenian", "n"): "Արևիկ Արշալույս Հույս Լույս Սիրուն".split(),
}
#: Capitals, small consonants and small vowels of family names, by script.
LETTERS = {
    "latin": ("BDFGHKLMNPRSTVWZ", "bdfghklmnprstvwz", "aeiou"), "cyrillic": ("БВГДЖЗКЛМНПРСТФХ", "бвгджзклмнпрстфх", "аеиоу"),
    "greek": ("ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧ", "βγδζθκλμνξπρστφχ", "αειου"), "armenian": ("ԲԳԴԶԹԼԽԿՀՄՆՊՍՎՏՐ", "բգդզթլխկհմնպսվտր", "աեիու"),
}


def _letters(script: str) -> tuple[str, str, str]:
    """Capitals and small letters of a script with two cases, by their names in Unicode; which are vowels isn't asked."""
    ranges = ((0x10A0, 0x1100), (0x13A0, 0x1400), (0x1C90, 0x1CC0), (0x2C00, 0x2D30), (0xAB70, 0xABC0), (0x10400, 0x10600), (0x10C80, 0x10D00), (0x118A0, 0x118E0), (0x16E40, 0x16E80), (0x1E900, 0x1E944))
    own = [chr(c) for a, b in ranges for c in range(a, b) if unicodedata.name(chr(c), "").startswith(script.replace("_", " ").upper())]
    upper = "".join(c for c in own if unicodedata.category(c) == "Lu" and len(c.lower()) == 1 and c.lower() in own)
    return upper, upper.lower(), upper.lower()


# The other scripts with two cases; their given names are made of letters as family names are.
for _script in ("georgian", "cherokee", "coptic", "glagolitic", "deseret", "osage", "old_hungarian", "warang_citi", "medefaidrin", "adlam"):
    LETTERS[_script] = _letters(_script)
    _upper, _lower, _ = LETTERS[_script]
    for _nth, _gender in enumerate("mfn"):
        GIVEN[_script, _gender] = [_upper[i] + "".join(_lower[(i * k + _nth + 3 * k) % len(_lower)] for k in (5, 7, 11)) for i in range(_nth, len(_upper), 3)]
#: Alphabets: a letter becomes one of its own.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àâäçèéêëîïñóôöùûüß", "ÀÂÄÇÈÉÊËÎÏÑÓÔÖÙÛÜ",
)
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = rf"(?:{'|'.join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))})\.?"
#: In order: the first type that matches at a place is the entity's.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ipv4": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.-])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[0-9]{13,19})(?![A-Za-z0-9])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "name": rf"(?<![\p{{L}}0-9]){_TITLE}(?: \p{{Lu}}[\p{{Ll}}'’-]{{1,30}}){{1,3}}(?![\p{{L}}])",
}
#: What stands before a secret, in any case.
_ASSIGNED = ("password=", "passwd=", "token=", "secret=", "api_key=", """token = ["']""", """secret = ["']""", """api_key = ["']""", """password = ["']""")
_SECRET = rf"(?i:{'|'.join(f'(?<={a})' for a in _ASSIGNED)})[A-Za-z0-9_/+.-]{{8,128}}"

#: What every entity contains: texts without any of it are settled by these cheap tests.
_HINTS = ("@", "AKIA", "ASIA")
_NAMED = rf"{_TITLE} \p{{Lu}}"
PATTERN = "|".join([*(f"(?:{p})" for p in PATTERNS.values()), _SECRET])


def _maybe(text: Column) -> Column:
    out = text.rlike("[0-9]{2}|[0-9][.][0-9]|[0-9A-Fa-f]:+[0-9A-Fa-f]")
    for hint in _HINTS:
        out = out | text.contains(hint)
    return out | text.rlike(f"(?i){'|'.join(_ASSIGNED)}") | text.rlike(_NAMED)


def _whole(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def kind_of(entity: Column) -> Column:
    out = F.lit("secret")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(_whole(entity, pattern), F.lit(kind)).otherwise(out)
    return out


def valid(kind: Column, entity: Column) -> Column:
    """Whether check digits, where the kind has some, are right."""
    bare = F.regexp_replace(entity, "[ -]", "")
    return F.when(kind == "card", F.call_function("luhn_check", bare)).when(kind == "iban", _mod97(bare) == 1).otherwise(True)


def _mod97(iban: Column) -> Column:
    """The remainder that is 1 for valid ones: letters count as 10 to 35, the first four characters go last."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(total, i):
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
        return (F.when(n < 10, total * 10).otherwise(total * 100) + n) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add)


def canonical(kind: Column, entity: Column) -> Column:
    """What spellings of one entity share."""
    name, digits = F.lower(F.regexp_replace(entity, rf"^{_TITLE} ", "")), F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "phone", F.regexp_replace(digits, "^1(?=[0-9]{10}$)", ""))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind.isin("name", "family"), name)
        .otherwise(entity)
    )


def family_of(canon: Column) -> Column:
    """The last word of a name."""
    return F.substring_index(canon, " ", -1)


def _byte(i: int | Column) -> Column:
    """The i-th of the 64 numbers from 0 to 255 in column ``bytes``."""
    return F.element_at("bytes", F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(64)) + 1)


def _chars(text: Column, f) -> Column:
    """text with f(character, place from 0) for each character."""
    each = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(each, f), "")


def _pick(alphabet: Column | str, n: Column) -> Column:
    alphabet = F.lit(alphabet) if isinstance(alphabet, str) else alphabet
    return F.substring(alphabet, F.pmod(n, F.length(alphabet)) + 1, F.lit(1))


def _swapped(text: Column) -> Column:
    """Every letter and digit replaced by one of its alphabet, by its place among them: separators don't shift what follows."""

    def swap(c, i):
        own = c
        for alphabet in ALPHABETS:
            own = F.when(F.instr(F.lit(alphabet), c) > 0, F.lit(alphabet)).otherwise(own)
        return _pick(own, _byte(F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), r"[^\p{L}0-9]", ""))))

    return _chars(text, swap)


def _digits_into(form: Column, digits: Column) -> Column:
    """The digits, written with the separators of form."""
    seen = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), "[^0-9]", ""))
    return _chars(form, lambda c, i: F.when(c.between("0", "9"), F.substring(digits, seen(i), F.lit(1))).otherwise(c))


def _into(form: Column, chars: Column) -> Column:
    """The characters, written with the spaces of form."""
    seen = lambda i: F.length(F.regexp_replace(F.substring(form, F.lit(1), i + 1), " ", ""))
    return _chars(form, lambda c, i: F.when(c == " ", c).otherwise(F.substring(chars, seen(i), F.lit(1))))


def _check_digit(digits: Column) -> Column:
    """The Luhn check digit."""
    n = F.length(digits)

    def add(total, i):
        twice = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * (i % 2 + 1)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.pmod(10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10, F.lit(10)).cast("string")


def _own_letters() -> tuple[Column, Column]:
    """The script of a name, and what names of the script named in column ``script`` are made of: a struct of letters and given names."""
    script = F.lit("latin")
    for s in LETTERS:
        if s != "latin":
            script = F.when(F.col("form").rlike(rf"\p{{Is{s.title()}}}"), s).otherwise(script)
    of = lambda s: F.struct(
        *[F.lit(x).alias(n) for n, x in zip(("first", "rest", "vowel"), LETTERS[s])], *[F.split(F.lit(" ".join(GIVEN[s, g])), " ").alias(g) for g in "mfn"]
    )
    table = F.map_from_arrays(F.array(*map(F.lit, LETTERS)), F.array(*map(of, LETTERS)))
    return script, F.element_at(table, F.col("script"))


def _syllables(at: int, n: int) -> list[Column]:
    """A capital and letters after it, vowels at every other place, from the bytes after the at-th."""
    return [_pick(F.col("own")["first" if i == 0 else "vowel" if i % 2 else "rest"], _byte(at + i)) for i in range(n)]


def _given(nth: int = 0) -> Column:
    """The nth given name; from the lists in the first attempts, then of three syllables that end as the gender's names do."""
    own, gender, at = F.col("own"), F.col("gender"), 9 * nth
    names = F.when(gender == "m", own["m"]).when(gender == "f", own["f"]).otherwise(own["n"])
    last = F.when(gender == "m", _pick(own["rest"], _byte(at + 7))).otherwise(F.substring(own["vowel"], F.when(gender == "f", 1).otherwise(3), F.lit(1)))
    return F.when(F.col("attempt") < LISTED, F.element_at(names, F.pmod(_byte(at), F.size(names)) + 1)).otherwise(F.concat(*_syllables(at + 1, 6), last))


def _family() -> Column:
    """Three syllables and a consonant: two million family names a script."""
    return F.concat(*_syllables(1, 7))


def _hexed(form: Column) -> Column:
    """An address of 2001:db8::/32 with as many groups and digits as the form has, in its case."""
    lower = F.lower(form)
    swapped = _chars(lower, lambda c, i: F.when(c == ":", c).otherwise(_pick("123456789abcdef" * 17 + "1", _byte(i))))
    groups = F.split(swapped, ":")
    whole = F.when(
        F.instr(lower, "::") > 0, F.concat(F.lit("2001:db8::"), F.substring_index(swapped, "::", -1))
    ).otherwise(F.concat(F.lit("2001:db8:"), F.array_join(F.slice(groups, 3, 6), ":")))
    return F.when(form == F.upper(form), F.upper(whole)).otherwise(whole)


def _gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\.$", "")
    return F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").otherwise("n")


def draw(df: DataFrame, key: str) -> DataFrame:
    """df: (kind, canon, attempt, form, code, gender). Adds ``surrogate``: the replacement of form, in its own format. Forms of one canon, code and gender get one surrogate, title, case and separators aside."""
    form, swapped = F.col("form"), F.col("swapped")
    added = ("stream", "bytes", "swapped", "digits", "body", "written", "script", "own")
    stream = F.sha2(F.concat_ws("\u0000", F.lit(key), "kind", "canon", F.col("attempt").cast("string")), 512)
    each = lambda i: F.conv(F.substring(F.col("stream"), i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    rows = df.withColumn("stream", stream).withColumn("bytes", F.transform(F.sequence(F.lit(0), F.lit(63)), each))
    script, own = _own_letters()
    rows = rows.withColumn("script", F.when(F.col("kind").isin("name", "family"), script)).withColumn("own", own)
    rows = rows.withColumns(
        {
            "swapped": _swapped(form), "digits": F.regexp_replace(form, "[^0-9]", ""),
        }
    )
    rows = rows.withColumns({"body": F.concat(F.substring("digits", 1, 1), F.substring(F.regexp_replace(swapped, "[^0-9]", ""), F.lit(2), F.length("digits") - 2))})
    private = form.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\.")
    octets = F.concat_ws(".", F.when(private, F.lit("10")).otherwise((_byte(0) % 15 + 240).cast("string")), *[_byte(i).cast("string") for i in (1, 2, 3)])
    # Drawn for the canonical digits, with the code that the spelling has before them.
    number = F.array_join(F.transform(F.sequence(F.lit(1), F.length("canon")), lambda i: (_byte(i) % 10).cast("string")), "")
    number = F.when((F.length("canon") == 10) & F.col("code").isin("", "1"), F.concat(F.substring(number, 1, 3), F.lit("555"), F.substring(number, 7, 4))).otherwise(
        F.concat("code", F.substring(number, F.length("code") + 1, F.length("canon")))
    )
    number = F.concat(F.substring("digits", F.lit(1), F.length("digits") - F.length("canon")), number)
    alike = lambda c, i: F.when(c.between("0", "9"), _pick(ALPHABETS[0], _byte(i))).otherwise(_pick(ALPHABETS[2], _byte(i)))
    account = F.concat(F.substring("canon", 1, 2), F.lit("00"), F.substring(_chars(F.col("canon"), alike), F.lit(5), F.length("canon")))
    account = F.concat(F.substring(account, 1, 2), F.lpad((98 - _mod97(account)).cast("string"), 2, "0"), F.substring(account, F.lit(5), F.length(account)))
    # As many given names as stand before the family name.
    n = F.length("canon") - F.length(F.regexp_replace("canon", " ", ""))
    named = F.concat(_given(), *[F.when(n > i, F.concat(F.lit(" "), _given(i))).otherwise(F.lit("")) for i in (1, 2)])
    kind = F.col("kind")
    written = (
        F.when(kind == "email", F.regexp_replace(swapped, r"\.[A-Za-z]+$", ".example"))
        .when(kind == "ipv4", octets)
        .when(kind == "ipv6", _hexed(form))
        .when(kind == "iban", _into(form, account))
        .when(kind == "card", _digits_into(form, F.concat("body", _check_digit(F.col("body")))))
        .when(kind == "phone", _digits_into(form, number))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(swapped, F.lit(2), F.length(form))))
        .when(kind == "access_key", F.concat(F.substring(form, 1, 4), F.substring(swapped, F.lit(5), F.length(form))))
        .when(kind == "name", named)
        .when(kind == "family", _family())
        .when(form.rlike("^[0-9a-f]+$"), F.substring(F.concat("stream", "stream"), F.lit(1), F.length(form)))
        .otherwise(swapped)
    )
    more = F.lpad(F.conv(F.substring("stream", 121, 6), 16, 10), 8, "0")
    rows = rows.withColumn("written", written)
    return rows.withColumn("surrogate", F.when(F.col("attempt") < RELAXED, F.col("written")).otherwise(F.concat("written", F.lit("x"), more))).drop(*added)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities: (entity), distinct. Returns (entity, kind, surrogate), no two canonical forms sharing a surrogate; what only looks like an entity is left out."""
    seen = entities.withColumn("kind", kind_of(F.col("entity"))).filter(valid(F.col("kind"), F.col("entity"))).withColumn("canon", canonical(F.col("kind"), F.col("entity")))
    name, code = F.col("kind") == "name", F.regexp_extract("entity", r"^\+([0-9]{1,3})(?=[ .(-])", 1)
    seen = seen.withColumn("code", F.when(F.col("kind") == "phone", code).otherwise("")).withColumn("gender", F.when(name, _gender(F.regexp_extract("entity", rf"^({_TITLE}) ", 1))).otherwise("n"))
    # What all spellings of an entity tell: its country code, and its gender where the other titles agree.
    told = seen.groupBy("kind", "canon").agg(F.max_by("code", F.length("code")).alias("code"), F.array_remove(F.collect_set("gender"), "n").alias("told"))
    gender = F.when((F.col("gender") == "n") & (F.size("told") == 1), F.element_at("told", 1)).otherwise(F.col("gender"))
    e = cut(seen.drop("code").join(told, ["kind", "canon"]).withColumn("gender", gender).drop("told"), "entities")
    bare = F.regexp_replace("entity", rf"^{_TITLE} ", "")
    families = e.filter(name).groupBy(family_of(F.col("canon")).alias("canon")).agg(F.min(family_of(bare)).alias("form"))
    several = F.col("canon").contains(" ")
    # Of a name, its given names are drawn; they are told apart beside its own family name, whose surrogate no other has.
    alike = F.when(name, F.concat(F.lower("surrogate"), F.lit(" "), family_of(F.col("canon")))).otherwise(canonical(F.col("kind"), F.col("surrogate")))
    drawn = lambda df: draw(df, key).withColumn("drawn", alike).drop("surrogate")
    # One spelling of each gender stands for the others while collisions are looked for.
    first = e.filter(~name | several).groupBy("kind", "canon", "code", "gender").agg(F.min("entity").alias("form"))
    first = first.unionByName(families.select(F.lit("family").alias("kind"), "canon", F.lit("").alias("code"), F.lit("n").alias("gender"), "form"))
    forms = cut(drawn(first.withColumn("attempt", F.lit(0))), "drawn")
    real = e.filter(~name).select("kind", F.col("canon").alias("drawn")).distinct().union(families.select(F.lit("family"), "canon")).withColumn("real", F.lit(True))
    while True:
        same, own = Window.partitionBy("kind", "drawn").orderBy("attempt", "canon"), Window.partitionBy("kind", "canon")
        ranked = forms.withColumn("nth", F.dense_rank().over(same)).join(real, ["kind", "drawn"], "left")
        again = F.max((F.col("nth") > 1) | F.col("real").isNotNull()).over(own)
        clashes = cut(ranked.withColumn("again", again).drop("nth", "real"), "ranked")
        if not clashes.filter("again").limit(1).count():
            break
        redrawn = drawn(clashes.filter("again").withColumn("attempt", F.col("attempt") + 1).drop("drawn", "again"))
        forms = cut(clashes.filter("not again").drop("again").unionByName(redrawn), "drawn")
    chosen = forms.select("kind", "canon", "attempt").distinct()
    plain = draw(e.filter(~name | several).join(chosen, ["kind", "canon"]).withColumn("form", F.col("entity")), key).drop("form")
    last = draw(forms.filter("kind = 'family'"), key).select(F.col("canon").alias("family"), F.col("surrogate").alias("last"))
    title = F.regexp_extract("entity", rf"^({_TITLE} )", 1)
    given = F.coalesce(F.concat(F.when(name, F.col("surrogate")), F.lit(" ")), F.lit(""))
    titled = plain.filter(name).unionByName(e.filter(name & ~several), allowMissingColumns=True).withColumn("family", family_of(F.col("canon"))).join(last, "family")
    return plain.filter(~name).select("entity", "kind", "surrogate").union(titled.select("entity", "kind", F.concat(title, given, "last")))


def replace(df: DataFrame, key: str = "doc_id", text: str = "text", secret: str = "loom") -> DataFrame:
    """One row per input row: key, text (with surrogates), n_entities."""
    rows = df.select(col(key).alias("key"), col(text).cast("string").alias("text")).withColumn("row", F.xxhash64("key", "text"))
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("hits")
    hits = cut(rows.filter(_maybe(F.col("text"))).select("row", found).filter(F.size("hits") > 0).distinct(), "hits")
    mentions = hits.select("row", F.explode(F.array_distinct("hits")).alias("entity"))
    named = cut(surrogates(mentions.select("entity").distinct(), secret), "surrogates")
    per_row = mentions.join(named, "entity").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("names"))
    changed = hits.join(per_row, "row").select(
        "row", F.transform("hits", lambda x: F.coalesce(F.element_at("names", x), x)).alias("written"),
        F.size(F.filter("hits", lambda x: F.map_contains_key("names", x))).cast("long").alias("n_entities"),
    )
    changed = cut(changed, "changed")
    ids = changed.select("row")
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        untouched = rows.join(F.broadcast(ids), "row", "left_anti").select("key", "text", F.lit(0).cast("long").alias("n_entities"))
        joined = rows.join(F.broadcast(ids), "row", "left_semi").join(changed, "row")
    else:
        untouched, joined = None, rows.join(changed, "row", "left")
    # n entities part a text into n + 1 pieces.
    pieces = F.split("text", PATTERN, -1)
    whole = F.array_join(F.flatten(F.zip_with(pieces, "written", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    out = joined.select("key", F.when(F.col("written").isNull(), F.col("text")).otherwise(whole).alias("text"), F.coalesce("n_entities", F.lit(0)).cast("long").alias("n_entities"))
    out = out if untouched is None else untouched.unionByName(out)
    return out.select(F.col("key").alias(key), F.col("text").alias(text), "n_entities")
