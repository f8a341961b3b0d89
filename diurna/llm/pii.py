r"""Personal data and secrets replaced by surrogates, with DataFrame functions only.

1. One pattern finds entities: addresses of mail and network, phone, card and account numbers,
   secrets and keys, and names after a form of address. Only texts with a cheap hint are searched.
   Numbers like those of cards or IBANs whose check digits are wrong are no such numbers and stay.
2. Each entity has a kind and a canonical form (digits of a number, lower case of a mail address, each
   word of a name), so that spellings of one thing share a surrogate in the whole corpus. Words of
   names are one kind: a word keeps its surrogate after any form of address, first name or last.
3. A surrogate is made from a keyed digest of kind, canonical form and a counter. It keeps the kind
   and format: digits become digits, letters letters of their script and case, separators stay; mail
   addresses keep the top-level domain, cards the first digit and IBANs the country, both with valid
   check digits, keys their prefix; octets are octets. A first name is masculine if
   some form of address in the corpus says so and none says otherwise, and likewise feminine.
4. All distinct entities are checked together: of several with one surrogate one keeps it, and none
   may have what is itself an entity of the corpus or was given before; the others alone count up
   until none collides. After ROUNDS counts, when a format has hardly a free value left, what remains
   gets sixteen digits of its digest behind a surrogate, which keeps entities distinct.
5. Texts with entities are put together again from what lies between and the surrogates. Other texts
   are not moved. A common entity is joined to its texts in several tasks.

Names without a form of address are not found.

Defined cases: an empty table gives an empty result; null and empty texts stay as they are, and very
long ones are searched whole; repeated rows get equal results; rows equal in doc_id and text are
replaced alike; all columns are kept, and a column whose name begins with _pii_ is lost.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written
from .words import small, spread_join

HONORIFICS = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н", "Κύριος", "Κος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita", "Srta", "Госпожа", "г-жа", "Κυρία", "Κα"),
    "n": ("Dr", "Prof", "Доктор", "Δρ"),
}
# of forms that begin alike the longest is tried first
_ADDRESS = "|".join(sorted((name for names in HONORIFICS.values() for name in names), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HEX = r"[0-9A-Fa-f]{1,4}"
_NAME = r"\p{Lu}[\p{Ll}’'-]+"
_SECRET_WORDS = r"(?i:token|secret|api_key|apikey|passwd|password|pwd)"
#: Kinds and their patterns, in the order in which they are tried at a place.
PATTERNS = (
    ("secret", r"(?<=(?i:token|secret|api_key|apikey|passwd|password|pwd)[ \t]{0,2}[=:][ \t]{0,2}[\"']?)[A-Za-z0-9][A-Za-z0-9_./+@!-]{4,}[A-Za-z0-9]"),
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"),
    ("key", r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])"),
    ("secret", r"(?<![A-Za-z0-9])[0-9a-f]{32,}(?![A-Za-z0-9])"),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9])(?!\.[0-9])"),
    ("ipv6", rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|[0-9A-Fa-f]{{3,4}}(?::{_HEX}){{0,5}}::(?:{_HEX}:){{0,5}}{_HEX})(?![\p{{L}}\p{{N}}:])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"),
    ("ssn", r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"),
    ("name", rf"(?<![\p{{L}}\p{{N}}_])(?:{_ADDRESS})\.? {_NAME}(?: {_NAME}){{0,2}}"),
)
ENTITY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: What a text with an entity must hold, for each kind a part of its pattern: literals, and patterns that begin with a rare character.
LITERALS = ("@", "ghp_", "sk-", "AKIA", "ASIA")
HINTS = (
    r"[0-9](?:(?:[ .()-]{0,3}[0-9]){5}|\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9])",
    rf"[=:](?:(?<=:)[0-9A-Fa-f]{{0,4}}:|(?<={_SECRET_WORDS}[ \t]{{0,2}}[=:]))",
    rf" (?=\p{{Lu}})(?<=(?:{_ADDRESS})\.? )",
    r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4}",
    r"[0-9a-f]{32}",
)
ROUNDS = 24


def _letters(first: str, last: str) -> str:
    return "".join(c for c in map(chr, range(ord(first), ord(last) + 1)) if c.isalpha())


#: Scripts, and the letters that stand for others of theirs (lower case where there are cases).
ALPHABETS = {
    "Latin": _letters("a", "z"), "Cyrillic": _letters("а", "я"), "Greek": _letters("α", "ω").replace("ς", ""), "Armenian": _letters("ա", "ֆ"), "Georgian": _letters("ა", "ჰ"),
    "Hebrew": _letters("א", "ת"), "Arabic": _letters("ا", "غ"), "Devanagari": _letters("क", "ह"), "Bengali": _letters("ক", "ন"), "Thai": _letters("ก", "ฮ"),
    "Hiragana": _letters("か", "も"), "Katakana": _letters("カ", "モ"), "Hangul": _letters("가", "갛"), "Han": _letters("一", "丿"),
}
SYLLABLES = {
    "Latin": ("ba", "cor", "dan", "fel", "gar", "hol", "jen", "kar", "lin", "mar", "nor", "per", "ros", "sel", "tor", "vin"),
    "Cyrillic": ("ба", "вол", "гор", "дан", "зор", "кар", "лен", "мар", "нов", "пет", "рос", "сав", "тим", "фед", "хар", "яр"),
    "Greek": ("βα", "κορ", "δαν", "φελ", "γαρ", "χολ", "ζεν", "καρ", "λιν", "μαρ", "νορ", "περ", "ροσ", "σελ", "τορ", "θαλ"),
}
#: Endings of first names of either gender or none, and of last names (s).
ENDINGS = {
    "Latin": {"m": ("ton", "rick", "us", "o"), "f": ("ina", "elle", "ia", "a"), "n": ("en", "is", "el", "y"), "s": ("son", "er", "ley", "ard")},
    "Cyrillic": {"m": ("ан", "ий", "ор", "ил"), "f": ("ина", "ия", "ана", "а"), "n": ("ен", "ис", "ель", "и"), "s": ("енко", "ук", "ич", "ян")},
    "Greek": {"m": ("ος", "ης", "ας", "ων"), "f": ("ια", "ινα", "ουλα", "η"), "n": ("ι", "ον", "υ", "ε"), "s": ("ίδης", "άκης", "όγλου", "έας")},
}


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def kind_of(value: Column) -> Column:
    """The kind of an entity, from its own form."""
    found = F.when(value.rlike(rf"^(?:{_ADDRESS})\.? {_NAME}"), "name")
    for kind, pattern in PATTERNS[1:-1]:
        found = found.when(value.rlike(rf"^(?:{pattern})$"), kind)
    return found.otherwise("secret")


def parts_of(value: Column, kind: Column) -> Column:
    """(kind, canonical form, role) of each part of an entity that has a surrogate of its own.

    The role of a name's last word is s, that of others the gender that the form of address gives.
    """
    numbers = F.regexp_replace(value, r"[^0-9A-Za-z]", "")
    canonical = F.when(kind.isin("email", "ipv6"), F.lower(value)).when(kind.isin("card", "ssn", "iban"), numbers).when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), numbers)).otherwise(value)
    address = F.regexp_extract(value, rf"^({_ADDRESS})\.? ", 1)
    words = F.split(F.regexp_replace(value, rf"^(?:{_ADDRESS})\.? ", ""), " ")
    gender = reduce(lambda c, g: c.when(address.isin(*HONORIFICS[g]), g), "mf", F.when(F.lit(False), "n")).otherwise("n")
    named = F.transform(words, lambda w, i: F.struct(F.lit("name").alias("kind"), F.lower(w).alias("canonical"), F.when(i == F.size(words) - 1, "s").otherwise(gender).alias("role")))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), canonical.alias("canonical"), F.lit("").alias("role"))))


def style_of(role: Column) -> Column:
    """Aggregate: what kind of name a word is, from all its roles in the corpus."""
    m, f, given = F.bool_or(role == "m"), F.bool_or(role == "f"), F.bool_or(role != "s")
    return F.when(F.bool_or(role == ""), "").when(~given, "s").when(m & ~f, "m").when(f & ~m, "f").otherwise("n")


def luhn(digits: Column) -> Column:
    """The check sum of a number: every second digit from the right counts double."""

    def add(acc: Column, c: Column) -> Column:
        d = F.try_to_number(c, F.lit("9")).cast("int") * F.when(acc["n"] % 2 == 1, 2).otherwise(1)
        return F.struct((acc["n"] + 1).alias("n"), (acc["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("sum"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, add, lambda acc: acc["sum"])


def mod97(iban: Column) -> Column:
    """The remainder by 97 of an account number with country and check digits moved to its end; letters count from 10."""

    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).when(c.between("A", "Z"), (acc * 100 + F.ascii(c) - 55) % 97).otherwise(acc)

    return F.aggregate(F.split(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), ""), F.lit(0), add)


def genuine(value: Column, kind: Column) -> Column:
    """Whether a card number or IBAN has the check digits that such numbers have; others need none."""
    numbers = F.regexp_replace(value, r"[^0-9A-Za-z]", "")
    return F.when(kind == "card", luhn(numbers) % 10 == 0).when(kind == "iban", mod97(numbers) == 1).otherwise(True)


def surrogate(kind: Column, canonical: Column, style: Column, tweak: int, key: str) -> Column:
    """What stands for a canonical form, at a count of `tweak`."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, F.lit(str(tweak))), 256)
    number = lambda i, n: F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")
    pick = lambda alphabet, i, n: F.substr(F.lit(alphabet), F.pmod(F.xxhash64(seed, i), n).cast("int") + 1, F.lit(1))
    size = F.length(canonical)
    head = F.when(kind == "key", F.when(canonical.startswith("sk-"), 3).otherwise(4)).when(kind == "iban", 2).when(kind == "card", 1).when((kind == "phone") & canonical.startswith("+"), 2).otherwise(0)
    tail = F.when(kind == "email", F.length(F.substring_index(canonical, ".", -1))).otherwise(0)
    hexed = (kind == "ipv6") | canonical.rlike("^[0-9a-f]+$")

    def other(c: Column, i: Column) -> Column:
        drawn = F.when(c.between("0", "9"), pick("0123456789", i, F.lit(10))).when(hexed & c.between("a", "f"), pick("abcdef", i, F.lit(6)))
        for script, letters in ALPHABETS.items():
            drawn = drawn.when(c.rlike(rf"^[\p{{Is{script}}}&&\p{{L}}]$"), pick(letters, i, F.lit(len(letters))))
        drawn = drawn.when(c.rlike(r"^\p{L}$"), pick(ALPHABETS["Latin"], i, F.lit(26))).otherwise(c)
        return F.when((i < head) | (i >= size - tail), c).when(c != F.lower(c), F.upper(drawn)).otherwise(drawn)

    typed = F.array_join(F.transform(F.split(canonical, ""), other), "")
    drawn = F.substr(typed, F.lit(1), size - 1)
    checked = F.concat(drawn, F.pmod(10 - luhn(F.concat(drawn, F.lit("0"))) % 10, F.lit(10)).cast("string"))
    country, rest = F.substr(typed, F.lit(1), F.lit(2)), F.substr(typed, F.lit(5))
    account = F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0"), rest)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (number(i, 223) + 1).cast("string")), ".")

    def named(script: str) -> Column:
        # each count adds a syllable, so there are always names left
        syllables = F.transform(F.sequence(F.lit(1), F.lit(tweak + 2)), lambda i: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), number(i, len(SYLLABLES[script])) + 1))
        endings = F.lit("")
        for g, choice in ENDINGS[script].items():
            endings = F.when(style == g, F.element_at(F.array(*map(F.lit, choice)), number(F.lit(0), len(choice)) + 1)).otherwise(endings)
        return F.concat(F.array_join(syllables, ""), endings)

    out = F.when(kind == "ip", octets).when(kind == "card", checked).when(kind == "iban", account)
    for script in SYLLABLES:
        out = out.when((kind == "name") & canonical.rlike(rf"^\p{{Is{script}}}"), named(script))
    out = out.otherwise(typed)
    return out if tweak < ROUNDS else F.concat(out, F.substr(seed, F.lit(1), F.lit(16)))


def assign(known: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for all known(kind, canonical, style), with no surrogate twice in a kind and none that is an entity itself.

    Only what collides is tried again, and of what is taken only the surrogates tried are looked up.
    """
    known = written(known)
    left, given, tweak = known, [], 0
    while True:
        tried = written(left.select("kind", "canonical", "style", surrogate(F.col("kind"), F.col("canonical"), F.col("style"), tweak, key).alias("surrogate")))
        if tweak == ROUNDS:
            given.append(tried.select("kind", "canonical", "surrogate"))
            break
        keepers = written(tried.groupBy("kind", "surrogate").agg(F.min("canonical").alias("keeper")))
        taken = reduce(DataFrame.unionByName, [known.select("kind", F.col("canonical").alias("surrogate")), *(g.select("kind", "surrogate") for g in given)])
        hit = taken.join(small(keepers.select("kind", "surrogate"), keepers.count()), ["kind", "surrogate"], "left_semi").distinct()
        free = keepers.join(hit, ["kind", "surrogate"], "left_anti").select("kind", F.col("keeper").alias("canonical"), F.lit(True).alias("free"))
        judged = written(tried.join(free, ["kind", "canonical"], "left"))
        given.append(judged.where("free").select("kind", "canonical", "surrogate"))
        left, tweak = judged.where("free is null").select("kind", "canonical", "style"), tweak + 1
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, given)


def rendered(value: Column, kind: Column, surrogates: Column) -> Column:
    """The surrogate in the format of the entity as written; what a surrogate has beyond it follows."""
    one = F.element_at(surrogates, 1)["surrogate"]
    chars = F.split(value, "")
    counted = lambda text: F.length(F.regexp_replace(text, r"[^0-9A-Za-z+]", ""))
    numbers = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9A-Za-z+]$"), F.substr(one, counted(F.substr(value, F.lit(1), i + 1)), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c != F.lower(c), F.upper(F.substr(one, i + 1, F.lit(1)))).otherwise(F.substr(one, i + 1, F.lit(1)))), "")
    names = F.array_join(F.transform(surrogates, lambda s: F.initcap(s["surrogate"])), " ")
    address = F.regexp_extract(value, rf"^((?:{_ADDRESS})\.? )", 1)
    return (
        F.when(kind == "name", F.concat(address, names))
        .when(kind.isin("phone", "card", "ssn", "iban"), F.concat(numbers, F.substr(one, counted(value) + 1)))
        .when(kind.isin("email", "ipv6"), F.concat(cased, F.substr(one, F.length(value) + 1)))
        .otherwise(one)
    )


def replace(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs with all entities of `text` replaced, and their number in `_pii_entities`."""
    docs = docs.select(*(c for c in docs.columns if not c.startswith("_pii_")))
    text = F.col("text").cast("string")
    hinted = F.coalesce(reduce(Column.__or__, [*(F.contains(text, F.lit(x)) for x in LITERALS), *(text.rlike(h) for h in HINTS)]), F.lit(False))
    searched = written(docs.where(hinted).select("*", entities(text).alias("_pii_found"), F.xxhash64("text").alias("_pii_text")))
    touched = searched.where(F.size("_pii_found") > 0)
    uses = touched.select("doc_id", "_pii_text", F.explode(F.array_distinct("_pii_found")).alias("value")).distinct()
    values = written(uses.groupBy("value").agg(F.count("*").alias("n")).withColumn("whole", kind_of(F.col("value"))).where(genuine(F.col("value"), F.col("whole"))))
    parts = values.select("*", F.posexplode_outer(parts_of(F.col("value"), F.col("whole"))).alias("part", "p")).select("value", "n", "whole", "part", "p.kind", "p.canonical", "p.role")
    table = assign(parts.groupBy("kind", "canonical").agg(style_of(F.col("role")).alias("style")), key)
    told = parts.join(table, ["kind", "canonical"]).groupBy("value", "n", "whole").agg(F.array_sort(F.collect_list(F.struct("part", "surrogate"))).alias("s"))
    told = written(told.select("value", "n", rendered(F.col("value"), F.col("whole"), F.col("s")).alias("new")))
    maps = spread_join(uses, told, "value", ["doc_id", "_pii_text"]).groupBy("doc_id", "_pii_text").agg(F.map_from_entries(F.collect_list(F.struct("value", "new"))).alias("_pii_map"))
    maps = maps.select(F.col("doc_id").alias("_pii_doc"), F.col("_pii_text").alias("_pii_key"), "_pii_map")
    both = touched.join(maps, touched.doc_id.eqNullSafe(F.col("_pii_doc")) & (touched._pii_text == F.col("_pii_key")), "left")
    between = F.split(F.col("text"), ENTITY, -1)
    # behind the last stretch nothing was found; what was found and is not in the map stays
    whole = F.zip_with(between, F.col("_pii_found"), lambda a, e: F.concat(a, F.coalesce(F.element_at(F.col("_pii_map"), e), e, F.lit(""))))
    many = F.size(F.filter("_pii_found", lambda e: F.element_at(F.col("_pii_map"), e).isNotNull()))
    new = both.withColumn("text", F.array_join(whole, "")).select(*docs.columns, many.cast("long").alias("_pii_entities"))
    none = F.lit(0).cast("long").alias("_pii_entities")
    untouched = docs.where(~hinted).select("*", none).unionByName(searched.where(F.size("_pii_found") == 0).select(*docs.columns, none))
    return untouched.unionByName(new)


#: Key of the digests; a deployment passes its own.
KEY = "diurna"


def op7_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every text of `documents` with surrogates for what it holds of personal data."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replace(docs, KEY).select("doc_id", "text", F.col("_pii_entities").alias("n_entities"))
