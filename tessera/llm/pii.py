"""Surrogates for personal data, in SQL functions throughout.

Entities (e-mail and IP addresses, phone, card, account and social security numbers, access
keys, secrets, titled names) are found by one pattern.  Each gets a replacement made from a
keyed hash of its type and normal form, so the same entity has the same replacement in every
text and however it is written.  Replacements keep type and format: digits stay digits (in
their punctuation), letters keep case and script, card numbers keep a valid check digit, IP
addresses stay addresses, account numbers keep valid check digits, names keep title, gender
and script.  Given names and surnames are entities of their own, so "Mr. John Smith" and
"MR. SMITH" share a surname afterwards, too, and a person known as Ms. somewhere has the same given name
as Dr.  A check over all distinct entities draws again wherever two would share a replacement, or one
would be the value of any entity, itself or another, whatever its gender and case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Patterns by type; the first that fits an entity whole names its type.  Fixed values.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{13,19}|(?:\d{4}[ -]){3}\d{4})(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])",
    "key": r"(?<![\p{L}\d])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})(?![\p{L}\d])",
    "secret": r"(?i:password|passwd|secret|token|api_key)(?:\s{0,3}[=:]\s{0,3}[\"']?|\s{1,3}[\"'])[A-Za-z0-9+/_-]{8,}",
    "name": r"(?<!\p{L})(?i:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? (?:(?:\p{Lu}\.|\p{Lu}\p{L}*(?:['’-]\p{L}+)*) ){0,2}\p{Lu}\p{L}*(?:['’-]\p{L}+)*",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no entity; most texts stop here.
HINT = r"[0-9@]|(?i:password|passwd|secret|token|api_key|mr|ms|miss|dr|herr|frau|monsieur|madame|señor)"
#: Front parts of entities that stay as they are.
LEAD = {"key": r"^(AKIA|ASIA|gh._|sk-)", "secret": r"^([^=:\"']*(?:[=:]\s*[\"']?|[\"']))", "name": r"^((?i:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? )", "phone": r"^(\+\d{1,3}[ .-])"}

#: Given names by script and gender (n: the title doesn't tell), and syllables of surnames.
NAMES = {
    "latin": {
        "f": ["Ada", "Clara", "Edith", "Flora", "Greta", "Helena", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Selma", "Vera"],
        "m": ["Anton", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Oscar", "Paul", "Viktor"],
        "n": ["Alex", "Andrea", "Chris", "Dominique", "Jo", "Kim", "Mika", "Robin", "Sam", "Sascha", "Toni", "Yuki"],
    },
    "cyrillic": {"f": ["Вера", "Нина", "Ольга", "Раиса", "Тамара", "Юлия"], "m": ["Антон", "Борис", "Глеб", "Игорь", "Олег", "Павел"], "n": ["Женя", "Саша", "Валя", "Слава"]},
    "greek": {"f": ["Άννα", "Ελένη", "Μαρία", "Σοφία"], "m": ["Νίκος", "Πέτρος", "Στέφανος", "Χρήστος"], "n": ["Άρης", "Φώτης", "Χρύσα", "Ήρα"]},
}
SYLLABLES = {
    "latin": ["al", "ber", "cor", "dan", "el", "fen", "gor", "hal", "in", "kel", "lor", "mar", "nes", "or", "ren", "sol"],
    "cyrillic": ["бел", "вор", "гор", "дан", "зим", "кол", "лес", "мар", "нов", "орл", "пет", "рен", "сол", "тар", "фед", "яр"],
    "greek": ["αλ", "βασ", "γιο", "δημ", "ελ", "καλ", "λαμ", "μαρ", "νικ", "παπ", "ραλ", "σαμ", "τσα", "φιλ", "χατ", "ωρ"],
}
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäçèéêëíîïñòóôõöùúûü", "ÀÁÂÃÄÇÈÉÊËÍÎÏÑÒÓÔÕÖÙÚÛÜ", "абвгдежзийклмнопрстуфхцчшщыэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]

#: Draws after which a replacement is lengthened, should its format have too few values.
LENGTHEN = 8


def type_of(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(F.regexp_replace(entity, f"^(?:{pattern})$", "") == "", name).otherwise(out)
    return out


def lead_of(kind: Column, entity: Column) -> Column:
    """The part of an entity that stays in front."""
    out = F.lit("")
    for name, pattern in LEAD.items():
        out = F.when(kind == name, F.regexp_extract(entity, pattern, 1)).otherwise(out)
    return out


def normal(kind: Column, entity: Column) -> Column:
    """What is the same however an entity is written: digits alone, or letters in lower case (of names, too)."""
    rest = F.substring(entity, F.length(lead_of(kind, entity)) + 1, F.length(entity))
    digits = F.regexp_replace(rest, r"\D+", "")  # of a phone number, without its country
    return F.when(kind.isin("ssn", "card", "phone"), digits).when(kind == "iban", F.replace(rest, F.lit(" "))).when(kind.isin("email", "name"), F.lower(rest)).otherwise(rest)


def _byte(stream: Column, i) -> Column:
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _like(text: Column, stream: Column, hexadecimal: Column) -> Column:
    """Every letter and digit replaced by another of its alphabet, as the stream says."""

    def one(c: Column, i: Column) -> Column:
        v = _byte(stream, i)
        out = c
        for letters in reversed(ALPHABETS):
            n = len(letters)
            if letters.startswith("abc"):
                n = F.when(hexadecimal, 6).otherwise(n)
            out = F.when(F.instr(F.lit(letters), c) > 0, F.substring(F.lit(letters), (v % n) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _mod97(text: Column) -> Column:
    """An account number's digits (letters: 10 to 35) modulo 97."""
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda a, c: ((a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("long")
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), step)


def _script(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.rlike(text, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def _luhn(digits: Column) -> Column:
    """The check digit that a number's other digits ask for."""
    places = F.reverse(F.split(digits, ""))
    weight = lambda d, i: F.when(i % 2 == 0, (2 * d) % 10 + F.floor(2 * d / 10)).otherwise(d)
    sums = F.transform(places, lambda c, i: weight(c.cast("long"), i).cast("long"))
    return ((10 - F.aggregate(sums, F.lit(0).cast("long"), lambda a, x: a + x) % 10) % 10).cast("string")


def surrogate(kind: Column, norm: Column, attempt: Column, gender: Column, key: str) -> Column:
    """The replacement of a normal form, in normal form."""
    seed = F.concat_ws("|", F.lit(key), attempt.cast("string"), kind, norm)
    stream = F.concat(F.sha2(F.concat(F.lit("0|"), seed), 256), F.sha2(F.concat(F.lit("1|"), seed), 256))
    hexadecimal = (kind == "secret") & F.rlike(norm, F.lit("^[0-9a-f]+$"))
    plain = _like(norm, stream, hexadecimal)
    body = F.substring(plain, F.lit(1), F.length(plain) - 1)
    valid = F.substring(norm, F.length(norm), F.lit(1)) == _luhn(F.substring(norm, F.lit(1), F.length(norm) - 1))
    card = F.when(valid, F.concat(body, _luhn(body))).otherwise(plain)
    octets = F.array_join(F.array(*[(_byte(stream, F.lit(k)) % 223 + 1).cast("string") for k in range(4)]), ".")
    # The last part of a domain stays.
    ends = F.regexp_extract(norm, r"(\.[^.@]+)$", 1)
    mail = F.concat(_like(F.substring(norm, F.lit(1), F.length(norm) - F.length(ends)), stream, F.lit(False)), ends)
    pick = lambda names, at: F.element_at(F.array(*[F.lit(x) for x in names]), _byte(stream, F.lit(at)) % len(names) + 1)
    script = _script(norm)
    by_script = lambda make: F.when(script == "cyrillic", make("cyrillic")).when(script == "greek", make("greek")).otherwise(make("latin"))
    # Drawn again: another name with a syllable more, then two, and so on.
    more_of = lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda k: F.when(attempt > 0, F.element_at(F.array(*[F.lit(y) for y in SYLLABLES[x]]), _byte(stream, k + 7) % len(SYLLABLES[x]) + 1)).otherwise("")), "")
    one = lambda x, at: F.when(gender == "f", pick(NAMES[x]["f"], at)).when(gender == "m", pick(NAMES[x]["m"], at)).otherwise(pick(NAMES[x]["n"], at))
    hyphen, mark = F.instr(norm, "-") > 0, F.regexp_extract(norm, "['’]", 0)
    short = lambda x: F.initcap(F.concat(pick(SYLLABLES[x], 21), pick(SYLLABLES[x], 22)))
    given = by_script(lambda x: F.concat(one(x, 0), more_of(x), F.when(hyphen, F.concat(F.lit("-"), short(x))).otherwise("")))
    long = lambda x: F.initcap(F.concat(*[pick(SYLLABLES[x], k) for k in range(1, 5)], more_of(x)))
    front = lambda x: F.when(mark != "", F.concat(F.upper(F.substring(pick(SYLLABLES[x], 23), F.lit(1), F.lit(1))), mark)).otherwise("")
    surname = by_script(lambda x: F.concat(front(x), long(x), F.when(hyphen, F.concat(F.lit("-"), short(x))).otherwise("")))
    bban = _like(F.substring(norm, F.lit(5), F.length(norm)), stream, F.lit(False))
    country = F.substring(norm, F.lit(1), F.lit(2))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0"), bban)
    out = F.when(kind == "card", card).when(kind == "ip", octets).when(kind == "email", mail).when(kind == "name", surname).when(kind == "given", given).when(kind == "iban", iban).otherwise(plain)
    more = F.substring(stream, F.lit(97), 4 + attempt)
    return F.when((attempt < LENGTHEN) | kind.isin("ip", "iban", "name", "given"), out).when(kind == "email", F.concat(more, out)).otherwise(F.concat(out, F.when(kind.isin("ssn", "card", "phone"), F.translate(more, "abcdef", "012345")).otherwise(more)))


def written_as(kind: Column, entity: Column, value: Column) -> Column:
    """A replacement in the writing of the entity that it stands for."""
    digits = F.split(value, "")
    lead = lead_of(kind, entity)
    parts = F.split(F.substring(entity, F.length(lead) + 1, F.length(entity)), r"\d", -1)
    n = F.size(parts) - 1
    extra = F.array_join(F.slice(digits, n + 1, F.greatest(F.lit(0), F.size(digits) - n)), "")
    punctuated = F.concat(lead, F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < n, F.coalesce(F.get(digits, i), F.lit(""))).otherwise(F.lit("")))), ""), extra)
    upper = (F.upper(entity) == entity) & (F.lower(entity) != entity)
    spaced = F.when(F.instr(entity, " ") > 0, F.btrim(F.regexp_replace(F.concat(lead, value), "(.{4})", "$1 "))).otherwise(F.concat(lead, value))
    out = F.concat(lead, value)
    return F.when(kind.isin("ssn", "card", "phone"), punctuated).when(kind == "iban", spaced).when((kind == "email") & upper, F.upper(value)).otherwise(out)


def entities(docs: DataFrame) -> DataFrame:
    """(doc_id, h, place, part, entity, kind, norm, gender, full, word) of every entity; h is the text's
    hash.  A name has a row a word: its last word is the surname (kind 'name'), those before it are
    given names (kind 'given'); ``word`` is a name's word as it stands there, ``full`` all its words' normal form."""
    found = F.when(F.rlike(F.col("text"), F.lit(HINT)), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(found).alias("place", "entity"))
    rows = rows.withColumn("kind", type_of(F.col("entity")))
    # Between "12" and "3" in other text an entity may fit no type alone (its surroundings did): then by its looks.
    rows = rows.withColumn("kind", F.coalesce("kind", F.when(F.instr("entity", "@") > 0, "email").otherwise("phone")))
    of = lambda titles: F.rlike(F.col("entity"), F.lit(f"^(?i:{titles})\\.? "))
    gender = F.when(of("Mrs|Ms|Miss|Frau|Madame|Señora"), "f").when(of("Mr|Herr|Monsieur|Señor"), "m").otherwise("n")
    name = F.col("kind") == "name"
    rows = rows.withColumn("full", normal(F.col("kind"), F.col("entity"))).withColumn("gender", F.when(name, gender).otherwise("n"))
    plain = F.substring("entity", F.length(lead_of(F.col("kind"), F.col("entity"))) + 1, F.length("entity"))
    rows = rows.withColumn("words", F.when(name, F.split(plain, " ")).otherwise(F.array(F.lit(None).cast("string"))))
    rows = rows.select("*", F.posexplode("words").alias("part", "word"))
    last = F.col("part") == F.size("words") - 1
    kind = F.when(name & ~last, "given").otherwise(F.col("kind"))
    norm = F.when(name, F.lower("word")).otherwise(F.col("full"))
    return rows.select("doc_id", "h", "place", "part", "entity", kind.alias("kind"), norm.alias("norm"), "gender", F.when(name, F.col("full")).alias("full"), "word")


def with_known_gender(spark: SparkSession, found: DataFrame) -> DataFrame:
    """Given names take the gender that any title of the same full name tells, and their normal form has it: Dr. Kim and
    Mr. Kim may be two persons, Dr. Kim Berg and Ms. Kim Berg are one.  Where titles tell both, each keeps its own."""
    told = found.where("kind = 'given' and gender != 'n'").groupBy("full").agg(F.min("gender").alias("told"))
    known = found.join(common.small_side(common.written(spark, told, "pii-genders")), "full", "left")
    gender = F.when((F.col("kind") == "given") & (F.col("gender") == "n"), F.coalesce("told", "gender")).otherwise(F.col("gender"))
    known = known.withColumn("gender", gender).withColumn("norm", F.when(F.col("kind") == "given", F.concat_ws(" ", "norm", "gender")).otherwise(F.col("norm")))
    return known.drop("told", "full")


def surrogates(spark: SparkSession, found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, value, own): one replacement for each distinct entity; none shared, and none
    that is another entity's own value.  Later ones (by normal form) draw again."""
    bare = lambda c: F.when(F.col("kind") == "given", F.substring_index(c, " ", 1)).otherwise(F.col(c))
    now = found.groupBy("kind", "norm").agg(F.min("gender").alias("gender"), F.count("*").alias("own"))
    now = common.written(spark, now.withColumn("attempt", F.lit(0)).withColumn("value", surrogate(F.col("kind"), F.col("norm"), F.lit(0), F.col("gender"), key)), "pii-values")
    while True:
        shared = now.groupBy("kind", "value").agg(F.count("*").alias("times"), F.min("norm").alias("first")).where("times > 1")
        parts = lambda c: F.when(F.col("kind").isin("name", "given"), F.array_union(F.array(c), F.split(c, "[-'’]"))).otherwise(F.array(c))
        real = now.select("kind", F.explode(parts(bare("norm"))).alias("plain"), F.lit(True).alias("real")).distinct()
        # of a double name, its first part is looked up; what follows is made of syllables
        judged = now.withColumn("plain", F.when(F.col("kind").isin("name", "given"), F.regexp_replace(F.lower("value"), "^.['’]|-.*$", "")).otherwise(F.col("value")))
        judged = judged.join(shared, ["kind", "value"], "left").join(real, ["kind", "plain"], "left")
        again = F.coalesce(F.col("first") != F.col("norm"), F.lit(False)) | F.coalesce("real", F.lit(False))
        judged = common.written(spark, judged.select("kind", "norm", "gender", "own", "attempt", "value", again.alias("again")), "pii-judged")
        if judged.where("again").isEmpty():
            return judged.select("kind", "norm", "value", "own")
        attempt = F.col("attempt") + F.col("again").cast("int")
        value = F.when(F.col("again"), surrogate(F.col("kind"), F.col("norm"), attempt, F.col("gender"), key)).otherwise(F.col("value"))
        now = common.written(spark, judged.select("kind", "norm", "gender", "own", attempt.alias("attempt"), value.alias("value")), "pii-values")


def pseudonymised(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities replaced, and n_entities.

    Null text: stays null, no entities.  Rows of equal doc_id and text (and null ids) are
    treated alike.  Columns are those of ``docs`` and n_entities (which replaces one of that name)."""
    found = common.written(spark, entities(docs.select("doc_id", "text")).distinct(), "pii-entities")
    found = common.written(spark, with_known_gender(spark, found), "pii-parts")
    values = surrogates(spark, found.select("kind", "norm", "gender"), key)
    each = common.spread_join(found.withColumn("id", F.struct("kind", "norm")), values.select(F.struct("kind", "norm").alias("id"), "value", "own"), "id", "own")
    word = F.col("word")
    upper = (F.length("word") > 1) & (F.upper(word) == word) & (F.lower(word) != word)
    value = F.when(upper, F.upper("value")).otherwise(F.col("value"))
    each = each.groupBy("doc_id", "h", "place").agg(
        F.first("entity").alias("entity"), F.max_by("kind", "part").alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", value.alias("value")))), lambda x: x["value"]), " ").alias("value")
    )  # one entity's words
    each = each.select("doc_id", "h", "place", written_as(F.col("kind"), F.col("entity"), F.col("value")).alias("new"))
    own = each.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_list(F.struct("place", "new"))).alias("_new"))  # one text's entities
    own = common.written(spark, own.select("_id", "_h", F.transform("_new", lambda x: x["new"]).alias("_new")), "pii-new")
    out = common.boxed(docs, "doc_id", "text").join(own.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left")
    parts = F.split("text", ENTITY, -1)
    text = F.array_join(F.zip_with(parts, F.array_append("_new", F.lit("")), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    found_n = F.when(F.col("_new").isNull(), 0).otherwise(F.size("_new"))
    out = out.withColumn("n", found_n).withColumn("text", F.when(F.col("_new").isNull(), F.col("text")).otherwise(text))
    columns = [c for c in docs.columns if c != "n_entities"]
    return out.select(*[F.col(c) if c in ("doc_id", "text") else F.col("box").getField(c).alias(c) for c in columns], F.col("n").alias("n_entities"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str, key: str = "tessera") -> DataFrame:
    """All ``documents`` with surrogates in place of personal data: doc_id, text, n_entities.

    Null text: null, 0.  A text without entities: unchanged.  Null doc_id and repeated rows:
    each has its row, equal rows the same result.  Empty table: no rows.  Other columns: ignored."""
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(spark, docs, key)
