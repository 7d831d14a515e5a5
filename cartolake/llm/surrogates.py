"""Personal data and secrets replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolake.functions.text import let
from cartolake.llm.common import materialize, small_side, text_class

KEY = "surrogate-key"
# What counts as an entity, most specific first.  A kind's number is its place here.
TITLES_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|Г-жа|Госпожа"
TITLES_NEUTRAL = "Dr|Prof|Professor|Doctor|Doktor|Docteur|Доктор|Профессор"
TITLES_MALE = "Mr|Herr|Monsieur|Señor|Sr|Signor|Г-н|Господин"
IP = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
LOCAL_PHONES = (r"\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?!\w)", r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])")
GROUPED_CARD = "|".join(rf"(?:[0-9]{{4}}(?:{s}[0-9]{{4}}){{2}}{s}[0-9]{{1,4}}|[0-9]{{4}}{s}[0-9]{{6}}{s}[0-9]{{5}})(?!{s}?[0-9])" for s in " -")
# Digits after the country code, least and most, of numbering plans; by E.164 a number has 15 at most with its code.
NATIONAL = {
    (8, 8): "45 47 65 852", (8, 9): "32 36 51 66 886 971 972", (8, 10): "20 60 63 64 82 234", (8, 12): "62",
    (9, 9): "27 31 33 34 40 41 48 56 61 212 254 351 380 420 421 966", (9, 10): "44 81 84 92", (6, 11): "39 49",
    (7, 9): "353", (7, 10): "46", (10, 10): "1 7 30 52 57 90 91 98", (10, 11): "54 55 86",
}
COUNTRY = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"


def _international() -> str:
    """Phones with a country code: as long as its plan says, else 5 to 15 digits.

    Where the length is open, no group after the first begins another entity.
    """
    others = "|".join((IP, SSN, GROUPED_CARD, *LOCAL_PHONES))
    first = r"[ .-]?\(?[0-9]{2}\)?"
    digits = lambda least, most: rf"(?:(?:[ .-](?=\(?[0-9]{{2}}){f'(?!{others})' if least < most else ''})?\(?[0-9]\)?){{{least},{most}}}(?!\w)"
    plans = [f"(?:{codes.replace(' ', '|')}){first}{digits(least - 2, most - 2)}" for (least, most), codes in NATIONAL.items()]
    plans += [f"[0-9]{{{n}}}{first}{digits(2, 13 - n)}" for n in (3, 2, 1)]
    return rf"(?<![\w+])\+(?:{'|'.join(plans)})"


PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-][A-Za-z0-9.-]*(?<=[A-Za-z0-9-])\.[A-Za-z]{2,}",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "secret": r"\b(?i:password|passwd|pwd|token|secret|api[_-]?key) {0,2}[=:] {0,2}[\"']?[A-Za-z0-9_+/-]{8,}",
    "ip": rf"(?<![\w.]){IP}",
    "ssn": rf"(?<![\w-]){SSN}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w+.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])",
    "phone": rf"{_international()}|(?<!\w){LOCAL_PHONES[0]}|(?<![\w.-]){LOCAL_PHONES[1]}",
    "name": rf"\b(?:{TITLES_FEMALE}|{TITLES_MALE}|{TITLES_NEUTRAL})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
SECRET_LABEL = r"^((?i:password|passwd|pwd|token|secret|api[_-]?key) {0,2}[=:] {0,2}[\"']?)"
TITLE = rf"^((?:{TITLES_FEMALE}|{TITLES_MALE}|{TITLES_NEUTRAL})\.? )"
# Syllables of invented names.
LATIN = "ba be bo da de do fa fe ga ge ha he ja jo ka ke la le lo ma me mi na ne no pa pe ra re ro sa se ta te to va ve wa za"
CYRILLIC = "ба бе бо ва ве га да де до жа за зе ка ко ла ле ма ме ми на не но па пе ра ре ро са се та те то фа ха ша"
ENDINGS = {"female": ("lia", "лия"), "male": ("ron", "рон"), "given": ("nor", "нор"), "surname": ("mer", "мер")}
# From this attempt on, addresses and national ids come from all of their kind's numbers, not only from ranges nobody has.
WIDE_FROM = 6
# From this attempt on, a surrogate is longer than its kind allows: what is left has found no free one.
LONG_FROM = 24


def _byte(stream: Column, i: Column) -> Column:
    """A number from 0 to 255: the i-th of 64 that a digest holds, in turn."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(64)).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _nth(text: str, i: Column) -> Column:
    return F.substring(F.lit(text), F.pmod(i, F.lit(len(text))) + 1, F.lit(1))


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _mapped(value: Column, stream: Column, keep: Column) -> Column:
    """``value`` with each letter or digit after the first ``keep`` characters replaced by another of its class."""
    def other(hexadecimal: bool):
        def one(c: Column, i: Column) -> Column:
            b = _byte(stream, i)
            small = F.when(c.rlike("[a-z]"), _nth("abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz", b))
            return (
                F.when(i < keep, c)
                .when(c.rlike("[0-9]"), F.pmod(c.cast("int") + 1 + F.pmod(b, F.lit(9)), F.lit(10)).cast("string"))
                .otherwise(F.coalesce(small, F.when(c.rlike("[A-Z]"), _nth("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)), c)))

        return one

    # Asked once for the whole value, not for each of its characters.
    return F.array_join(F.when(value.rlike("^[0-9a-f]+$"), F.transform(_chars(value), other(True))).otherwise(
        F.transform(_chars(value), other(False))), "")


def _luhn(digits: Column) -> Column:
    """The checksum of a card number: 0 if it is valid."""
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.pmod(F.aggregate(values, F.lit(0), lambda a, v: a + v), F.lit(10))


def _modulo_97(text: Column) -> Column:
    """The remainder by 97 of digits and capital letters, a letter being a number from 10 on."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("long")).otherwise(F.ascii(F.upper(c)).cast("long") - 55)
    return F.aggregate(_chars(text), F.lit(0).cast("long"), lambda a, c: F.pmod(
        a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97).cast("long")))


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The normal form of the replacement of an entity in its normal form."""
    stream = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string")), 512)
    return let(stream, lambda drawn: _made(kind, norm, attempt, drawn))


def _made(kind: Column, norm: Column, attempt: Column, stream: Column) -> Column:
    syllable = lambda words, n: F.element_at(F.split(F.lit(words), " "), F.pmod(
        _byte(stream, F.lit(n)) * 256 + _byte(stream, F.lit(n + 1)), F.lit(len(words.split()))) + 1)

    def name(words: str, ending: int) -> Column:
        end = reduce(lambda c, e: c.when(kind.endswith(e[0]), e[1][ending]), ENDINGS.items(), F.when(F.lit(False), ""))
        # Longer with every second attempt: there is no last name.
        more = [F.when(attempt > 2 * i + 1, syllable(words, 4 + 2 * i)).otherwise("") for i in range(14)]
        return F.concat(syllable(words, 0), syllable(words, 2), *more, end)

    digits = _mapped(norm, stream, F.when(
        kind == "phone", F.when(F.length(norm) > 10, F.length(F.regexp_extract(norm, f"^({COUNTRY})", 1))).otherwise(0))
                     .when(kind == "card", 1).when(kind == "iban", 2).when(kind == "key", 4).otherwise(0))
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    # The last digit that makes the checksum that of the original.
    check = F.pmod(_luhn(norm) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    # The top-level domain stays.
    domain = F.regexp_extract(norm, r"(\.[a-z]{2,})$", 1)
    mail = F.concat(_mapped(F.substring(norm, F.lit(1), F.length(norm) - F.length(domain)), stream, F.lit(0)), domain)
    wide = attempt >= WIDE_FROM
    block = F.when(wide, (F.pmod(_byte(stream, F.lit(3)), F.lit(223)) + 1).cast("string")).otherwise("10")
    # What makes the number of an account, its country and check digits at the end, leave what the original leaves.
    account = F.substring(digits, F.lit(5), F.length(digits))
    country = F.substring(norm, 1, 2)
    owed = F.pmod(_modulo_97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4)))
                  - _modulo_97(F.concat(account, country, F.lit("00"))), F.lit(97))
    iban = F.concat(country, F.lpad(F.when(owed < 2, owed + 97).otherwise(owed).cast("string"), 2, "0"), account)
    made = (
        F.when(kind == "email", mail)
        .when(kind == "iban", iban)
        .when(kind == "ip", F.concat_ws(".", block, *(_byte(stream, F.lit(i)).cast("string") for i in (0, 1)),
                                        (F.pmod(_byte(stream, F.lit(2)), F.lit(254)) + 1).cast("string")))
        .when(kind == "ssn", F.when(wide, digits).otherwise(F.concat(F.lit("9"), F.substring(digits, 2, 8))))
        .when(kind == "card", F.concat(body, check))
        .when(kind.startswith("name"), F.when(norm.rlike(r"\p{IsCyrillic}"), name(CYRILLIC, 1)).otherwise(name(LATIN, 0)))
        .otherwise(digits))
    longer = F.concat(made, F.when(kind == "ip", ".").otherwise(""), F.conv(F.substring(stream, 1, 12), 16, 10))
    return F.when(attempt < LONG_FROM, made).otherwise(longer)


def _normal(kind: Column, value: Column) -> Column:
    """What mentions of one entity have in common."""
    return (
        # A North American number is the same with and without its country code.
        F.when(kind == "phone", F.regexp_replace(F.regexp_replace(value, "[^0-9]", ""), "^1([0-9]{10})$", "$1"))
        .when(kind.isin("card", "ssn"), F.regexp_replace(value, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(value, " ", "")).when(kind.isin("secret", "key"), value).otherwise(F.lower(value)))


def _rendered(kind: Column, value: Column, norm: Column, new: Column) -> Column:
    """A surrogate written the way its mention was: with the same separators and letter case."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    new = F.when((kind == "phone") & (digits == 11) & (F.length(norm) == 10), F.concat(F.lit("1"), new)).otherwise(new)
    spaced = F.aggregate(_chars(value), start, lambda a, c: F.when(c.rlike("[0-9A-Za-z]"), F.struct(
        F.concat(a["out"], F.substring(new, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(
        F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))), lambda a: a["out"])
    cased = F.when(value == F.lower(value), new).when((value == F.upper(value)) & (F.length(value) > 1), F.upper(new)).when(
        kind.startswith("name"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 200))).otherwise(
        F.array_join(F.zip_with(_chars(value), _chars(new), lambda o, n: F.when(
            o.rlike("[A-Z]"), F.upper(n)).otherwise(n)), ""))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spaced).when(kind.isin("secret", "key", "ip"), new).otherwise(cased)


def _parts(match: Column) -> Column:
    """The parts of a match: (kind, text) in order; kind is null for what stays."""
    part = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    stays = lambda text: part(F.lit(None).cast("string"), text)
    kind = reduce(lambda c, p: c.when(match.rlike(f"^(?:{p[1]})$"), F.lit(p[0])), [
        (k, v) for k, v in PATTERNS.items() if k not in ("secret", "name")], F.when(F.lit(False), F.lit("")))
    label, title = F.regexp_extract(match, SECRET_LABEL, 1), F.regexp_extract(match, TITLE, 1)
    after = lambda head: F.substring(match, F.length(head) + 1, F.length(match))
    gender = F.when(title.rlike(rf"^(?:{TITLES_FEMALE})\b"), "name-female").when(
        title.rlike(rf"^(?:{TITLES_MALE})\b"), "name-male").otherwise("name-given")
    names = F.split(after(title), " ")
    two = F.array(stays(title), part(gender, names[0]), stays(F.lit(" ")), part(F.lit("name-surname"), F.get(names, F.lit(1))))
    return (
        F.when(label != "", F.array(stays(label), part(F.lit("secret"), after(label))))
        .when(title != "", F.when(F.size(names) > 1, two).otherwise(
            F.array(stays(title), part(F.lit("name-surname"), names[0]))))
        # A match that its own pattern alone does not find stands at a place the pattern asks for.
        .otherwise(F.array(part(F.coalesce(kind, F.lit("other")), match))))


def replacements(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, new): surrogates that are distinct within a kind and are no entity of the input.

    An entity whose surrogate is taken, or is itself in the input, tries the next
    one; of several with the same surrogate the smallest keeps it.  Names grow and
    numbers come from wider ranges with the attempts; in the end a surrogate is longer
    than its kind allows, so that every entity gets one.
    """
    have = materialize(entities.select("kind", "norm").distinct(), "entities")
    accepted, pending = None, have.withColumn("attempt", F.lit(0))
    while True:
        tried = materialize(pending.withColumn("new", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)), "tried")
        taken = have.select("kind", F.col("norm").alias("new"))
        if accepted is not None:
            taken = taken.unionByName(accepted.select("kind", "new"))
        first = tried.join(taken, ["kind", "new"], "left_anti").groupBy("kind", "new").agg(F.min("norm").alias("norm"))
        good = materialize(first.select("kind", "norm", "new"), "surrogates")
        accepted = good if accepted is None else accepted.unionByName(good)
        pending = materialize(tried.join(good, ["kind", "norm"], "left_anti").select(
            "kind", "norm", (F.col("attempt") + 1).alias("attempt")), "pending")
        if not pending.take(1):
            return accepted


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates for the entities in ``text``, and ``n_entities``.

    The same entity gets the same surrogate in all documents, however it is
    written; different entities get different ones, and none is an entity of the
    input.  Surrogates keep the kind: separators, letter case, character classes,
    card prefixes, checksums of cards and accounts, country codes, top-level domains, and the gender
    and script of names; they depend on ``key``.  Names are found directly after a
    listed title only: the same name without a title stays as it is.

    Null and empty texts stay and have 0 entities; equal texts stay equal; repeated rows are kept.
    An empty table gives no rows.  Other columns pass through; an ``n_entities``
    column of the input is replaced.
    """
    found = docs.select(text_class(F.col("text")).alias("cls"), F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1)).alias(
        "found")).filter(F.size("found") > 0)
    # One row per distinct text; equal texts hold equal lists.
    texts = materialize(found.groupBy("cls").agg(F.first("found").alias("found")), "mentions")
    mentions = texts.select("cls", F.posexplode("found").alias("place", "match")).withColumn(
        "part", F.explode(F.transform(_parts(F.col("match")), lambda p, i: F.struct(
            i.alias("i"), p["kind"].alias("kind"), p["text"].alias("text")))))
    mentions = mentions.select("cls", "place", F.col("part.i").alias("i"), F.col("part.kind").alias("kind"),
                               F.col("part.text").alias("value"))
    mentions = materialize(mentions.withColumn("norm", _normal(F.col("kind"), F.col("value"))), "parts")
    chosen = replacements(mentions.filter("kind is not null"), key)
    kind, value = F.col("kind"), F.col("value")
    written = mentions.join(chosen, ["kind", "norm"], "left").select("cls", F.struct("place", "i", F.when(
        kind.isNull(), value).otherwise(_rendered(kind, value, F.col("norm"), F.col("new"))).alias("out")).alias("o"))
    # The parts of each match in order, then the matches in order.
    matches = written.groupBy("cls", F.col("o.place").alias("place")).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list("o")), lambda o: o["out"]), "").alias("out"))
    rewritten = materialize(matches.groupBy("cls").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "out"))), lambda o: o[
        "out"]).alias("__new")).withColumnRenamed("cls", "__cls"), "rewritten")
    side = small_side(rewritten, F.lit(64) + F.size("__new") * 48)
    joined = docs.withColumn("__own", text_class(F.col("text"))).join(side, F.col("__own") == F.col("__cls"), "left")
    between = F.split("text", ANY, -1)
    new = F.array_join(F.flatten(F.zip_with(between, F.concat("__new", F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return (
        joined.withColumn("text", F.when(F.col("__new").isNotNull(), new).otherwise(F.col("text")))
        .withColumn("n_entities", F.coalesce(F.size("__new"), F.lit(0)).cast("long")).drop("__new", "__cls", "__own")
    )
