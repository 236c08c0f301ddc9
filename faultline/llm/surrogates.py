"""Personal data replaced by keyed surrogates (DataFrame functions only).

Every detected entity gets a replacement of its own type that a key, the type
and the entity's canonical form determine: equal entities get equal surrogates
in every document, whatever their spelling.  Names keep gender and script,
e-mail addresses, numbers and secrets their format; a card number that passes
the Luhn check still does.  Surrogates are compared with one another and with
all entities of the tables: of those that meet, all but one are drawn again,
until different entities have different surrogates and none is a real entity.
Draws that keep failing come from a wider space, so a free one is always found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Scratch, small

#: Honorifics and common given names by gender.
MALE_TITLES = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин", "Господин"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Signora", "г-жа", "госпожа", "Госпожа"]
OTHER_TITLES = ["Dr", "Prof", "Professor"]
MALE_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Mark Andrew "
    "Hans Klaus Jürgen Wolfgang Pierre Jean Jacques François Carlos José Juan Miguel Luis Antonio "
    "Иван Александр Сергей Дмитрий Алексей Михаил Николай Владимир"
).split()
FEMALE_NAMES = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Emily Emma Olivia Anna "
    "Ursula Monika Petra Sabine Marie Sophie Camille Isabelle Carmen Ana Maria María Lucía Elena "
    "Ольга Татьяна Наталья Екатерина Мария Светлана Ирина Анна"
).split()
SECRET_WORDS = ["password", "passwd", "pwd", "passphrase", "secret", "secret_key", "access_token", "auth_token", "token", "api_key", "api-key", "apikey"]

_B, _A = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_WORD = r"\p{Lu}[\p{L}'’-]*+"
_TITLES = "(?:" + "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES) + ")"
_GIVEN = "(?:" + "|".join(MALE_NAMES + FEMALE_NAMES) + ")"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.){1,8}\p{L}{2,24}"
SECRET = _B + r"(?=[PpSsTtAa])(?i:" + "|".join(SECRET_WORDS) + r")\"?'?[ ]?[=:][ ]?[\"']?[^\s\"',;<>]{4,}+"
AWS = _B + r"(?:AKIA|ASIA)[0-9A-Z]{12,20}" + _A
IPV6 = r"(?<![\p{L}\p{N}_:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}_:])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = r"(?<![\p{L}\p{N}_.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![\p{L}\p{N}_]|\.\d)"
CARD = r"(?<![\p{L}\p{N}_.])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}_]|[.-]\d)"
SSN = r"(?<![\p{L}\p{N}_-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}_-])"
IBAN = _B + r"[A-Z]{2}\d{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?" + _A
PHONE = (
    r"(?<![\p{L}\p{N}_.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\p{L}\p{N}_]|[.-]\d)"
    r"|(?<![\p{L}\p{N}_.+-])\+\d{8,15}(?![\p{L}\p{N}_])"
)
PERSON = (
    _B + r"(?=[\p{Lu}г])(?:" + _TITLES + r"\.?[ ]" + _WORD + r"(?:[ ]" + _WORD + r"){0,2}|" + _GIVEN + r"[ ]" + _WORD + r")"
)
#: No entity starts within a word, so most places are left after one look back.
ALL = _B + "(?:" + "|".join([EMAIL, SECRET, AWS, IPV6, IPV4, CARD, SSN, IBAN, PHONE, PERSON]) + ")"

#: Attempts after which local parts of e-mail addresses and secrets get longer, by a letter an attempt, and after which
#: numbers of a fixed length get letters in the places of digits, addresses all their digits.
LONGER, LETTERS = 4, 8

_HEX, _CONSONANTS = "0123456789abcdef", "bcdfghjklmnpqrst"
_LATIN = (["b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "br", "st"], ["a", "e", "i", "o"])
_CYRILLIC = (["б", "д", "ф", "г", "х", "к", "л", "м", "н", "п", "р", "с", "т", "в", "бр", "ст"], ["а", "е", "и", "о"])


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _full(e: Column, pattern: str) -> Column:
    return e.rlike("^(?:" + pattern + ")$")


def kind_of(e: Column) -> Column:
    out = F.when(_full(e, SECRET), "secret").when(e.contains("@"), "email")
    for name, pattern in (("aws", AWS), ("ipv6", IPV6), ("ipv4", IPV4), ("card", CARD), ("ssn", SSN), ("iban", IBAN), ("phone", PHONE)):
        out = out.when(_full(e, pattern), name)
    return out.otherwise("person")


def _secret_value(e: Column) -> Column:
    return F.regexp_extract(e, r"(?s)^[^=:]*[=:][ ]?[\"']?(.*)$", 1)


def _canon(kind: Column, e: Column) -> Column:
    """One spelling for all formats of an entity; a phone number is its last ten digits."""
    digits = F.regexp_replace(e, r"[^0-9]", "")
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(e))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.substring(digits, -10, 10))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "secret", _secret_value(e))
        .otherwise(e)
    )


def _title(e: Column) -> Column:
    return F.regexp_extract(e, "^(" + _TITLES + r"\.?[ ])?", 1)


def _name_kinds(e: Column) -> Column:
    """For a person: an array of (kind, token), the title left out."""
    title = F.regexp_replace(_title(e), r"[. ]", "")
    tokens = F.split(F.regexp_replace(e, "^(?:" + _TITLES + r"\.?[ ])", ""), " ")

    def kinds(t: Column) -> Column:
        first = F.element_at(t, 1)
        gender = (
            F.when(title.isin(MALE_TITLES), "m").when(title.isin(FEMALE_TITLES), "f")
            .when(first.isin(MALE_NAMES), "m").when(first.isin(FEMALE_NAMES), "f").otherwise("u")
        )
        return F.transform(
            t,
            lambda x, i: F.struct(
                F.when((i == 0) & (F.size(t) > 1), F.concat(F.lit("given_"), gender)).otherwise("surname").alias("kind"),
                x.alias("token"),
            ),
        )

    return _let(tokens, kinds)


def units(e: Column) -> Column:
    """The (kind, canon) pairs that an entity is made of: one, or one a name of a person."""

    def of(k: Column) -> Column:
        names = F.transform(_name_kinds(e), lambda x: F.struct(x["kind"].alias("kind"), F.lower(x["token"]).alias("canon")))
        return F.when(k == "person", names).otherwise(F.array(F.struct(k.alias("kind"), _canon(k, e).alias("canon"))))

    return _let(kind_of(e), of)


def _at(k: Column, i: Column) -> Column:
    return F.substring(k, F.pmod(i, F.lit(64)) + 1, F.lit(1))


def _chars(s: Column, body) -> Column:
    """Joins body(char, position from 0) over the characters of a non-empty string."""
    return F.array_join(F.transform(F.split(s, ""), body), "")


def _shape(s: Column, k: Column) -> Column:
    """Letters become letters, digits digits, both by the hash k; the rest stays."""

    def one(c: Column, i: Column) -> Column:
        h = _at(k, i)
        return (
            F.when(c.rlike("[0-9]"), F.translate(h, "abcdef", "012345"))
            .when(c.rlike(r"\p{Lu}"), F.upper(F.translate(h, _HEX, _CONSONANTS)))
            .when(c.rlike(r"\p{L}"), F.translate(h, _HEX, _CONSONANTS))
            .otherwise(c)
        )

    return F.when(F.length(s) > 0, _chars(s, one)).otherwise(s)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a number, its last digit taken once."""
    one = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")),
    )
    return F.aggregate(one, F.lit(0), lambda a, x: a + x)


def _name(kind: Column, canon: Column, k: Column, attempt: Column) -> Column:
    """A made-up name: syllables by the hash, an ending by gender, the script of the name it stands for."""

    def syllables(onsets: list[str], vowels: list[str]) -> Column:
        count = 3 + (attempt / 4).cast("int")
        onset, vowel = F.array(*map(F.lit, onsets)), F.array(*map(F.lit, vowels))
        num = lambda i: F.conv(_at(k, i), 16, 10).cast("int")
        one = lambda i: F.concat(F.element_at(onset, num(2 * i) + 1), F.element_at(vowel, num(2 * i + 1) % 4 + 1))
        return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), one), "")

    latin = F.concat(
        syllables(*_LATIN), F.when(kind == "given_f", "na").when(kind == "given_m", "n").when(kind == "surname", "ler").otherwise("l")
    )
    slav = F.when(canon.rlike("а$"), "ова").otherwise("ов")
    cyrillic = F.concat(
        syllables(*_CYRILLIC), F.when(kind == "given_f", "на").when(kind == "given_m", "н").when(kind == "surname", slav).otherwise("л")
    )
    return F.when(canon.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of an entity; ``attempt`` counts its collisions so far."""

    def of(k: Column) -> Column:
        local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
        top = F.regexp_extract(canon, r"\.(com|net|org)$", 0)
        host = F.translate(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256), 1, 12), _HEX, _CONSONANTS)
        # letters that a value gets besides its own; one without letters and digits is made up, as its shape says nothing
        more = F.translate(F.substring(F.reverse(k), F.lit(1), F.greatest(attempt - LONGER + 1, F.lit(0))), _HEX, _CONSONANTS)
        made_up = lambda s: F.translate(F.substring(k, F.lit(1), F.least(F.greatest(F.length(s), F.lit(12)), F.lit(32))), _HEX, _CONSONANTS)
        longer = lambda s: F.concat(F.when(s.rlike(r"[0-9\p{L}]"), _shape(s, k)).otherwise(made_up(s)), more)
        email = F.concat(longer(local), F.lit("@"), host, F.lit(".example"), F.when(top == "", ".com").otherwise(top))
        octet = lambda i: (F.conv(F.substring(k, 2 * i + 1, 2), 16, 10).cast("int") % 254 + 1).cast("string")
        ipv6 = _chars(canon, lambda c, i: F.when(c == ":", c).otherwise(_at(k, i)))
        body = F.concat(F.substring(canon, 1, 1), F.substring(_shape(canon, k), F.lit(2), F.length(canon) - 2))
        check = F.when(_luhn(canon) % 10 == 0, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
        card = F.concat(body, F.coalesce(check, F.translate(F.substring(k, 64, 1), "abcdef", "012345")))
        keep4, rest = F.substring(canon, 1, 4), F.substring(canon, 5, 1 << 20)
        country = F.concat(F.substring(canon, 1, 2), _shape(F.substring(canon, 3, 1 << 20), k))
        lettered = _chars(canon, lambda c, i: F.upper(F.translate(_at(k, i), _HEX, _CONSONANTS)))
        kept = F.when(kind == "aws", 4).when(kind == "iban", 2).otherwise(0)
        group = lambda i: F.substring(k, 4 * i + 1, 4)
        wide, address = attempt >= LETTERS, kind.isin("ipv4", "ipv6")
        return (
            F.when(kind == "email", email)
            .when(wide & address, F.concat(F.lit("2001:db8:"), F.concat_ws(":", *[group(i) for i in range(6)])))
            .when(
                wide & kind.isin("card", "aws", "iban", "phone", "ssn"),
                F.concat(F.substring(canon, F.lit(1), kept), F.substring(lettered, kept + 1, F.length(canon))),
            )
            .when(kind == "ipv4", F.concat_ws(".", *[octet(i) for i in range(4)]))
            .when(kind == "ipv6", ipv6)
            .when(kind == "card", card)
            .when(kind == "aws", F.concat(keep4, _shape(rest, k)))
            .when(kind == "iban", country)
            .when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), F.concat(_chars(canon, lambda c, i: _at(k, i)), more))
            .when(kind == "secret", longer(canon))
            .when(kind.isin("phone", "ssn"), _shape(canon, k))
            .otherwise(_name(kind, canon, k, attempt))
        )

    return _let(F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256), of)


def _refill(e: Column, s: Column, kept: str) -> Column:
    """The characters of s in the places of e that match ``kept``, from the right; further ones stay."""

    def one(c: Column, i: Column) -> Column:
        right = F.length(F.regexp_replace(F.substring(e, i + 1, F.length(e)), "[^" + kept[1:], ""))
        return F.when(c.rlike(kept) & (right <= F.length(s)), F.substring(s, F.length(s) - right + 1, F.lit(1))).otherwise(c)

    return _chars(e, one)


def replaced(e: Column, again: Column, key: str) -> Column:
    """The text that stands for an entity; ``again`` maps kind|canon to attempts above 0 (null: none)."""

    def made(kind: Column, canon: Column) -> Column:
        n = F.coalesce(F.try_element_at(again, F.concat_ws("|", kind, canon)), F.lit(0))
        return surrogate(kind, canon, n, key)

    def name(x: Column) -> Column:
        up = (F.upper(x["token"]) == x["token"]) & (F.length(x["token"]) > 1)
        return _let(made(x["kind"], F.lower(x["token"])), lambda out: F.when(up, F.upper(out)).otherwise(F.initcap(out)))

    def shown(kind: Column, s: Column) -> Column:
        value = _secret_value(e)
        return (
            F.when(kind == "secret", F.concat(F.substring(e, F.lit(1), F.length(e) - F.length(value)), s))
            .when(kind == "email", F.when(F.upper(e) == e, F.upper(s)).otherwise(s))
            .when(kind.isin("card", "phone", "ssn"), _refill(e, s, "[0-9]"))
            .when(kind == "iban", _refill(e, s, "[0-9A-Z]"))
            .otherwise(s)
        )

    def of(kind: Column) -> Column:
        person = F.concat(_title(e), F.array_join(F.transform(_name_kinds(e), name), " "))
        other = _let(_canon(kind, e), lambda canon: _let(made(kind, canon), lambda s: shown(kind, s)))
        return F.when(kind == "person", person).otherwise(other)

    return _let(kind_of(e), of)


def _resolved(scratch: Scratch, entities: DataFrame, key: str) -> DataFrame | None:
    """(kind, canon, attempt) of the entities whose first surrogate met another; None if none did."""
    now = scratch.write(
        entities.withColumn("attempt", F.lit(0)).withColumn("s", surrogate(F.col("kind"), F.col("canon"), F.lit(0), key)), "drawn-0"
    )
    i = 0
    while True:
        best = now.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon")).alias("best"), F.count("*").alias("n"))
        lost = now.join(best.where("n > 1"), ["kind", "s"]).where("canon <> best.canon").select("kind", "canon")
        real = entities.select("kind", F.col("canon").alias("s"))
        lost = lost.union(now.join(real, ["kind", "s"], "left_semi").select("kind", "canon")).distinct()
        lost = scratch.write(lost, f"lost-{i}")
        if lost.isEmpty():
            return None if i == 0 else now.where("attempt > 0").select("kind", "canon", "attempt")
        i += 1
        again = now.join(lost.withColumn("l", F.lit(1)), ["kind", "canon"], "left")
        attempt = F.col("attempt") + F.coalesce("l", F.lit(0))
        drawn = again.select("kind", "canon", attempt.alias("attempt"), "s", "l")
        fresh = F.when(F.col("l") == 1, surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)).otherwise(F.col("s"))
        now = scratch.write(drawn.select("kind", "canon", "attempt", fresh.alias("s")), f"drawn-{i}")


def replace_private(
    docs: DataFrame, key: str = "faultline", text: str = "text", id_col: str = "doc_id", count_col: str = "n_entities"
) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and the number of entities added as ``count_col`` long.

    Detected: e-mail addresses, secrets after a word such as ``password=``,
    access key ids, IPv4 and IPv6 addresses, card numbers, social security
    numbers, IBANs, phone numbers, and names after a title or a common given
    name.  All other text stays as it is.

    A null text stays null with 0 entities; an empty or long text is treated
    whole; documents without an entity come back unchanged; repeated rows are
    treated alike; an empty table gives an empty result; other columns are kept,
    but for one named as ``count_col``, which is replaced.  A secret without
    letters or digits gets a made-up one.  After ``LONGER`` failed draws
    surrogates of e-mail addresses and secrets are longer than what they stand
    for; after ``LETTERS``, numbers hold letters and IPv4 addresses become IPv6.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")
    found = F.regexp_extract_all(F.col(text), F.lit(ALL), F.lit(0))
    each = docs.select(F.col(id_col).alias("id"), F.explode(F.flatten(F.transform(found, units))).alias("u"))
    seen = scratch.write(each.select("id", "u.kind", "u.canon").distinct(), "seen")
    entities = scratch.write(seen.select("kind", "canon").distinct(), "entities")
    redrawn = _resolved(scratch, entities, key)
    if redrawn is None:
        docs = docs.withColumn("__again", F.lit(None).cast("map<string,int>"))
    else:
        pairs = F.struct(F.concat_ws("|", "kind", "canon"), "attempt")
        by_doc = scratch.write(
            seen.join(redrawn, ["kind", "canon"]).groupBy(F.col("id").alias("__id")).agg(F.map_from_entries(F.collect_set(pairs)).alias("__again")),
            "again",
        )
        docs = docs.join(small(by_doc, 4 * by_doc.count()), F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")
    # one pass to split and one to extract, only in texts with an entity
    parts = F.split(F.col(text), ALL, -1)
    stand = F.transform(found, lambda e: replaced(e, F.col("__again"), key))
    rest = lambda p: F.slice(p, F.lit(2), F.size(p))
    joined = _let(parts, lambda p: F.concat(F.element_at(p, 1), F.array_join(F.zip_with(stand, rest(p), lambda s, q: F.concat(s, q)), "")))
    has = F.col(text).rlike(ALL)
    count = F.when(has, F.regexp_count(F.col(text), F.lit(ALL))).otherwise(0).cast("long")
    return docs.withColumns({count_col: count, text: F.when(has, joined).otherwise(F.col(text))}).drop("__again")
