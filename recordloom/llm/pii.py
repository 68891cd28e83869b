"""Surrogates for personal data, in DataFrame functions only.

Detected entities are replaced by values of their kind: letters by letters of the same
script and case, digits by digits, octets by octets, given names by given names of the same
gender and script; signs, country codes and top-level domains stay, and a card number that
passes the Luhn check still does.

A surrogate is a keyed permutation of the value (a four-round Feistel network over the
value's characters, whose round function is SHA-256 of the key, the kind and the other half; then a turn of the first
character, then the rounds backwards, so that no value keeps itself).  Letters and numbers of
every script of the first plane, and CJK beyond it, are permuted.  Where a format has values
that are treated apart (given names among words, hexadecimal secrets among others), the
permutation of the rest is walked on until it leaves those, so it stays one.  A permutation
keeps distinct values distinct and gives a value the same surrogate everywhere, in whatever
spelling of the same format, without a table of entities; so texts are rewritten in their own
rows and nothing of them is shuffled, and no value can fail.

Before that, the corpus's distinct entities and their surrogates are checked by aggregation:
no two entities of a kind may share a surrogate, none may keep its value, and as few
surrogates as can be may be the value of another entity.  Of some salts of the key the one
that does best is taken.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import names, once
from recordloom.storage import drop, save

# Common given names by gender and script, and forms of address.
MALE = {
    "latin": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Edward Brian Peter Hans Pierre Carlos Juan Pedro Luis".split(),
    "cyrillic": "Иван Дмитрий Сергей Алексей Андрей Николай Михаил Владимир Павел Юрий".split(),
    "greek": "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παναγιώτης".split(),
}
FEMALE = {
    "latin": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Anna Maria Sophie Claire Marie Carmen Lucia Ingrid".split(),
    "cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    "greek": "Μαρία Ελένη Κατερίνα Σοφία Βασιλική Αγγελική".split(),
}
ADDRESS = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Señor Señora Господин Госпожа Κύριος Κυρία".split()
SECRET_NAMES = "token secret password passwd apikey api_key api-key access_key key".split()
# Letters that stand for one another, by script, in lower case.
ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ",
]
#: First and last of large ranges of letters, which are permuted within 64 code points: CJK and Hangul.
BLOCKS = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x2A6DF)]
#: Letters that are not the lower case of one character, although they have a lower case: they stand for themselves.
ODD = "".join(c for c in map(chr, range(128, 0x10000)) if c.isalpha() and c.lower() != c and (len(c.lower()) > 1 or c.lower().upper() != c))


def _others() -> list[str]:
    """Letters and numbers of the first plane in none of ``ALPHABETS`` and ``BLOCKS``, by script and case."""
    by: dict[tuple[str, ...], list[str]] = {}
    for c in map(chr, range(128, 0x10000)):
        sort = unicodedata.category(c)[0]
        if sort not in "LN" or any(first <= ord(c) <= last for first, last in BLOCKS) or any(c in a for a in ALPHABETS) or (c.lower() != c and c not in ODD):
            continue
        cased = c.upper() != c and len(c.upper()) == 1 and c.upper().lower() == c
        by.setdefault((sort, "cased" if cased else "", unicodedata.name(c, "?").replace("-", " ").split()[0]), []).append(c)
    rest = [c for cs in by.values() if len(cs) == 1 for c in cs]  # no other of their script
    found = ["".join(cs) for cs in by.values() if len(cs) > 1]
    return [*found, "".join(c for c in rest if c.upper() == c), "".join(c for c in rest if c.upper() != c)]


OTHERS = [a for a in _others() if len(a) > 1]
#: A private character for each of ``OTHERS``, and which has which.
MARK = 0xE000
_OTHER_LETTERS = "".join(OTHERS)
_OTHER_MARKS = "".join(chr(MARK + k) * len(a) for k, a in enumerate(OTHERS))
ROUNDS = 4
#: Steps in which a walk leaves the given names, or hexadecimal values: at least as many as there are of one format's names;
#: a walk through as many hexadecimal values of eight signs or more has a chance of 1 to 10**70.
WALK = 30
KINDS = ["email", "phone", "ip", "card", "ssn", "iban", "secret", "name"]


def _given() -> list[str]:
    return sorted({n for by in (MALE, FEMALE) for names in by.values() for n in names})


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SECRET_BEFORE = r"(?<=[=:]\s{0,2}[\"']?)(?<=(?i:" + "|".join(SECRET_NAMES) + r")\s{0,2}[=:]\s{0,2}[\"']?)"
_SURNAME = r"\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)?"
#: No entity begins inside a word or number: everywhere else one look back ends the attempt.
_BEGIN = r"(?<![A-Za-z0-9\p{L}\p{N}._%+-])"
#: By what an entity begins with, so that a text's ordinary words are refused by their first letter.
PATTERNS = [
    r"(?=[\d(+])(?:"
    + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\d|\.\d)"
    + r"|\d{3}-\d{2}-\d{4}(?![\d-])"
    + r"|(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
    + r"|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
    + r"|\d(?:[ -]?\d){12,18}(?![\d-]|\.\d))",
    r"[A-Za-z0-9\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}",
    r"(?=[A-Z][A-Z])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|AKIA[0-9A-Z]{16})(?![\p{L}\p{N}])",
    r"[0-9a-f]{32,}(?![\p{L}\p{N}])",
    _SECRET_BEFORE + r"(?=[_+/=-]*+[A-Za-z0-9])[A-Za-z0-9_+/=-]{8,}",
    r"(?=\p{Lu})(?:(?<=(?<!\p{L})(?:" + "|".join(ADDRESS) + r")\.? )" + _SURNAME + r"(?: " + _SURNAME + r")?|(?:" + "|".join(_given()) + r") " + _SURNAME + ")",
]
ENTITY = _BEGIN + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS) + ")"


def kind_of(value: Column) -> Column:
    """The kind of a matched value."""
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"), "iban")
        .when(value.rlike(r"^[\d -]+$") & (digits >= 13), "card")
        .when(value.rlike(r"^[\d +().-]+$"), "phone")
        .when(value.rlike(rf"^{_SURNAME}(?: {_SURNAME})?$") & ~value.rlike(r"^AKIA"), "name")
        .otherwise("secret")
    )


def _hash(key: Column, *parts: Column) -> Column:
    """A keyed number from 0 to 2**60 - 1."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", key, *parts), 256), 1, 15), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _permuted(indices: Column, sizes: Column, key: Column, kind: Column) -> Column:
    """A keyed permutation of an array of indices, each below its size (sizes stay, 2 at least), that leaves none as it is.

    Rounds, a turn of the first index, and the rounds backwards: as no turn leaves an index in place, neither does the whole.
    """

    def step(values: Column, n: Column) -> Column:
        r = F.when(n < ROUNDS, n).otherwise(2 * ROUNDS - n)
        sign = F.when(n < ROUNDS, 1).otherwise(-1)

        def of(other: Column) -> Column:
            def moved(v: Column, i: Column) -> Column:
                size = F.get(sizes, i)
                turn = F.when(i == 0, (v + 1 + _hash(key, kind, F.lit("turn")) % (size - 1)) % size).otherwise(v)
                return F.when(n == ROUNDS, turn).when(i % 2 == r % 2, F.pmod(v + sign * _hash(key, kind, r.cast("string"), i.cast("string"), other), size)).otherwise(v)

            return F.transform(values, moved)

        return _let(F.array_join(F.filter(values, lambda _, i: i % 2 != r % 2), ","), of)

    return F.aggregate(F.array(*map(F.lit, range(2 * ROUNDS + 1))), indices, step)


_HEX = ["0123456789abcdef"]


def _letters(value: Column, key: Column, kind: Column, last: int | None = None, alphabets: list[str] = ALPHABETS) -> Column:
    """The value with its letters and digits permuted (the last ``last`` of them only)."""
    every = F.lit("".join(alphabets))
    chars = F.split(value, "")

    def listed(c: Column) -> Column:
        return (F.instr(every, c) > 0) | ((F.ascii(c) >= 128) & (_in_blocks(c) | _other(c).isNotNull())) if alphabets is ALPHABETS else F.instr(every, c) > 0

    def of(cs: Column) -> Column:
        low = F.transform(cs, lambda c: F.when(F.instr(F.lit(ODD), c) > 0, c).otherwise(F.lower(c)))
        places = F.filter(F.transform(low, lambda c, i: F.when(listed(c), i)), lambda i: i.isNotNull())
        if last is not None:
            places = F.slice(places, F.greatest(F.size(places) - last, F.lit(0)) + 1, last)
        return _let(F.struct(low.alias("low"), F.reverse(places).alias("at")), lambda s: _written(cs, s["low"], s["at"], key, kind, alphabets))

    return _let(chars, of)


def _alphabet(c: Column, alphabets: list[str]) -> Column:
    other = F.when(_in_blocks(c), _block(c)).otherwise(F.get(F.array(*map(F.lit, OTHERS)), _other(c))) if alphabets is ALPHABETS else F.lit("")
    return reduce(lambda rest, a: F.when(F.instr(F.lit(a), c) > 0, a).otherwise(rest), alphabets, other)


def _in_blocks(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.ascii(c).between(*b) for b in BLOCKS])


def _block(c: Column) -> Column:
    """The 64 letters of a large range among which a letter is, fewer at the range's end."""
    begin = F.ascii(c) - F.ascii(c) % 64
    last = reduce(lambda rest, b: F.when(F.ascii(c) <= b[1], b[1]).otherwise(rest), reversed(BLOCKS), F.lit(0))
    codes = F.sequence(begin, F.least(begin + 63, last))
    return F.array_join(F.transform(codes, lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")), "")


def _other(c: Column) -> Column:
    """Which of ``OTHERS`` has a character, or null."""
    mark = F.ascii(F.translate(c, _OTHER_LETTERS, _OTHER_MARKS)) - MARK
    return F.when((F.ascii(c) >= 128) & ~F.ascii(c).between(MARK, MARK + len(OTHERS) - 1) & mark.between(0, len(OTHERS) - 1), mark)


def _written(cs: Column, low: Column, at: Column, key: Column, kind: Column, alphabets: list[str]) -> Column:
    chosen = F.transform(at, lambda i: _alphabet(F.get(low, i), alphabets))

    def of(abc: Column) -> Column:
        old = F.transform(at, lambda i, k: (F.instr(F.get(abc, k), F.get(low, i)) - 1).cast("long"))
        new = _permuted(old, F.transform(abc, lambda a: F.length(a).cast("long")), key, kind)
        return _let(new, lambda ns: _spelled(cs, low, at, abc, ns))

    return _let(chosen, of)


def _spelled(cs: Column, low: Column, at: Column, abc: Column, new: Column) -> Column:
    def char(c: Column, i: Column) -> Column:
        k = F.array_position(at, i).cast("int") - 1
        plain = F.substring(F.get(abc, k), (F.get(new, k) + 1).cast("int"), F.lit(1))
        return F.when(k < 0, c).when(c != F.get(low, i), F.upper(plain)).otherwise(plain)

    return F.array_join(F.transform(cs, char), "")


def _email(value: Column, key: Column) -> Column:
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(host, ".", -1)
    labels = F.substring(host, F.lit(1), F.length(host) - F.length(top) - 1)
    own = F.concat_ws("\x1f", F.lit("email"), F.lower(host))
    return F.concat(_letters(local, key, own), F.lit("@"), _letters(labels, key, F.lit("host")), F.lit("."), top)


def _ip(value: Column, key: Column) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    sizes = F.array(*[F.lit(256).cast("long")] * 4)
    return F.array_join(_let(octets, lambda o: _permuted(o, sizes, key, F.lit("ip"))), ".")


def _luhn(digits: Column) -> Column:
    """Sum of a digit string's Luhn terms, the last digit's weight being one."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: _let(c.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def _walked(value: Column, step, left) -> Column:
    """``step`` applied to the value, and again while ``left`` holds of what it gave.

    If ``step`` permutes the values of a format and ``left`` doesn't hold of the value, this
    permutes those of which it doesn't hold.
    """
    return F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), step(value), lambda v, _: F.when(left(v), step(v)).otherwise(v))


def _card(value: Column, key: Column) -> Column:
    """The last digit stays as far from the Luhn check digit as it was, so that valid numbers are valid and others not."""

    def missing(digits: Column) -> Column:
        return -_luhn(F.concat(F.regexp_replace(digits, r"\D", ""), F.lit("0")))

    head = F.substring(value, F.lit(1), F.length(value) - 1)
    apart = F.substring(value, F.length(value), F.lit(1)).cast("int") - missing(head)
    return _let(_letters(head, key, F.lit("card")), lambda h: F.concat(h, F.pmod(missing(h) + apart, F.lit(10)).cast("string")))


def _secret(value: Column, key: Column, kind: Column) -> Column:
    """The well-known beginning of an access key stays, and a hexadecimal secret is one."""
    hexadecimal = "^[0-9a-f]+$"
    rest = F.substring(value, F.lit(5), F.length(value))
    return (
        F.when(value.rlike(hexadecimal), _letters(value, key, F.lit("hex"), alphabets=_HEX))
        .when(value.rlike("^AKIA[0-9A-Z]{16}$"), F.concat(F.lit("AKIA"), _letters(rest, key, F.lit("access"))))
        .otherwise(_walked(value, lambda v: _letters(v, key, kind), lambda v: v.rlike(hexadecimal) | v.rlike("^AKIA[0-9A-Z]{16}$")))
    )


def _name_word(word: Column, key: Column) -> Column:
    """A given name's surrogate is one of its gender and script; another word is spelled anew, as no given name."""
    out = _walked(word, lambda w: _letters(w, key, F.lit("surname")), lambda w: w.isin(_given()))
    for gender, of_gender in (("m", MALE), ("f", FEMALE)):
        for script, own in of_gender.items():
            listed = F.array(*[F.lit(n) for n in own])
            at = F.array_position(listed, word).cast("long") - 1
            turn = 1 + _hash(key, F.lit("given"), F.lit(gender), F.lit(script)) % (len(own) - 1)  # moves every name
            out = F.when(word.isin(own), F.get(listed, ((at + turn) % len(own)).cast("int"))).otherwise(out)
    return out


def surrogate(value: Column, kind: Column, key: Column) -> Column:
    """What replaces a value of a kind under a key."""
    return (
        F.when(kind == "email", _email(value, key))
        .when(kind == "ip", _ip(value, key))
        .when(kind == "card", _card(value, key))
        .when(kind == "phone", _letters(value, key, F.lit("phone"), last=10))
        .when(kind == "name", F.array_join(F.transform(F.split(value, "(?<=[ -])|(?=[ -])"), lambda w: F.when(w.isin(" ", "-"), w).otherwise(_name_word(w, key))), ""))
        .when(kind == "iban", F.concat(F.substring(value, 1, 2), _letters(F.substring(value, F.lit(3), F.length(value)), key, kind)))
        .when(kind == "ssn", _letters(value, key, kind))
        .otherwise(_secret(value, key, kind))
    )


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct ``(kind, value)`` of the corpus."""
    found = docs.where(F.col(text_col).rlike(ENTITY)).select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(ENTITY), F.lit(0))).alias("value"))
    return found.distinct().select(kind_of(F.col("value")).alias("kind"), "value")


def checked_key(docs: DataFrame, key: str, text_col: str = "text", tries: int = 3) -> str:
    """The key, salted so that the corpus's surrogates pass the checks.

    Of ``tries`` salts that one is taken under which the fewest values share a surrogate or keep
    their value (none can), then the fewest surrogates are values of the corpus.
    """
    known = save(entities(docs, text_col), "entities")
    best: tuple[int, int, str] | None = None
    for turn in range(tries):
        salted = f"{key}/{turn}"
        mapped = save(known.withColumn("new", once(surrogate(F.col("value"), F.col("kind"), F.lit(salted)))), "surrogates")
        shared = mapped.groupBy("kind", "new").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
        # Signs alone, as in "_@-.com", tell nothing and stay.
        kept = mapped.where((F.col("value") == F.col("new")) & ~((F.col("kind") == "email") & F.col("value").rlike(r"^[^\p{L}\p{N}]+@[^\p{L}\p{N}]+\.\p{L}+$"))).count()
        real = mapped.join(known.select(F.col("kind").alias("k"), F.col("value").alias("v")), (F.col("kind") == F.col("k")) & (F.col("new") == F.col("v")), "left_semi").count()
        drop(mapped)
        best = min(best or (shared + kept, real, salted), (shared + kept, real, salted))
        if not best[0] and not best[1]:
            break
    drop(known)
    return best[2]


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """``docs`` with entities replaced in the text, and ``_entities``, their kinds in order.

    Null texts stay null and have no entities; empty ones stay.  Null or repeated ids and
    repeated rows are rewritten alike; an empty table gives no rows; other columns stay, but
    for one that is called ``_entities``.
    """
    salted = checked_key(docs, key, text_col) if check else f"{key}/0"
    found, new, gaps = names(docs, "found", "new", "gaps")
    text = F.col(text_col)
    has = F.coalesce(text.rlike(ENTITY), F.lit(False))
    df = docs.withColumn(found, once(F.when(has, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))))
    df = df.withColumn(found, once(F.transform(found, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))))
    surrogates = F.transform(found, lambda m: surrogate(m["value"], m["kind"], F.lit(salted)))
    # Pieces between entities, each followed by the next surrogate.
    df = df.withColumn(new, once(surrogates)).withColumn(gaps, once(F.when(F.col(found).isNotNull(), F.split(text, ENTITY, -1))))
    written = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(new, i), F.lit("")))), "")
    kinds = F.coalesce(F.transform(found, lambda m: m["kind"]), F.array().cast("array<string>"))
    kept = [c for c in docs.columns if c.lower() != "_entities"]
    return df.select(*[(F.coalesce(written, text).alias(c) if c == text_col else F.col(c)) for c in kept], kinds.alias("_entities"))
