"""What a text's own words say: kinds, dates beside numbers, marks of bad reading, plain forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a filing type holds, in the order that is asked, and what it then is.
KINDS = [
    ("motion", "Motion"),
    ("petition", "Motion"),
    ("reply", "Reply"),
    ("notice of intent", "Notice"),
    ("notice", "Notice"),
    ("comment", "Comments"),
    ("discovery", "Discovery"),
    ("status report", "Report"),
    ("report", "Report"),
    ("letter", "Letter"),
    ("supplement", "Supplement"),
    ("modify", "Supplement"),
    ("complaint", "Complaint"),
    ("nomination", "Nomination"),
    ("application", "Application"),
    ("brief", "Brief"),
    ("errata", "Errata"),
    ("support statem", "Statement"),
    ("statement", "Statement"),
    ("miscellaneous", "Misc."),
]
# Types that two registers go by, and beginnings of words in which a capital may follow a small letter.
COURT, PROTECTIVE = "court action", "protective order"
MIXED = "Mc Mac O' D' De La Le Van Von".split()


def kind_label(kind: Column, filing_type: Column) -> Column:
    """A record's kind in a word: by the first needle that its type holds, else the type's first word."""
    low = F.lower(F.coalesce(filing_type, F.lit("")))
    first = F.split(F.trim(F.regexp_extract(F.coalesce(filing_type, F.lit("Filing")), r"^([^/(]*)", 1)), " ")[0]
    other = F.when(first == "", "Filing").otherwise(first)
    named = reduce(lambda rest, rule: F.when(low.contains(rule[0]), rule[1]).otherwise(rest), reversed(KINDS), other)
    return F.when(kind == "decision", "Decision").when(kind == "comment", "Comment").otherwise(named)


def register_of(kind: Column, entry_type: Column) -> Column:
    """The register that an entry of this type is in, or null."""
    low = F.lower(F.coalesce(entry_type, F.lit("")))
    return F.when((kind == "decision") & (low == COURT), "court").when((kind == "filing") & low.contains(PROTECTIVE), "protective")


def own_key(key: Column, own: Column) -> Column:
    """A bare six-digit key whose first five digits are one of the document's own keys is that key."""
    short = F.substring(key, F.lit(1), F.length(key) - 1)
    fused = key.rlike(r"^[A-Z]+ \d{6}$") & ~F.array_contains(own, key) & F.array_contains(own, short)
    return F.when(F.coalesce(fused, F.lit(False)), short).otherwise(key)


_MONTHS = "Jan(?:uary|\\.)?|Feb(?:ruary|\\.)?|Mar(?:ch|\\.)?|Apr(?:il|\\.)?|May|June?|July?|Aug(?:ust|\\.)?|Sept?(?:ember|\\.)?|Oct(?:ober|\\.)?|Nov(?:ember|\\.)?|Dec(?:ember|\\.)?"
_NUMBER = r"\b(?:FD|AB|EP|NOR|MCF|WB|SO|SDM) \d{1,6}(?: \(Sub-No\. \d+\))?"


def served_beside(line: Column, printed: Column) -> Column:
    """The served date that belongs to a docket number on a line: after it, before the next number or
    sentence; null unless all its occurrences give one date, or none of its sub-numbers' if it gives none."""
    flat = F.trim(F.regexp_replace(line, r"\s+", " "))
    # Each number begins a piece that ends where the next begins.
    pieces = F.split(F.regexp_replace(flat, f"({_NUMBER})", "\x1e$1\x1f"), "\x1e")
    told = F.transform(
        pieces,
        lambda p: F.struct(
            F.substring_index(p, "\x1f", 1).alias("number"),
            F.regexp_extract(F.regexp_replace(F.substring_index(p, "\x1f", -1), r"\. [A-Z][a-z]+ .*$", "."), rf"served ((?:{_MONTHS}) \d{{1,2}}, \d{{4}})", 1).alias("date"),
        ),
    )

    def dates(of) -> Column:
        return F.array_distinct(F.transform(F.filter(told, lambda t: of(t["number"]) & (t["date"] != "")), lambda t: t["date"]))

    own, family = dates(lambda n: n == printed), dates(lambda n: n.startswith(F.concat(printed, F.lit(" ("))))

    def only(found: Column) -> Column:
        return F.when(F.size(found) == 1, found[0])

    return F.when(F.size(own) > 0, only(own)).otherwise(only(family))


def decided_lines(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """Lines that say when something was decided: their ordinal on the page and the date as printed."""
    lines = pages.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "printed"))
    date = F.regexp_extract("printed", rf"(?i)^\s*decided:?\s+((?:{_MONTHS}) \d{{1,2}}, \d{{4}})", 1)
    return lines.withColumn("decided", date).where("decided <> ''")


def reading_features(pages: DataFrame, column: str, lexicon: DataFrame, keep: list[str]) -> DataFrame:
    """Counts and shares that tell a bad reading: lettered tokens, words, words whose parts are all in the
    lexicon (a table ``word``), words with a capital after a small letter, signs that no text has.

    Words meet the lexicon in a join, once for each distinct word of a page.
    """
    tokens = F.filter(F.split(F.col(column), r"\s+"), lambda t: t != "")
    base = pages.select(*keep, F.col(column).alias("x"), tokens.alias("t"))
    lettered = F.filter("t", lambda t: t.rlike("[A-Za-z]"))
    cores = F.transform(lettered, lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    base = base.select(*keep, "x", F.size("t").cast("long").alias("n_tok"), F.size(lettered).cast("long").alias("lettered"), F.filter(cores, lambda c: c.rlike(r"^[A-Za-z]+(?:['-][A-Za-z]+)*$") & (F.length(c) >= 2)).alias("w"))
    begins = "^(?:" + "|".join(MIXED) + ")[A-Z]"
    flips = F.size(F.filter("w", lambda c: (c != F.upper(c)) & c.rlike("[a-z][A-Z]") & ~c.rlike(begins))).cast("long")
    bare = F.regexp_replace("x", r"\s+", "")
    junk = F.length(F.regexp_replace(bare, r"""[A-Za-z0-9.,;:!?'"()\[\]/&$%#@*+=<>_-]""", "")).cast("long")
    counted = base.select(*keep, "n_tok", "lettered", F.size("w").cast("long").alias("words"), flips.alias("flips"), F.length(bare).cast("long").alias("nonspace"), junk.alias("junk"), "w")
    parts = counted.select(*keep, F.explode("w").alias("c")).groupBy(*keep, "c").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.select(*keep, "c", "n", F.explode(F.array_distinct(F.transform(F.split("c", "['-]"), lambda p: F.lower(p)))).alias("word"))
    known = parts.join(lexicon.select("word", F.lit(1).alias("in")), "word", "left").groupBy(*keep, "c").agg(F.first("n").alias("n"), F.min(F.coalesce("in", F.lit(0))).alias("all"))
    hits = known.groupBy(*keep).agg(F.sum(F.col("n") * F.col("all")).alias("hits"))
    joined = counted.drop("w").join(hits, keep, "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))

    def share(a: Column, b: str) -> Column:
        return F.round(a / F.nullif(F.col(b), F.lit(0)), 6)

    return joined.select(
        *keep, "n_tok", "lettered", "words", "hits", "flips", "nonspace", "junk",
        share(F.col("hits"), "words").alias("lex"), share(F.col("lettered") - F.col("words"), "lettered").alias("mangled"), share(F.col("junk"), "nonspace").alias("junk_share"), share(F.col("flips"), "words").alias("case_share"),
    )


def word_errors(truth: Column, output: Column) -> Column:
    """Word error rate: edits between the texts' words over the words of the truth.

    Every distinct word is a character of its own, so the built-in distance of strings counts words.
    """

    def words(x: Column) -> Column:
        return F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")

    both = F.array_distinct(F.concat(words(truth), words(output)))

    def spelled(x: Column) -> Column:
        return F.array_join(F.transform(words(x), lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(both, w) + 0x4E00), 8, "0")), "UTF-32")), "")

    return F.round(F.levenshtein(spelled(truth), spelled(output)) / F.nullif(F.size(words(truth)), F.lit(0)), 6)


def _fixed(v: Column, places: int) -> Column:
    """A double in decimal with no or one place, as C prints it: its exact binary value rounded, halves to the even digit.

    Java's formats round the shortest decimal that reads back as the number, halves up: 36.55, which is a little
    less in binary, is 36.6 there.
    """
    size = F.abs(v)
    whole = F.floor(size)
    part = size - whole  # exact, as are eight and two times it
    if places:
        up = part * 8 + part * 2
        lost = part * 2 - (up - part * 8)
    else:
        up, lost = part, F.lit(0.0)
    digit = F.floor(up)
    over = up - digit - 0.5
    total = whole * 10**places + digit
    total = total + F.when((over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & (total % 2 == 1)))), 1).otherwise(0)
    digits = F.concat(F.floor(total / 10).cast("string"), F.lit("."), (total % 10).cast("string")) if places else total.cast("string")
    sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
    # Doubles from 2^52 on are whole.
    return F.when(size < 2.0**52, F.concat(sign, digits)).otherwise(F.format_string(f"%.{places}f", v))


def compact(n: Column) -> Column:
    """1,284 as 1.3K, 2,500,000 as 2.5M; below a thousand as it is."""

    def scaled(by: float, sign: str) -> Column:
        v = n / by
        return F.concat(F.when((v * 10 >= 999.5) | (v == F.floor(v)), _fixed(v, 0)).otherwise(_fixed(v, 1)), F.lit(sign))

    return F.when(F.abs(n) >= 1e6 * 0.9995, scaled(1e6, "M")).when(F.abs(n) >= 1e3 * 0.9995, scaled(1e3, "K")).otherwise(_fixed(n, 0))


def axis_top(v: Column, ticks: int = 4) -> Column:
    """The least of 1, 2, 2.5 and 5 times a power of ten that reaches ``v`` in some steps, as often as there are steps."""
    raw = v / ticks
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    step = reduce(lambda rest, m: F.when(m * power >= raw, m * power).otherwise(rest), [5.0, 2.5, 2.0, 1.0], 10.0 * power)
    return F.when(v <= 0, 1.0).otherwise(step * ticks)


def marked(text: Column, word: str) -> Column:
    """``text`` for a page, with the word in marks: escaped after it was marked with signs that no text has."""
    held = F.regexp_replace(F.translate(text, "\x02\x03", ""), f"(?i)\\b({word})\\b", "\x02$1\x03")
    safe = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], held)
    return F.replace(F.replace(safe, F.lit("\x02"), F.lit("<mark>")), F.lit("\x03"), F.lit("</mark>"))


def plausible_email(address: Column) -> Column:
    local, domain = F.substring_index(address, "@", 1), F.regexp_extract(address, "^[^@]*@(.*)$", 1)
    return F.coalesce(address.contains("@") & (local != "") & domain.contains(".") & ~address.contains(" ") & (F.length(address) <= 254), F.lit(False))


def normal_url(url: Column) -> Column:
    """Scheme and host in small letters, no fragment, nothing around it."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]+)", 1)
    return F.when(head != "", F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))).otherwise(F.trim(url))


def plausible_url(url: Column) -> Column:
    """Secure, with a host, without credentials, fragment or space, and not too long."""
    return F.coalesce(url.rlike(r"^(?i:https)://[^/?#@\s:]+(?::\d+)?(?:[/?][^#\s]*)?$") & (F.length(url) <= 2048), F.lit(False))
