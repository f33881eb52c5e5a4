"""String expressions with the white space and length rules of ECMAScript, all native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript's ``\s`` has it, as a Java character class; signs beyond Latin-1 are tried only on letters of their range.
BLANKS = r"\t\n\x0B\f\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
BLANK = f"[{BLANKS}]"
#: The same signs one by one.
BLANK_SIGNS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_SIGNS))


def collapsed(text: Column) -> Column:
    others = BLANK_SIGNS.replace(" ", "")
    plain = F.translate(text, others, " " * len(others))
    return F.when(plain.contains("  "), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)


def normalized(text: Column) -> Column:
    """One blank between words, none around: the form that is hashed and stored."""
    return trimmed(collapsed(text))


def lookup_form(text: Column) -> Column:
    return F.lower(normalized(text))


def text_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def blank(text: Column) -> Column:
    return text.isNull() | (trimmed(text) == "")


def plain_lines(text: Column) -> Column:
    """Text with every line break and tab as one blank, runs collapsed, ends trimmed; null gives ''."""
    text = F.regexp_replace(text, r"\r\n?|\n|\t", " ")
    return F.coalesce(trimmed(F.regexp_replace(text, " +", " ")), F.lit(""))


def unified_lines(text: Column) -> Column:
    """Text with line feeds only, blanks collapsed and at most one empty line in a row."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def numeric_only(text: Column) -> Column:
    return text.rlike(rf"^[0-9{BLANKS}.,:+\-/%()]+$")


def worth_keeping(text: Column) -> Column:
    """A segment worth translating: not blank, not only numbers, a single character only if it is a letter."""
    core = normalized(text)
    # fixed values: the letters that may stand alone
    letter = core.rlike(r"[A-Za-z\u00C0-\u017F\u0400-\u04FF\u0600-\u06FF\u4E00-\u9FFF]")
    return F.coalesce((core != "") & ((utf16_length(core) >= 2) | letter) & ~numeric_only(core), F.lit(False))


def short_phrase(text: Column, most_words: int = 2, most_chars: int = 30) -> Column:
    text = trimmed(text)
    return F.coalesce((text != "") & (word_count(text) <= most_words) & (utf16_length(text) <= most_chars), F.lit(False))


def interface_command(text: Column, most_words: int = 4, most_chars: int = 40) -> Column:
    text = trimmed(text)
    short = (word_count(text) <= most_words) & (utf16_length(text) <= most_chars)
    return F.coalesce((text != "") & short & ~text.rlike(r"[.!?]$"), F.lit(False))


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ? before white space, trimmed, without blanks."""
    parts = F.split(trimmed(text), f"(?<=[.!?]){BLANK}+")
    return F.filter(F.transform(parts, trimmed), lambda s: s != "")


def splits(text: Column, least: int = 120) -> Column:
    return (utf16_length(text) >= least) & (F.size(sentences(text)) > 1)


def units(text: Column, least: int = 120) -> Column:
    """The units that a text is translated in: its sentences if it is long and has several, else itself."""
    whole = F.array(text)
    several = F.transform(F.array(sentences(text)), lambda s: F.when(F.size(s) > 1, s).otherwise(whole))[0]  # worked out once
    return F.when(utf16_length(text) >= least, several).otherwise(whole)


def merged_lines(text: Column) -> Column:
    """Lines joined until one ends a sentence; an empty line closes a paragraph and stays as ''."""
    lines = F.split(unified_lines(text), "\n")
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def add(state, line):
        line = trimmed(line)
        text = F.when(state["open"] == "", line).otherwise(F.concat(state["open"], F.lit(" "), line))
        closed = F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        ends = line.rlike(r"[.!?]$")
        return F.struct(
            F.when((line == "") | ends, "").otherwise(text).alias("open"),
            F.when(line == "", F.concat(closed, F.array(F.lit(""))))
            .when(ends, F.concat(state["done"], F.array(text)))
            .otherwise(state["done"]).alias("done"),
        )

    def finish(state):
        return F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))

    none = F.array().cast("array<string>")
    return F.when(F.coalesce(unified_lines(text), F.lit("")) == "", none).otherwise(F.aggregate(lines, start, add, finish))


def preprocessed(text: Column) -> Column:
    """All sentences of the merged lines of a text."""
    return F.flatten(F.transform(F.filter(merged_lines(text), lambda p: p != ""), sentences))


def packed_sentences(text: Column, room: int = 400) -> Column:
    """Sentences packed greedily into chunks of at most ``room`` characters (joining blanks not counted)."""
    parts = F.filter(F.split(trimmed(text), rf"(?<=[.!?]){BLANK}+"), lambda s: trimmed(s) != "")
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("done"))

    def add(state, part):
        fits = (F.size(state["open"]) == 0) | (state["size"] + F.length(part) <= room)
        return F.struct(
            F.when(fits, F.concat(state["open"], F.array(part))).otherwise(F.array(part)).alias("open"),
            F.when(fits, state["size"] + F.length(part)).otherwise(F.length(part)).alias("size"),
            F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(F.array_join(state["open"], " ")))).alias("done"),
        )

    def finish(state):
        return F.when(F.size(state["open"]) == 0, state["done"]).otherwise(F.concat(state["done"], F.array(F.array_join(state["open"], " "))))

    return F.when(blank(text), F.array().cast("array<string>")).otherwise(F.aggregate(parts, start, add, finish))


def _decoded_numbers(text: Column, pattern: str, base: int) -> Column:
    """Numbers that are no code point stay as they are."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0))

    def join(gap, reference):
        digits = F.regexp_replace(reference, "^&#[xX]?0*|;$", "")
        code = F.when(F.length(digits) <= 7, F.conv(F.concat(F.lit("0"), digits), base, 10).cast("int"))
        point = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        # a code point as UTF-32 bytes, read as text
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(point, code.cast("long"))), 8, "0")), "UTF-32")
        return F.concat(gap, F.coalesce(char, reference, F.lit("")))

    return F.array_join(F.zip_with(gaps, found, join), "")


def decoded_entities(text: Column) -> Column:
    """Numeric and the five XML character references decoded, ``&amp;`` first among the named ones."""
    text = _decoded_numbers(_decoded_numbers(text, r"&#x[0-9a-fA-F]+;", 16), r"&#[0-9]+;", 10)
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def repaired(text: Column, lossy: bool = True) -> Column:
    """UTF-8 that was read as Latin-1, read again; kept only if it then holds characters beyond Latin-1."""
    latin = F.regexp_replace(text, r"[^\x00-\xFF]", "")
    again = F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))
    suspect = ~text.rlike(r"[^\x00-\xFF]") & text.rlike(r"[\x80-\xFF]")
    better = again.rlike(r"[\u0100-\uFFFF]")
    if not lossy:
        better = better & ~again.contains("\uFFFD")
    return F.when(suspect & better, again).otherwise(text)


def download_name(name: Column, locale: Column) -> Column:
    """File name of a translated resource file, safe to put in a header."""
    base = trimmed(F.regexp_replace(F.coalesce(name, F.lit("file")), r"(?i)\.properties$", ""))
    safe = lambda c, n: F.substring(F.regexp_replace(c, r"[\r\n\"%\\]", "_"), 1, n)
    base = safe(F.when(base == "", "file").otherwise(base), 200)
    place = F.when(F.coalesce(locale, F.lit("")) == "", "translated").otherwise(safe(locale, 20))
    return F.concat(base, F.lit("-"), place, F.lit(".properties"))
