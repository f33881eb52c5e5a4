"""Protecting parts of a text with tokens and putting them back, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Placeholders of resource files, and the wider set of running text (alternatives in order).
FILE_PLACEHOLDER = r"%[a-zA-Z@]|\{[^}]+\}|\$\{[^}]*\}"
TEXT_PLACEHOLDER = r"%\d+\$[a-zA-Z@]|%[a-zA-Z@]|\{\{[^}]+\}\}|\$\{[^}]*\}|\{[^}]+\}"


def originals(text: Column, pattern: str) -> Column:
    """Distinct matches in the order of their first occurrence; their place is their number."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def protected(text: Column, pattern: str, before: str, after: str = "") -> Column:
    """Text with each match replaced by ``before`` + its number + ``after``."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    known = F.array_distinct(found)

    def join(gap, match):
        number = (F.array_position(known, match) - 1).cast("string")
        return F.concat(gap, F.when(match.isNull(), "").otherwise(F.concat(F.lit(before), number, F.lit(after))))

    return F.array_join(F.zip_with(gaps, found, join), "")


def restored(text: Column, values: Column, before: str, after: str = "") -> Column:
    """Tokens replaced by their originals, the longest token first."""
    pairs = F.transform(values, lambda v, i: F.struct((-i).alias("order"), v.alias("value"), F.concat(F.lit(before), i.cast("string"), F.lit(after)).alias("token")))
    longest = F.array_sort(pairs, lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0))
    return F.aggregate(longest, text, lambda t, p: F.replace(t, p["token"], p["value"]))


def restored_loosely(text: Column, values: Column) -> Column:
    """File tokens put back even where blanks or case crept into them; unknown numbers stay, then exact tokens."""
    pattern = r"(?i)__\s*PH\s*(\d+)\s*__"
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    number = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    put = F.zip_with(whole, number, lambda w, n: F.coalesce(F.get(values, F.coalesce(F.try_to_number(F.substring(n, 1, 6), F.lit("999999")).cast("int"), F.lit(-1))), w))
    loose = F.array_join(F.zip_with(gaps, put, lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")
    return restored(loose, values, "__PH", "__")


def quoted(text: str) -> str:
    """A text as a Java pattern that matches only itself."""
    return "".join(f"\\{c}" if c in r".*+?^${}()|[]\\" else c for c in text)


def brand_pattern(brand: str, edges: str = "boundary") -> str:
    """A brand in any case, with ``edges`` of one of two kinds.

    "boundary": between a letter, digit or underscore of ASCII and another sign, as the ``\\b`` of
    ECMAScript has it, so that a brand that begins or ends with another sign, like C++, is only
    found where such a letter touches it.  "word": not beside a letter or digit of any alphabet.
    """
    if edges == "word":
        return rf"(?iu)(?<![\p{{L}}\p{{N}}_]){quoted(brand)}(?![\p{{L}}\p{{N}}_])"
    inner = lambda sign: sign.isascii() and (sign.isalnum() or sign == "_")
    before = "(?<![A-Za-z0-9_])" if inner(brand[:1]) else "(?<=[A-Za-z0-9_])"
    after = "(?![A-Za-z0-9_])" if inner(brand[-1:]) else "(?=[A-Za-z0-9_])"
    return f"(?iu){before}{quoted(brand)}{after}"


def _tagged(matches: Column, token: str) -> Column:
    return F.transform(matches, lambda m: F.struct(F.lit(token).alias("token"), m.alias("original")))


def brands_protected(text: Column, brands: list[str], edges: str = "boundary") -> Column:
    """(text, found): brands replaced in list order by ``BRAND_i``, with the spellings found, in order."""
    found = F.array().cast("array<struct<token:string,original:string>>")
    for i, brand in enumerate(brands):
        matches = F.regexp_extract_all(text, F.lit(f"({brand_pattern(brand, edges)})"), F.lit(1))
        found = F.concat(found, _tagged(matches, f"BRAND_{i}"))
        text = F.regexp_replace(text, brand_pattern(brand, edges), f"BRAND_{i}")
    return F.struct(text.alias("text"), found.alias("found"))


def brands_restored(text: Column, found: Column, mode: str = "first") -> Column:
    """``first``: each token everywhere by its first spelling, in recorded order; ``each``: one occurrence for each spelling, long tokens first."""
    if mode == "first":
        return F.aggregate(found, text, lambda t, p: F.replace(t, p["token"], p["original"]))
    by_length = F.array_sort(found, lambda a, b: F.length(b["token"]) - F.length(a["token"]))

    def once(t, p):
        at = F.instr(t, p["token"])
        return F.when(at > 0, F.concat(t.substr(F.lit(1), at - 1), p["original"], t.substr(at + F.length(p["token"]), F.length(t)))).otherwise(t)

    return F.aggregate(by_length, text, once)
