"""Glossary lookup: exact phrases by an equi-join, patterns with one ``*`` by an index of their first and last words."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLANK, BLANK_SIGNS, lookup_form, normalized, trimmed, utf16_length

SCHEMA = "target_lang string, ord int, src string, value string"
#: Most entries of a language that are sent to all texts; of a larger glossary, the tasks that rows of one phrase are dealt to.
MOST_SENT, DEALS = 100_000, 16


def read_json(spark: SparkSession, path: str) -> dict | None:
    """An object from a small JSON file; none if the file is missing, or with a warning if it is not readable as such."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(conf).exists(at):
        return None
    try:
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
    except (json.JSONDecodeError, TypeError) as e:
        warnings.warn(f"{path} is left out: {e}", stacklevel=2)
        return None
    return found if isinstance(found, dict) else None


def merged_entries(entries: dict[str, dict[str, str]], over: dict[str, dict[str, str]]) -> dict[str, dict[str, str]]:
    """Entries with those of ``over`` put in: an equal key takes the new value in its old place, others follow at the end.

    Keys are equal only if they are written alike, so that one in another case comes
    later and loses to the first.
    """
    kept = {lang: terms for lang, terms in over.items() if not lang.startswith("_") and isinstance(terms, dict)}
    return {**entries, **{lang: {**entries.get(lang, {}), **terms} for lang, terms in kept.items()}}


def read_glossary(spark: SparkSession, path: str, entries: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """A glossary table from a JSON file ``{language: {source: target}}`` put over ``entries``.

    Languages that begin with ``_`` are left out; a missing file leaves ``entries``.
    """
    return from_entries(spark, merged_entries(entries or {}, read_json(spark, path) or {}))


def read_brands(spark: SparkSession, path: str, brands: list[str] = ()) -> list[str]:
    """The brands of a JSON file ``{"brands": [...]}``, or ``brands`` where it has none."""
    found = (read_json(spark, path) or {}).get("brands")
    return [str(b) for b in found] if isinstance(found, list) else list(brands)


def from_entries(spark: SparkSession, entries: dict[str, dict[str, str]]) -> DataFrame:
    rows = [(lang, i, src, value) for lang, terms in entries.items() if not lang.startswith("_") for i, (src, value) in enumerate(terms.items())]
    return spark.createDataFrame(rows, SCHEMA)


def exact_entries(glossary: DataFrame) -> DataFrame:
    """One row for each language and normalized phrase: the first entry wins."""
    plain = glossary.where(~F.col("src").contains("*")).withColumn("norm_src", lookup_form(F.col("src")))
    return plain.groupBy("target_lang", "norm_src").agg(F.min_by("value", "ord").alias("glossary_value"))


#: Letters whose upper case is an ASCII letter though they are none; they are equal only to themselves.
ALONE = "\u017f\u0131\u212a"
#: A ``*`` that stands for white space only: some before, one sign that ends no line, some behind.
ALL_BLANK = f"^{BLANK}+[^\\n\\r\\u2028\\u2029]{BLANK}+$"
#: What ends a line.
ENDS = "\n\r\u2028\u2029"



def folded(text: Column) -> Column:
    """A text with its case taken away, letter by letter."""
    return F.lower(F.upper(F.translate(text, ALONE, "\ue000\ue001\ue002")))


def ends_of(text: Column) -> tuple[Column, Column, Column]:
    """First, second and last word of a trimmed text; without a second one it is ''."""
    others = BLANK_SIGNS.replace(" ", "")
    plain = F.translate(text, others, " " * len(others))
    first = F.substring_index(plain, " ", 1)
    rest = F.ltrim(plain.substr(F.length(first) + 1, F.length(plain)))
    return first, F.substring_index(rest, " ", 1), F.substring_index(plain, " ", -1)


def pattern_index(patterns: DataFrame) -> DataFrame:
    """(first, second, last, patterns): of (ord, src, value) with one ``*``, by the first two words before it, if there are two, and the last behind it.

    A text that matches begins and ends with these words, so that only the patterns of two
    rows of the index are ever tried on it.  Where nothing stands before or behind the ``*``
    a pattern matches nothing, as white space must, and texts are trimmed.  Of patterns that are
    equal but for case the first one is kept.
    """
    sides = F.split("src", r"\*", -1)
    rows = patterns.where(F.size(sides) == 2).select("ord", "value", trimmed(sides[0]).alias("left"), trimmed(sides[1]).alias("right"))
    rows = rows.where("left <> '' and right <> ''").groupBy(folded(F.col("left")).alias("_left"), folded(F.col("right")).alias("_right"))
    rows = rows.agg(F.min_by(F.struct("ord", "left", "right", "value"), "ord").alias("_first"))
    rows = rows.select("_left", "_right", F.struct("_first.*", F.col("_left").alias("begins"), F.col("_right").alias("ends")).alias("p"))
    first, second, _ = ends_of(F.col("_left"))
    index = rows.groupBy(first.alias("first"), second.alias("second"), ends_of(F.col("_right"))[2].alias("last"))
    return index.agg(F.array_sort(F.collect_list("p")).alias("patterns"))


def _middle(text: Column, pattern: Column) -> Column:
    """What a text has between the two sides of a pattern, null if they are not its beginning and end."""
    before, behind = F.length(pattern["left"]), F.length(pattern["right"])
    room = F.length(text) - before - behind
    fits = (room > 2) & (folded(text.substr(F.lit(1), before)) == folded(pattern["left"])) & (folded(text.substr(before + room + 1, behind)) == folded(pattern["right"]))
    return F.when(fits, text.substr(before + 1, room))


def _stands(middle: Column) -> Column:
    """Whether a text may stand for a ``*``: white space, at least one character of one line, white space; without patterns where it is not blank."""
    core = trimmed(middle)
    blank = lambda sign: F.lit(BLANK_SIGNS).contains(sign)
    several = reduce(lambda a, b: a | b, [core.contains(e) for e in ENDS])
    beside = blank(middle.substr(F.lit(1), F.lit(1))) & blank(F.right(middle, F.lit(1)))
    return F.coalesce(F.when(core == "", middle.rlike(ALL_BLANK)).otherwise(beside & ~several), F.lit(False))


def inserted(value: Column, captured: Column) -> Column:
    """``value`` with each ``*`` replaced by ``captured``, in which ``$$`` means a dollar sign and ``$&`` the star."""
    meant = F.replace(F.replace(F.replace(captured, F.lit("$$"), F.lit("\ue000")), F.lit("$&"), F.lit("*")), F.lit("\ue000"), F.lit("$"))
    return F.replace(value, F.lit("*"), meant)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where Spark moves a filter on the result below the projections."""
    return F.transform(F.array(value), use)[0]


def with_patterns(df: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """``df`` with ``pattern_value``: that of the first of ``patterns`` (ord, src, value) that the trimmed text matches, or null.

    Case is ignored for letters of any alphabet; white space beside the ``*`` may be of any
    kind and length, elsewhere it must be as in the pattern; what stands for the ``*`` lies
    within one line and is trimmed.
    """
    first, second, last = ends_of(folded(trimmed(F.col(text))))
    rows = df.withColumns({"_first": first, "_second": second, "_last": last})
    index = pattern_index(patterns)
    for name, part in (("_one", index.where("second = ''")), ("_two", index.where("second <> ''"))):
        keys = part.select(F.col("first").alias("_i"), F.col("second").alias("_j"), F.col("last").alias("_k"), F.col("patterns").alias(name))
        same = (F.col("_first") == F.col("_i")) & (F.col("_last") == F.col("_k"))
        rows = rows.join(keys, same & (F.col("_second") == F.col("_j")) if name == "_two" else same, "left").drop("_i", "_j", "_k")
    there = F.when(F.col("_one").isNull(), F.col("_two")).when(F.col("_two").isNull(), F.col("_one")).otherwise(F.concat("_one", "_two"))

    def value(whole: Column) -> Column:
        near = _once(folded(whole), lambda low: F.filter(there, lambda p: low.startswith(p["begins"]) & low.endswith(p["ends"])))
        found = F.array_min(F.filter(near, lambda p: _once(_middle(whole, p), _stands)))
        return _once(found, lambda p: inserted(p["value"], trimmed(_middle(whole, p))))

    # worked out behind the joins, which the text alone goes through, and only where there is a pattern to try
    rows = rows.withColumn("pattern_value", F.when(there.isNotNull(), _once(trimmed(F.col(text)), value)))
    return rows.drop("_first", "_second", "_last", "_one", "_two")


def pattern_rows(spark: SparkSession, patterns: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(i, src, value) for i, (src, value) in enumerate(patterns)], "ord int, src string, value string")


def with_glossary(df: DataFrame, text: str, target_lang: str, glossary: DataFrame, patterns: list[tuple[str, str]] = (), most_words: int = 2, most_chars: int = 30) -> DataFrame:
    """``df`` with ``glossary_value``: '' for blank text, else the entry of a short phrase, else a pattern's, else null.

    Entries with a ``*`` are patterns; those of ``patterns`` come after them.
    """
    own = glossary.where(F.col("target_lang") == target_lang)
    exact = exact_entries(own).select(F.concat(F.lit("phrase "), "norm_src").alias("_phrase"), "glossary_value")
    starred = own.where(F.col("src").contains("*")).select(F.lit(0).alias("_late"), "ord", "src", "value")
    if patterns:
        starred = starred.unionByName(pattern_rows(df.sparkSession, list(patterns)).withColumn("_late", F.lit(1)))
    df = df.withColumn("_norm", normalized(F.col(text)))
    size = utf16_length(F.when(F.col(text) == F.col("_norm"), F.col("_norm")).otherwise(trimmed(F.col(text))))
    short = (F.col("_norm") != "") & (F.size(F.split("_norm", " ")) <= most_words) & (utf16_length(F.col("_norm")) <= most_chars) & (size <= most_chars)
    phrase = F.lower("_norm")
    if exact.limit(MOST_SENT + 1).count() <= MOST_SENT:
        # entries go to the texts, so that a phrase that many rows have, or none, is no single task's
        looked = df.withColumn("_phrase", F.when(short, F.concat(F.lit("phrase "), phrase))).join(F.broadcast(exact), "_phrase", "left").drop("_phrase")
    else:
        # a text that is no short phrase joins on a number of its own, which is no key: nulls would all go to one task; streams cannot number rows
        number = F.xxhash64(text) if df.isStreaming else F.monotonically_increasing_id()
        key = F.when(short, F.concat(F.lit("phrase "), phrase)).otherwise(F.concat(F.lit("row "), number.cast("string")))
        # rows of one phrase are dealt to several tasks, each of which has its entry
        dealt = exact.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
        looked = df.withColumns({"_phrase": key, "_deal": F.pmod(number, F.lit(DEALS).cast("long"))}).join(dealt, ["_phrase", "_deal"], "left").drop("_phrase", "_deal")
    if not starred.isEmpty():
        looked = with_patterns(looked, text, starred.select(F.struct("_late", "ord").alias("ord"), "src", "value"))
        looked = looked.withColumn("glossary_value", F.coalesce("glossary_value", "pattern_value")).drop("pattern_value")
    blank = F.coalesce(F.col("_norm"), F.lit("")) == ""
    return looked.withColumn("glossary_value", F.when(blank, "").otherwise(F.col("glossary_value"))).drop("_norm")
