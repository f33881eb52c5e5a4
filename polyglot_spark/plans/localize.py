"""The localization pipeline: units in, translated units out, and its two front ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import COMPATIBLE, EngineConfig
from ..functions import text as tx
from ..functions import tokens as tk
from ..functions.languages import in_target_script
from ..functions.quality import with_scores
from ..functions.urls import url_verdict
from ..operators import html_segments, memory
from ..operators.backends import Backend, identity
from ..operators.glossary import with_glossary
from ..operators.memory import materialized
from ..sources import properties

#: Rows are put together in so many deals, one after the other, and their units answered in so many cuts of the keys, so
#: that the shuffle files of one are there at a time; tables of fewer compressed bytes are done at once.
DEALS, CUTS, SMALL = 8, 3, 16 << 20
#: Most units of the second pass whose 64-bit hashes are sent to what is known, so that only that is shuffled which they may ask for.
MOST_SENT = 1_000_000


def polished(df: DataFrame, column: str, pick, hook: Backend | None, before: str, lang: str) -> DataFrame:
    """A hook (fluency, tone) applied to the picked rows, value placeholders protected; without a hook the text stays."""
    if hook is None:
        return df
    kept = tk.originals(F.col(column), tk.TEXT_PLACEHOLDER)
    marked = df.withColumns({"_pick": pick, "_kept": kept, "_send": tk.protected(F.col(column), tk.TEXT_PLACEHOLDER, before)})
    done = hook(marked.where("_pick"), "_send", "_back", lang).withColumn(column, tk.restored(F.coalesce("_back", "_send"), F.col("_kept"), before))
    return done.drop("_back").unionByName(marked.where("not coalesce(_pick, false)")).drop("_pick", "_kept", "_send")


def localized(
    units: DataFrame, keys: list[str], target_lang: str, *, backend: Backend = identity, known: DataFrame | memory.TranslationMemory | None = None, glossary: DataFrame | None = None,
    patterns: list[tuple[str, str]] = (), brands: list[str] = (), fluency: Backend | None = None, tone: Backend | None = None, config: EngineConfig = COMPATIBLE,
    carry: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(``units`` with ``translated`` and first-pass scores, new memory entries) for texts in column ``text``.

    Stages: brands protected, glossary, long texts split, memory and backend, parts joined,
    brands restored, scores against the source, one more pass for flagged units (unsplit),
    tone.  A null text is treated as blank and gives ''.

    ``carry`` names the columns of ``units`` that are wanted back, all if it is not given: texts that
    are not wanted are kept no longer than the job needs them.
    Every row of ``units`` gives one row: rows are told apart by a number of their own, so
    that ``keys``, which name a unit for the caller, may repeat or be null.  The memory is
    read once, for the units of both passes.
    """
    spark, carry = units.sparkSession, units.columns if carry is None else list(carry)
    units = units.select(*dict.fromkeys([*carry, "text"]))
    fluency, tone = fluency if config.fluency_correction else None, tone if config.tone_normalization else None
    glossary = spark.createDataFrame([], "target_lang string, ord int, src string, value string") if glossary is None else glossary
    own = F.coalesce(F.col("text"), F.lit(""))
    marked = units.withColumn("_brand", tk.brands_protected(own, list(brands), config.brand_edges))
    marked = marked.withColumns({"_branded": F.col("_brand.text"), "_found": F.col("_brand.found")}).drop("_brand")
    looked = with_glossary(marked, "_branded", target_lang, glossary, list(patterns), config.short_words, config.short_chars)
    # a text without brands is kept once
    looked = looked.withColumn("_branded", F.when(F.col("_branded") != own, F.col("_branded"))).withColumn("_row", F.monotonically_increasing_id())
    branded, deal = F.coalesce("_branded", "text", F.lit("")), F.pmod("_row", F.lit(DEALS)).cast("int").alias("_deal")

    def ask(fresh: DataFrame, source: str, result: str, lang: str) -> DataFrame:
        out = backend(fresh, source, result, lang)
        return polished(out, result, tx.word_count(F.col(result)) > config.fluency_min_words, fluency, "FLUENCY_TOKEN_", lang)

    once_more = F.coalesce(F.col("flagged") if config.retry_scope == "all" else F.col("flagged") & F.col("glossary_value").isNull(), F.lit(False))
    spare = [c for c in ("text", "_branded", "_found") if c != "text" or "text" not in carry and tone is None]
    with memory.Scratch(spark) as scratch:
        scratch.put(looked.select("*", deal), "rows")
        small = scratch.size("rows") < SMALL
        rows = scratch.get("rows")
        todo = rows.where("glossary_value is null").select("_row", F.posexplode(tx.units(branded, config.split_min_chars)).alias("part", "text"))
        todo, whole = memory.keyed(todo), memory.keyed(rows.select("_row", branded.alias("text")))
        first, fresh, found = memory.asked(memory.distinct_units(todo), known, ask, target_lang, later=whole)
        cuts = 1 if small else CUTS
        for i in range(cuts):
            scratch.put(memory.answered(todo, first, cut=(i, cuts)).select("_row", "part", "translated_text", deal), "parts")
        scored = []
        for deals in [range(DEALS)] if small else [[d] for d in range(DEALS)]:
            looked, parts = (scratch.get(name).where(F.col("_deal").isin(list(deals))).drop("_deal") for name in ("rows", "parts"))
            pieces = F.transform(F.array_sort(F.collect_list(F.struct("part", "translated_text"))), lambda x: x["translated_text"])
            joined = parts.groupBy("_row").agg(pieces.alias("_pieces"))
            together = F.when(F.size("_pieces") > 1, tx.trimmed(F.array_join("_pieces", " "))).otherwise(F.element_at("_pieces", 1))
            joined = joined.select("_row", together.alias("_model"))
            done = looked.join(joined, "_row", "left").withColumn("translated", tk.brands_restored(F.coalesce("glossary_value", "_model", F.lit("")), F.col("_found"), config.brand_restore))
            done = with_scores(done.drop("_row", "_model"), "text", "translated", config)
            scored.append(materialized(done.withColumns({c: F.when(once_more, F.col(c)) for c in spare})))
            for name in ("rows", "parts"):
                scratch.drop(name, deals)
    scored = reduce(DataFrame.unionByName, scored)

    # only the rows that are sent again are shuffled again
    again = memory.keyed(scored.where(once_more).select(F.struct("*").alias("_all"), branded.alias("text")))
    wanted = materialized(memory.distinct_units(again))
    if wanted.count() <= MOST_SENT:
        found = found.withColumn("_hash", F.xxhash64("source_hash")).join(F.broadcast(wanted.select(F.xxhash64(F.lower(F.hex("unit_key"))).alias("_hash"))), "_hash", "left_semi").drop("_hash")
    second, more, _ = memory.asked(wanted, found, ask, target_lang)
    again = memory.answered(again, second).select("_all.*", F.col("translated_text").alias("_again"))
    better = F.when(F.col("_again").isNotNull(), tk.brands_restored(F.col("_again"), F.col("_found"), config.brand_restore)).otherwise(F.col("translated"))
    out = again.withColumn("translated", better).drop("_again").unionByName(scored.where(~once_more))
    pick = tx.interface_command(F.col("text"), config.command_words, config.command_chars) & ~tx.blank(F.col("translated"))
    out = polished(out, "translated", pick, tone, "UITONE_TOKEN_", target_lang)
    columns = [*carry, "translated", "bleu", "chrf", "length_score", "confidence", "flagged"]
    return out.select(*columns), fresh.unionByName(more)


def page_status(requests: DataFrame, config: EngineConfig = COMPATIBLE) -> DataFrame:
    """All columns of ``requests`` (url, html, target_lang) plus (status, error): 200, or what is wrong first.

    400: no language, no URL or one that may not be fetched; 502: no page came back.
    """
    verdict = url_verdict(F.col("url"), config)["error"]
    # fixed values: the texts of the errors
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    bad = F.when(missing("target_lang"), "Missing targetLang").when(missing("url"), "Missing url").otherwise(verdict)
    page = F.when(missing("html"), "Invalid HTML received")
    return requests.withColumns({"status": F.when(bad.isNotNull(), 400).when(page.isNotNull(), 502).otherwise(200), "error": F.coalesce(bad, page)})


def file_status(requests: DataFrame) -> DataFrame:
    """All columns of ``requests`` (filename, content, target_lang) plus (status, error): 200, or what is wrong first."""
    # fixed values: the texts of the errors
    kind = F.when(~F.lower("filename").endswith(".properties"), "Only .properties files are allowed")
    bad = F.when(F.col("content").isNull(), "No file uploaded").when(F.coalesce("target_lang", F.lit("")) == "", "Missing target language (targetLang)")
    return requests.withColumns({"status": F.when(kind.isNotNull(), 500).when(bad.isNotNull(), 400).otherwise(200), "error": F.coalesce(kind, bad)})


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a number of their own, which stays."""
    return materialized(rows.withColumn(name, F.monotonically_increasing_id()))


def localize_pages(pages: DataFrame, target_lang: str, *, config: EngineConfig = COMPATIBLE, **options) -> tuple[DataFrame, DataFrame]:
    """(page_id, source_html, translated_html, rtl, warning) of every page, and new memory entries; ids may repeat or be null."""
    own = numbered(pages.select("page_id", "html"), "_page")
    found = materialized(html_segments.segments(own, key="_page", config=config))
    done, fresh = localized(found, ["_page", "seq"], target_lang, config=config, **options)
    return html_segments.rebuilt(own, done, target_lang, key="_page", carry=["page_id"], config=config).drop("_page"), fresh


def localize_properties(files: DataFrame, target_lang: str, *, config: EngineConfig = COMPATIBLE, **options) -> tuple[DataFrame, DataFrame]:
    """(filename, content, download_name) of resource files, and new memory entries; ``files`` has filename and content, names may repeat."""
    own = numbered(files.select("filename", "content"), "_file")
    lines = materialized(properties.parsed(own.drop("filename"), deal=True))
    todo = (F.col("type") == "entry") & ~in_target_script(F.col("value"), target_lang)
    kept = tk.originals(F.col("value"), tk.FILE_PLACEHOLDER)
    units = lines.where(todo).select("_file", "line_no", kept.alias("_kept"), tk.protected(F.col("value"), tk.FILE_PLACEHOLDER, "__PH", "__").alias("text"))
    done, fresh = localized(units, ["_file", "line_no"], target_lang, config=config, carry=["_file", "line_no", "_kept"], **options)
    done = done.select("_file", "line_no", tk.restored_loosely(F.col("translated"), F.col("_kept")).alias("_done"))
    merged = lines.join(done, ["_file", "line_no"], "left").withColumn("value", F.coalesce("_done", "value"))
    content = own.select("_file", "filename").join(properties.rebuilt(merged, "_file", stretch=properties.STRETCH), "_file", "left").drop("_file")
    return content.withColumn("download_name", tx.download_name(F.col("filename"), F.lit(target_lang))), fresh
