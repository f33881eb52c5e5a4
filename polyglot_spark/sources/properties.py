"""Resource files with ``key = value`` lines: reading, classifying and writing them, all native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COMPATIBLE, EngineConfig
from ..functions.text import trimmed

#: Lines of a large file that are joined in one task.
STRETCH = 10_000


def read_files(spark: SparkSession, path: str, config: EngineConfig = COMPATIBLE) -> DataFrame:
    """(filename, content, error) of the resource files under a path; one over the configured size has an error and no content."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".properties"))
    fits = F.col("length") <= config.max_file_bytes
    content = F.when(fits, F.make_valid_utf8(F.col("content").cast("string")))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), content.alias("content"), F.when(~fits, "File too large").alias("error"))


def unquoted(text: Column) -> Column:
    """Trimmed, without a final semicolon and surrounding double quotes."""
    text = trimmed(text)
    text = F.when(text.endswith(";"), trimmed(text.substr(F.lit(1), F.length(text) - 1))).otherwise(text)
    quoted = (F.length(text) >= 2) & text.startswith('"') & text.endswith('"')
    return F.when(quoted, text.substr(F.lit(2), F.length(text) - 2)).otherwise(text)


def parsed(files: DataFrame, content: str = "content", deal: bool = False) -> DataFrame:
    """One row for each line: (…, line_no, type, key, value, raw).

    A line is blank, a comment (it begins with #, ! or //, or has no equals sign) or an
    entry, cut at its first equals sign.  With ``deal`` the lines of a file are dealt to
    all tasks, for few files of many lines.
    """
    others = [c for c in files.columns if c != content]
    lines = files.select(*others, F.posexplode(F.split(F.col(content), r"\r?\n", -1)).alias("line_no", "raw"))
    if deal:
        lines = lines.repartition(*others, "line_no")
    line = trimmed(F.col("raw"))
    comment = line.rlike(r"^(#|!|//)") | ~F.col("raw").contains("=")
    kind = F.when(line == "", "blank").when(comment, "comment").otherwise("entry")
    lines = lines.withColumn("type", kind)
    at = F.instr("raw", "=")
    entry = F.col("type") == "entry"
    return lines.select(
        *others, "line_no", "type",
        F.when(entry, unquoted(F.col("raw").substr(F.lit(1), at - 1))).alias("key"),
        F.when(entry, unquoted(F.col("raw").substr(at + 1, F.length("raw")))).alias("value"),
        "raw",
    )


def joined(lines: DataFrame, file: str, number: str, line: Column, stretch: int | None = None) -> DataFrame:
    """(file, content): the lines of each file in the order of their numbers, null ones left out, joined by line feeds.

    With ``stretch`` lines whose numbers have the same quotient by it are joined first, in tasks of their
    own, so that only such stretches meet in the task of a file: for few files of many lines.
    """
    def content(part: Column, order: str) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.struct(order, part.alias("part"))))["part"], "\n")

    if stretch is None:
        return lines.groupBy(file).agg(content(line, number).alias("content"))
    parts = lines.withColumn("_line", line).groupBy(file, F.floor(F.col(number) / stretch).alias("_stretch"))
    parts = parts.agg(F.when(F.count("_line") > 0, content(F.col("_line"), number)).alias("_part"))
    return parts.groupBy(file).agg(content(F.col("_part"), "_stretch").alias("content"))


def rebuilt(lines: DataFrame, file: str, value: str = "value", stretch: int | None = None) -> DataFrame:
    """(file, content): entries as ``key = value``, other lines as they were, joined by line feeds."""
    line = F.when(F.col("type") == "entry", F.concat(F.col("key"), F.lit(" = "), F.coalesce(F.col(value), F.lit("")))).otherwise(F.col("raw"))
    return joined(lines, file, "line_no", line, stretch)


def text_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(…, line_no, line): trimmed lines of plain text files, empty ones included."""
    others = [c for c in files.columns if c != content]
    lines = files.select(*others, F.posexplode(F.split(F.col(content), r"\r?\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line", trimmed(F.col("line")))


def rebuilt_text(lines: DataFrame, file: str, translated: str = "translated") -> DataFrame:
    """(file, content): lines in order, each translated where a translation is there."""
    rows = F.collect_list(F.struct("line_no", F.coalesce(F.col(translated), F.col("line")).alias("line")))
    return lines.groupBy(file).agg(F.array_join(F.transform(F.array_sort(rows), lambda x: x["line"]), "\n").alias("content"))
