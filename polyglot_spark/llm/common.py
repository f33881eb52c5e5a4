"""Building blocks shared by the training-data operators.

Everything here is plain DataFrame code: reading tables, cutting lineage in the
cluster's shared folder, distributed running sums, dense ranks and connected
components.  No helper collects more than a bounded number of scalars.
"""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of bytes other than space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and cut its lineage in the folder of ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a local session names none (tests, laptops), a temporary one.

    On a cluster without the setting this is an error: other machines would not see a local folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="polyglot-checkpoint-"))
        folder = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


class Scratch:
    """Parquet tables in the cluster's shared folder for the length of one job, deleted at its end or failure."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.folder = spark, [], shared_folder(spark)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.made.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, keep: int = 0) -> None:
        """Delete all tables but the last ``keep``."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        last = len(self.made) - keep
        for path in self.made[:last]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        del self.made[:last]


def words(text) -> F.Column:
    """Array of the words of a text; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def n_words(text) -> F.Column:
    """Number of words, 0 for null, without building the array."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(column) -> F.Column:
    """A reproducible 60-bit key spread evenly over [0, 2**60): the head of the value's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def remainder(doc_id) -> F.Column:
    """crc32 of the id written as text, modulo 5 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def running_total(df: DataFrame, group: str, key: str, value: str, before: str, ties: list[str] = (), rows: int | None = None) -> DataFrame:
    """Add ``before``: the sum of ``value`` over the rows of the same group with a smaller key.

    ``key`` is a long in [0, 2**60) spread evenly inside a group.  Its leading bits
    cut every group into buckets of about a hundred rows; bucket sums are added up
    level by level, at most 256 per window, so that no task ever holds a whole group.
    """
    rows = df.count() if rows is None else rows
    bits = max(1, math.ceil(math.log2(max(2, rows / 128))))
    levels = math.ceil(bits / 8)
    cuts = [bits * i // levels for i in range(levels + 1)]
    part = F.shiftright(F.col(key), 60 - bits)
    level = lambda i: F.shiftright(F.col("_bucket"), bits - cuts[i])
    sums = df.groupBy(group, part.alias("_bucket")).agg(F.sum(value).alias("_sum"))
    base = None
    for i in range(1, levels + 1):
        at = sums.groupBy(group, level(i - 1).alias(f"_k{i - 1}"), level(i).alias(f"_k{i}")).agg(F.sum("_sum").alias("_sum"))
        w = Window.partitionBy(group, f"_k{i - 1}").orderBy(f"_k{i}")
        at = at.withColumn("_in", F.sum("_sum").over(w) - F.col("_sum"))
        if base is None:
            base = at.select(group, f"_k{i}", F.col("_in").alias("_base"))
        else:
            base = at.join(base, [group, f"_k{i - 1}"]).select(group, f"_k{i}", (F.col("_in") + F.col("_base")).alias("_base"))
    base = base.withColumnRenamed(f"_k{levels}", "_bucket")
    w = Window.partitionBy(group, "_bucket").orderBy(key, *ties)
    out = df.withColumn("_bucket", part).join(base, [group, "_bucket"])
    return out.withColumn(before, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(value) + F.col("_base")).drop("_bucket", "_base")


def dense_rank(df: DataFrame, column: str, rank: str) -> DataFrame:
    """Number the rows of ``df`` from 0 in the order of ``column``, nulls last, without a single-task window.

    A range-partitioned sort is materialised with its partition numbers; the offsets
    of the partitions (one row each) then turn local positions into global ones.
    """
    placed = cut(df.orderBy(F.col(column).asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_offset", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(rank, F.col("_at") - F.shiftleft("_part", 33) + F.col("_offset"))
        .drop("_at", "_part", "_offset")
    )


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large and small stars: (node, root) for each node of an edge.

    ``root`` is the smallest node of the component.  The number of rounds is
    logarithmic in the longest path; each round's edges are cut with a checkpoint, and
    so is the side with one row for each node of the joins on hub nodes, which adaptive
    execution can then split.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, mark = cut(e), None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("v")))
        moved = large.join(low.withColumnRenamed("v", "m"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(low.select("u", "v").union(moved).distinct())
    root = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.union(root.select(F.col("root").alias("node"), "root").distinct())
