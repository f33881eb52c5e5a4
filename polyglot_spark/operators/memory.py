"""Translation memory: a bucketed, append-only store with a latest-wins view, asked once for each distinct unit.

Entries are keyed by the hash of the normalized text and the target language.  The store
is partitioned by language and dealt to buckets by the hash, so that a lookup reads one
language and shuffles units only.  Every append is a generation of its own; several
generations of a tier are merged into one of the next tier, so that an entry is rewritten
a logarithmic number of times.  Bloom sketches beside the entries tell which units are new
before anything is joined.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructType
from pyspark.sql.utils import AnalysisException

from ..functions.text import normalized
from . import sketch

SCHEMA = "source_text string, source_hash string, translated_text string, created_at timestamp, version long, target_lang string"
#: A unit is hot if it is more than one in so many; there can be no more hot units than that.
HOT_SHARE = 1000
#: Bytes of a unit's hash that its rows are joined on inside a job; the memory keeps all 32.
JOINED_BYTES = 16
#: Shuffle files of a query go when it ends, and not when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keyed(units: DataFrame, text: str = "text") -> DataFrame:
    return units.withColumn("source_text", normalized(F.col(text))).withColumn("source_hash", F.sha2("source_text", 256))


def latest(log: DataFrame) -> DataFrame:
    """The last version of each key; older ones are dropped before the shuffle where they meet."""
    key = ["source_hash", "target_lang"]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*[c for c in log.columns if c not in key]), "version").alias("_last"))
    return last.select(*key, "_last.*").select(*log.columns)


def hits(units: DataFrame, memory: DataFrame) -> DataFrame:
    return units.join(memory, ["source_hash", "target_lang"], "left_semi")


def misses(units: DataFrame, memory: DataFrame) -> DataFrame:
    return units.join(memory, ["source_hash", "target_lang"], "left_anti")


def looked_up(units: DataFrame, memory: DataFrame) -> DataFrame:
    """``units`` with ``translated_text``, null where the memory has none."""
    return units.join(memory.select("source_hash", "target_lang", "translated_text"), ["source_hash", "target_lang"], "left")


def unit_key(source_hash="source_hash") -> F.Column:
    """The hash as 32 bytes, which are shuffled and joined in place of its 64 digits."""
    return F.unhex(source_hash)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where a local session names none (tests, laptops), a temporary one.

    On a cluster without the setting this is an error: other machines would not see a local folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="polyglot-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run meanwhile leave no shuffle files behind."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


def materialized(df: DataFrame) -> DataFrame:
    """Cut lineage in the checkpoint folder, so that a backend is asked once; the shuffle files behind it go."""
    shared_folder(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a new query, as Spark notes the setting when one is made


class Scratch:
    """Compressed tables in the folder of ``spark.checkpoint.dir``, dealt to folders by ``_deal``; what is left of them goes when the job ends or fails."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.schemas = spark, f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop("")

    def _at(self, name: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(conf), at

    def put(self, df: DataFrame, name: str) -> None:
        """Append rows to a table."""
        empty = [c for c, kind in df.dtypes if kind == "void"]  # files have no such columns
        self.schemas[name] = df.schema
        with shuffles_dropped(self.spark):
            df.drop(*empty).write.mode("append").option("compression", "zstd").partitionBy("_deal").parquet(f"{self.folder}/{name}")

    def get(self, name: str) -> DataFrame:
        """What there is of a table now."""
        schema = self.schemas[name]
        kept = StructType([f for f in schema if f.dataType != NullType()])
        found = self.spark.read.schema(kept).parquet(f"{self.folder}/{name}")
        return found.select(*[F.lit(None).alias(f.name) if f.dataType == NullType() else F.col(f"`{f.name}`") for f in schema])

    def size(self, name: str) -> int:
        files, at = self._at(name)
        return files.getContentSummary(at).getLength()

    def drop(self, name: str, deals: Iterable[int] = ()) -> None:
        """Delete a table, or its rows of some deals."""
        for part in [f"{name}/_deal={d}" for d in deals] or [name]:
            files, at = self._at(part)
            files.delete(at, True)


class TranslationMemory:
    """A memory at a path; one writer at a time.

    ``buckets`` is fixed when the memory is made.  Readers that run while generations are
    merged may miss files: merge between jobs.  A merge that breaks off leaves entries
    twice, which changes nothing, as the newest of equal keys wins.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.made_with = buckets

    # --- folders ---

    def _at(self, name: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(conf), at

    def _settings(self) -> dict | None:
        files, at = self._at("memory.json")
        return json.loads("\n".join(r[0] for r in self.spark.read.text(str(at)).collect())) if files.exists(at) else None

    def _made(self) -> int:
        """Number of buckets of the memory, which is made if it is not there."""
        found = self._settings()
        if found is None:
            found = {"buckets": self.made_with or int(self.spark.conf.get("spark.sql.shuffle.partitions"))}
            files, at = self._at("memory.json")
            out = files.create(at, False)
            out.write(bytearray(json.dumps(found).encode()))
            out.close()
            for name in ("entries", "sketches"):
                files.mkdirs(self._at(name)[1])
        return found["buckets"]

    def generations(self) -> list[tuple[int, int]]:
        """(tier, number) of the generations there are."""
        files, at = self._at("entries")
        if not files.exists(at):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return sorted(tuple(int(x) for x in n.removeprefix("gen=").split("-")) for n in names if n.startswith("gen="))

    # --- reading ---

    def _table(self) -> str:
        """The entries as a bucketed table of the session's catalog, with the generations of now."""
        buckets, name = self._made(), "polyglot_memory_" + hashlib.md5(self.path.encode()).hexdigest()
        place = f"{self.path}/entries".replace("'", "''")
        try:
            known = self.spark.table(name).columns
        except AnalysisException:
            known = None
        if known is not None:
            self.spark.sql(f"DROP TABLE {name}")  # external: its files stay
        self.spark.sql(
            f"CREATE TABLE {name} (unit_key BINARY, source_text STRING, translated_text STRING, created_at TIMESTAMP, version BIGINT, gen STRING, target_lang STRING) "
            f"USING parquet PARTITIONED BY (gen, target_lang) CLUSTERED BY (unit_key) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
        self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        return name

    def keyed_entries(self, target_lang: str) -> DataFrame:
        """(unit_key, translated_text, version) of a language, the latest of each key: no row leaves its bucket for it."""
        log = self.spark.table(self._table()).where(F.col("target_lang") == target_lang)
        last = log.groupBy("unit_key").agg(F.max_by(F.struct("translated_text", "version"), "version").alias("_last"))
        return last.select("unit_key", "_last.translated_text", "_last.version")

    def log(self) -> DataFrame:
        if not self.generations():
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.table(self._table()).withColumn("source_hash", F.lower(F.hex("unit_key")))
        return rows.select("source_text", "source_hash", "translated_text", "created_at", "version", "target_lang")

    def entries(self, target_lang: str | None = None) -> DataFrame:
        log = self.log()
        return latest(log if target_lang is None else log.where(F.col("target_lang") == target_lang))

    def sketches(self, target_lang: str) -> DataFrame:
        files, at = self._at("sketches")
        if not files.exists(at) or not self.generations():
            return self.spark.createDataFrame([], sketch.SCHEMA)
        rows = self.spark.read.schema(sketch.SCHEMA + ", gen string, target_lang string").parquet(f"{self.path}/sketches")
        return rows.where(F.col("target_lang") == target_lang).select("unit_key", "n", "bits")

    def lookup(self, units: DataFrame, target_lang: str, prefilter: bool = True) -> DataFrame:
        """``units`` (with ``unit_key``) and their ``translated_text``, null where the memory has none.

        With ``prefilter`` units that no sketch has are known to be new and take no part in the join.
        """
        if not self.generations():
            return units.withColumn("translated_text", F.lit(None).cast("string"))
        entries = self.keyed_entries(target_lang).select("unit_key", "translated_text")
        if not prefilter:
            return units.join(entries, "unit_key", "left").select(*units.columns, "translated_text")
        asked = sketch.tested(units, self.sketches(target_lang), self._made())
        fresh = F.when(F.col("maybe_known"), F.col("unit_key"))  # new units join on nothing
        joined = asked.withColumn("_ask", fresh).join(entries.withColumnRenamed("unit_key", "_entry"), F.col("_ask") == F.col("_entry"), "left")
        return joined.select(*units.columns, "translated_text")

    # --- writing ---

    def _append(self, rows: DataFrame, generation: tuple[int, int]) -> None:
        """(unit_key, source_text, translated_text, created_at, version, target_lang) as a generation, one file for each bucket and language, and its sketches."""
        gen, buckets = f"{generation[0]}-{generation[1]:09}", self._made()
        dealt = rows.repartition(buckets, "unit_key").withColumn("gen", F.lit(gen))
        dealt.select("unit_key", "source_text", "translated_text", "created_at", "version", "gen", "target_lang").write.insertInto(self._table())
        written = self.spark.table(self._table()).where(F.col("gen") == gen)
        for lang in [r[0] for r in written.select("target_lang").distinct().collect()]:  # partitions: languages of one append
            one = written.where(F.col("target_lang").eqNullSafe(F.lit(lang)))
            made = sketch.built(one, buckets).withColumns({"gen": F.lit(gen), "target_lang": F.lit(lang)})
            made.write.mode("append").partitionBy("gen", "target_lang").parquet(f"{self.path}/sketches")

    def store(self, translated: DataFrame) -> None:
        """Append (source_text, source_hash, target_lang, translated_text); the newest entry of a key wins."""
        number = max((n for _, n in self.generations()), default=0) + 1
        rows = translated.withColumns({"unit_key": unit_key(), "created_at": F.current_timestamp(), "version": F.lit(number).cast("long")})
        self._append(rows, (0, number))

    def merge(self, fan: int = 4) -> int:
        """Merge generations where a tier has ``fan`` or more; the number of merges."""
        merges = 0
        while True:
            tiers: dict[int, list[int]] = {}
            for tier, number in self.generations():
                tiers.setdefault(tier, []).append(number)
            full = [t for t, numbers in sorted(tiers.items()) if len(numbers) >= fan]
            if not full:
                return merges
            tier, numbers = full[0], tiers[full[0]]
            old = [f"{tier}-{n:09}" for n in numbers]
            rows = self.spark.table(self._table()).where(F.col("gen").isin(old))
            last = rows.groupBy("unit_key", "target_lang").agg(F.max_by(F.struct("source_text", "translated_text", "created_at", "version"), "version").alias("_last"))
            self._append(last.select("unit_key", "_last.*", "target_lang"), (tier + 1, max(numbers)))
            for name in ("sketches", "entries"):
                for gen in old:
                    files, at = self._at(f"{name}/gen={gen}")
                    files.delete(at, True)
            merges += 1

    def compact(self, path: str) -> TranslationMemory:
        """The latest entries as a new memory at another path."""
        copy = TranslationMemory(self.spark, path, self._made())
        copy._append(self.entries().withColumn("unit_key", unit_key()), (0, 1))
        return copy

    def delete(self) -> None:
        """Remove the memory with all it holds."""
        self.spark.sql(f"DROP TABLE IF EXISTS polyglot_memory_{hashlib.md5(self.path.encode()).hexdigest()}")
        files, at = self._at("")
        files.delete(at, True)


def scratch_memory(spark: SparkSession, buckets: int | None = None) -> TranslationMemory:
    """A new memory in the folder of ``spark.checkpoint.dir``, for the length of a job."""
    return TranslationMemory(spark, f"{shared_folder(spark).rstrip('/')}/memory-{uuid.uuid4().hex}", buckets)


def distinct_units(units: DataFrame, texts: bool = True) -> DataFrame:
    """(unit_key[, source_text], n) of keyed units: one row for each text, with its number of occurrences, counted before they meet."""
    units = units.where("source_text is not null")
    if not texts:
        return units.groupBy(unit_key().alias("unit_key")).agg(F.count(F.lit(1)).alias("n"))
    counted = units.groupBy("source_text").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(unit_key(F.sha2("source_text", 256)).alias("unit_key"), "source_text", "n")


def answered(units: DataFrame, answers: DataFrame, share: int = HOT_SHARE, cut: tuple[int, int] = (0, 1)) -> DataFrame:
    """Keyed ``units`` with the ``translated_text`` of ``answers`` (unit_key, n, translated_text), null where there is none.

    Units of one text meet in a task.  Texts that make up more than one in ``share`` of all
    units, at most ``share`` of them, are therefore looked up in a broadcast table instead,
    and their rows are dealt evenly.  With ``cut`` (i, k) only the rows of the i-th of k
    parts of the keys are given, so that a caller who takes one part after the other shuffles less at a time.
    """
    total = answers.agg(F.sum("n")).first()[0] or 0
    hot = answers.where(F.col("n") > max(total / share, 1)).select(F.col("unit_key").alias("_hot_key"), F.struct("translated_text").alias("_hot"))
    rows = units.withColumn("_key", unit_key()).join(F.broadcast(hot), F.col("_key") == F.col("_hot_key"), "left").drop("_hot_key")
    short = lambda key: F.substring(key, 1, JOINED_BYTES)
    rest = answers.select(short("unit_key").alias("_rest_key"), F.col("translated_text").alias("_rest"))
    i, k = cut
    if k > 1:
        part = lambda key: F.pmod(F.xxhash64(key), F.lit(k))
        rows = rows.where(F.when(F.col("_hot").isNotNull(), F.lit(0)).otherwise(F.coalesce(part(short("_key")), F.lit(0))) == i)
        rest = rest.where(part(F.col("_rest_key")) == i)
    # a row that has its answer joins on a number of its own, which is no key
    rows = rows.withColumn("_key", F.when(F.col("_hot").isNull(), short("_key")).otherwise(F.unhex(F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))))
    out = rows.join(rest, F.col("_key") == F.col("_rest_key"), "left")
    text = F.when(F.col("_hot").isNotNull(), F.col("_hot.translated_text")).otherwise(F.col("_rest"))
    return out.withColumn("translated_text", text).drop("_key", "_hot", "_rest_key", "_rest")


def asked(wanted: DataFrame, memory: DataFrame | TranslationMemory | None, backend, target_lang: str, later: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, new entries, all that is known) for ``wanted``, a table of ``distinct_units``.

    The memory is read once, the backend asked once for each miss.  Answers are (unit_key, n,
    translated_text); what is known is (source_hash, target_lang, translated_text) and may be given
    as the memory of a later call, whose keyed units are ``later``: only their keys are looked up now.
    Without a memory all units are misses, and only the backend's answers are kept.
    """
    lang = F.lit(target_lang).alias("target_lang")
    found = None
    if isinstance(memory, DataFrame) or memory is not None and memory.generations():
        if later is not None:
            keys = later.where("source_hash is not null").select(unit_key().alias("unit_key"), F.lit(None).cast("string").alias("source_text"), F.lit(0).cast("long").alias("n"))
            wanted = wanted.unionByName(keys).groupBy("unit_key").agg(F.first("source_text", ignorenulls=True).alias("source_text"), F.sum("n").alias("n"))
        if isinstance(memory, TranslationMemory):
            found = memory.lookup(wanted, target_lang)
        else:
            there = memory.where(F.col("target_lang") == target_lang).select(unit_key().alias("unit_key"), "translated_text")
            found = wanted.join(there, "unit_key", "left")
        found = materialized(found.select("unit_key", "source_text", "n", "translated_text"))
        wanted = found.where("translated_text is null and n > 0")
    new = backend(wanted.select("source_text", F.lower(F.hex("unit_key")).alias("source_hash"), lang, "n"), "source_text", "translated_text", target_lang)
    # the hash is that of the text, which is kept alone
    fresh = materialized(new.select("source_text", "n", "translated_text")).select("source_text", F.sha2("source_text", 256).alias("source_hash"), lang, "n", "translated_text")
    answers = fresh.select(unit_key().alias("unit_key"), "n", "translated_text")
    known = fresh.select("source_hash", "target_lang", "translated_text")
    if found is not None:
        hit = found.where("translated_text is not null")
        answers = hit.where("n > 0").select("unit_key", "n", "translated_text").unionByName(answers)
        known = hit.select(F.lower(F.hex("unit_key")).alias("source_hash"), lang, "translated_text").unionByName(known)
    return answers, fresh.drop("n"), known


def translate(units: DataFrame, memory: DataFrame | TranslationMemory | None, backend, target_lang: str) -> tuple[DataFrame, DataFrame]:
    """(units with ``translated_text``, new entries): the memory first, the backend once for each distinct miss."""
    units = keyed(units).withColumn("target_lang", F.lit(target_lang))
    answers, fresh, _ = asked(distinct_units(units), memory, backend, target_lang)
    return answered(units, answers), fresh
