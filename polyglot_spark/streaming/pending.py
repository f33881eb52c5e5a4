"""Units asked for once, while their answers are pending: keyed state over a stream of pages and a stream of answers.

Pages that arrive in one micro-batch after another share units.  The state of a unit
remembers that it has been asked for, so that a later page asks for nothing new; an answer
ends the waiting, and a unit that has waited too long is asked for again.  The requests go
to a log that a backend is run on, at its own pace; its answers go to the memory and, as a
stream, back to the state.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import COMPATIBLE, EngineConfig
from ..functions import text as tx
from ..functions import tokens as tk
from ..operators import html_segments, memory
from ..operators.backends import Backend
from ..operators.glossary import with_glossary

REQUESTS = "source_hash string, target_lang string, source_text string, attempt int"
ANSWERS = "source_hash string, target_lang string"
#: Units that a task remembers while it drops the repeated ones of its part of a micro-batch.
REMEMBERED = 100_000
STORE, EMPTY_BATCHES = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_units(pages: DataFrame, target_lang: str, *, glossary: DataFrame | None = None, brands: list[str] = (), config: EngineConfig = COMPATIBLE) -> DataFrame:
    """(source_hash, target_lang, source_text) of the units that pages, a table or a stream, ask a backend for."""
    found = html_segments.segments(pages, config=config).withColumn("_text", tk.brands_protected(F.coalesce("text", F.lit("")), list(brands), config.brand_edges)["text"])
    if glossary is not None:
        found = with_glossary(found, "_text", target_lang, glossary, (), config.short_words, config.short_chars).where("glossary_value is null")
    units = memory.keyed(found.select(F.explode(tx.units(F.col("_text"), config.split_min_chars)).alias("text")))
    return units.where("source_text <> ''").select("source_hash", F.lit(target_lang).alias("target_lang"), "source_text")


def first_of_each(units: DataFrame) -> DataFrame:
    """Units without those that a task has just seen, so that a text of every page is not sent to its state by every page."""

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[tuple, None] = OrderedDict()
        for batch in batches:
            keep = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(key not in seen)
                seen[key] = None
                seen.move_to_end(key)
                if len(seen) > REMEMBERED:
                    seen.popitem(last=False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return units.mapInArrow(drop, T.StructType([T.StructField(f.name, f.dataType) for f in units.schema]))  # all nullable, as the state's keys must stay


class AskOnce(StatefulProcessor):
    """State of a unit: when and how often it was asked for, and whether it was answered."""

    def __init__(self, patience_ms: int, most_attempts: int):
        self.patience_ms, self.most_attempts = patience_ms, most_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "source_text string, attempt int, answered boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = self.asked.get()  # a tuple, or None for a unit that is new
        text, answered = (old[0], old[2]) if old else (None, False)
        wanted = False
        for row in rows:
            answered |= row.answered
            wanted |= not row.answered
            text = text if row.source_text is None else row.source_text
        attempt = old[1] if old else 0
        if wanted and not answered and not attempt:
            attempt = 1
            self._remind(timerValues)
            yield Row(source_hash=key[0], target_lang=key[1], source_text=text, attempt=attempt)
        if answered:
            self._forget_timers()
        self.asked.update((None if answered else text, attempt, answered))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        old = self.asked.get()
        if old and not old[2] and old[1] < self.most_attempts:
            self.asked.update((old[0], old[1] + 1, False))
            self._remind(timerValues)
            yield Row(source_hash=key[0], target_lang=key[1], source_text=old[0], attempt=old[1] + 1)

    def _remind(self, timerValues) -> None:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, (tuple, Row)) else at)

    def close(self) -> None:
        pass


def requests(units: DataFrame, answers: DataFrame, patience_ms: int = 600_000, most_attempts: int = 5) -> DataFrame:
    """A stream of ``REQUESTS`` from streams of units and of answers: each unit once until it is answered.

    An answer may come before the unit does.  A unit without an answer is asked for again
    after each ``patience_ms``, ``most_attempts`` times in all.  The state has one row for each
    distinct unit, which keeps its text only while it waits.
    """
    asks = first_of_each(units.select("source_hash", "target_lang", "source_text")).withColumn("answered", F.lit(False))
    ends = answers.select("source_hash", "target_lang", F.lit(None).cast("string").alias("source_text"), F.lit(True).alias("answered"))
    keyed = asks.unionByName(ends).groupBy("source_hash", "target_lang")
    return keyed.transformWithState(AskOnce(patience_ms, most_attempts), REQUESTS, "append", "processingTime")


def request_stream(pages: DataFrame, target_lang: str, requests_path: str, answers_path: str, checkpoint_path: str, *, patience_ms: int = 600_000, most_attempts: int = 5, trigger: dict | None = None, **options) -> StreamingQuery:
    """Start a query that appends the units of a stream of pages to the log of requests, each once while it is pending."""
    spark, trigger = pages.sparkSession, trigger or {"availableNow": True}
    folder(spark, answers_path)
    answers = spark.readStream.schema(ANSWERS).parquet(answers_path)
    asked = requests(page_units(pages, target_lang, **options), answers, patience_ms, most_attempts)
    writer = asked.writeStream.format("parquet").option("path", requests_path).option("checkpointLocation", checkpoint_path).outputMode("append")
    # a query keeps the settings that it is started with: the store that keyed state needs, and batches without data,
    # in which timers run out, only where it goes on for ever
    own = {STORE: ROCKS, EMPTY_BATCHES: str("availableNow" not in trigger).lower()}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        return writer.trigger(**trigger).start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def answer_stream(spark: SparkSession, target_lang: str, requests_path: str, answers_path: str, memory_path: str, checkpoint_path: str, *, backend: Backend, trigger: dict | None = None) -> StreamingQuery:
    """Start a query that runs the backend on new requests, puts the results in the memory and reports them as answered.

    The batch that a failure interrupts is done again: the newest of equal entries wins, and an answer
    told twice is one answer.
    """

    def run(batch: DataFrame, number: int) -> None:
        wanted = batch.where(F.col("target_lang") == target_lang).select("source_text", "source_hash", "target_lang").dropDuplicates(["source_hash"])
        done = memory.materialized(backend(wanted, "source_text", "translated_text", target_lang)).where("translated_text is not null")
        if not done.isEmpty():
            memory.TranslationMemory(spark, memory_path).store(done)
            done.select("source_hash", "target_lang").write.mode("append").parquet(answers_path)

    writer = spark.readStream.schema(REQUESTS).parquet(requests_path).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_path)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def folder(spark: SparkSession, path: str) -> None:
    """Make a folder, so that a stream can be read from it before anything is there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
