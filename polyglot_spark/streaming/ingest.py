"""New pages as they arrive: each micro-batch is localized and its new entries join the memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import COMPATIBLE, EngineConfig
from ..operators.memory import TranslationMemory
from ..plans.localize import localize_pages


def localize_stream(pages: DataFrame, target_lang: str, memory_path: str, output_path: str, checkpoint_path: str, *, config: EngineConfig = COMPATIBLE, trigger: dict | None = None, **options) -> StreamingQuery:
    """Start a query that localizes a stream of (page_id, url, html).

    The results of batch n go to ``output_path/batch=n``, written over if the batch is
    repeated after a failure; memory entries are appended after them, and a repeated
    entry changes nothing as the newest of equal keys wins.
    """
    spark = pages.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        store = TranslationMemory(spark, memory_path)
        done, fresh = localize_pages(batch, target_lang, config=config, known=store, **options)
        done.write.mode("overwrite").parquet(f"{output_path}/batch={number}")
        if not fresh.isEmpty():
            store.store(fresh)

    writer = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_path)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
