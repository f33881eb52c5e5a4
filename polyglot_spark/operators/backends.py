"""Translation backends: functions (df, source column, result column, target language) -> df."""

from __future__ import annotations

import logging
import math
import queue
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Backend = Callable[[DataFrame, str, str, str], DataFrame]


def identity(df: DataFrame, source: str, result: str, target_lang: str) -> DataFrame:
    return df.withColumn(result, F.col(source))


def pseudo(df: DataFrame, source: str, result: str, target_lang: str) -> DataFrame:
    """Marks text as translated without changing it: for tests and layout checks."""
    blank = F.coalesce(F.trim(F.col(source)), F.lit("")) == ""
    return df.withColumn(result, F.when(blank, "").otherwise(F.concat(F.lit(f"[{target_lang}] "), F.col(source))))


def dictionary(entries: DataFrame) -> Backend:
    """Whole texts looked up in a table (source_text, target_lang, value); unknown texts stay."""

    def run(df: DataFrame, source: str, result: str, target_lang: str) -> DataFrame:
        known = entries.where(F.col("target_lang") == target_lang).select(F.col("source_text").alias(source), F.col("value").alias("_value"))
        return df.join(known, source, "left").withColumn(result, F.coalesce("_value", source)).drop("_value")

    return run


class Pace:
    """When the next call may be made, for calls of one worker process, whichever tasks they are made in."""

    last: dict[str, float] = {}

    def __init__(self, name: str, seconds: float):
        self.name, self.seconds = name, seconds

    def wait(self) -> None:
        now = time.monotonic()
        free = max(now, self.last.get(self.name, -math.inf) + self.seconds)
        self.last[self.name] = free
        if free > now:
            time.sleep(free - now)


def within(call: Callable[[], Sequence[str]], deadline: float | None) -> Sequence[str]:
    """The result of a call, which is given up after ``deadline`` seconds: a call that hangs keeps its thread, not its task."""
    if deadline is None:
        return call()
    answer: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            answer.put((call(), None))
        except Exception as e:
            answer.put((None, e))

    threading.Thread(target=run, daemon=True).start()
    try:
        out, wrong = answer.get(timeout=deadline)
    except queue.Empty:
        raise TimeoutError(f"no answer in {deadline} s") from None
    if wrong is not None:
        raise wrong
    return out


def batches(
    *translators: Callable[[Sequence[str], str], Sequence[str]], failures: str | None = None, size: int | None = None, calls_a_second: float | None = None,
    deadline: float | None = None, attempts: int = 1, first_wait: float = 0.5,
) -> Backend:
    """Models called with a batch of texts; the next one is asked if one fails or returns another number of texts.

    If all fail the texts are returned as they are.  A model is loaded where it is called,
    once for each worker; blank texts give '' and are not sent.  With ``failures``, a column of
    that name says what went wrong with the models asked in vain, null if nothing did;
    otherwise workers write it to their logs.

    ``size`` is the most texts of a call.  ``calls_a_second`` holds for the whole cluster: each of the tasks that
    can run at once has its share.  A call without an answer in ``deadline`` seconds has failed.  A model that fails
    is asked ``attempts`` times in all, after waits that begin with ``first_wait`` seconds and double.
    """

    def run(df: DataFrame, source: str, result: str, target_lang: str) -> DataFrame:
        schema = T.StructType([f for f in df.schema if f.name not in (result, failures)]).add(result, "string")
        schema = schema.add(failures, "string") if failures else schema
        at_once = df.sparkSession.sparkContext.defaultParallelism
        name = uuid.uuid4().hex

        def ask(texts: list[str]) -> tuple[list[str], str | None]:
            wrong, pace = [], Pace(name, at_once / calls_a_second) if calls_a_second else None
            for k, translate in enumerate(translators):
                for attempt in range(attempts):
                    if attempt:
                        time.sleep(first_wait * 2 ** (attempt - 1))
                    if pace:
                        pace.wait()
                    try:
                        out = list(within(lambda f=translate: f(texts, target_lang), deadline))
                    except Exception as e:
                        wrong.append(f"{k}: {type(e).__name__}: {e}")
                        continue
                    if len(out) == len(texts):
                        return [t if o is None else o for t, o in zip(texts, out, strict=True)], "; ".join(wrong) or None
                    wrong.append(f"{k}: {len(out)} texts for {len(texts)}")
            return texts, "; ".join(wrong) or None

        def ask_all(texts: list[str]) -> tuple[list[str], list[str | None]]:
            out, wrong, step = [], [], size or max(1, len(texts))
            for i in range(0, len(texts), step):
                some, why = ask(texts[i : i + step])
                out += some
                wrong += [why] * len(some)
            return out, wrong

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                texts = [t or "" for t in frame[source]]
                out, wrong = ask_all([t for t in texts if t.strip()])
                answer, why = iter(out), iter(wrong)
                frame = frame.drop(columns=[result], errors="ignore")
                if failures:
                    frame[failures] = [next(why) if t.strip() else None for t in texts]
                elif any(wrong):
                    logging.getLogger(__name__).warning("models asked in vain: %s", sorted({w for w in wrong if w}))
                frame[result] = [next(answer) if t.strip() else "" for t in texts]
                yield frame[schema.names]

        return df.mapInPandas(work, schema)

    return run
