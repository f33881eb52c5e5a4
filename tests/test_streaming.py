import time

from polyglot_spark.operators import backends
from polyglot_spark.operators.memory import TranslationMemory
from polyglot_spark.streaming import pending
from polyglot_spark.streaming.ingest import localize_stream


def test_stream_of_pages(spark, tmp_path):
    at = {name: str(tmp_path / name) for name in ("in", "memory", "out", "state")}
    for batch in ([(1, "u", "<p>first page</p>")], [(2, "u", "<p>first page</p><p>other words</p>")]):
        spark.createDataFrame(batch, "page_id long, url string, html string").write.mode("append").parquet(at["in"])
        stream = spark.readStream.schema("page_id long, url string, html string").parquet(at["in"])
        localize_stream(stream, "spa_Latn", at["memory"], at["out"], at["state"], backend=backends.pseudo).awaitTermination(120)
    pages = {r.page_id: r.translated_html for r in spark.read.parquet(at["out"]).collect()}
    assert "[spa_Latn] first page" in pages[1] and "[spa_Latn] other words" in pages[2]
    assert TranslationMemory(spark, at["memory"]).entries("spa_Latn").count() == 2


PAGES = "page_id long, url string, html string"


def test_a_pending_unit_is_asked_for_once(spark, tmp_path):
    at = {name: str(tmp_path / name) for name in ("in", "memory", "requests", "answers", "state", "served")}
    asked = lambda: sorted((r.source_text, r.attempt) for r in spark.read.schema(pending.REQUESTS).parquet(at["requests"]).collect())

    def arrive(*pages):
        spark.createDataFrame(list(pages), PAGES).coalesce(1).write.mode("append").parquet(at["in"])
        stream = spark.readStream.schema(PAGES).parquet(at["in"])
        query = pending.request_stream(stream, "spa_Latn", at["requests"], at["answers"], at["state"])
        assert query.awaitTermination(60) and query.exception() is None

    def serve():
        query = pending.answer_stream(spark, "spa_Latn", at["requests"], at["answers"], at["memory"], at["served"], backend=backends.pseudo)
        assert query.awaitTermination(60) and query.exception() is None

    arrive((1, "u", "<p>first words</p><p>common words</p>"), (2, "u", "<p>common words</p><p>common words</p>"))
    arrive((3, "u", "<p>common words</p><p>third words</p>"), (1, "u", "<p>first words</p><p>common words</p>"))  # a restart, a repeated page
    assert asked() == [("common words", 1), ("first words", 1), ("third words", 1)]
    serve()
    arrive((4, "u", "<p>common words</p><p>fourth words</p>"))  # after the answer: known, not asked again
    assert asked() == [("common words", 1), ("first words", 1), ("fourth words", 1), ("third words", 1)]
    serve()
    store = TranslationMemory(spark, at["memory"])
    assert sorted(r.source_text for r in store.entries("spa_Latn").collect()) == ["common words", "first words", "fourth words", "third words"]
    assert store.generations() == [(0, 1), (0, 2)]


def test_a_unit_without_an_answer_is_asked_for_again(spark, tmp_path):
    at = {name: str(tmp_path / name) for name in ("in", "requests", "answers", "state")}
    for n in range(3):
        spark.createDataFrame([(n, "u", f"<p>page {n} words</p><p>slow words</p>")], PAGES).coalesce(1).write.mode("append").parquet(at["in"])
        stream = spark.readStream.schema(PAGES).parquet(at["in"])
        pending.request_stream(stream, "spa_Latn", at["requests"], at["answers"], at["state"], patience_ms=1, most_attempts=2).awaitTermination(60)
        time.sleep(0.1)
    tries = [r.attempt for r in spark.read.parquet(at["requests"]).where("source_text = 'slow words'").collect()]
    assert sorted(tries) == [1, 2]
