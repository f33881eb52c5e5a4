import os
import re
import time
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polyglot_spark.config import COMPATIBLE, EngineConfig
from polyglot_spark.functions.dom import Scanner, parse, serialized
from polyglot_spark.operators import backends, html_segments, memory, sketch
from polyglot_spark.operators import glossary as gl
from polyglot_spark.operators.glossary import from_entries, read_brands, read_glossary, with_glossary
from polyglot_spark.plans import localize, queries
from polyglot_spark.sources import properties


def texts(body):
    return [s["text"] for s in html_segments.segments_of(f"<html><body>{body}</body></html>")]


def test_segments():
    assert texts("<p>Hello <b>big</b> world</p>") == ["Hello TAG_OPEN_0 big TAG_CLOSE_0 world"]
    assert texts("<p>Hello<b>x</b>!</p>") == ["Hello TAG_OPEN_0 x TAG_CLOSE_0 !"]
    assert texts('<p>a <a href="/x">b <i>c</i></a></p>') == ["a TAG_OPEN_0 b TAG_OPEN_1 c TAG_CLOSE_1 TAG_CLOSE_0"]
    assert texts("<div>lead<p>inner text</p></div>") == ["inner text"]
    assert texts('<div>lead text<p translate="no">x</p></div>') == ["lead text"]
    assert texts("<p>one<br>two</p>") == ["one two"]
    assert texts("<p>12.50</p><p><b>12</b></p>") == ["TAG_OPEN_0 12 TAG_CLOSE_0"]
    assert texts("<p>run <code>x</code> now</p>") == ["run now"]
    assert texts(f"<p>{'x' * 3001}</p>") == []
    assert texts("<p><b>one<p>two") == ["TAG_OPEN_0 one TAG_CLOSE_0", "TAG_OPEN_0 two TAG_CLOSE_0"]


def test_blocks_are_measured_in_utf16_units():
    assert len(texts(f"<p>{chr(0x1F600) * 1500}</p>")) == 1 and texts(f"<p>{chr(0x1F600) * 1501}</p>") == []


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "word here", "<div><b>" * 20_000 + "word here", "<span>" * 30_000 + "word", "<table><tr><td>" * 20_000 + "cell text", "<ul><li>" * 30_000 + "item text", "<b>x<p>" * 3000])
def test_deep_pages(page):
    began = time.time()
    found = html_segments.segments_of(page)
    assert html_segments.put_back(page, [{**r, "translated": None} for r in found], "arb_Arab") and time.time() - began < 60


def test_nested_inline_elements_and_blanks():
    assert texts("<p> a<b> <i>x </i>y</b>z <span></span> <u> </u>!</p>") == ["a TAG_OPEN_0 TAG_OPEN_1 x TAG_CLOSE_1y TAG_CLOSE_0 z TAG_OPEN_2 TAG_CLOSE_2 TAG_OPEN_3 TAG_CLOSE_3 !"]


def test_head_of_a_page(spark):
    pages = spark.createDataFrame([(1, "<body><title> A &amp; b </title><meta name=description content=' d '>"), (2, "<p>x"), (3, None)], "id int, translated_html string")
    assert [(r.title, r.description) for r in html_segments.with_head(pages).orderBy("id").collect()] == [("A & b", "d"), ("", ""), ("", "")]


def test_title_and_description_come_first():
    page = '<title>Hi you</title><meta name="description" content="D text"><body><p>block</p>'
    assert [s["kind"] for s in html_segments.segments_of(page)] == ["title", "meta-description", "block"]


def test_tree_is_canonical_and_stable():
    page = "<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><script>if (a < b) '</p>'</script>"
    once = serialized(parse(page))
    assert serialized(parse(once)) == once


def test_rebuild_and_right_to_left():
    rows = [{"seq": 0, "kind": "block", "text": "a TAG_OPEN_0 b TAG_CLOSE_0", "translated": "TAG_OPEN_0 B TAG_CLOSE_0 A", "tag_map": [{"token": "TAG_OPEN_0", "tag": "<b>"}, {"token": "TAG_CLOSE_0", "tag": "</b>"}], "node_ord": 0}]
    out = html_segments.put_back("<p>a <b>b</b></p>", rows, "arb_Arab")
    assert "<p><b> B </b> A</p>" in out and 'dir="rtl"' in out and "rtl-override" in out
    kept = html_segments.put_back("<p>a <b>b</b></p>", [{**rows[0], "translated": "lost"}], "spa_Latn", COMPATIBLE.strict())
    assert "<b> b </b>" in kept


def test_pages_without_segments_keep_their_markup(spark):
    pages = spark.createDataFrame([(1, "<p>12</p>"), (2, "<p>word here</p>"), (3, None)], "page_id long, html string")
    out = {r.page_id: r for r in localize.localize_pages(pages, "spa_Latn", backend=backends.pseudo)[0].collect()}
    assert out[1].translated_html == "<p>12</p>" and out[1].warning and out[3].translated_html is None
    assert "[spa_Latn] word here" in out[2].translated_html and out[2].warning is None


def test_glossary(spark):
    entries = from_entries(spark, {"spa_Latn": {"Log In": "Iniciar sesión", "log in": "second", "Save": "Guardar"}, "_note": {"Save": "x"}})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([" log   IN ", "Save your work", "Save", " ", None, "Delete 3 files", "files"])], "i int, text string")
    out = with_glossary(rows, "text", "spa_Latn", entries, [("Delete * files", "Eliminar * archivos"), ("* files", "X")])
    assert [r.glossary_value for r in out.orderBy("i").collect()] == ["Iniciar sesión", None, "Guardar", "", "", "Eliminar 3 archivos", None]
    assert with_glossary(rows, "text", "nld_Latn", entries).where("glossary_value <> ''").count() == 0


def test_glossary_and_brand_files(spark, tmp_path):
    at = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    own = {"spa_Latn": {"Save": "Guardar", "Log In": "Entrar"}}
    file = at("g.json", '{"spa_Latn": {"Log In": "Acceder", "save": "X", "New": "Nuevo"}, "_note": {"a": "b"}, "fra_Latn": {"Save": "Sauver"}, "bad": 3}')
    rows = spark.createDataFrame([("save",), ("log in",), ("new",)], "text string")
    found = with_glossary(rows, "text", "spa_Latn", read_glossary(spark, file, own)).collect()
    assert {r.text: r.glossary_value for r in found} == {"save": "Guardar", "log in": "Acceder", "new": "Nuevo"}
    assert read_glossary(spark, str(tmp_path / "none.json"), own).count() == 2
    with pytest.warns(UserWarning):
        assert read_glossary(spark, at("bad.json", "{"), own).count() == 2
    assert read_brands(spark, at("b.json", '{"brands": ["A", "B C"]}'), ["D"]) == ["A", "B C"]
    assert read_brands(spark, str(tmp_path / "none.json"), ["D"]) == read_brands(spark, file, ["D"]) == ["D"]


def test_settings_of_the_session(spark):
    set_ = {"split_min_chars": "300", "mojibake_lossy": "True", "fluency_correction": "1", "weights": "0.2,0.3,0.5", "url_hosts": "strict"}
    try:
        for k, v in set_.items():
            spark.conf.set(f"spark.polyglot.{k}", v)
        config = EngineConfig.from_settings(spark)
    finally:
        for k in set_:
            spark.conf.unset(f"spark.polyglot.{k}")
    assert (config.split_min_chars, config.mojibake_lossy, config.fluency_correction, config.weights, config.url_hosts) == (300, False, True, (0.2, 0.3, 0.5), "strict")
    assert EngineConfig.from_settings(spark) == COMPATIBLE


def test_request_status(spark):
    pages = spark.createDataFrame([(0, None, "x", "es"), (1, "https://a.com", "x", ""), (2, "https://a.com", "", "es"), (3, "ftp://a.com", "x", "es"), (4, "https://a.com", "<p>", "es")], "i int, url string, html string, target_lang string")
    assert [(r.status, r.error) for r in localize.page_status(pages).orderBy("i").collect()] == [
        (400, "Missing url"), (400, "Missing targetLang"), (502, "Invalid HTML received"), (400, "Only HTTP and HTTPS URLs are allowed"), (200, None),
    ]
    files = spark.createDataFrame([(0, "a.txt", "x", "es"), (1, "a.PROPERTIES", None, "es"), (2, "a.properties", "x", None), (3, "a.properties", "", "es")], "i int, filename string, content string, target_lang string")
    assert [(r.status, r.error) for r in localize.file_status(files).orderBy("i").collect()] == [
        (500, "Only .properties files are allowed"), (400, "No file uploaded"), (400, "Missing target language (targetLang)"), (200, None),
    ]


def test_failures_of_models_are_told(spark):
    def broken(texts, lang):
        raise RuntimeError("no model")

    rows = spark.createDataFrame([("a",), (" ",)], "t string")
    short, good = (lambda texts, lang: []), (lambda texts, lang: texts)
    out = {r.t: (r.o, r.why) for r in backends.batches(broken, short, good, failures="why")(rows.coalesce(1), "t", "o", "x").collect()}
    assert out == {"a": ("a", "0: RuntimeError: no model; 1: 0 texts for 1"), " ": ("", None)}
    assert backends.batches(good, failures="why")(rows, "t", "o", "x").where("why is not null").count() == 0


def test_memory_asks_once_for_each_text(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def count(texts, lang):
        asked.add(len(texts))
        return [t.upper() for t in texts]

    store = memory.TranslationMemory(spark, str(tmp_path / "tm"))
    units = spark.createDataFrame([(1, "a b"), (2, " a  b "), (3, "c")], "id int, text string")
    for expected in (2, 2):
        done, fresh = memory.translate(units, store.entries("spa_Latn"), backends.batches(count), "spa_Latn")
        fresh = fresh.cache()
        n = fresh.count()
        if n:
            store.store(fresh)
        assert asked.value == expected
    assert sorted(r.translated_text for r in store.entries().collect()) == ["A B", "C"]
    store.store(store.entries().withColumn("translated_text", F.lit("new")))
    assert {r.translated_text for r in store.compact(str(tmp_path / "tm2")).entries().collect()} == {"new"}


def test_backends_fall_back(spark):
    def broken(texts, lang):
        raise RuntimeError

    rows = spark.createDataFrame([("a",), ("",)], "t string")
    short = lambda texts, lang: []
    good = lambda texts, lang: [t + "!" for t in texts]
    run = lambda *b: sorted(r.o for r in backends.batches(*b)(rows, "t", "o", "x").collect())
    assert run(broken, short, good) == ["", "a!"]
    assert run(broken) == ["", "a"]


def test_flagged_units_are_sent_again_unsplit(spark):
    rows = spark.createDataFrame([(1, "Save"), (2, "x" * 118 + ". yes."), (3, None)], "doc_id int, text string")
    entries = from_entries(spark, {"spa_Latn": {"Save": "Guardar"}})
    mark = lambda texts, lang: [f"<{t}>" for t in texts]
    out, _ = localize.localized(rows, ["doc_id"], "spa_Latn", backend=backends.batches(mark), glossary=entries)
    got = {r.doc_id: r.translated for r in out.collect()}
    assert got == {1: "<Save>", 2: "<" + "x" * 118 + ". yes.>", 3: ""}
    kept, _ = localize.localized(rows, ["doc_id"], "spa_Latn", backend=backends.batches(mark), glossary=entries, config=COMPATIBLE.strict())
    assert {r.doc_id: r.translated for r in kept.collect()}[1] == "Guardar"


def test_hooks_see_protected_placeholders(spark):
    rows = spark.createDataFrame([(1, "You have %d new messages {name}")], "doc_id int, text string")
    seen = lambda texts, lang: [t.replace("FLUENCY_TOKEN_0", "FLUENCY_TOKEN_0!") for t in texts]
    out, _ = localize.localized(rows, ["doc_id"], "spa_Latn", fluency=backends.batches(seen))
    assert out.first().translated == "You have %d! new messages {name}"


def test_properties_round_trip(spark, tmp_path):
    (tmp_path / "m.properties").write_bytes(b'a=1\r\n\r\n"k" = "v";\n')
    (tmp_path / "other.txt").write_text("x=1")
    files = properties.read_files(spark, str(tmp_path))
    assert [(r.filename, r.error) for r in files.collect()] == [("m.properties", None)]
    small = properties.read_files(spark, str(tmp_path), replace(COMPATIBLE, max_file_bytes=3)).collect()
    assert [(r.filename, r.content, r.error) for r in small] == [("m.properties", None, "File too large")]
    assert properties.rebuilt(properties.parsed(files), "filename").first().content == "a = 1\n\nk = v\n"


def test_same_result_for_any_partitioning(spark):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text no. "), F.col("id") % 7).alias("text"))
    results = [sorted(localize.localized(rows.repartition(n), ["doc_id"], "spa_Latn", backend=backends.pseudo)[0].select("doc_id", "translated").collect()) for n in (1, 8)]
    assert results[0] == results[1]


# --- memory ---------------------------------------------------------------------------------------------------------------


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def entries_of(spark, pairs, lang="spa_Latn"):
    rows = spark.createDataFrame(pairs, "text string, translated_text string")
    return memory.keyed(rows).select("source_text", "source_hash", "translated_text").withColumn("target_lang", F.lit(lang))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_lookup_shuffles_units_only(no_broadcast, tmp_path):
    store = memory.TranslationMemory(no_broadcast, str(tmp_path / "m"), buckets=4)
    store.store(entries_of(no_broadcast, [(f"text {i}", f"T{i}") for i in range(50)]))
    store.store(entries_of(no_broadcast, [("text 1", "newer")]))
    units = memory.keyed(no_broadcast.createDataFrame([("text 1",), ("text 2",), ("other",)], "text string"))
    plan = plan_of(store.lookup(memory.distinct_units(units, texts=False), "spa_Latn", prefilter=False))
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 4 out of 4" in plan
    assert plan.count("Exchange") == 1  # that of the units, which counts them too
    found = store.lookup(memory.distinct_units(units), "spa_Latn", prefilter=False)
    assert {r.source_text: r.translated_text for r in found.collect()} == {"text 1": "newer", "text 2": "T2", "other": None}


def test_generations_are_merged_in_tiers(spark, tmp_path):
    store = memory.TranslationMemory(spark, str(tmp_path / "m"), buckets=2)
    for i in range(5):
        store.store(entries_of(spark, [("same", f"v{i}"), (f"own {i}", "x")]))
        store.merge(fan=2)
    assert store.generations() == [(0, 5), (2, 4)]
    assert {r.source_text: r.translated_text for r in store.entries("spa_Latn").collect()} == {"same": "v4", **{f"own {i}": "x" for i in range(5)}}
    again = memory.TranslationMemory(spark, str(tmp_path / "m"))  # as another session opens it
    assert again.entries().count() == 6 and again.entries("fra_Latn").count() == 0
    store.store(entries_of(spark, [("same", "fr")], "fra_Latn"))
    assert [r.translated_text for r in again.entries("fra_Latn").collect()] == ["fr"]
    wanted = memory.distinct_units(memory.keyed(spark.createDataFrame([("same",), ("own 3",), ("none",)], "text string")))
    assert sorted((r.source_text, r.translated_text) for r in again.lookup(wanted, "spa_Latn").collect() if r.translated_text) == [("own 3", "x"), ("same", "v4")]
    store.delete()
    assert store.generations() == [] and store.entries().count() == 0


def test_sketches_miss_no_key(spark):
    keys = spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("unit_key"), "id")
    made = sketch.built(keys.where("id < 10000"), 3, most_keys=60_000)
    parts = sketch.built(keys.where("id < 10000").unionByName(keys.where("id < 10000")), 3, most_keys=1)  # several sketches for a bucket
    odd = keys.unionByName(spark.createDataFrame([(None, -1), (bytearray(b"short"), -2)], "unit_key binary, id long"))
    for sketches in (made, parts):
        seen = sketch.tested(odd, sketches, 3)
        assert seen.count() == 20_002 and seen.where("id between 0 and 9999 and not maybe_known").count() == 0
        assert seen.where("id >= 10000 and maybe_known").count() < 300 and seen.where("id < 0 and maybe_known").count() == 0
    assert sketch.tested(odd, made.where("false"), 3).where("maybe_known").count() == 0


def test_a_task_that_reads_several_buckets_sketches_each(spark, tmp_path):
    store = memory.TranslationMemory(spark, str(tmp_path / "m"), buckets=12)  # of small files, which few tasks read
    texts = [f"text {i}" for i in range(600)]
    store.store(entries_of(spark, [(t, "T") for t in texts]))
    assert store.sketches("spa_Latn").count() == 12
    wanted = memory.distinct_units(memory.keyed(spark.createDataFrame([(t,) for t in [*texts, "new"]], "text string")), texts=False)
    assert store.lookup(wanted, "spa_Latn").where("translated_text = 'T'").count() == 600


def test_known_units_are_not_asked_again(spark, tmp_path):
    store = memory.TranslationMemory(spark, str(tmp_path / "m"), buckets=12)
    texts = [f"text {i}" for i in range(600)]
    store.store(entries_of(spark, [(t, "T") for t in texts]))
    units = spark.createDataFrame([(t,) for t in [*texts, *texts, "new"]], "text string")
    done, fresh = memory.translate(units, store, backends.pseudo, "spa_Latn")
    assert done.where("translated_text = 'T'").count() == 1200 and [r.source_text for r in fresh.collect()] == ["new"]


def test_half_of_the_units_are_one_text(no_broadcast):
    units = no_broadcast.range(40_000).select("id", F.when(F.col("id") % 2 == 0, "Home").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    keyed = memory.keyed(units)
    answers = memory.distinct_units(keyed).withColumn("translated_text", F.concat(F.lit("T:"), "source_text")).select("unit_key", "n", "translated_text")
    out = memory.answered(keyed, answers)
    assert out.where(F.col("translated_text") == F.concat(F.lit("T:"), "source_text")).count() == 40_000
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 40_000 / 4  # of 4 shuffle partitions none has all the copies


def test_cuts_of_the_keys_hold_every_row_once(no_broadcast):
    units = no_broadcast.range(20_000).select("id", F.when(F.col("id") % 2 == 0, "Home").otherwise(F.concat(F.lit("text "), F.col("id") % 999)).alias("text"))
    keyed = memory.keyed(units)
    answers = memory.distinct_units(keyed).withColumn("translated_text", F.concat(F.lit("T:"), "source_text")).select("unit_key", "n", "translated_text")
    answers = answers.where("translated_text <> 'T:text 1'")
    whole = sorted(memory.answered(keyed, answers).select("id", "translated_text").collect())
    cuts = [sorted(memory.answered(keyed, answers, cut=(i, 3)).select("id", "translated_text").collect()) for i in range(3)]
    assert all(cuts) and sorted(sum(cuts, [])) == whole and len(whole) == 20_000


def test_the_memory_is_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        reads.add(1)
        return text

    known = entries_of(spark, [("one sentence", "T1"), ("never asked", "T2")]).withColumn("translated_text", seen("translated_text"))
    rows = spark.createDataFrame([(1, "one sentence"), (2, "x" * 118 + ". yes."), (3, "Save")], "doc_id int, text string")
    localize.localized(rows, ["doc_id"], "spa_Latn", backend=backends.pseudo, known=known)[0].collect()
    assert reads.value == 2


def files_below(folder):
    return {f"{d}/{f}": os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names}


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f.getPath(): f.length() for f in (found.apply(i) for i in range(found.size())) if f.getName().startswith("shuffle_")}


def test_the_pipeline_leaves_neither_shuffle_files_nor_spare_texts(spark):
    rows = spark.range(400).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(F.sha2(F.concat_ws("-", "id", i), 256), F.lit("."))), " ").alias("text"))
    size, shared = rows.agg(F.sum(F.length("text"))).first()[0], memory.shared_folder(spark)
    before, shuffled, setting = files_below(shared), shuffle_files(spark), spark.conf.get(memory.DROP_SHUFFLES)
    out, fresh = localize.localized(rows, ["id"], "spa_Latn", backend=backends.identity, carry=["id"])
    kept = {f: n for f, n in files_below(shared).items() if f not in before}
    left = {f: n for f, n in shuffle_files(spark).items() if f not in shuffled}
    assert sum(left.values()) < size / 10
    assert sum(kept.values()) < 3 * size and not [f for f in kept if "/scratch-" in f]  # units with their answers, translated texts
    assert out.columns[0] == "id" and "text" not in out.columns and out.count() == 400 and fresh.count() == 20_000
    assert spark.conf.get(memory.DROP_SHUFFLES) == setting


def test_a_failure_leaves_no_tables(spark):
    def broken(df, source, result, lang):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError, match="no model"):
        localize.localized(spark.createDataFrame([("some words",)], "text string"), [], "spa_Latn", backend=broken)
    assert not [f for f in os.listdir(memory.shared_folder(spark).removeprefix("file:")) if f.startswith("scratch-")]


@pytest.mark.parametrize("known", [False, True])
def test_same_result_in_deals_and_cuts(spark, monkeypatch, known):
    long = "Acme text no. 1 goes on and on. " * 4
    texts = ["Save", "Acme", None, "", " ", "same old text", long, long + "Save", *[f"{long} It has part {i}. same old text." for i in range(40)]]
    rows = spark.createDataFrame([(i % 7, t, None) for i, t in enumerate([*texts, *texts[:9]])], "doc_id int, text string, none void")
    entries = from_entries(spark, {"spa_Latn": {"Save": "Guardar"}})
    words = lambda texts, lang: [" ".join(w[::-1] if len(t) > 60 else w for w in t.split()) for t in texts]
    there = entries_of(spark, [("same old text", "el mismo texto"), (long.strip(), "todo")]) if known else None
    got = []
    for small in (localize.SMALL, 0):
        monkeypatch.setattr(localize, "SMALL", small)
        out, fresh = localize.localized(rows.repartition(3), ["doc_id"], "spa_Latn", backend=backends.batches(words), glossary=entries, brands=["Acme"], known=there)
        assert out.columns[:3] == ["doc_id", "text", "none"] and fresh.count() == fresh.select("source_hash").distinct().count()
        got.append((sorted(map(str, out.collect())), sorted(map(str, fresh.collect()))))
    assert got[0] == got[1] and len(got[0][0]) == len(texts) + 9 and any("flagged=True" in r for r in got[0][0])
    assert any("el mismo texto" in r for r in got[0][0]) == known


# --- rows and their own texts ----------------------------------------------------------------------------------------------


def test_rows_with_equal_or_null_keys_keep_their_own_text(spark):
    rows = spark.createDataFrame([(1, "First one."), (1, "Second one."), (None, "Third one."), (None, "Third one."), (2, None)], "doc_id int, text string")
    out, fresh = localize.localized(rows, ["doc_id"], "spa_Latn", backend=backends.pseudo)
    assert sorted((str(r.doc_id), r.translated) for r in out.collect()) == [
        ("1", "[spa_Latn] First one."), ("1", "[spa_Latn] Second one."), ("2", ""), ("None", "[spa_Latn] Third one."), ("None", "[spa_Latn] Third one."),
    ]
    assert fresh.count() == 4  # the blank text of the null row is one of them


def test_pages_and_files_with_equal_or_null_keys(spark):
    pages = spark.createDataFrame([(1, "<p>first page</p>"), (1, "<p>second page</p>"), (None, "<p>third page</p>"), (None, None)], "page_id long, html string")
    out = localize.localize_pages(pages, "spa_Latn", backend=backends.pseudo)[0].collect()
    assert len(out) == 4
    for r in out:
        assert r.source_html is None or f"[spa_Latn] {r.source_html[3:-4]}" in r.translated_html and r.warning is None
    files = spark.createDataFrame([("a.properties", "k=one"), ("a.properties", "k=two"), (None, "k=three"), ("b.properties", None)], "filename string, content string")
    done = localize.localize_properties(files, "spa_Latn", backend=backends.pseudo)[0].collect()
    assert sorted((str(r.filename), str(r.content)) for r in done) == [
        ("None", "k = [spa_Latn] three"), ("a.properties", "k = [spa_Latn] one"), ("a.properties", "k = [spa_Latn] two"), ("b.properties", "None"),
    ]


# --- patterns --------------------------------------------------------------------------------------------------------------


def pattern_values(spark, texts, patterns):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.pattern_value for r in gl.with_patterns(rows, "text", gl.pattern_rows(spark, patterns)).orderBy("i").collect()]


def test_patterns_match_the_trimmed_text(spark):
    texts = ["Delete my  old   files", "Delete a\nb files", "  DELETE\n\n3\t files ", "Delete   files", "Delete  files", "Delete files", "Deleted 3 files", "Delete 3 files now", None, "", "files"]
    assert pattern_values(spark, texts, [("Delete * files", "<*|*>")]) == ["<my  old|my  old>", None, "<3|3>", "<|>", None, None, None, None, None, None, None]


def test_patterns_ignore_case_in_any_alphabet(spark):
    texts = ["ÉDITER 3 files", "éditer 3 FILES", "удалить 2 ФАЙЛА", "ſave 1 file", "MASSE 1 x"]
    patterns = [("éditer * files", "E*"), ("УДАЛИТЬ * файла", "R*"), ("save * file", "S*"), ("maße * x", "M*")]
    assert pattern_values(spark, texts, patterns) == ["E3", "E3", "R2", None, None]


def test_the_first_pattern_wins_and_signs_are_plain(spark):
    patterns = [("a b * z", "1*"), ("a * z", "2*"), ("A * Z", "3*"), ("a (b) * [z].", "4 $* $1"), ("* z", "5"), ("a *", "6"), ("a * b * z", "7"), ("no star z", "8")]
    texts = ["a b c z", "a c z", "a  b c z", "a (b) $$x $& [z].", "a b z", "no star z"]
    assert pattern_values(spark, texts, patterns) == ["1c", "2c", "2b c", "4 $$x * $1", "2b", None]


def test_entries_with_a_star_are_patterns_before_those_given_apart(spark):
    entries = from_entries(spark, {"spa_Latn": {"Delete * files": "A*", "Save": "Guardar"}, "fra_Latn": {"Move * files": "F*"}})
    rows = spark.createDataFrame([(0, "Delete 3 files"), (1, "Move 3 files"), (2, "Save"), (3, " ")], "i int, text string")
    out = with_glossary(rows, "text", "spa_Latn", entries, [("delete * FILES", "B*"), ("move * files", "M*")])
    assert [r.glossary_value for r in out.orderBy("i").collect()] == ["A3", "M3", "Guardar", ""]


def test_ten_thousand_patterns(spark):
    patterns = [(f"Open {i} * in window {i}", f"{i}:*") for i in range(10_000)]
    found = pattern_values(spark, [f"open {i} a b IN window {i}" for i in range(0, 10_000, 50)] + ["open 1 x in window 2"], patterns)
    assert found == [f"{i}:a b" for i in range(0, 10_000, 50)] + [None]


# --- backends --------------------------------------------------------------------------------------------------------------


def test_calls_keep_a_pace_a_deadline_and_attempts(spark, tmp_path):
    log = str(tmp_path / "calls")

    def noted(texts, lang):
        with open(log, "a") as out:
            out.write(f"{time.time()} {len(texts)}\n")
        return [t.upper() for t in texts]

    def slow(texts, lang):
        time.sleep(30)

    rows = spark.createDataFrame([(f"t{i}",) for i in range(10)], "t string").coalesce(1)
    at_once = spark.sparkContext.defaultParallelism
    paced = backends.batches(noted, size=2, calls_a_second=10 * at_once)  # a tenth of a second apart in each task
    assert sorted(r.o for r in paced(rows, "t", "o", "x").collect()) == sorted(f"T{i}" for i in range(10))
    calls = [line.split() for line in open(log)]
    assert [n for _, n in calls] == ["2"] * 5 and all(float(b[0]) - float(a[0]) > 0.09 for a, b in zip(calls, calls[1:], strict=False))
    began = time.time()
    out = backends.batches(slow, noted, deadline=0.3, attempts=2, first_wait=0.1, failures="why")(rows, "t", "o", "x").collect()
    assert {r.why for r in out} == {"0: TimeoutError: no answer in 0.3 s; 0: TimeoutError: no answer in 0.3 s"} and {r.o for r in out} == {f"T{i}" for i in range(10)}
    assert time.time() - began < 20


def test_a_failing_model_is_asked_again_after_waits(spark, tmp_path):
    log = str(tmp_path / "tries")

    def second_time(texts, lang):
        with open(log, "a") as out:
            out.write("x")
        if os.path.getsize(log) < 3:
            raise RuntimeError("busy")
        return texts

    rows = spark.createDataFrame([("a",)], "t string").coalesce(1)
    out = backends.batches(second_time, attempts=3, first_wait=0.01, failures="why")(rows, "t", "o", "x").first()
    assert out.o == "a" and out.why == "0: RuntimeError: busy; 0: RuntimeError: busy"


# --- scanning pages --------------------------------------------------------------------------------------------------------

#: What a token is, as a pattern, which takes time that grows with the square of hostile pages.
TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
PIECES = ["<", "</", ">", "<p", "<b>", "</b>", '<p a="', "'", '"', " ", "x", "&amp;", "<!--", "-->", "<!d>", "<!>", "<?x", "<div class='a'>", "<br/>", "=", "/", '<a"b', "<a href=x>", "\n", "é", "</>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16).map("".join))
def test_tokens_are_those_of_the_pattern(page):
    want = [(m.start(), m.end(), m[1], bool(m[2]), m[3] or "", m[4] or "") for m in TOKEN.finditer(page)]
    assert list(Scanner(page).tokens()) == want


@pytest.mark.parametrize("piece", ['<p a="', "<x ", "<title", '<a"', "<a'\"", "a</x>", "<p a='\" ", "<!--", "<b", "</", "<title>", "x<", "&lt"])
@pytest.mark.parametrize("end", ["", ">"])
def test_hostile_pages_take_linear_time(piece, end):
    page = piece * (2_000_000 // len(piece)) + end
    began = time.process_time()
    parse(page)
    assert time.process_time() - began < 20


def test_references_without_a_semicolon(spark):
    page = "<title>a &amp;amp; b &lt;&quot;&copy;&#65; &unknown; &AMP &amp</title><p title='&lt'>some text &amp here</p>"
    titles = lambda config: [s["text"] for s in html_segments.segments_of(page, config)]
    assert titles(EngineConfig()) == ['a &amp; b <"©A &unknown; & &', "some text & here"]
    assert titles(EngineConfig(open_references=False)) == ['a &amp; b <"©A &unknown; &AMP &amp', "some text &amp here"]
    assert "&lt" not in html_segments.put_back(page, [], "fra_Latn").split("title=")[1].split(">")[0]


def test_html_title_reads_titles_as_its_sql_does(spark, tmp_path):
    titles = ["one &amp;amp; two", "cut off &amp", "\u00c7 \u00c7 \u00c7", "\u00c7 &amp; \u00c7", "42"]
    pages = [(k, f"<html><head><title>{t}</title></head><body><p>text</p></body></html>") for k, t in enumerate(titles)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r.page_id: r.text for r in queries.html_title(spark, str(tmp_path)).collect()}
    assert found == {0: "one &amp; two", 1: "cut off &amp", 3: "\u00c7 & \u00c7"}


def test_pages_are_put_together_a_few_at_a_time(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"<p>page {k}</p><p>and <b>more</b></p>") for k in range(230)], "page_id long, html string")
    found = html_segments.segments(pages).withColumn("translated", F.col("text"))
    sizes = []

    def one_batch(self, function, schema):
        sizes.append([len(b) for b in function(iter(self.toArrow().combine_chunks().to_batches()))])
        return self

    monkeypatch.setattr(type(pages), "mapInArrow", one_batch)
    html_segments.rebuilt(pages, found, "arb_Arab")
    html_segments.with_head(pages, "html")
    assert [sum(s) for s in sizes] == [230, 230] and max(map(max, sizes)) <= html_segments.AT_ONCE


def test_texts_that_are_no_phrases_are_dealt_evenly(no_broadcast):
    units = no_broadcast.range(8_000).select("id", F.when(F.col("id") % 8 == 0, "Save").otherwise(F.concat(F.lit("a text of many words "), "id")).alias("text"))
    out = with_glossary(units, "text", "spa_Latn", from_entries(no_broadcast, {"spa_Latn": {"Save": "Guardar"}}))
    assert out.where("glossary_value = 'Guardar'").count() == 1_000 and out.where("glossary_value is null").count() == 7_000
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 8_000 / 2


@pytest.mark.parametrize("most", [100_000, 0])
def test_rows_of_one_phrase_are_dealt_to_several_tasks(no_broadcast, monkeypatch, most):
    monkeypatch.setattr(gl, "MOST_SENT", most)
    rows = no_broadcast.range(0, 8_000, 1, 8).select("id", F.when(F.col("id") % 8 == 0, "New").otherwise("Save").alias("text"))
    out = with_glossary(rows, "text", "spa_Latn", from_entries(no_broadcast, {"spa_Latn": {"Save": "Guardar"}}))
    assert out.count() == 8_000 and out.where("glossary_value = 'Guardar'").count() == 7_000
    largest = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 6_000


def test_lines_of_one_file_are_dealt_and_joined_in_order(spark):
    lines = [f"k{i} = {i};" for i in range(2_000)] + ["", "# end"]
    files = spark.createDataFrame([(1, "\n".join(lines)), (2, ""), (3, None)], "file int, content string")
    parsed = properties.parsed(files, deal=True).localCheckpoint()
    assert sorted(parsed.collect()) == sorted(properties.parsed(files).collect())
    plan = properties.parsed(files, deal=True)._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression" in plan
    done = {r.file: r.content for r in properties.rebuilt(parsed, "file", stretch=300).collect()}
    assert done == {r.file: r.content for r in properties.rebuilt(parsed, "file").collect()}
    assert done == {1: "\n".join([f"k{i} = {i}" for i in range(2_000)] + ["", "# end"]), 2: ""}


def test_what_stands_for_a_star_is_found_as_by_a_pattern(spark):
    signs = ["", " ", "\n", "a", " ", " ", "b c", "　", "﻿", "ᚁ"]
    middles = [(a + b + c + d,) for a in signs for b in signs for c in signs for d in signs]
    between = f"^{gl.BLANK}+([^\\n\\r\\u2028\\u2029]+?){gl.BLANK}+$"
    rows = spark.createDataFrame(middles, "m string").where("m <> ''")
    m = F.col("m")
    found = rows.select(gl._stands(m).alias("stands"), m.rlike(between).alias("meant"), gl.trimmed(m).alias("core"), gl.trimmed(F.regexp_extract(m, between, 1)).alias("caught"))
    assert found.where("stands <> meant or (meant and core <> caught)").count() == 0 and found.where("stands").count() > 100
