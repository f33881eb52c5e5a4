import os
import time

import pytest
from pyspark.sql import functions as F

from polyglot_spark.operators import backends
from polyglot_spark.plans import localize
from polyglot_spark.sources import properties, stored


@pytest.fixture
def source(spark):
    spark.dataSource.register(stored.StoredFiles)
    return spark


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        (folder / name.replace("__", ".")).write_bytes(content if isinstance(content, bytes) else content.encode())


def names_in(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_files_are_dealt_by_size(tmp_path):
    put(tmp_path / "in", **{f"f{i}__properties": "x" * (10_000 if i % 10 else 900_000) for i in range(40)}, other__txt="y", _hidden="z")
    options = {"path": str(tmp_path / "in"), "suffix": ".PROPERTIES", "partitionBytes": "1500000", "maxFileBytes": "800000"}
    parts = stored.dealt(stored.listed(options), options)
    assert sum(len(p.files) for p in parts) == 40 and max(len(p.files) for p in parts) <= 1_500_000 // (stored.OPEN_BYTES + 10_000) + 2
    assert stored.dealt([], options) == []


def test_large_and_unreadable_files_give_errors(source, tmp_path):
    put(tmp_path / "in", good__properties="a=é", bad__properties=b"b=\xff", note__txt="x")
    with open(tmp_path / "in" / "huge.properties", "wb") as f:
        f.truncate(3 << 30)  # 3 GB: would fail the job if it were loaded
    found = source.read.format("stored_files").option("suffix", ".properties").load(str(tmp_path / "in"))
    assert {(r.filename, r.content, r.error) for r in found.collect()} == {("good.properties", "a=é", None), ("bad.properties", "b=�", None), ("huge.properties", None, "File too large")}
    assert found.where("error is not null").select("length").first().length == 3 << 30
    part = stored.Files([(str(tmp_path / "in" / "gone.properties"), 5, 0)])
    assert next(stored.rows(part, {"path": str(tmp_path)}))[5].startswith("FileNotFoundError")
    assert source.read.format("stored_files").load(str(tmp_path / "none")).count() == 0


def test_a_folder_is_read_as_a_stream(source, tmp_path):
    at = {name: str(tmp_path / name) for name in ("out", "state")}

    def run():
        stream = source.readStream.format("stored_files").load(str(tmp_path / "in"))
        query = stored.stored_pages(stream).writeStream.format("parquet").option("path", at["out"]).option("checkpointLocation", at["state"])
        query = query.trigger(availableNow=True).start()
        assert query.awaitTermination(90) and query.exception() is None
        return sorted(r.html for r in source.read.parquet(at["out"]).collect())

    put(tmp_path / "in", a__html="<p>one</p>", b__html="<p>two</p>")
    assert run() == ["<p>one</p>", "<p>two</p>"]
    time.sleep(0.01)
    put(tmp_path / "in", c__html="<p>three</p>")
    assert run() == ["<p>one</p>", "<p>three</p>", "<p>two</p>"]
    assert run() == ["<p>one</p>", "<p>three</p>", "<p>two</p>"]


def test_localized_files_are_written_and_read_back(source, tmp_path):
    files = source.createDataFrame([("a.properties", "k = one"), ("b/c.properties", "k = two"), ("d.properties", None)], "filename string, content string")
    done, _ = localize.localize_properties(files, "spa_Latn", backend=backends.pseudo)
    stored.write_localized(done, str(tmp_path / "out"))
    assert names_in(tmp_path / "out") == ["a-spa_Latn.properties", "b_c-spa_Latn.properties"]
    back = properties.read_files(source, str(tmp_path / "out"))
    assert {r.filename: r.content for r in back.collect()} == {"a-spa_Latn.properties": "k = [spa_Latn] one", "b_c-spa_Latn.properties": "k = [spa_Latn] two"}
    more = source.createDataFrame([("n.properties", "new")], "filename string, content string")
    more.write.format("stored_files").mode("append").save(str(tmp_path / "out"))
    assert len(names_in(tmp_path / "out")) == 3
    more.write.format("stored_files").mode("overwrite").save(str(tmp_path / "out"))
    assert names_in(tmp_path / "out") == ["n.properties"]


def test_a_failed_task_leaves_nothing(source, tmp_path):
    put(tmp_path / "out", old__properties="kept")

    @F.udf("string")
    def fails(n):
        if n == 70:
            raise RuntimeError("killed")
        return f"content {n}"

    rows = source.range(0, 100, 1, 4).select(F.concat(F.lit("f"), "id", F.lit(".txt")).alias("filename"), fails("id").alias("content"))
    with pytest.raises(Exception, match="killed"):
        rows.write.format("stored_files").mode("append").save(str(tmp_path / "out"))
    assert names_in(tmp_path / "out") == ["old.properties"] and os.listdir(tmp_path / "out") == ["old.properties"]
    twice = source.createDataFrame([("a", "1"), ("a", "2")], "filename string, content string")
    with pytest.raises(Exception, match="one file name"):
        twice.write.format("stored_files").mode("append").save(str(tmp_path / "out"))
    with pytest.raises(Exception, match="not a name"):
        source.createDataFrame([("../a", "1")], "filename string, content string").write.format("stored_files").mode("append").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["old.properties"]


def test_a_repeated_attempt_writes_each_file_once(source, tmp_path):
    row = source.createDataFrame([("a", "1")], "filename string, content string").first()
    writer = stored.Writer({"path": str(tmp_path)}, ["filename", "content"], False)
    lost, good = writer.write(iter([row])), writer.write(iter([row]))
    assert lost.files != good.files
    writer.commit([good, None])
    assert names_in(tmp_path) == ["a"] and (tmp_path / "a").read_text() == "1"
