import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from polyglot_spark.llm import queries as llm

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    assert len(set(ids["simhash"])) == len(ids["simhash"]) <= len(ids["toxicity"]) and set(ids["substrings"]) == set(ids["simhash"])
    assert max(collections.Counter(ids["mixing"]).values()) == 2
    assert collections.Counter(ids["mixing"]) == collections.Counter(r.doc_id for r in kept["packing"] if r.piece == 0)
    assert all(r.n_chars == len(r.text) for r in kept["substrings"])


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_and_empty_tables(spark, tmp_path, rows):
    """Nulls in every column, empty and blank texts, repeated rows and columns with names that the operators use."""
    made = [
        (1, "a b c", "en", "s1"), (1, "a b c", "en", "s1"), (2, None, None, None), (None, None, None, None), (None, None, None, None), (None, "x y", "en", "s1"),
        (3, "", "en", "s2"), (4, " \n\t", "en", "s2"), (5, "w " * 5000, "en", "s1"), (6, "\x1c\u0085\u00a0", "en", None), (7, "é <b>|</b> \x00 \U0001f600", "de", "s3"),
    ]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("score", "spans", "component_id", "fp", "runs", "position", "key", "rank", "size", "n_words", "length", "piece")})
    docs = docs if rows == "odd" else docs.where("false")
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0 if rows == "none" else 0 < docs.count() <= 2 * before + 2


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))
