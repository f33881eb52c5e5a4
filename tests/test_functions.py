from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polyglot_spark.config import COMPATIBLE
from polyglot_spark.functions import quality
from polyglot_spark.functions import text as tx
from polyglot_spark.functions import tokens as tk
from polyglot_spark.functions import urls
from polyglot_spark.functions.urls import url_verdict


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.select("i", expression(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_hash_of_normalized_text(spark):
    assert column(spark, ["  Hello \n world "], tx.text_hash) == ["64ec88ca00b268e5ba1a35678a1b5316d212f4f366b2477232534a8aeca37f3c"]


def test_white_space_is_that_of_ecmascript(spark):
    assert column(spark, [" a﻿  b\u0085"], tx.normalized) == ["a b\u0085"]


def test_sentences(spark):
    assert column(spark, ["A. B!  c", "v1.2 is out.", "  ", None], tx.sentences) == [["A.", "B!", "c"], ["v1.2 is out."], [], None]


def test_units_split_only_long_texts(spark):
    long = "x" * 118 + ". y."
    assert [len(u) for u in column(spark, ["A. B.", long, "y" * 130], tx.units)] == [1, 2, 1]


def test_lengths_count_utf16(spark):
    assert column(spark, ["\U0001f600é"], tx.utf16_length) == [3]


def test_merged_lines(spark):
    text = "One\ntwo.\n\nthree\nfour"
    assert column(spark, [text, "", None], tx.merged_lines) == [["One two.", "", "three four"], [], []]


def test_packed_sentences(spark):
    text = " ".join(["a" * 199 + "."] * 3)
    assert [len(c) for c in column(spark, [text, " "], tx.packed_sentences)[0]] == [401, 200]


def test_kept_segments(spark):
    values = ["12.50", "TAG_OPEN_0 12 TAG_CLOSE_0", "a", "-", "é", "ok", " ", None]
    assert column(spark, values, tx.worth_keeping) == [False, True, True, False, True, True, False, False]


def test_brands(spark):
    brands = ["Acme Show", "DriveIt", "Office Suite", "Acme One", "Talk", "Meeting"]
    protect = lambda v: tk.brands_protected(v, brands)["text"]
    values = ["Open DriveIt now", "talk and TALK", "Acme One, Acme Show", "Meetings", "éTalk"]
    assert column(spark, values, protect) == ["Open BRAND_1 now", "BRAND_4 and BRAND_4", "BRAND_3, BRAND_0", "Meetings", "éBRAND_4"]
    back = lambda v: tk.brands_restored(tk.brands_protected(v, brands)["text"], tk.brands_protected(v, brands)["found"])
    assert column(spark, values[:2], back) == ["Open DriveIt now", "talk and talk"]


def test_brand_restored_each_spelling(spark):
    both = spark.createDataFrame([("talk and TALK",)], "v string").select(tk.brands_protected(F.col("v"), ["Talk"]).alias("b"))
    assert both.select(tk.brands_restored(F.col("b.text"), F.col("b.found"), "each")).first()[0] == "talk and TALK"


def test_entities_of_any_number(spark):
    values = ["&#x0000041;&#0000066;", "&#1114112;&#x110000;&#xD800;", "&#99999999999999999999;", "&#x1F600;&#0;", "&amp;#65;", "&#xE9;&#;&#x;"]
    assert column(spark, values, tx.decoded_entities) == ["AB", values[1], values[2], "\U0001f600\x00", "&#65;", "\xe9&#;&#x;"]


def test_character_grams_of_all_scripts():
    def directly(a, b, n=4):
        def grams(t):
            units = t.encode("utf-16-le")
            t = "".join(chr(int.from_bytes(units[i : i + 2], "little")) for i in range(0, len(units), 2))
            return Counter(t[i : i + n].lower() for i in range(len(t) - n + 1))

        x, y = grams(a), grams(b)
        shared = sum((x & y).values())
        return 2 * shared / (x.total() + y.total()) if shared else 0.0

    texts = ["the quick brown fox", "The Quick BROWN dog", "\u0130stanbul \u0130stanbul", "\u03a3\u039f\u03a6\u039f\u03a3 \u03c3\u03bf\u03c6\u03cc\u03c2", "\U0001f600\U0001f601 smile \U0001f600", "abc", "\xe9\xc9\xe9\xc9\xe9", "aaaaaaaa"]
    for a in texts:
        for b in texts:
            assert quality._character_f(a, b, 4) == pytest.approx(directly(a, b)), (a, b)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab %d{}$0s é", max_size=40))
def test_protect_then_restore_is_identity(spark, value):
    rows = spark.createDataFrame([(value,)], "v string")
    rows = rows.select("v", tk.protected(F.col("v"), tk.FILE_PLACEHOLDER, "__PH", "__").alias("p"), tk.originals(F.col("v"), tk.FILE_PLACEHOLDER).alias("o"))
    assert rows.select(tk.restored_loosely(F.col("p"), F.col("o"))).first()[0] == value


@pytest.mark.parametrize(
    ("source", "translated", "scores"),
    [
        ("Save", "Guardar", (0, 0, 1, 0.30, True)), ("Error", "Error", (1, 1, 1, 1.0, False)), ("Yes", "Yes", (1, 0, 1, 0.65, True)),
        ("the quick brown fox", "the quick brown dog", (0.75, 0.8125, 1, 0.846875, True)), ("a", "a a a", (1.5, 0, 0.7, 0.735, True)),
        ("one two three", "one", (0.5, 0, 0.7, 0.385, True)), ("", "", (0, 0, 1, 0.30, True)), (None, None, (0, 0, 1, 0.30, True)),
    ],
)
def test_scores(spark, source, translated, scores):
    row = quality.with_scores(spark.createDataFrame([(source, translated)], "s string, t string"), "s", "t").first()
    assert (row.bleu, row.chrf, row.length_score, row.confidence, row.flagged) == pytest.approx(scores)


def test_strict_urls(spark):
    verdict = lambda v: url_verdict(v, COMPATIBLE.strict())["allowed"]
    assert column(spark, ["http://[::1]/", "http://2130706433/", "https://example.com/a", None], verdict) == [False, False, True, False]


@pytest.mark.parametrize(
    ("host", "parsed", "is_closed"),
    [
        ("１２７.0.0.1", "127.0.0.1", True), ("%31%32%37.0.0.1", "127.0.0.1", True), ("0x7f.1", "127.0.0.1", True), ("[::ffff:7f00:1]", "[::ffff:127.0.0.1]", True), ("2130706433", "127.0.0.1", True), ("017700000001", "127.0.0.1", True),
        ("127.1.", "127.0.0.1", True), ("LOCALHOST.", "localhost.", True), ("a.localhost", "a.localhost", True), ("lo­calhost", "localhost", True), ("ⓛocalhost", "localhost", True), ("127。0。0。1", "127.0.0.1", True),
        ("[0:0:0:0:0:0:0:1]", "[::1]", True), ("[::]", "[::]", True), ("[fe80::1]", "[fe80::1]", True), ("[fd00::1]", "[fd00::1]", True), ("[2001:DB8:0::1]", "[2001:db8::1]", False), ("172.32.0.1", "172.32.0.1", False),
        ("10.example.com", "10.example.com", False), ("Bücher.example", "xn--bcher-kva.example", False), ("8.8.8.8", "8.8.8.8", False), ("0", "0.0.0.0", True), ("0x", "0.0.0.0", True), ("1.2.3.4.5", None, False), ("256.1.1.1", None, False),
        ("09.1.1.1", None, False), ("a%00b", None, False), ("a%2Fb", None, False), ("a b", None, False), ("", None, False), (None, None, False), ("[::1", None, False), ("[::1%25eth0]", None, False), ("%ff", None, False), ("4294967296", None, False), ("x.0x", None, False),
    ],
)
def test_hosts_as_browsers_parse_them(host, parsed, is_closed):
    got = urls.parsed_host(host)
    if parsed == "[::ffff:127.0.0.1]":
        assert got.lower() in ("[::ffff:127.0.0.1]", "[::ffff:7f00:1]")
    else:
        assert got == parsed
    assert (got is not None and urls.closed(got)) == is_closed


def test_strict_verdicts(spark):
    cases = {
        "http://１２７.0.0.1/": "URL host not allowed", "http://%31%32%37.0.0.1:80/": "URL host not allowed", "http://0x7f.1": "URL host not allowed", "http://[::ffff:7f00:1]/": "URL host not allowed", "http://user:a@b@localhost:1/": "URL host not allowed",
        "http://exa\tmple.com/": None, "http://10.example.com": None, "http://1.2.3.256/": "Invalid URL", "http:///": "Invalid URL", "ftp://example.com": "Only HTTP and HTTPS URLs are allowed", "mailto:a": "Only HTTP and HTTPS URLs are allowed",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", urls.url_verdict(F.col("url"), COMPATIBLE.strict()).alias("v"))
    assert {r.url: r.v.error for r in rows.collect()} == cases


def test_edges_of_brands(spark):
    texts, brands = ["C++ code and c++x", "élan ÉLAN xÉlan", "Ring ring_ rings, RING!", "übering"], ["C++", "Élan", "ring"]
    by = {edges: column(spark, texts, lambda c, e=edges: tk.brands_protected(c, brands, e)["text"]) for edges in ("boundary", "word")}
    assert by["boundary"] == ["C++ code and BRAND_0x", "élan ÉLAN xBRAND_1", "BRAND_2 ring_ rings, BRAND_2!", "übering"]
    assert by["word"] == ["BRAND_0 code and c++x", "BRAND_1 BRAND_1 xÉlan", "BRAND_2 ring_ rings, BRAND_2!", "übering"]


def test_few_pairs_of_a_batch_are_objects_at_a_time(monkeypatch):
    rows = [f"text number {k % 60} of the batch" for k in range(300)]
    scored, sizes = [], []
    plain = quality._overlap
    monkeypatch.setattr(quality, "_overlap", lambda x, y: scored.append(x) or plain(x, y))

    class Watched(list):
        def __len__(self):
            return len(self[0])

        def slice(self, first, n):
            sizes.append(n)
            return self[0].slice(first, n)

    out = list(quality.pair_scores(Watched([pa.array(rows)]), Watched([pa.array(rows[1:] + rows[:1])]), 4))
    assert max(sizes) == quality.AT_ONCE and len(scored) == 60  # equal pairs once
    assert out == [(plain(x, y), quality._character_f(x, y, 4)) for x, y in zip(rows, rows[1:] + rows[:1], strict=True)]
    scored.clear()
    monkeypatch.setattr(quality, "MOST_HELD", 100)
    assert list(quality.pair_scores(pa.array(rows), pa.array(rows[1:] + rows[:1]), 4)) == out and len(scored) > 200
