"""Each operator against brute force on small tables, and on nulls, empty texts, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from polyglot_spark.llm import chroma, common, crf, ctw, embeddings, html_text, mixing, packing, simhash, substrings, token_counts, toxicity

SF = "/root/testdata/sf0.001"
CLASHING = ["score", "key", "size", "fp", "chunk", "spans", "n_words", "position", "rank"]


@pytest.fixture(scope="module")
def table(spark):
    """All documents of the smallest test table."""
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, ties, one long text and columns with clashing names."""
    rows = [
        (1, "a b c d e", "en", "s1"), (1, "a b c d e", "en", "s1"), (2, None, "en", "s1"), (3, "", None, None), (4, " \n\t", "en", "s2"),
        (None, "x y z", "en", "s1"), (6, "A B  c\nd e", "en", "s2"), (7, "w " * 30_000, "en", "s1"), (8, "é <b>|</b> \x00 \U0001f600", "de", "s3"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHING}).cache()


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return (text or "").encode().split()


# --- context-tree weighting -----------------------------------------------------------------------------------------------


def direct_tree(texts, depth):
    """Counts of every node of the context tree of some texts, bit by bit."""
    counts = collections.Counter()
    for t in texts:
        data = b"\xff" * depth + b" ".join(t.lower().split()) + b"\xff"
        for k in range(depth, len(data)):
            for b in range(8):
                seen, bit = (1 << b) | (data[k] >> (8 - b)), data[k] >> (7 - b) & 1
                for d in range(depth + 1):
                    counts[data[k - d : k], seen, bit] += 1
    return counts


def direct_score(counts, children, text, depth):
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(context, seen):
        own = kt(counts[context, seen, 0], counts[context, seen, 1])
        if len(context) == depth:
            return own, own
        below = sum(weighted(c, seen)[0] for c in children[context, seen])
        return np.logaddexp(own, below) - math.log(2), own

    memo, total = {}, 0.0
    data = b"\xff" * depth + b" ".join(text.lower().split()) + b"\xff"
    for k in range(depth, len(data)):
        for b in range(8):
            seen, bit = (1 << b) | (data[k] >> (8 - b)), data[k] >> (7 - b) & 1
            mixed, rest, last = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                context = data[k - d : k]
                zero, one = counts[context, seen, 0], counts[context, seen, 1]
                if not zero + one:
                    break
                last = (one + 0.5) / (zero + one + 1)
                if (context, seen) not in memo:
                    whole, own = weighted(context, seen)
                    memo[context, seen] = 1.0 if d == depth else math.exp(own - whole - math.log(2))
                mixed, rest = mixed + rest * memo[context, seen] * last, rest * (1 - memo[context, seen])
            mixed += rest * last
            total += math.log10(mixed if bit else 1 - mixed)
    return total


def test_context_tree_is_exact(spark):
    texts = ["The cat sat on the mat", "the dog sat\ton the log", None, "", "A cat! and a dog", "The cat sat on the mat", "ééé ça va", "on the mat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows_of(ctw.score(docs, depth=4, shared=2, chunk=64))}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    learnt = [(t or "").encode() for i, t in enumerate(texts) if not held[i]]
    counts, children = direct_tree(learnt, 4), collections.defaultdict(set)
    for context, seen, _ in list(counts):
        if context:
            children[context[1:], seen].add(context)
    unigrams = collections.Counter(w for t in learnt for w in [*t.lower().split(), None])
    n, v = sum(unigrams.values()), len(unigrams)
    for i, text in enumerate(texts):
        text = (text or "").encode()
        tokens = [*text.lower().split(), None]
        assert got[i]["held_out"] == held[i] and got[i]["train_tokens"] == n
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(tokens), sum(w in unigrams for w in tokens))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((unigrams[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert got[i]["score"] == pytest.approx(direct_score(counts, children, text, 4), rel=1e-5)


def test_context_tree_beats_unigrams_on_held_out_text(spark):
    held = ctw.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_context_tree_odd_rows(odd, nothing):
    assert ctw.score(odd).count() == 9
    assert ctw.score(nothing).count() == 0


# --- HTML -----------------------------------------------------------------------------------------------------------------


def test_extraction_on_held_out_layouts():
    chain, wrong, total = html_text.default_model(), 0, 0
    for page, labels in html_text.labelled_pages(150, seed=99):
        path = chain.viterbi(chain.emissions([fs for _, fs in html_text.leaf_blocks(page)]))
        wrong += sum(a != b for a, b in zip(path, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.01


def test_extraction_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    out = html_text.extract(pages).collect()
    assert len(out) == pages.count() and all(r.n_chars == len(r.text) for r in out)
    for r in out:
        assert "&amp;" not in r.text.replace("&amp;amp;", "") and "track(" not in r.text


def test_elements_without_end_tag_keep_the_rest_of_the_page():
    texts = lambda page: [x for x, _ in html_text.leaf_blocks(page)]
    for tag in ("<svg width='1'/>", '<svg viewBox="0 0 1 1" />', "<svg>", "<select>", "<template>", "<noscript>", "<canvas>"):
        assert texts(f"<p>one</p>{tag}<p>two</p><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one</p><svg/><p>two</p><svg><text>x</text></svg><p>three</p>") == ["one", "two", "three"]
    for name in ("svg", "select", "template", "noscript", "canvas", "script", "style", "textarea", "title", "iframe"):
        assert texts(f"<p>one</p><{name} a='>'>x<b>y</b></{name} ><p>two</p>") == ["one", "two"]
    for name in ("script", "style", "textarea", "title", "iframe"):
        assert texts(f"<p>one</p><{name}/><p>two</p>") == ["one"]


def test_extraction_odd_pages(spark):
    page = "<body><nav><a href=/>Home</a></nav><article><h1>A &amp; b</h1><p>One   two.\n three.<script>x('</p>')</script><p>Four &#233;.</article><section class=comments><p>Nice text here.</p></section><footer>(c) all</footer>"
    rows = [(1, "u", page, "own"), (1, "u", page, "own"), (2, None, None, None), (3, "u", "", ""), (4, "u", "<<<p", "x")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [r.text for r in out][:4] == ["A & b\n\nOne two. three.\n\nFour é."] * 2 + ["", ""]
    assert len(out) == 5 and out[0].n_chars == len(out[0].text)


# --- substrings -----------------------------------------------------------------------------------------------------------


def removed_directly(rows, window=50):
    first = {}
    for d, t in sorted((d, t) for d, t in rows if d is not None):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((-1 if d is None else d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings(spark, table):
    rng = np.random.default_rng(5)
    shared = [" ".join(f"w{x}" for x in rng.integers(0, 50, 70)) for _ in range(4)]
    made = []
    for i in range(60):
        parts = [" ".join(f"u{i}x{k}" for k in range(rng.integers(0, 40)))]
        for s in rng.permutation(4)[: rng.integers(0, 4)]:
            w = shared[s].split()
            a, b = sorted(rng.integers(0, 71, 2))
            parts += [" ".join(w[a:b] if rng.random() < 0.5 else w), f"e{i}"]
        made.append((1000 + i // 2, " ".join(parts)))
    made += [(5000, "same " * 300), (5001, "same " * 120), (5001, "same " * 120), (5002, None), (5003, ""), (None, shared[0]), (1, shared[0])]
    made += [(r.doc_id + 10_000, r.text) for r in table.select("doc_id", "text").collect()]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    got = substrings.remove_repeats(docs, texts=False).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed_directly(made)


def test_substrings_keep_other_text_and_columns(spark, odd, nothing):
    out = substrings.remove_repeats(odd)
    assert set(odd.columns) <= set(out.columns) | {"n_words"}
    assert sorted(str(r.text) for r in out.collect()) == sorted(str(r.text) for r in odd.collect())
    assert substrings.remove_repeats(nothing, texts=False).count() == 0
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(1, passage), (2, f"before\n\n{passage}\nafter  it")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in substrings.remove_repeats(docs).collect()}[2] == "before\nafter  it"


# --- packing --------------------------------------------------------------------------------------------------------------


def test_packing(table):
    from tokenizers import Tokenizer

    from polyglot_spark.llm.tokens import vocabulary

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = rows_of(packing.pack(table))
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
    for r in table.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by_doc[r.doc_id], key=lambda p: p["piece"])
        assert [p["start"] for p in own] == list(range(0, len(ids), 4096))
        assert [p["ids_crc32"] for p in own] == [zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) for p in own]
        assert sum(p["length"] for p in own) == len(ids)
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    least = math.ceil(sum(p["length"] for p in pieces) / 4096)
    assert len(sequences) <= least + max(1, least // 50)


@pytest.mark.parametrize("seed", range(4))
def test_pattern_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    hist = np.bincount(np.minimum(4096, rng.lognormal(6, 1, 3000).astype(int) + 1), minlength=4097)
    used = np.zeros(4097, np.int64)
    for lengths, often in packing.pattern_plan(hist):
        assert sum(lengths) <= 4096 and often > 0
        np.add.at(used, list(lengths), often)
    assert (used == hist).all()


def test_counts_by_least_squares():
    """Against the optimality conditions: no pattern gains by being used more, and none that is used by being used less."""
    hist = np.zeros(17, np.int64)
    hist[[3, 4, 5, 8, 11, 12, 13]] = [9, 20, 14, 6, 11, 17, 8]
    number, lengths = packing.few_document_patterns(hist)
    assert all(lengths[number == p].sum() == 16 for p in range(number.max() + 1))
    x = packing.non_negative_least_squares(number, lengths, hist.astype(float), rounds=20_000)
    uses = np.zeros((number.max() + 1, 17))
    np.add.at(uses, (number, lengths), 1)
    slope = uses @ (x @ uses - hist)
    assert (x >= 0).all() and (slope > -1e-2).all() and np.abs(slope * x).max() < 1e-1


def test_rounded_counts_keep_their_sum():
    x = np.random.default_rng(3).random(10_000) * 0.3
    assert abs(packing.rounded(x).sum() - x.sum()) <= 0.5 and packing.rounded(x).min() == 0


def test_most_sequences_come_from_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").repartition(8)
    hist = np.zeros(4097, np.int64)
    for length, n in packing.token_pieces(docs, packing.vocabulary("word_bpe_49k.json")).groupBy("length").count().collect():
        hist[length] = n
    left = np.append(hist[:-1], 0)
    fitted = sum(often for _, often in packing.fitted_patterns(left))
    plan = packing.pattern_plan(hist)
    print(fitted, "of", sum(often for _, often in plan) - hist[-1], "sequences from patterns")
    assert fitted > (sum(often for _, often in plan) - hist[-1]) / 2
    assert sum(often for _, often in plan) == math.ceil((hist * np.arange(4097)).sum() / 4096)


def test_packing_in_windows_of_an_order(spark, tmp_path):
    """Sequences follow the stored order from window to window; copies far apart are not in one sequence."""
    text = F.repeat(F.lit("a b "), (F.hash("id") % 100 + 150).cast("int"))
    docs = spark.range(2000, numPartitions=3).select((F.col("id") % 1000).alias("doc_id"), text.alias("text"), "id")
    docs.orderBy("id").write.parquet(str(tmp_path / "docs"))
    stored = packing.in_stored_order(spark.read.parquet(str(tmp_path / "docs")), "at")
    placed = stored.orderBy("at").select("id").collect()
    assert [r.id for r in placed] == list(range(2000)) and stored.where("at < 0 or at >= 1L << 60").count() == 0
    pieces = packing.cut(packing.token_pieces(stored, packing.vocabulary("word_bpe_49k.json"), order="at"))
    out = rows_of(packing.place(pieces, order="at", window=10))
    turn = {(p["doc_id"], p["start"], p["at"]): p["at"] for p in rows_of(pieces)}
    windows = max(1, min(packing.WINDOWS, sum(p["length"] for p in out) // 4096 // 10))
    assert windows > 5 and len(out) == len(turn) == 2000 and "at" not in out[0]
    shared = collections.Counter((p["doc_id"], p["sequence_id"]) for p in out)
    assert max(shared.values()) == 1
    places = collections.defaultdict(list)
    for p in out:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 4096
    least = math.ceil(sum(p["length"] for p in out) / 4096)
    assert len(places) <= least + windows
    # the windows of a document's two copies, half of the order apart, by its sequences
    order = sorted(places)
    rank = {s: k / len(order) for k, s in enumerate(order)}
    both = collections.defaultdict(list)
    for p in out:
        both[p["doc_id"]].append(rank[p["sequence_id"]])
    assert all(abs(abs(a - b) - 0.5) <= 2 / windows for a, b in both.values())


def test_words_are_encoded_as_whole_texts():
    from tokenizers import Tokenizer

    from polyglot_spark.llm.tokens import WordEncoder, vocabulary

    path = vocabulary("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), WordEncoder(path)
    chars = [chr(c) for c in [*range(0x0, 0x370), 0x180E, 0xFEFF, 0x1F600, *range(0x2000, 0x2070)]] + [chr(c) for c in range(0x100, 0x3100) if chr(c).isspace()]
    texts = [s.format(c) for c in chars for s in ("the{}cat", "the{} cat", "the {}cat", "the {} cat", "{}the", "the{}", "{0}{0}", "\x1f{}\x1c", "It'{0}S 9{0}9")]
    texts += ["", " ", "IT'S we'LL I'D <|endoftext|> a<|endoftext|>b x<|y", "e\u0301 É ßẞ ŉ ǅ ª º ² ½", "x" * 100_000, "\n" * 10, "don''t 'tis 's"]
    ids, sizes = words.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    got = [ids[a:b].tolist() for a, b in zip(ends - sizes, ends, strict=True)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    again, _ = words.encode(pa.array(texts))
    assert (again == ids).all()


def test_packing_odd_rows(odd, nothing):
    out = rows_of(packing.pack(odd, with_ids=True))
    assert sum(p["length"] == 1 for p in out) == 3 and all(len(p["ids"]) == p["length"] for p in out)
    assert packing.pack(nothing).count() == 0


# --- mixing ---------------------------------------------------------------------------------------------------------------


def test_mixing(table):
    out = rows_of(mixing.mix(table))
    sizes = collections.Counter()
    for r in table.collect():
        sizes[r.source] += len(words(r.text))
    taken = collections.Counter()
    for r in out:
        taken[r["target"], r["source_size"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"])
    most = max(r["size"] for r in out)
    assert all(abs(n - target) <= most for (target, _), n in taken.items())
    assert sum({(t, s) for t, s in taken}.pop() is not None for _ in [0]) == 1
    assert sum(t for t, _ in taken) == pytest.approx(1.5 * sum(sizes.values()), rel=0.35)  # equal sizes share a key
    assert sorted(map(str, out)) == sorted(map(str, rows_of(mixing.mix(table.repartition(7)))))


def test_targets_follow_weights_until_capped(spark):
    rows = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), (None, 10)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    # 3165 words by 5, 2, 1, 5: a and the null source stop at 200 and 20, b takes two thirds of the rest but stops at 2000
    assert got == {"a": 200.0, None: 20.0, "b": pytest.approx(2945 * 2 / 3), "c": pytest.approx(2945 / 3)}


def test_positions_invert_the_schedule(spark):
    demand = spark.range(101).select((F.col("id") / 100).alias("u"))
    for rank, (a, b) in enumerate([(1.5, 0.5), (1.0, 1.0), (0.5, 1.5)]):
        for r in demand.select("u", mixing.training_position(F.col("u"), F.lit(rank)).alias("t")).collect():
            assert a * r.t + (b - a) * r.t**2 / 2 == pytest.approx(r.u, abs=1e-12)


def test_mixing_odd_rows(odd, nothing):
    assert mixing.mix(odd).count() == 9 and mixing.mix(nothing).count() == 0
    copies = mixing.mix_documents(odd)
    assert copies.columns == odd.columns
    assert copies.count() == mixing.mix(odd).agg(F.sum("copies")).first()[0]
    assert mixing.mix_documents(nothing).count() == 0


# --- SimHash --------------------------------------------------------------------------------------------------------------


def simhash_directly(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_directly(ids, near):
    label = np.array(ids)
    while True:
        low = np.where(near, label[None, :], 1 << 60).min(1)
        if (low == label).all():
            return label.tolist()
        label = low


def test_simhash(spark, table):
    rows = [(r.doc_id, r.text) for r in table.collect()] + [(900, None), (901, ""), (902, "One"), (903, "one"), (904, "a b"), (905, "a b c")]
    got = {r.doc_id: r for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = np.array([simhash_directly(t) for _, t in rows], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    assert [got[i].fp & (1 << 64) - 1 for i, _ in rows] == prints.tolist()
    assert [got[i].component_id for i, _ in rows] == components_directly([i for i, _ in rows], near)


def test_simhash_index_finds_all_components(spark):
    """Dense clusters, larger than a leaf, so that nodes are factored again."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = set()
    for c in centres:
        for _ in range(1500):
            flips = rng.choice(20, rng.integers(0, 9), replace=False)
            fps.add(int(c) ^ sum(1 << int(b) for b in flips))
    fps = np.array(sorted(fps), np.uint64)
    links = simhash.near_links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    place = {int(x): k for k, x in enumerate(fps.view(np.int64))}
    got, want = list(range(len(fps))), list(range(len(fps)))
    for r in links:
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2
        got[embeddings.find(got, place[r.a])] = embeddings.find(got, place[r.b])
    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 2).tolist():
            want[embeddings.find(want, k)] = embeddings.find(want, j)
    groups = lambda tops: len({embeddings.find(tops, k) for k in range(len(tops))})
    assert groups(got) == groups(want)


def test_large_nodes_are_not_split_where_joins_are_skewed(spark):
    rng = np.random.default_rng(1)
    ball = np.repeat(rng.integers(0, 1 << 62, 1, np.uint64), 1000)
    for _ in range(3):
        ball = ball ^ (np.uint64(1) << rng.integers(0, 64, 1000).astype(np.uint64))
    fps = np.unique(np.concatenate([ball, rng.integers(0, 1 << 63, 2000, np.uint64)]))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.shuffle.partitions": "64",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        distinct = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(20)
        found = np.array([(r.a, r.b) for r in simhash.near_links(common.cut(distinct)).collect()]).view(np.uint64)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    i, j = np.triu_indices(len(fps), 1)
    near = np.flatnonzero(np.bitwise_count(fps[i] ^ fps[j]) <= 2)
    want, got = simhash.spanning(i[near], j[near], len(fps)), np.searchsorted(fps, found)
    assert np.all(np.bitwise_count(found[:, 0] ^ found[:, 1]) <= 2)
    assert len(simhash.spanning(got[:, 0], got[:, 1], len(fps))) == len(want)


def test_simhash_keeps_one_of_each_group(odd, nothing):
    kept = rows_of(simhash.keep_first(odd.select(*odd.columns)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 2), (False, 7), (False, 8), (True, 0)]
    assert set(kept[0]) == set(odd.columns) and simhash.keep_first(nothing).count() == 0


# --- toxicity -------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_on(docs, labels)
    both = toxicity.score(docs, model).join(labels, "doc_id").select("doc_id", "toxic", "predicted", "spans").collect()
    held = [r for r in both if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.toxic == r.predicted for r in held) / len(held) > 0.95
    assert sum(r.predicted for r in held if r.toxic) >= 0.8 * sum(r.toxic for r in held)
    assert sum(bool(r.spans) for r in both if r.toxic) >= 0.8 * sum(r.toxic for r in both)


def test_toxicity_spans_are_offsets():
    texts = [f"clean words number {k} are here" for k in range(80)] + [f"you are an IDIOT, {k} indeed {k + 1}" for k in range(40)]
    model = toxicity.train(texts, [0] * 80 + [1] * 40)
    (low, none), (high, spans) = toxicity.Tagger(model).tag(pa.array(["fine text", "he is an Idiot! Yes"]))
    assert low < 0.5 <= high and not none
    assert ["he is an Idiot! Yes"[s["start"] : s["end"]] for s in spans] == ["Idiot!"]


def test_emissions_are_those_of_the_features():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(12)]
    names = [f for w in words for f in (*toxicity.own_features(w), f"-1={w}", f"+1={w}")]
    chain = crf.Chain({"bias": -1.0, **{f: float(rng.normal()) for f in names}})
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 2, 9, 0, 5)] + [None]
    e, sizes = toxicity.Tagger(toxicity.Model(chain, (0.0, 1.0))).emissions(pa.array(texts, pa.string()))
    docs = [(t or "").split() for t in texts]
    assert sizes.tolist() == [len(d) for d in docs]
    assert e == pytest.approx(chain.emissions([["bias", *toxicity.own_features(w), *toxicity.around(d, k)] for d in docs for k, w in enumerate(d)]))


def test_chain_is_that_of_enumeration():
    """Marginals and best paths of the field against all labellings of short sequences."""
    rng = np.random.default_rng(9)
    sizes = np.array([1, 5, 0, 7, 2, 7])
    chain, e = crf.Chain(start=rng.normal(size=2), trans=rng.normal(size=(2, 2))), rng.normal(size=int(sizes.sum())) * 2
    odds, at = chain.marginals(e, sizes), 0
    for n in sizes.tolist():
        own = e[at : at + n]
        paths = list(itertools.product((0, 1), repeat=n))
        scores = np.array([sum(own[k] for k in range(n) if y[k]) + (chain.start[y[0]] + sum(chain.trans[a, b] for a, b in zip(y, y[1:], strict=False)) if n else 0) for y in paths])
        for k in range(n):
            one, zero = (np.logaddexp.reduce([s for s, y in zip(scores, paths, strict=True) if y[k] == v]) for v in (1, 0))
            assert odds[at + k] == pytest.approx(one - zero)
        if n:
            assert tuple(chain.viterbi(own)) == paths[int(scores.argmax())]
        at += n


def test_chain_learns_the_gradient_to_zero():
    """At the end of training the expected counts of features are near those seen, but for the penalty."""
    sequences = [[["bias", "a"], ["bias"], ["bias", "b"]], [["bias", "b"], ["bias", "a"]], [["bias"], ["bias"]]] * 20
    labels = [[1, 0, 0], [0, 1], [0, 0]] * 19 + [[0, 0, 1], [1, 1], [1, 0]]
    chain = crf.fit(sequences, labels, rounds=400, penalty=0.1)
    sizes = np.array([len(s) for s in sequences])
    p = 1 / (1 + np.exp(-chain.marginals(chain.emissions([f for s in sequences for f in s]), sizes)))
    flat, y = [f for s in sequences for f in s], [v for some in labels for v in some]
    for name in ("bias", "a", "b"):
        assert sum((v - q) for f, v, q in zip(flat, y, p, strict=True) if name in f) == pytest.approx(0.1 * chain.weights.get(name, 0.0), abs=0.3)


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit_on(odd, labels)
    out = rows_of(toxicity.score(odd, model))
    assert len(out) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert toxicity.keep_clean(odd, labels).columns == odd.columns
    assert toxicity.keep_clean(nothing, labels.where("false")).count() == 0


# --- embeddings -----------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    rng = np.random.default_rng(2)
    for k in range(40):  # pairs about the threshold
        base = np.array(rows[k][1])
        side = rng.normal(size=64)
        side -= base * (side @ base) / (base @ base)
        cosine = 0.9 + rng.normal() * 1e-4
        rows.append((10_000 + k, (base / np.linalg.norm(base) * cosine + side / np.linalg.norm(side) * math.sqrt(1 - cosine**2)).tolist()))
    rows += [(20_000, rows[0][1]), (20_001, [2 * x for x in rows[0][1]]), (20_002, [0.0] * 64), (20_003, None), (20_004, [float("nan")] * 64), (20_005, [])]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=100).collect()}
    sound = [(i, v) for i, v in rows if v and not math.isnan(v[0]) and any(v)]
    x = np.array([v for _, v in sound])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, True)
    ids = [i for i, _ in sound]
    assert [got[i].n_links for i in ids] == (near.sum(1) - 1).tolist()
    assert [got[i].component_id for i in ids] == components_directly(ids, near)
    for i in (20_002, 20_003, 20_004, 20_005):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert embeddings.near_vectors(vectors.where("false")).count() == 0


def test_embeddings_at_the_threshold_and_without_ids(spark):
    """Pairs nearer to the threshold than both roundings tell apart, huge components, and vectors without an id."""
    rng, rows, want = np.random.default_rng(6), [], []
    for k in range(200):
        base, side = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        cosine = 0.9 + rng.normal() * 1e-8
        rows += [(2 * k, base.tolist()), (2 * k + 1, (1e300 * (base * cosine + side * math.sqrt(1 - cosine**2))).tolist())]
        want += [int(cosine >= 0.9)] * 2
    near = [[1.0, 0.1], [1.0, 0.12], [1.0, 0.1]]
    rows += [(None, v) for v in near] + [(None, [0.0, 1.0]), (900, [0.0, 5.0]), (None, [-1.0, 0.0]), (None, None)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("own")), tile=64).collect()
    links = {r.vec_id: r.n_links for r in got if r.vec_id is not None and r.vec_id < 900}
    assert [links[i] for i in range(400)] == want
    assert sorted((r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in got if r.vec_id is None or r.vec_id == 900) == sorted(
        [(2, -1, True)] * 3 + [(1, 900, False), (1, 900, True), (0, -1, True), (0, -1, True)]
    )


def test_tile_bounds_hold():
    rng = np.random.default_rng(8)
    for size in (1, 2, 3, 64, 1500):
        x = rng.normal(size=(300, size)) * rng.choice([1, 1e-9], (300, size))
        x[150:] = x[:150] + rng.normal(size=(150, size)) * 0.4 * np.abs(x[:150]).max(1)[:, None] / math.sqrt(size)
        x /= np.linalg.norm(x, axis=1)[:, None]
        cosines, known = x @ x.T, np.zeros((300, 300), int)
        for i, j, sure in embeddings.tile_links(embeddings.quantised(x), None, 0.9, 64):
            known[i, j] += 1 if sure else 2
        upper = np.triu(np.ones((300, 300), bool), 1)
        assert (known[upper & (cosines >= 0.9)] > 0).all() and (cosines[known == 1] >= 0.9).all() and known.max() <= 2


# --- audio ----------------------------------------------------------------------------------------------------------------


def test_audio_copies_shifts_and_noise(spark):
    rng = np.random.default_rng(1)
    tune = lambda n: " ".join(f"n{x}" for x in rng.integers(0, 1000, n))
    song, other = tune(80), tune(80)
    noisy = chroma.tones(song) + rng.normal(0, 0.05, 80 * chroma.HOP)
    sound = {1: chroma.tones(song), 2: chroma.tones(tune(7) + " " + song), 3: noisy, 4: chroma.tones(other), 5: chroma.tones(song), 6: None, 7: np.zeros(100), 8: None}
    rows = [(i, None if s is None else (np.clip(s / 2, -1, 1) * 32767).astype("<i2").tobytes(), "own") for i, s in sound.items()]
    out = {r.rec_id: r for r in chroma.group_recordings(spark.createDataFrame(rows, "rec_id long, audio binary, codes string"), "audio").collect()}
    assert {i: r.component_id for i, r in out.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 6: 6, 7: 7, 8: 8}
    assert out[6].n_codes == 0 and out[1].codes_crc32 == out[5].codes_crc32


def test_audio_alignment_finds_the_shift(spark):
    rng = np.random.default_rng(4)
    song = [f"n{x}" for x in rng.integers(0, 1000, 60)]
    rows = spark.createDataFrame([(1, " ".join(song)), (2, " ".join(["q1", "q2", "q3", "q4", "q5", *song]))], "rec_id long, text string")
    _, pairs = chroma.aligned(rows, "text", chroma.tones)
    assert [abs(r.shift) for r in pairs.collect()] == [5]
    assert chroma.group_recordings(rows.where("false"), "text", chroma.tones).count() == 0


def aligned_directly(x, y, marked):
    """Whether some offset of two code sequences has a window (or all of the shorter one) with few bit errors, with an equal code and equal upper 20 bits eight codes later in it if ``marked``."""
    span = min(16, len(x), len(y))
    for shift in range(-len(x) + span, len(y) - span + 1):
        first, last = max(0, -shift), min(len(x), len(y) - shift)
        differ = x[first:last] ^ y[first + shift : last + shift]
        wrong, upper = np.bitwise_count(differ).astype(int), differ >> 12
        for k in range(len(wrong) - span + 1):
            part = wrong[k : k + span]
            if part.sum() <= 0.15 * 32 * span and (not marked or ((part[:-8] == 0) & (upper[k + 8 : k + span] == 0)).any()):
                return True
    return False


def test_audio_links_are_those_of_brute_force(spark):
    rng = np.random.default_rng(11)
    song = rng.integers(0, 1 << 32, 60, np.uint32)

    def noisy(codes, share):
        return codes ^ np.packbits(rng.random((len(codes), 32)) < share, axis=1).view(np.uint32).ravel()

    sounds = {i: rng.integers(0, 1 << 32, rng.integers(2, 40), np.uint32) for i in range(40, 70)}
    sounds |= {i: np.concatenate([rng.integers(0, 1 << 32, i, np.uint32), noisy(song, (0.01, 0.03, 0.06)[i % 3])]) for i in range(1, 25)}
    sounds |= {0: song, 25: song[:6], 26: song[3:5], 27: song[:1], 28: noisy(song[:12], 0.03), 29: np.tile(song[:2], 40), 30: np.tile(song[:2], 9), 31: song[:17], 32: song[44:]}
    jingle = song[20:29] & np.uint32(0xFFFFF000)
    sounds |= {100 + i: np.concatenate([rng.integers(0, 1 << 32, 20, np.uint32), np.concatenate([jingle[:1], noisy(jingle[1:8], 0.2 + 0.02 * (i % 6)), jingle[8:]]), noisy(song[29:36], 0.13 + 0.01 * (i % 6)), rng.integers(0, 1 << 32, i % 4, np.uint32)]) for i in range(40)}
    codes = {i: x.tobytes() for i, x in sounds.items()}
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in codes.items()], "rec_id long, codes binary")
    keys = {r.key: r.rec_id for r in rows.select("rec_id", F.xxhash64("codes").alias("key")).collect()}

    def groups(pairs):
        tops = {i: i for i in codes}
        for a, b in pairs:
            while tops[a] != a:
                a = tops[a]
            while tops[b] != b:
                b = tops[b]
            tops[max(a, b)] = min(a, b)
        top = lambda i: i if tops[i] == i else top(tops[i])
        return {i: top(i) for i in codes}

    both = [(i, j) for i in codes for j in codes if i < j]
    marked = [(i, j) for i, j in both if aligned_directly(sounds[i], sounds[j], True)]
    whole = chroma.fingerprints
    try:
        chroma.fingerprints = lambda rows, column, *_: rows.select("rec_id", F.col(column).alias("codes"))
        for block in (4096, 5):
            _, pairs = chroma.aligned(rows, "codes", block=block)
            links = [(keys[r.a], keys[r.b]) for r in pairs.collect()]
            assert {tuple(sorted(x)) for x in links} <= set(marked)
            assert groups(links) == groups(marked)
    finally:
        chroma.fingerprints = whole


def test_audio_recall_by_noise():
    """Share of pairs of a recording and its noisy copy, 8 seconds each, that brute force over all offsets links and a landmark does too."""
    rng = np.random.default_rng(12)
    recall = {}
    for share in (0.01, 0.03, 0.05, 0.1):
        wide = marked = 0
        for _ in range(300):
            x = rng.integers(0, 1 << 32, 56, np.uint32)
            y = x ^ np.packbits(rng.random((56, 32)) < share, axis=1).view(np.uint32).ravel()
            if aligned_directly(x, y, False):
                wide += 1
                marked += aligned_directly(x, y, True)
        recall[share] = marked / wide
    assert min(recall[s] for s in (0.01, 0.03, 0.05)) >= 0.9, recall


def test_audio_of_long_recordings_is_worked_out_in_blocks():
    rng = np.random.default_rng(3)
    for rate in (2000, 8000, 44_100):
        samples = rng.normal(size=chroma.frame_size(rate) * 40).astype(np.float32)
        assert np.allclose(chroma.pitch_classes(samples, rate, 7), chroma.pitch_classes(samples, rate))
        assert len(chroma.pitch_classes(samples, rate)) == 79
    assert len(chroma.packed_codes(chroma.pitch_classes(np.zeros(44_100 * 600, np.float32), 44_100))) > 3000


# --- token counts ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(table, rule):
    from tokenizers import Tokenizer

    from polyglot_spark.llm.tokens import vocabulary

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = collections.defaultdict(dict)
    for r in token_counts.count_by_section(table, rule).collect():
        got[r.doc_id][r.section] = r.n_tokens
    for r in table.collect():
        bounds = [0, *[k + 1 for k, c in enumerate(r.text) if c == "\n" and k < len(r.text) - 1], len(r.text)]
        want = [0.0] * (len(bounds) - 1)
        for a, b in tokenizer.encode(r.text, add_special_tokens=False).offsets:
            share = [max(0, min(b, bounds[k + 1]) - max(a, bounds[k])) for k in range(len(want))]
            if rule == "split":
                want = [w + s / (b - a) for w, s in zip(want, share, strict=True)]
            else:
                want[int(np.argmax(share)) if rule == "majority" else next(k for k, s in enumerate(share) if s)] += 1
        assert [got[r.doc_id][k] for k in range(len(want))] == pytest.approx(want)


def test_long_runs_are_counted():
    from tokenizers import Tokenizer

    from polyglot_spark.llm.tokens import vocabulary

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    encoder, lengths = token_counts.byte_encoder(vocabulary("byte_bpe_50k.tiktoken"))
    for run in ("\n" * 5000, " " * 1000, "\t \u3000" * 700, "\x1c" * 1500):
        for text in (f"a {run}b", f"{run}", f"x{run} ", f"{run}'s 1{run}\n."):
            assert token_counts.token_ids(encoder, text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    for text in ("\n" * 2_000_000, "a" * 300_000, "ab " * 100_000, "." * 300_000):
        first, end = token_counts.token_spans(encoder, lengths, text)
        assert end[-1] == len(text)


def test_token_counts_of_given_sections_and_odd_rows(spark, odd, nothing):
    rows = spark.createDataFrame([(1, "the cat sat", [0, 3, 7])], "doc_id long, text string, at array<int>")
    assert [r.n_tokens for r in token_counts.count_by_section(rows, sections="at").orderBy("section").collect()] == [1, 1, 1]
    out = token_counts.count_by_section(odd)
    assert out.where("n_tokens = 0").count() == 2 and out.select("doc_id").count() >= 9
    assert token_counts.count_by_section(nothing).count() == 0
