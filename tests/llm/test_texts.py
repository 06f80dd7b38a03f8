import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import packing, quality, splitting, tokens

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from plain_statistics import plain_statistics  # noqa: E402

VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_50k.json"


# -- splitting

TEXTS = ["First sentence here. Second one, with commas; and clauses: yes! \"Quoted.\" Next\n\nNew paragraph\r\nline " * 9, "x" * 777, "é́" * 300, "一つの実施形態。" * 60 + "終", "👩‍👩‍👧" * 150, " " * 500, "a\n" * 400, "two words " + "z" * 400 + " end " + "y" * 60]


def brute_cut(text, limit, overlap):
    strength = splitting.boundary_strengths(text)
    shortest = max(overlap + 1, -(-limit // 2))
    begin, out = 0, []
    while len(text) - begin > limit:
        window = range(begin + shortest, begin + limit + 1)
        best = max(strength[i] for i in window)
        if best <= splitting.INSIDE:
            window = range(begin + overlap + 1, begin + limit + 1)
            best = max(strength[i] for i in window)
        end = max(i for i in window if strength[i] == best)
        out.append((begin, end))
        begin = end - overlap
    return out + [(begin, len(text))]


@pytest.mark.parametrize("limit,overlap", [(50, 0), (50, 10), (97, 49), (120, 119), (1, 0), (2, 5)])
def test_cuts_against_brute_force(limit, overlap):
    for text in TEXTS:
        pieces = splitting.cut(text, limit, overlap, block=300)
        kept = max(0, min(overlap, limit - 1))
        assert [p[:2] for p in pieces] == brute_cut(text, limit, kept)
        assert all(0 < b - a <= limit for a, b, _ in pieces)
        rebuilt = text[: pieces[0][1]] + "".join(text[a + kept : b] for a, b, _ in pieces[1:])
        assert rebuilt == text


def test_boundaries():
    s = splitting.boundary_strengths("One. Two, 3\nx\n\ny é́")
    at = lambda sub: int(s["One. Two, 3\nx\n\ny é́".index(sub)])
    assert at("Two") == splitting.SENTENCE and at("3") == splitting.COMMA and at("x") == splitting.LINE and at("y") == splitting.PARAGRAPH and int(s[-1]) == splitting.JOINED


def test_range_maximum():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 4, 200).astype(np.int8)
    table = splitting.RangeMaximum(values, 64)
    for _ in range(300):
        low = int(rng.integers(0, 190))
        high = min(199, low + int(rng.integers(0, 63)))
        window = values[low : high + 1]
        assert table.at(low, high) == low + np.flatnonzero(window == window.max())[-1]


def test_split_oversized(spark):
    rows = [(1, "short", 10, 2), (2, "word " * 20, 30, 5), (3, None, 10, 2), (4, "", 10, 2), (5, "long " * 9, None, 1), (6, "long " * 9, 0, 1), (7, "long " * 9, 20, None), (2, "word " * 20, 30, 5)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, text string, most int, over int, piece string")
    got = splitting.split_oversized(df, "text", "most", "over", ["id"]).collect()
    assert {r["id"] for r in got} == {2, 7} and all(len(r["piece"]) == r["piece_end"] - r["piece_begin"] for r in got)
    assert splitting.split_oversized(df.limit(0), "text", "most", "over", ["id"]).count() == 0


# -- tokens


def test_encoding_equals_the_library(spark, sf):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    library.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["a" * 3001, "<|endoftext|> hi <|endoftext|>", "  \n\n \t x'S don't   ½ 12³ é́ 👩‍👩‍👧 ퟿ ", "", None, "ab" * 5000, "aaab" * 700, "\x00\x01", "日本語" * 50]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, ids string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(df, "doc_id", "text").collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.encode_corpus(df, "doc_id", "text", only_counts=True).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_long_words_equal_the_library(monkeypatch):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(VOCABULARY)
    rng, letters = random.Random(0), "etaoinshrdlu"
    texts = ["".join(rng.choices(letters, k=300_000)), "a" * 9001 + " b " + "ab" * 3000, "請求項" * 3000, "".join(rng.choices("ab", k=5000)), "", "short words too"]
    e = tokens.Encoder(tokens.load_vocabulary(VOCABULARY))
    offsets, ids = e.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(tokens, "LONG_WORD", 3)  # the same words one way and the other
    again, other = tokens.Encoder(e.v).encode(texts[3:])
    assert other.tolist() == ids[offsets[3] :].tolist()


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(tokens, "_HELD_WORDS", 3)
    e = tokens.Encoder(tokens.load_vocabulary(VOCABULARY))
    first = [x.tolist() for x in e.encode(["one two three four five"])]
    e.encode(["six seven eight nine ten"])
    assert [x.tolist() for x in e.encode(["one two three four five"])] == first


# -- packing


def test_best_fit_fills_and_respects_capacity():
    rng = np.random.default_rng(0)
    for capacity in (1, 7, 512, 5000):
        sizes = rng.integers(1, capacity + 1, 400)
        number = packing.best_fit(sizes, capacity)
        used = np.bincount(number, sizes)
        assert used.max() <= capacity and used.min() > 0
        assert len(used) <= max(1, 11 / 9 * -(-sizes.sum() // capacity) + 1 + (sizes > capacity / 2).sum())


def pack(spark, rows, **kw):
    items = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, n_tokens bigint, window int")
    caps = spark.createDataFrame([("small", 100), ("large", 1000), ("none", None), ("zero", 0)], "name string, capacity int")
    return packing.pack(items, "doc_id", "source", "n_tokens", caps, **kw)


def test_pack_places_everything_once(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([0, None, 1, 5, 30, 99, 100, 101, 250, 3333])) for i in range(400)] + [(7, "a", 12), (None, "a", 5)]
    got = pack(spark, rows, window_containers=8).collect()
    assert {r["name"] for r in got} == {"small", "large"}
    for name, capacity in (("small", 100), ("large", 1000)):
        mine = [r for r in got if r["name"] == name]
        total = sum(n or 0 for k, _, n in rows if k is not None)
        assert sum(r["piece_size"] for r in mine) == total
        loads = {}
        for r in mine:
            if r["container_id"] is not None:
                loads[r["container_id"]] = loads.get(r["container_id"], 0) + r["piece_size"]
        assert max(loads.values()) <= capacity
        for r in mine:
            if r["piece_no"] > 0:
                assert rows[r["doc_id"]][2] > capacity
        assert len([r for r in mine if r["container_id"] is None]) == sum(1 for k, _, n in rows if k is None or not n)


def test_windows_keep_the_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "abc"[min(2, int(rng.random() * 4) // 2 if i % 3 else 2)], rng.randint(1, 60)) for i in range(3000)]
    got = pack(spark, rows, window_containers=40)
    tokens_by = {}
    for r in got.filter("name = 'small'").groupBy("window", "source").agg(F.sum("piece_size").alias("t")).collect():
        tokens_by.setdefault(r["window"], {})[r["source"]] = r["t"]
    total = sum(r[2] for r in rows)
    for s in {r[1] for r in rows}:
        share = sum(r[2] for r in rows if r[1] == s) / total
        sent = 0
        for w in sorted(tokens_by)[:-1]:
            sent += tokens_by[w].get(s, 0)
            assert abs(sent - (w + 1) * share * 4000) <= 61  # the deficit never exceeds one item
    again = pack(spark, rows[::-1], window_containers=40)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_pack_targets_and_empty(spark):
    rows = [(i, "ab"[i % 2], 10) for i in range(2000)]
    got = pack(spark, rows, shares={"a": 3.0, "b": 1.0}, window_containers=20).filter("name = 'small' and window = 0")
    t = {r["source"]: r["t"] for r in got.groupBy("source").agg(F.sum("piece_size").alias("t")).collect()}
    assert t == {"a": 1500, "b": 500}
    items = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, n_tokens bigint, window int")
    whole = pack(spark, rows, shares={"a": 3.0, "b": 1.0}, window_containers=20)
    told = {r["source"]: r for r in packing.mixture(whole, packing.target_shares(items, "source", "n_tokens", {"a": 3.0, "b": 1.0})).filter("name = 'small'").collect()}
    assert (told["a"]["share"], told["a"]["ends_early"], told["a"]["least"], told["a"]["most"]) == (0.75, True, 0.75, 0.75)  # a is used up after 7 windows
    assert told["a"]["last_window"] == 6 and told["b"]["last_window"] == 19 and not told["b"]["ends_early"] and told["b"]["share"] == 0.25
    assert {r["source"]: r["share"] for r in packing.target_shares(items.union(items.selectExpr("doc_id", "'c'", "n_tokens * 2", "window").filter("doc_id < 1000")), "source", "n_tokens", {"a": 1.0}).collect()} == {"a": 0.25, "b": 0.25, "c": 0.5}
    caps = spark.createDataFrame([("small", 100), ("large", 1000)], "name string, capacity int")
    assert all((r["n_items"], r["n_overfull"], r["n_not_whole"], r["n_needless"], r["n_lost"]) == (2000, 0, 0, 0, 0) for r in packing.faults(whole, items, "doc_id", "n_tokens", caps).collect())
    spoiled = whole.filter("doc_id > 2").withColumn("container_id", F.when(F.col("doc_id") < 50, -1).otherwise(F.col("container_id")))
    assert all(r["n_lost"] == 3 and r["n_overfull"] == (1 if r["name"] == "small" else 0) for r in packing.faults(spoiled, items, "doc_id", "n_tokens", caps).collect())
    assert pack(spark, []).count() == 0
    assert pack(spark, [(1, "a", 0)]).count() == 2


# -- quality

COMMON = frozenset("the of a and is in to that it der die und".split())


def test_statistics_by_hand():
    common = quality.common_hashes(COMMON)
    rows = quality.statistics(["The cat, it is here.\nno end\n\n", None, "", " \n\t　", "word " * 200_000], common)
    f = dict(zip(quality.FEATURES, rows[0]))
    assert f["word_count"] == 7 and f["mean_word_length"] == pytest.approx(19 / 7) and f["common_share"] == pytest.approx(3 / 7)
    assert f["punct_line_share"] == 0.5 and f["symbol_share"] == pytest.approx(2 / 29)
    assert not rows[1:4].any() and rows[4, 0] == 200_000 and np.isfinite(rows).all()
    assert quality.statistics([], common).shape == (0, len(quality.FEATURES)) and not quality.statistics([None], common).any()


ODD = ["İstanbul'da İyi. n/a 12 n/a\r\n- one two\n(3). four five six\na) b\n12345 x\n•\tx", "<b>bold</b> <a href='x'>y</a> <>< 3 > 2 </p", "a\t\t b ; c|d, e,f,, g\t \t", "aaaaaa\n\n\n\n\n\nbbbbb  b" * 3, "Ã© â€œx Â ° Â° \x00\x1f \ufffd", "請求項に記載のとおり、この装置は前記部材を備える。" * 3 + "一二三四五\n部品", "x. y! z? … 。！", "ΑΣ ΣΑΣ", "🙂🙂🙂🙂🙂 ok", "1. 2) (3) 4", "\x85a\u2028b\x1cc  ", "word_word x² ½ ٣"]


def test_statistics_against_plain_python(sf):
    import pyarrow.parquet as pq

    common = frozenset(w.lower() for w in pq.read_table(f"{sf}/common_words.parquet")["word"].to_pylist() if w)
    texts = ODD + [None, ""] + pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() + ODD[::-1]
    got = quality.statistics(texts, quality.common_hashes(common))
    want = np.array([plain_statistics(t, common) for t in texts])
    for k, name in enumerate(quality.FEATURES):
        if name not in ("damage_share", "prose_share", "listed_share"):  # marks of damage may overlap there, and n/a in longer words
            assert got[:, k] == pytest.approx(want[:, k], abs=1e-9), name
    assert np.abs(got - want)[:, [quality.FEATURES.index("damage_share"), quality.FEATURES.index("prose_share")]].max() < 0.2


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.boost(x[:1500], y[:1500], np.ones(1500), trees=60)
    score = model.score(x[1500:])
    assert ((score > 0) == (y[1500:] == 1)).mean() > 0.95
    noisy = np.where(rng.random(500) < 0.05, 1 - y[1500:], y[1500:])
    a, b = quality.calibrate(score, noisy)
    p = 1 / (1 + np.exp(-(a * score + b)))
    assert 0 < a < 2 and abs(p.mean() - noisy.mean()) < 0.03


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, words, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "common_words", "doc_labels"))
    half = labels.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(2)))  # calibrate on one half, measure on the other
    stats = quality.document_statistics(docs, "doc_id", "text", words)
    model = quality.fit(docs, "doc_id", "text", stats, words, half.filter("h = 0"))
    got = quality.predict(stats, "doc_id", model).join(half.filter("h = 1"), "doc_id").filter("not blank").collect()
    right = sum((r["probability"] >= 0.5) == (r["kind"] != "prose") for r in got)
    assert right / len(got) > 0.9  # some labels are wrong


def test_quality_without_labels_or_text(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "It is the end of the day and that is it in a way to the end.", "k"), (4, "■" * 90, "k"), (4, "■" * 90, "k")], "doc_id int, text string, kind string")
    words = spark.createDataFrame([(w,) for w in sorted(COMMON)] + [(None,)], "word string")
    labels = spark.createDataFrame([], "doc_id int, kind string")
    found = quality.not_prose(docs, "doc_id", "text", words, labels).collect()
    assert [r["doc_id"] for r in found] == [4, 4]  # rows stay as they are, repeated ones too
    assert quality.not_prose(docs.limit(0), "doc_id", "text", words, labels).count() == 0
