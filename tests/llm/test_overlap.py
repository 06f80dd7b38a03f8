import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.functions.shingles import mix
from treeloom.llm import overlap as O
from treeloom.llm import sketches as S
from treeloom.functions.text import alnum_key, split_name

SCHEMA = "record_id bigint, texts array<string>, split string, patent_id string, value string, class string"


def triples(texts):
    out = set()
    for t in texts or []:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out |= set(zip(w, w[1:], w[2:]))
    return out


def corpus(seed=1, groups=40, size=60):
    """Records of random words, with copies, edited copies, reordered texts, short texts and hot phrases."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    hot = "the hot phrase of every claim as shown before".split()
    rows, number = [], 0
    for g in range(groups):
        n = rng.choice([1, 3, 4, 6, 12, 30, size, size * 3])
        base = [rng.choice(words) for _ in range(n)]
        for k in range(rng.choice([1, 2, 3])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, n // 12, n // 6])):
                text[rng.randrange(n)] = rng.choice(words)
            half = n // 2
            texts = [" ".join(hot), " ".join(text)] if rng.random() < 0.5 else [" ".join(text[half:]), " ".join(text[:half]), None, ""]
            rows.append((number, texts, rng.choice(["train", " Train", "dev", "TEST ", None, ""]), rng.choice([None, "", f"P-{g % 7}", f"p{g % 7} "]), "x", "y"))
            number += 1
    rows += [(number, None, "train", None, "", ""), (number + 1, [], "dev", "!!", "", ""), (number + 2, [None, "one two"], "test", None, "", "")]
    hot_text = "this very text is delivered again and again by the same source every single day"
    rows += [(number + 10 + k, [hot_text], "train" if k % 2 else "dev", None, "", "") for k in range(20)]
    return rows + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def near_truth(rows):
    sets = {r[0]: triples(r[1]) for r in rows}
    ids = sorted(k for k, s in sets.items() if s)
    return {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}


SPLIT = O.Overlap(hot=2, keys_at_once=40)  # many buckets, most lists split


@pytest.mark.parametrize("seed,o", [(1, O.Overlap()), (2, SPLIT), (7, O.Overlap(agree_near=1))])
def test_near_pairs_against_brute_force(spark, seed, o):
    rows = corpus(seed)
    got = {tuple(r) for r in O.near_pairs(frame(spark, rows).repartition(3), "record_id", "texts", o).collect()}
    assert got == near_truth(rows)


def test_near_groups(spark):
    rows = corpus(3)
    truth = near_truth(rows)
    got = {r["record_id"]: r for r in O.near_groups(frame(spark, rows), "record_id", "texts").collect()}
    sets = {r[0]: triples(r[1]) for r in rows}
    assert set(got) == {k for k, s in sets.items() if s}
    for a, b in truth:
        assert got[a]["group_id"] == got[b]["group_id"]
    for k, r in got.items():
        same = [x for x in got if sets[x] == sets[k]]
        assert r["class_id"] == min(same) and r["n_copies"] == len(same)
        assert r["n_links"] == len({frozenset(sets[x]) for x in got if sets[x] != sets[k] and (min(x, k), max(x, k)) in truth})


@pytest.mark.parametrize("seed,o", [(4, O.Overlap()), (5, SPLIT), (8, O.Overlap(agree=1))])
def test_cross_split_against_brute_force(spark, seed, o):
    rows = corpus(seed)
    once = {r[0]: r for r in rows}
    name = lambda s: (s or "").strip().lower() or None
    key = lambda s: re.sub("[^A-Z0-9]", "", (s or "").upper()) or None
    truth = set()
    for e in once.values():
        for t in once.values():
            if name(e[2]) in ("dev", "test") and name(t[2]) == "train":
                a, b = triples(e[1]), triples(t[1])
                if (a and 5 * len(a & b) >= 4 * len(a)) or (key(e[3]) and key(e[3]) == key(t[3])):
                    truth.add((min(e[0], t[0]), max(e[0], t[0])))
    got = {tuple(r) for r in O.cross_split(frame(spark, rows), "record_id", "texts", split_name("split"), alnum_key("patent_id"), o).collect()}
    assert got == truth


def test_codes_of_classes(spark):
    """All classes that share a code become candidates; pairs that meet too seldom don't."""

    class Told:
        members = spark.createDataFrame([(5, 1), (5 + (1 << 32), 2), (9, 3), (-1, 4)], "class bigint, id bigint")

    met = spark.createDataFrame([((5 << 32) | 9, 2, 6), ((5 << 32) | 9, 4, 6), ((9 << 32) | 0xFFFFFFFF, 1, 1), ((5 << 32) | 0xFFFFFFFF, 2, 3)], "pair bigint, c int, agree int")
    assert {tuple(r) for r in O._candidates(met, Told).collect()} == {(5, 9), (5 + (1 << 32), 9), (9, -1)}


def test_empty_tables(spark):
    empty = frame(spark, corpus(1)).limit(0)
    assert O.near_pairs(empty, "record_id", "texts").count() == 0
    assert O.cross_split(empty, "record_id", "texts", F.col("split"), F.col("patent_id")).count() == 0


def test_exact_way_where_candidates_are_many(spark, monkeypatch):
    monkeypatch.setattr(O, "BROADCAST_ROWS", 0)
    rows = corpus(6)
    assert {tuple(r) for r in O.near_pairs(frame(spark, rows), "record_id", "texts").collect()} == near_truth(rows)


def test_shared_counts():
    rng = np.random.default_rng(0)
    xs = [np.unique(rng.integers(0, 400, n)).astype(np.uint64) for n in (5, 100, 300, 1)]
    ys = [np.unique(rng.integers(0, 400, n)).astype(np.uint64) for n in (50, 100, 300, 1)]
    flat = lambda z: (np.concatenate(z), np.array([len(v) for v in z]))
    assert O.shared_counts(*flat(xs), *flat(ys)).tolist() == [len(np.intersect1d(a, b)) for a, b in zip(xs, ys)]
    packed = pa.array([O._packed(v) for v in xs], pa.binary())
    assert (O._flat(packed)[0] == np.concatenate(xs)).all()


def grown_pairs(common, shared, added, pairs=100, background=20_000):
    """Pairs of a record of ``common`` templated and ``shared`` rare shingles and the same with a rare passage added, and rare texts besides."""
    rows = []
    for k in range(pairs):
        texts = [" ".join(f"t{k // 5}x{i}" for i in range(common + 2)), " ".join(f"s{k}x{i}" for i in range(shared + 2))]
        rows.append((2 * k, texts, "train", None, "", ""))
        rows.append((2 * k + 1, [*texts, " ".join(f"n{k}x{i}" for i in range(added + 2))], "train", None, "", ""))
    rows += [(2 * pairs + k, [" ".join(f"b{k}x{i}" for i in range(202))], "train", None, "", "") for k in range(background // 200)]
    return rows, {(2 * k, 2 * k + 1) for k in range(pairs)}


@pytest.mark.parametrize("common,shared,added", [(85, 17, 68), (50, 10, 40), (90, 20, 70)])
def test_rare_passage_added_to_templated_text(spark, common, shared, added):
    rows, want = grown_pairs(common, shared, added)
    got = {tuple(r) for r in O.near_pairs(frame(spark, rows), "record_id", "texts").collect()}
    assert len(want - got) == 0 and got == near_truth(rows)


def test_one_shingle_in_all_records(spark):
    """A phrase that every record holds is in the sketches of the short ones: its list is split, and nothing is lost."""
    rng = random.Random(9)
    rows = []
    for k in range(400):
        own = [f"u{k // 2}x{i}" for i in range(rng.choice([1, 3, 6, 40]) if not k % 2 else 4)]
        rows.append((k, ["the one phrase that all records hold", " ".join(own)], "train" if k % 3 else "dev", None, "", ""))
    got = {tuple(r) for r in O.near_pairs(frame(spark, rows), "record_id", "texts", O.Overlap(hot=50)).collect()}
    assert got == near_truth(rows) and len(got) > 1000
    sets = {r[0]: triples(r[1]) for r in rows}
    want = {(min(e, t), max(e, t)) for e in sets for t in sets if e % 3 == 0 and t % 3 and 5 * len(sets[e] & sets[t]) >= 4 * len(sets[e])}
    assert {tuple(r) for r in O.cross_split(frame(spark, rows), "record_id", "texts", F.col("split"), o=O.Overlap(hot=50)).collect()} == want


def test_shares_of_a_list():
    level = np.arange(256).astype(np.uint8)
    assert O._shares(level, 1 << 14).min() == 1 and (np.diff(O._shares(level, 1 << 14)) >= 0).all()
    at, turn = O._repeat(np.array([2, 0, 3]))
    assert at.tolist() == [0, 0, 2, 2, 2] and turn.tolist() == [0, 1, 0, 1, 2]
    flat = [(i, t) for a, b in O._ranges(np.array([2, 0, 3])) for i, t in zip(a.tolist(), b.tolist())]
    assert flat == [(0, 0), (0, 1), (2, 0), (2, 1), (2, 2)]


def test_sketches(spark):
    values = np.random.default_rng(0).integers(-(2**60), 2**60, 500)
    bits = S.filter_bits(len(values))
    packed = S.bits_of_column(spark.createDataFrame([(int(v),) for v in values] + [(None,)], "h bigint"), "h", bits)
    assert S.may_contain(packed, mix(values.view(np.uint64))).all() and np.unpackbits(packed).mean() <= 0.1
    assert S.filter_bits(10**9) is None and all(2 ** S.filter_bits(n) >= 10 * n for n in (0, 1, 10**4, 5 * 10**7))
    counter = S.Counter(12)
    counter.add(np.repeat(np.arange(10, dtype=np.uint64), np.arange(10)))
    numbers, datas = S.blocks_of(counter.cells)
    merged = S.merge_counts(spark.createDataFrame(list(zip(numbers, map(bytearray, datas))) * 2, "block int, data binary"), 12)
    assert S.count_at(S.count_level(merged, np.arange(10, dtype=np.uint64))) == pytest.approx(2 * np.arange(10), rel=0.05)
    assert S.count_bits(0) == 12 and S.count_bits(10**6) == 18 and S.count_bits(10**12) == S.MOST_COUNT_BITS


def test_merging_a_sketch_leaves_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    counter, before = S.Counter(12), files()
    counter.add(np.arange(100, dtype=np.uint64))
    S.merge_counts(spark.createDataFrame(list(zip(*(x if i == 0 else map(bytearray, x) for i, x in enumerate(S.blocks_of(counter.cells))))), "block int, data binary"), 12)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before


def shuffled_rows(spark, run):
    """Rows that the stages of ``run()`` wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        return {s.stageId(): s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList()))}

    before = max(stages(), default=-1)
    run()
    return sum(n for k, n in stages().items() if k > before)


def test_pairs_that_meet_are_not_shuffled(spark):
    """Templated texts: pairs that meet grow with the square of the table, but only those with enough in common leave a task."""

    def classes(n):
        rng = random.Random(n)
        phrases = [" ".join(f"p{k}x{i}" for i in range(6)) for k in range(60)]
        rows = [(k, rng.sample(phrases, 10), "train" if k % 2 else "dev", None, "", "") for k in range(n)]
        df = frame(spark, rows).select(F.col("record_id").alias("id"), "texts", "split")
        texts, o = df.select("id", "texts"), O.Overlap()
        sets = {r[0]: triples(r[1]) for r in rows}
        near = sum(3 <= len(sets[e] & sets[t]) for e in sets for t in sets if not e % 2 and t % 2)
        return near, shuffled_rows(spark, lambda: O.contained_classes(df.filter("split = 'dev'").select("id", "texts"), df.filter("split = 'train'").select("id", "texts"), texts, O.Profile(texts, o), o).count())

    (met, few), (met_more, more) = classes(200), classes(800)
    assert met_more > 12 * met and more < 6 * few and more < met_more / 4, (met, few, met_more, more)


@pytest.mark.parametrize("o", [O.Overlap(groups_at_once=40), O.Overlap(groups_at_once=300, agree=1), O.Overlap(agree=40)])
def test_shares_of_the_index(spark, o):
    """Several shares, training sets then being read from a table of hashes, groups of one member and of many: nothing is lost."""
    rows = corpus(12)
    sets = {r[0]: (triples(r[1]), (r[2] or "").strip().lower()) for r in rows}
    want = {(min(e, t), max(e, t)) for e, (x, s) in sets.items() for t, (y, u) in sets.items() if s in ("dev", "test") and u == "train" and x and 5 * len(x & y) >= 4 * len(x)}
    got = {tuple(r) for r in O.cross_split(frame(spark, rows).repartition(3), "record_id", "texts", split_name("split"), o=o).collect()}
    assert got == want and len(got) > 100


def test_groups_of_a_set():
    """Every set's groups are disjoint, led by its rarest shingles; a set that holds all but n - need shingles always comes out, one without a whole group never."""
    o, rng = O.Overlap(), np.random.default_rng(3)
    texts = [[" ".join(f"g{k}x{i}" for i in range(n + 2))] for k, n in enumerate((1, 2, 4, 5, 9, 23, 200))]
    s = O.Sets(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "texts"]), 3)
    level = (s.values % np.uint64(7)).astype(np.uint8)
    leads, members, owner = O._groups(s, level, o)
    block = pa.table({"share": pa.array([0, 0], pa.int32()), **{c: [x.tobytes()] * 2 for c, x in (("names", s.classes), ("sizes", s.sizes.astype(np.int64)), ("leads", leads), ("members", members))}})
    index = {p: np.frombuffer(d, O._INDEX_TYPES[p]) for p, d in zip(*(O._index(block, o)[c].to_pylist() for c in ("part", "data")))}
    assert len(index["names"]) == len(texts) and len(index["entries"]) == len(leads)
    need = O._group_numbers(s.sizes, o)[0]
    for _ in range(50):
        held = [rng.choice(v, n, replace=False) for v, n in zip(np.split(s.values, s.offsets[1:-1]), need)]
        low = np.concatenate(held).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        a, b = O._holding(index, low.astype(np.uint32), np.concatenate(([0], np.cumsum(need))))
        assert sorted(zip(a.tolist(), b.tolist())) == [(k, k) for k in range(len(texts))]
    none = np.concatenate([v[: n - 1] for v, n in zip(np.split(s.values, s.offsets[1:-1]), need)]) & np.uint64(0xFFFFFFFF)
    assert not len(O._holding(index, none.astype(np.uint32), np.concatenate(([0], np.cumsum(need - 1))))[0])
