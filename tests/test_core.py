import json
import math
import os
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.functions import shingles, text, vectors
from treeloom.operators import checks, kmeans, metrics, pooling, records, reduction
from treeloom.operators.delivery import first_delivery
from treeloom.session import write_table
from treeloom.sources import readers, sinks

DEMO = [
    ("G01", [("1", []), ("2", ["1"]), ("3", ["2"])], [0, 1, 2]),
    ("G03", [("1", []), ("2", ["1"]), ("3", ["1"]), ("4", ["2", "3"])], [0, 1, 1, 2]),
    ("H03", [("1", []), ("2", []), ("3", ["1", "2"]), ("4", ["3"])], [0, 0, 1, 2]),
    ("A03", [("1", []), ("2", ["1"]), ("3", ["2"]), ("4", ["3"])], [0, 1, 2, 3]),
]


def nested(spark, rows):
    data = [(i, name, [(c, "text", p) for c, p in claims], ("A", "A01", "A01B"), "train", "s", None) for i, (name, claims, _) in enumerate(rows)]
    return spark.createDataFrame(data, "record_id bigint, patent_id string, claims array<struct<claim_id: string, text: string, parent_ids: array<string>>>, cpc struct<section: string, class: string, subclass: string>, split string, source string, received_at timestamp")


def test_depths_of_demo_records(spark):
    rec = records.normalize_records(nested(spark, DEMO))
    got = {(r["record_id"], r["claim_id"]): r["depth"] for r in records.claim_depths(rec).collect()}
    for i, (_, claims, depths) in enumerate(DEMO):
        assert [got[i, c] for c, _ in claims] == depths
    s = records.dataset_summary(rec).first()
    assert (s["n_records"], s["n_claims"], s["n_edges"], s["n_roots"], s["max_depth"]) == (4, 15, 12, 5, 3)


def test_graph_rules(spark):
    rows = [("self", [("1", []), ("2", ["2"])], None), ("unknown", [("1", []), ("2", ["9"])], None), ("cycle", [("1", ["2"]), ("2", ["1"])], None), ("none", [], None)]
    rec = records.normalize_records(nested(spark, rows))
    strict = {r["record_id"]: r for r in records.graph_validation(rec).collect()}
    loose = {r["record_id"]: r for r in records.graph_validation(rec, remove_invalid=True, require_acyclic=False).collect()}
    assert not any(r["is_valid"] for r in strict.values())
    assert not loose[0]["is_valid"] and loose[1]["is_valid"] and not loose[2]["is_valid"] and strict[2]["has_cycle"] and strict[2]["max_depth"] == 0
    with pytest.raises(records.RecordError):
        records.require_empty(records.self_references(records.explode_claims(rec)), "self references")


def test_first_delivery(spark):
    df = spark.createDataFrame([(1, "late", "2021-01-02", 5), (1, "early", "2021-01-01", 5), (2, "only", None, 5), (None, "x", None, 5), (None, "y", None, 5)], "record_id int, v string, received_at string, _row int")
    assert sorted((r["record_id"] or 0, r["v"]) for r in first_delivery(df).collect()) == [(0, "x"), (0, "y"), (1, "early"), (2, "only")]
    assert first_delivery(df.limit(0)).count() == 0


def test_text_rules(spark):
    df = spark.createDataFrame([("  a61k 31　",), ("",), (None,), ("12.0",), ("nan",)], "s string")
    rows = df.select(text.strip("s").alias("a"), text.label("s").alias("b"), text.code_levels(F.col("s")).alias("c"), text.cache_identifier(F.col("s")).alias("d"), text.alnum_key("s").alias("e")).collect()
    assert rows[0]["a"] == "a61k 31" and tuple(rows[0]["c"]) == ("A", "A61", "A61K") and rows[0]["e"] == "A61K31"
    assert rows[1]["b"] is None and rows[2]["a"] is None and rows[3]["d"] == "12" and rows[4]["d"] is None


def test_vector_functions(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [100.0, 200.0]], [1.0, 1.0, 0.0], 2)], "t array<array<double>>, m array<double>, n int")
    r = df.select(vectors.masked_mean(F.col("t"), F.col("m")).alias("a"), vectors.truncated_mean(F.col("t"), F.col("n")).alias("b"), vectors.masked_mean(F.col("t"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("c"), vectors.l2(F.array(F.lit(0.0), F.lit(0.0))).alias("d"), vectors.l2(F.array(F.lit(3.0), F.lit(4.0))).alias("e")).first()
    assert r["a"] == [2.0, 3.0] and r["b"] == [2.0, 3.0] and r["c"] is None and r["d"] is None and r["e"] == pytest.approx([0.6, 0.8])
    bad = spark.createDataFrame([(None,), ([],), ([float("nan"), 1.0],), ([0.0, 0.0],), ([1.0, None],), ([1.0, 2.0],)], "v array<double>")
    assert [r[0] for r in bad.select(vectors.valid(F.col("v"))).collect()] == [False] * 5 + [True]


def parts_of(spark):
    return spark.createDataFrame([(1, 1, 0, 0, [3.0, 4.0]), (1, 2, 1, 1, [2.0, 1.0]), (2, 1, 0, 0, [1.0, 0.0])], "patent_id int, claim_id int, depth int, claim_pos int, vector array<double>")


def test_pooling_modes(spark):
    raw = dict(unit_before=False, unit_after=False)
    got = {r["patent_id"]: r["vector"] for r in pooling.pool(parts_of(spark), pooling.Pooling(1.0, 0.0, **raw)).collect()}
    assert got[1] == pytest.approx([2.5, 2.5])
    w = [12.0, math.exp(-0.1)]
    got = {r["patent_id"]: r["vector"] for r in pooling.pool(parts_of(spark), pooling.Pooling(**raw)).collect()}
    assert got[1] == pytest.approx([(w[0] * 3 + w[1] * 2) / sum(w), (w[0] * 4 + w[1]) / sum(w)])
    unit = {r["patent_id"]: r["vector"] for r in pooling.pool(parts_of(spark), pooling.Pooling()).collect()}
    assert np.linalg.norm(unit[1]) == pytest.approx(1)
    for a in (1.0, 12.0):  # weights cancel where all chosen parts are alike
        got = {r["patent_id"]: r["vector"] for r in pooling.pool(parts_of(spark), pooling.Pooling(a, 0.1, "root_only", **raw)).collect()}
        assert got[1] == pytest.approx([3.0, 4.0])
    grid = {(r["pool"], r["patent_id"]): r["vector"] for r in pooling.pool_grid(parts_of(spark), [pooling.Pooling(1.0, 0.0, **raw), pooling.Pooling(**raw)]).collect()}
    assert grid["root1_d000", 1] == pytest.approx([2.5, 2.5])
    merged = {r["patent_id"]: r["vector"] for r in pooling.merge_partials(pooling.partial_sums(parts_of(spark), pooling.Pooling(**raw), ["claim_id", "patent_id"])).collect()}
    assert merged[1] == pytest.approx(grid["root12_d010", 1])
    with pytest.raises(ValueError):
        pooling.Pooling(root_weight=0)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(a, b) for a, b in zip([0, 0, 1, 1, 2, 2], [2, 2, 0, 0, 1, 1])], "t int, p int")
    s = metrics.scores(metrics.contingency(df, "t", "p")).first()
    assert all(s[c] == pytest.approx(1) for c in ("purity", "inverse_purity", "ari", "nmi_arithmetic", "nmi_min", "nmi_max", "nmi_geometric"))
    m = metrics.label_match(df, "t", "p").first()
    assert (m["n_equal"], m["n_unequal"]) == (0, 6)
    one = spark.createDataFrame([(1, 5), (1, 5)], "t int, p int")
    assert metrics.scores(metrics.contingency(one, "t", "p")).first()["nmi_arithmetic"] == 1
    half = spark.createDataFrame([(1, 5), (2, 5)], "t int, p int")
    assert metrics.scores(metrics.contingency(half, "t", "p")).first()["nmi_arithmetic"] == 0
    assert metrics.scores(metrics.contingency(df.limit(0), "t", "p")).count() == 0


def test_kmeans(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(36, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None), (98, [float("nan")] * 8), (0, x[0].tolist())], "row_idx bigint, features array<double>")
    a, r = kmeans.spherical_kmeans(df, "row_idx", "features", 4, seed=17)
    b, q = kmeans.spherical_kmeans(df.repartition(5), "row_idx", "features", 4, seed=17)
    assert r.counts.sum() == 36 and r.active_clusters == 4 and np.allclose(np.linalg.norm(r.centroids, axis=1), 1)
    assert sorted(map(tuple, a.select("row", "cluster").collect())) == sorted(map(tuple, b.select("row", "cluster").collect()))
    assert r.objective == pytest.approx(q.objective)
    with pytest.raises(ValueError):
        kmeans.run_seeds(df, "row_idx", "features", 4, [1, 1])
    with pytest.raises(ValueError):
        kmeans.spherical_kmeans(df, "row_idx", "features", 37)
    legacy, s = kmeans.spherical_kmeans(df, "row_idx", "features", 4, seed=17, legacy=True)
    assert legacy.count() == 36 and s.converged


def test_kmeans_reseeds_empty_clusters(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "row bigint, v array<double>")
    r = kmeans.lloyd(df, np.array([[1.0, 0.0], [1.0, 0.0]]), max_iter=10)
    assert sorted(r.counts.tolist()) == [1, 2]


def test_reduction(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 6)) @ rng.normal(size=(6, 6)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row bigint, v array<double>")
    model = reduction.fit(df, 3)
    c = x - x.mean(axis=0)
    values = np.linalg.svd(c, compute_uv=False) ** 2
    assert model.explained == pytest.approx(values[:3] / values.sum())
    model.save(str(tmp_path / "m.json"))
    again = reduction.Reduction.load(str(tmp_path / "m.json"), 6, 3)
    odd = df.union(spark.createDataFrame([(77, None), (78, [1.0])], "row bigint, v array<double>"))
    out = {r["row"]: r["reduced"] for r in reduction.transform(odd, "row", "v", again, unit=False).collect()}
    assert np.allclose(np.array([out[i] for i in range(50)]), c @ model.components.T) and out[77] is None and out[78] is None
    with pytest.raises(ValueError):
        reduction.Reduction.load(str(tmp_path / "m.json"), 7)
    with pytest.raises(ValueError):
        reduction.fit(df, 7)


def test_checks(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k int, v array<double>")
    r = checks.compare_matrices(a, a, "k", "v").first()
    assert r["max_difference"] == 0 and r["min_cosine"] == 1 and r["passed"]
    r = checks.compare_matrices(a, a.filter("k = 1"), "k", "v").first()
    assert r["n_left_only"] == 1 and not r["passed"]
    n = checks.norm_summary(a, "v").first()
    assert n["min_norm"] == n["max_norm"] == 1 and n["max_unit_error"] == 0
    assert checks.index_is_complete(spark.range(3).toDF("i"), "i").first()["complete"]


def brute_shingles(texts, width=3):
    out = set()
    for t in texts or []:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out |= {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return out


def test_shingles_against_regular_expressions(monkeypatch):
    texts = [["One two, THREE four", None, "a b"], None, [], ["é É ß ẞ İx one_two ½ 漢字 かな カナ words", "x" * 50], ["A b c d " * 100, "tail of words"], ["𝒜𝒷 𝒸 d éf g"]]
    for segment in (1 << 20, 64):
        monkeypatch.setattr(shingles, "SEGMENT_BYTES", segment)
        shingles._powers.clear()
        offsets, values = shingles.list_shingle_sets(pa.array(texts, pa.list_(pa.string())))
        sizes = np.diff(offsets).tolist()
        assert sizes == [len(brute_shingles(t)) for t in texts]
        if segment == 1 << 20:
            whole = values
        else:
            assert (whole == values).all()
    shingles._powers.clear()


def test_readers_and_sinks(spark, tmp_path):
    record = {"patent": "P1", "claims": [{"cid": "1", "text": "t", "parent_ids": []}], "cpc": {"section": "A", "class": "A01", "subclass": "A01B"}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"records": [record]}))
    (tmp_path / "in" / "b.json").write_text(json.dumps([record, record]))
    df = readers.read_records(spark, str(tmp_path / "in"), names={"patent_id": "patent", "claim_id": "cid"})
    assert df.count() == 3 and df.first()["claims"][0]["claim_id"] == "1"
    (tmp_path / "s.json").write_text('{"a": "${TL_X:-7}", "b": ["${TL_NONE}"]}')
    assert readers.load_settings(str(tmp_path / "s.json")) == {"a": "7", "b": ["${TL_NONE}"]}
    with pytest.raises(KeyError):
        readers.load_settings(str(tmp_path / "s.json"), strict_environment=True)
    sinks.save_json({"x": np.float64(1.5), "y": np.arange(2)}, str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text()) == {"x": 1.5, "y": [0, 1]}
    with pytest.raises(ValueError):
        sinks.save_json({"x": float("nan")}, str(tmp_path / "o.json"))
    assert not [p for p in os.listdir(tmp_path) if p.startswith("tmp")]
    sinks.save_vectors(spark.createDataFrame([("p", 1, [1.0])], "pool string, k int, v array<double>"), str(tmp_path / "v"), "v", by=("pool",))
    assert readers.read_pool(spark, str(tmp_path / "v"), "p").count() == 1
    with pytest.raises(Exception, match="NaN"):
        sinks.save_vectors(spark.createDataFrame([("p", 1, [float("nan")])], "pool string, k int, v array<double>"), str(tmp_path / "w"), "v")
    sums = pooling.partial_sums(parts_of(spark).withColumn("shard", F.lit("s0")), pooling.Pooling(), ["shard", "patent_id"])
    for _ in range(2):
        sinks.save_partials(sums, str(tmp_path / "partials"), "sig")
    held = spark.read.parquet(str(tmp_path / "partials"))
    assert held.count() == 2
    todo = sinks.shards_to_do(spark.createDataFrame([("s0",), ("s1",)], "shard string"), held, "sig")
    assert [r["shard"] for r in todo.collect()] == ["s1"]
    m = sinks.manifest({"k": 1}, [str(tmp_path / "o.json"), "missing"], [], spark)
    assert len(m["inputs"]) == 1 and m["inputs"][0]["sha256"] == sinks.checksums(spark, str(tmp_path), "o.json").first()["sha256"]
    assert readers.find_newest(spark, str(tmp_path / "in"), "*.json", "b.").endswith("b.json")
    (tmp_path / "a.csv").write_text("global_index,patent_id,section,class,subclass\n0,P,A,A01,A01B\n")
    assert readers.read_assignments(spark, str(tmp_path / "a.csv")).first()["global_index"] == 0
    assert readers.read_shards(spark, str(tmp_path / "v"), "*.parquet", expected=1).count() == 1
    with pytest.raises(ValueError):
        readers.read_shards(spark, str(tmp_path / "v"), "*.parquet", expected=3)


def test_synthetic_vectors(spark):
    from treeloom.sources.synthetic import synthetic_vectors

    df = spark.range(2000).toDF("k")
    a = {r["k"]: r["vector"] for r in synthetic_vectors(df, ["k"], 4, 1).collect()}
    b = {r["k"]: r["vector"] for r in synthetic_vectors(df.repartition(7), ["k"], 4, 1).collect()}
    x = np.array([a[k] for k in range(2000)])
    assert a == b and abs(x.mean()) < 0.05 and abs(x.std() - 1) < 0.05 and abs(np.corrcoef(x.T)[0, 1]) < 0.1


def test_grid_verification(spark):
    from treeloom.operators.experiments import delta_to, sensitivity_grid, verify_grid

    grid = sensitivity_grid()
    df = spark.createDataFrame([(g.name, 0.3 + 0.001 * i) for i, g in enumerate(grid)], "pool string, nmi double")
    r = verify_grid(df, "pool", "nmi", grid, grid[0].name, 0.3).first()
    assert len(grid) == 24 and r["passed"] and r["best"] == grid[-1].name
    assert not verify_grid(df.limit(5), "pool", "nmi", grid, grid[0].name, 0.3).first()["passed"]
    assert delta_to(df, "nmi", "pool", grid[0].name).agg({"delta": "max"}).first()[0] == pytest.approx(0.023)


def test_stream_resumes(spark, tmp_path):
    from datetime import datetime

    from treeloom.streaming.accumulate import accumulate_stream, event_windows, finalize

    schema = "patent_id bigint, claim_id int, token_embeddings array<array<float>>, num_tokens int, encoded_at timestamp"
    rows = [(1, 1, [[3.0, 4.0]], 1, datetime(2021, 1, 1)), (1, 2, [[2.0, 1.0]], None, None), (2, 1, [[1.0, 0.0]], 5, None), (2, 2, [[float("nan"), 0.0]], 1, None)]
    depths = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 1, 1), (2, 1, 0, 0), (2, 2, 1, 1)], "patent_id bigint, claim_id int, depth int, claim_pos int")
    p = pooling.Pooling(unit_before=False, unit_after=False)
    source, state, held = (str(tmp_path / x) for x in ("in", "state", "check"))
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)
    again = (1, 1, [[9.0, 9.0]], 1, datetime(2022, 1, 1))  # encoded anew later: the first one counts, in whatever batch it comes
    for part in (rows[:1], rows[1:], [again]):  # the later calls read only what is new
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(source)
        accumulate_stream(spark, source, kind, state, held, merge_after=2)
    assert [p for p in os.listdir(state) if p.startswith("generation=")] == ["generation=2"]  # merged twice
    rows.append(again)
    got = {r["patent_id"]: (r["vector"], r["n_parts"]) for r in finalize(spark, state, depths, p).collect()}
    parts = pooling.part_vectors(spark.createDataFrame(rows, kind)).join(depths, ["patent_id", "claim_id"])
    want = {r["patent_id"]: (r["vector"], r["n_parts"]) for r in pooling.pool(parts, p).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in got)
    events = spark.createDataFrame([(datetime(2021, 1, 1, 0, 5), "a", 1.0), (None, "a", 1.0)], "ts timestamp, event_type string, value double")
    assert event_windows(events).count() == 1


def test_late_rows_are_dropped_in_append_mode(spark, tmp_path):
    from datetime import datetime

    from treeloom.streaming.accumulate import stream_windows

    kind = "ts timestamp, event_type string, value double"
    source, out, held = (str(tmp_path / x) for x in ("in", "out", "check"))
    batches = ([(datetime(2021, 1, 1, 0, 5), "a", 1.0), (datetime(2021, 1, 1, 0, 50), "a", 2.0)], [(datetime(2021, 1, 1, 5, 0), "a", 4.0)], [(datetime(2021, 1, 1, 0, 7), "a", 8.0), (datetime(2021, 1, 1, 9, 0), "a", 16.0)], [(datetime(2021, 1, 1, 20, 0), "a", 32.0)])
    for rows in batches:
        df = spark.createDataFrame(rows, kind)
        df.coalesce(1).write.mode("append").parquet(source)
        stream_windows(spark, source, df.schema, out, held, mode="append")
    got = {r["window_start"]: (r["n"], r["total"]) for r in spark.read.parquet(out).collect()}
    assert got[datetime(2021, 1, 1)] == (2, 3.0) and got[datetime(2021, 1, 1, 5)] == (1, 4.0)  # the row of 0:07 came after its window was closed


def test_line_delimited_and_malformed_json(spark, tmp_path):
    record = {"patent_id": "P", "claims": [{"claim_id": "1", "text": "t", "parent_ids": []}], "cpc": None}
    (tmp_path / "l.json").write_text("".join(json.dumps(record | {"patent_id": f"P{k}"}) + "\n" for k in range(5)))
    assert [r["patent_id"] for r in readers.read_records(spark, str(tmp_path / "l.json")).orderBy("patent_id").collect()] == [f"P{k}" for k in range(5)]
    (tmp_path / "one.json").write_text(json.dumps({"records": [record, record]}))
    (tmp_path / "pretty.json").write_text(json.dumps([record, record], indent=2))
    assert readers.read_records(spark, str(tmp_path / "one.json")).count() == 2 and readers.read_records(spark, str(tmp_path / "pretty.json")).count() == 2
    assert readers.read_records(spark, str(tmp_path / "l.json"), layout="lines").count() == 5
    (tmp_path / "bad.json").write_text(json.dumps(record) + "\n{nothing\n")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.read_records(spark, str(tmp_path / "bad.json")).collect()


def test_numpy_files(spark, tmp_path):
    from treeloom.sources import arrays

    x = np.arange(12, dtype=np.float16).reshape(4, 3)
    np.save(tmp_path / "m.npy", x)
    np.save(tmp_path / "f.npy", np.asfortranarray(x.astype(np.float64)))
    np.savez(tmp_path / "a.npz", features=x, patent_ids=np.array(["p", "q", "r", "s"]), labels=np.array([[1], [2], [1], [3]]))
    np.savez_compressed(tmp_path / "b.npz", features=np.array([[np.nan]]), patent_ids=np.array(["p"]))
    np.save(tmp_path / "o.npy", np.array([{"code": 1}], dtype=object), allow_pickle=True)
    for name in ("m.npy", "f.npy"):
        got = arrays.read_matrix(spark, str(tmp_path / name), expected_rows=4, expected_dim=3).orderBy("row_idx").collect()
        assert [list(r["features"]) for r in got] == x.tolist()
    keys = {(os.path.basename(r["path"]), r["key"]): (r["n_rows"], r["n_columns"]) for r in arrays.npz_keys(spark, str(tmp_path)).collect()}
    assert keys[("a.npz", "features")] == (4, 3) and keys[("a.npz", "labels")] == (4, 1) and len(keys) == 5
    assert [r["patent_id"] for r in arrays.read_features(spark, str(tmp_path / "a.npz")).orderBy("row_idx").collect()] == ["p", "q", "r", "s"]
    assert [r["label"] for r in arrays.read_predictions(spark, str(tmp_path / "a.npz"), 4, key="labels").orderBy("row_idx").collect()] == [1, 2, 1, 3]
    for wrong in (lambda: arrays.read_matrix(spark, str(tmp_path / "a.npz"), "missing").collect(), lambda: arrays.read_matrix(spark, str(tmp_path / "b.npz"), "features").collect(), lambda: arrays.read_matrix(spark, str(tmp_path / "o.npy")).collect(), lambda: arrays.read_matrix(spark, str(tmp_path / "m.npy"), expected_rows=5), lambda: arrays.read_predictions(spark, str(tmp_path / "m.npy")).collect()):
        with pytest.raises(Exception, match="array|matrix|rows|NaN|vector"):
            wrong()


def test_strict_joins_and_quantiles(spark):
    from treeloom.operators import checks, metrics, records

    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, "c"), (3, "d")], "k int, y string")
    with pytest.raises(ValueError, match="2"):
        checks.join_strict(left, right, ["k"], "no depth")
    with pytest.raises(ValueError, match="1 positions only on the left"):
        checks.align_positions(left, right, "k")
    assert checks.align_positions(left, left.withColumnRenamed("x", "z"), "k").count() == 2
    rng = np.random.default_rng(0)
    for values in (rng.exponential(size=1000), np.zeros(5), np.array([3.0]), np.round(rng.random(501), 1)):
        df = spark.createDataFrame([(v.tolist(),) for v in np.array_split(values, 4)], "d array<double>").repartition(3)
        for share in (0.0, 0.5, 0.99, 1.0):
            assert checks.quantile(df, "d", share) == pytest.approx(np.quantile(values, share), abs=0)
    assert checks.quantile(spark.createDataFrame([], "d array<double>"), "d", 0.5) is None
    assert {(r["k"], r["row_idx"]) for r in checks.positions(spark.createDataFrame([(7,), (3,), (None,), (7,), (5,)], "k int"), "k").collect()} == {(3, 0), (5, 1), (7, 2)}
    with pytest.raises(ValueError, match="null or blank"):
        metrics.require_labels(spark.createDataFrame([(1, " ")], "k int, x string"), "x")
    flat = spark.createDataFrame([(12, "A", "A01", "A01B"), (13, None, "A01", "A01B")], "patent_id bigint, section string, class string, subclass string")
    assert records.evaluation_records(flat.limit(1)).first()["cpc"]["class"] == "A01"
    for wrong in (lambda: records.evaluation_records(flat), lambda: records.read_legacy(flat), lambda: records.read_legacy(flat, 3)):
        with pytest.raises(records.RecordError):
            wrong()
    from treeloom.functions.text import code_levels_of_list

    assert spark.createDataFrame([([None, " ", "a61k 9/00", "B01D"],)], "c array<string>").select(code_levels_of_list(F.col("c")).alias("l")).first()["l"]["class"] == "A61"


def test_public_names():
    import treeloom

    assert all(getattr(treeloom, name) is not None for name in treeloom.__all__)
    with pytest.raises(AttributeError):
        treeloom.nothing  # noqa: B018


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before, df = files(), spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count()
    assert write_table(df, "counts")[0].count() == 7 and df.count() == 7  # the table is whole, and can be computed again
    df.write.format("noop").mode("overwrite").save()
    assert files() - before  # files of other queries stay, so that they can be told from those
    before = files()
    write_table(df, "counts")
    time.sleep(1)  # they are deleted in the background; later, a collection of garbage could have done it
    assert not files() - before
