"""The jobs of the command line, one after the other, on the smallest tables."""

import argparse
import json

import numpy as np
import pytest

from treeloom.operators.reduction import Reduction
from treeloom.plans import commands
from treeloom.sources import sinks


def test_prepare_fit_and_evaluate(spark, sf, tmp_path):
    out = str(tmp_path / "features")
    base = ["prepare", "--entries", f"{sf}/token_entries.parquet", "--records", f"{sf}/legacy_records.parquet", "--out", out]
    assert commands.main(spark, base) == 0
    report = json.loads((tmp_path / "features/report.json").read_text())
    saved = spark.read.parquet(f"{out}/features")
    n = saved.count()
    assert n == report["summary"]["n_completed"] - report["norms"]["n_invalid"] and report["norms"]["max_unit_error"] < 1e-9
    assert sorted(r["row_idx"] for r in saved.collect()) == list(range(n))
    assert json.loads((tmp_path / "features/metadata.json").read_text())["n_rows"] == n
    again = [*base[:-1], str(tmp_path / "again"), "--reference", f"{out}/features", "--require-match"]
    assert commands.main(spark, again) == 0
    other = [*base[:-1], str(tmp_path / "other"), "--reference", f"{out}/features", "--require-match", "--root-weight", "1"]
    assert commands.main(spark, other) == 1
    with pytest.raises(ValueError):
        commands.main(spark, [*base[:-1], str(tmp_path / "strict"), "--strict"])

    assert commands.main(spark, ["fit", "--features", out, "--out", str(tmp_path / "m.json"), "--dim", "4"]) == 0
    model = Reduction.load(str(tmp_path / "m.json"), output_dim=4)
    (tmp_path / "wrapped.json").write_text(json.dumps({"pca": json.loads((tmp_path / "m.json").read_text())}))
    assert np.allclose(Reduction.load(str(tmp_path / "wrapped.json")).components, model.components)

    ids = {r["row_idx"]: r["patent_id"] for r in saved.collect()}
    labels = spark.createDataFrame([(i, str(ids[i]), "AB"[i % 2], f"A0{i % 3}", f"A0{i % 3}B") for i in range(n)], "global_index bigint, patent_id string, section string, class string, subclass string")
    labels.write.parquet(str(tmp_path / "labels"))
    run = ["evaluate", "--features", out, "--labels", str(tmp_path / "labels"), "--model", str(tmp_path / "m.json"), "--out", str(tmp_path / "run"), "--k", "3", "--seeds", "1", "2", "--check-order"]
    assert commands.main(spark, run) == 0
    report = json.loads((tmp_path / "run/report.json").read_text())
    assert all(report["gates"].values()) and len(report["seeds"]) == 2 and report["files"]
    assert spark.read.option("header", True).csv(str(tmp_path / "run/predictions")).count() == n
    assert spark.read.parquet(str(tmp_path / "run/clusterings/labels")).count() == 2 * n
    wrong = [*run[: run.index("--out")], "--out", str(tmp_path / "run2"), "--k", "3", "--seeds", "1", "--expect-nmi", "0.123"]
    assert commands.main(spark, wrong) == 1


def test_verify(spark, tmp_path):
    from treeloom.operators.experiments import sensitivity_grid

    names = [g.name for g in sensitivity_grid()]
    (tmp_path / "r.csv").write_text("pool,mean_nmi\n" + "".join(f"{p},{0.3 + k / 1000}\n" for k, p in enumerate(names)))
    args = ["verify", "--results", str(tmp_path / "r.csv"), "--anchor", names[3], "--expected"]
    assert commands.main(spark, [*args, "0.303"]) == 0 and commands.main(spark, [*args, "0.4"]) == 1


def test_settings(tmp_path):
    from treeloom.sources.readers import load_settings

    (tmp_path / "s.json").write_text(json.dumps({"data": {"path": "in/x", "uri": "s3://b/x"}, "k": 3, "_metadata": {"from": "here"}}))
    s = load_settings(str(tmp_path / "s.json"), required=("data.path",), paths=("data.path", "data.uri"), kinds={"k": int})
    assert s["data"] == {"path": str(tmp_path / "in/x"), "uri": "s3://b/x"}
    for wrong in ({"required": ("data.none",)}, {"kinds": {"k": str}}):
        with pytest.raises(ValueError):
            load_settings(str(tmp_path / "s.json"), **wrong)
    sinks.save_config(s, str(tmp_path / "t.json"))
    assert "_metadata" not in json.loads((tmp_path / "t.json").read_text())
    assert sinks.jsonable(argparse.Namespace(a=1)).startswith("Namespace")
