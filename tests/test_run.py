"""Settings, lineage, sinks, and whole runs with their plans, resumption and verification."""

import json

import pytest

from scenalyx import charts, cli, lineage, steps, verification
from scenalyx.config import Settings
from scenalyx.sources import sinks

SOURCE = "/root/testdata/sf0.01"
SMALL = {"matched_scenarios": 40, "starts": 2, "rounds": 15, "samples": 200, "models": ["gaussian_terminal", "historical_weighted"], "support": 50}


@pytest.mark.parametrize(
    "wrong",
    [{"end_train": "2001-01-01"}, {"horizon": 0}, {"p_step": "other"}, {"df": 4.0}, {"df_bounds": [5.0, 4.5]}, {"samples": 10}, {"multiple_testing": "none"}, {"support": 1}, {"folds": ["2001-01-01", "2000-01-01"]}, {"colour": 1}],
)
def test_settings_refuse(wrong):
    with pytest.raises(ValueError):
        Settings.of(wrong)


def test_settings_from_file(tmp_path):
    (tmp_path / "s.yaml").write_text(json.dumps(SMALL))
    assert Settings.load(tmp_path / "s.yaml").models == ("gaussian_terminal", "historical_weighted")


def test_lineage_notices_changes(spark, tmp_path):
    here = lambda name: f"file://{tmp_path}/{name}"
    spark.range(5).write.parquet(here("in"))
    spark.range(7).write.parquet(here("out"))
    manifest = here("m.json")
    assert lineage.validate(spark, manifest) == ["no manifest"]
    lineage.write_manifest(spark, manifest, "stage", [here("in")], [here("out")], {"a": [1]})
    assert lineage.validate(spark, manifest, {"a": (1,)}) == [] and lineage.validate(spark, manifest, {"a": [2]}) == ["other settings"]
    lineage.require(spark, manifest)
    spark.range(6).write.mode("overwrite").parquet(here("in"))
    found = lineage.validate(spark, manifest)
    assert any(x.startswith("missing") for x in found) and any(x.startswith("new") for x in found)
    with pytest.raises(RuntimeError, match="not current"):
        lineage.require(spark, manifest)
    (tmp_path / "m.json").write_text("{")
    (tmp_path / ".m.json.crc").unlink(missing_ok=True)
    assert lineage.validate(spark, manifest) == ["the manifest is no JSON"]
    with pytest.raises(ValueError):
        lineage.write_manifest(spark, manifest, "stage", [], [here("out")])


def test_sinks(spark, tmp_path):
    rows = [(s, a, 0.5, float(s) + k) for s in range(2) for k, a in enumerate("ba")]
    path = sinks.write_scenarios(spark.createDataFrame(rows, "scenario long, asset string, p double, x double"), f"file://{tmp_path}/s")
    assert sorted(tuple(r) for r in sinks.read_scenarios(spark, path).collect()) == sorted(rows)
    csv = sinks.write_table(spark.range(3), f"file://{tmp_path}/t", f"file://{tmp_path}/t.csv")
    assert spark.read.parquet(csv).count() == 3 == spark.read.option("header", True).csv(f"file://{tmp_path}/t.csv").count()


def test_wide_csv(spark, tmp_path):
    from scenalyx.sources.tables import read_wide_csv

    (tmp_path / "r.csv").write_text("date,B.SN,A.SN\n2024-01-02,0.5,-0.25\n2024-01-03,0,1e-3\n")
    got = read_wide_csv(spark, f"file://{tmp_path}/r.csv", ["A", "B"], ".SN").orderBy("date", "asset").collect()
    assert [(r.asset, r.value) for r in got] == [("A", -0.25), ("B", 0.5), ("A", 1e-3), ("B", 0.0)]
    with pytest.raises(ValueError, match="missing: Z"):
        read_wide_csv(spark, f"file://{tmp_path}/r.csv", ["Z"], ".SN")
    (tmp_path / "bad.csv").write_text("date,A\n2024-01-02,\n")
    with pytest.raises(ValueError, match="not finite"):
        read_wide_csv(spark, f"file://{tmp_path}/bad.csv", ["A"])


def test_two_level_header(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Price,Close,Close,Open\nTicker,B,A,A\n2024-01-02,1.5,2.5,9\n2024-01-03,,3.5,9\n")
    got = sinks.FieldPrices(f"file://{tmp_path}/w.csv", ["A", "B"]).prices(spark).orderBy("date", "asset").collect()
    assert [(r.asset, r.raw) for r in got] == [("A", 2.5), ("B", 1.5), ("A", 3.5), ("B", None)]
    with pytest.raises(ValueError, match="assets missing"):
        sinks.FieldPrices(f"file://{tmp_path}/w.csv", ["A", "Z"]).prices(spark)


def test_run_plan_resume_verify(spark, tmp_path, capsys):
    run = steps.Run(spark, f"file://{tmp_path}/run", sinks.OrderPrices(SOURCE), Settings.of(SMALL))
    assert [w for _, w, _ in steps.plan(run, "all")] == ["run"] * len(steps.NEEDS)
    with pytest.raises(RuntimeError, match="no manifest"):
        steps.execute(run, "transform")
    assert steps.execute(run, "all") == list(steps.NEEDS)
    assert steps.execute(run, "all", resume=True) == ["snapshot"]
    rows = verification.verify(run).collect()
    assert [r for r in rows if not r.passed] == [] and len(rows) > 25
    assert len(charts.write(run, run.folder)) == len(charts.FRAMES)
    steps.execute(run, "reuse-download")
    # another setting, or a changed table, is noticed
    other = steps.Run(spark, run.folder, run.source, Settings.of(SMALL | {"seed": 1}))
    assert steps.plan(other, "all")[0][1] == "run"
    with pytest.raises(RuntimeError, match="other settings"):
        steps.execute(other, "reuse-download")
    run.write(run.read("weights").limit(3), "weights")
    bad = {r.check_name for r in verification.verify(run).collect() if not r.passed}
    assert {"lineage of portfolio", "lineage of backtest"} <= bad
    assert [s for s, w, _ in steps.plan(run, "all") if w == "run"] == ["portfolio", "backtest", "liquidity", "snapshot"]


def test_command_line(tmp_path, capsys, spark):
    (tmp_path / "s.yaml").write_text(json.dumps(SMALL))
    at = ["--input", SOURCE, "--folder", f"file://{tmp_path}/run", "--config", str(tmp_path / "s.yaml")]
    assert cli.main(["run", *at, "--plan"]) == 0
    assert capsys.readouterr().out.splitlines()[0].split()[:2] == ["download", "run"]
    assert cli.main(["run", *at, "--step", "nothing"]) == 2
    assert cli.main(["run", *at, "--step", "download"]) == 0
    assert cli.main(["verify", *at, "--scope", "core"]) == 1
    with pytest.raises(SystemExit) as end:
        cli.main(["--version"])
    assert end.value.code == 0
