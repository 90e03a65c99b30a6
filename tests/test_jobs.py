"""Whole runs from a file to written report tables."""

import datetime
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest

from tablelens import AnalysisConfig, analyze, analyze_path, profile_table, temporary_copies, write_report_tables
from tablelens.functions.staging import stage
from tablelens.operators.charts import left_out
from tablelens.plans import batch, jobs
from tablelens.plans.report import SECTIONS, display_table, task_label


@pytest.fixture(scope="module")
def sales(tmp_path_factory):
    rng = np.random.default_rng(7)
    lines = ["일자,지역,판매채널,광고비,방문고객수,매출액"]
    for i in range(300):
        ad, visits = rng.gamma(2, 100), int(rng.poisson(320))
        lines.append(f"2024-{1 + i % 12:02d}-{1 + i % 28:02d},{'서울 부산 대구'.split()[i % 3]},{'AB'[i % 2]},"
                     f"{'' if i % 50 == 0 else round(ad, 1)},{visits},{round(5 * ad + 3 * visits + 100 * (i % 3) + rng.normal(0, 30), 1)}")
    path = tmp_path_factory.mktemp("data") / "sales.csv"
    path.write_text("\n".join(lines), encoding="utf-8-sig")
    return str(path)


def test_batch_job_writes_a_report(spark, sales, tmp_path, capsys):
    code = batch.main([sales, "--target", "매출액", "--out", str(tmp_path), "--cv", "2", "--max-models", "3", "--author", "A"], spark)
    out = capsys.readouterr().out
    assert code == 0 and "analysis: regression" in out and "r2:" in out
    folder = next(tmp_path.glob("run_id=*"))
    index = spark.read.parquet(str(folder / "report_index")).orderBy("ord").collect()
    assert [r["section"] for r in index] == sorted((r["section"] for r in index), key=lambda s: (s == "A", s))
    for r in index:
        spark.read.parquet(str(folder / r["table_name"])).limit(1).collect()
    names = {r["table_name"] for r in index}
    assert {"cover", "overview", "preparation", "leaderboard", "holdout", "importance", "settings", "chart_residual"} <= names
    holdout = {r["metric"]: r["value"] for r in spark.read.parquet(str(folder / "holdout")).collect()}
    assert holdout["r2"] > 0.5


def test_exit_codes(spark, tmp_path, capsys, monkeypatch):
    assert batch.main([str(tmp_path / "absent.csv"), "--quiet"], spark) == 2
    monkeypatch.setattr(batch, "analyze_path", lambda *a, **k: 1 / 0)
    assert batch.main([str(tmp_path / "x.csv")], spark) == 1
    assert "failed" in capsys.readouterr().err


def test_exploration_of_a_path(spark, sales):
    result = analyze_path(spark, sales, AnalysisConfig())
    assert result.task == "eda" and result.modeling is None
    rules = {r["rule_id"] for r in result.findings.collect()}
    assert {"size", "missing", "choose_target", "summary_no_model"} <= rules
    assert result.tables["cover"].where("item = 'encoding'").first()["content"] == "utf-8-sig"


def test_runs_are_never_overwritten(spark, tmp_path):
    tables = {"cover": spark.range(1)}
    now = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert write_report_tables(spark, tables, str(tmp_path), now=now).endswith("run_id=20240102_030405")
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        write_report_tables(spark, tables, str(tmp_path), now=now)


def test_dotted_and_blank_names_survive_everything(spark):
    rows = [(f"g{i % 4}", float(i % 31) + 0.5, "x" if i % 5 else None, float(i % 31) * 2 + (i % 4)) for i in range(200)]
    df = spark.createDataFrame(rows, "`group one` string, `a.b` double, `c``d` string, `y.z` double")
    result = analyze(df, AnalysisConfig(target="y.z", cv_folds=2, max_models=2))
    assert result.has_model, result.messages
    for name, t in {**result.tables, **result.charts}.items():
        t.limit(2).collect()


def test_copies_are_removed(spark):
    kept = stage(spark.range(3))
    with temporary_copies(spark):
        inner = stage(spark.range(5))
        folder = Path(urlparse(inner.inputFiles()[0]).path).parent
        assert folder.exists() and inner.count() == 5
    assert not folder.exists() and kept.count() == 3


def test_display_table(spark):
    df = spark.createDataFrame([(i, i / 7, None if i else "a") for i in range(5)], "i int, x double, s string")
    rows = display_table(df, 3, ["i"]).collect()
    assert [tuple(r) for r in rows] == [("0", "0", "a", True), ("1", "0.1429", "-", True), ("2", "0.2857", "-", True)]
    assert not display_table(df, 5).first()["truncated"]


def test_labels_and_sections():
    assert task_label("eda", None) == "exploratory data analysis" and task_label("regression", "y") == "regression of 'y'"
    names = [n for _, _, tables in SECTIONS for n in tables]
    assert len(names) == len(set(names))


def test_every_report_table_has_a_place(spark):
    df = spark.createDataFrame([(float(i % 23), "ab"[i % 2], float(i % 23 + i % 2)) for i in range(100)], "x double, c string, y double")
    result = analyze(df, AnalysisConfig(target="y", cv_folds=2, max_models=1))
    placed = {n for _, _, tables in SECTIONS for n in tables}
    assert set(result.tables) <= placed


def test_pairs_and_names_beyond_the_first_columns(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(120, 44))
    values[:, 43] = values[:, 42] * 2 + rng.normal(0, 1e-3, 120)
    names = [f"v{i:02d}" for i in range(44)]
    df = spark.createDataFrame([tuple(r) for r in values.tolist()], ", ".join(f"{n} double" for n in names))
    result = analyze(df, AnalysisConfig())
    top = result.tables["top_correlations"].first()
    assert (top.var1, top.var2) == ("v42", "v43")
    said = [r.message for r in result.tables["messages"].collect()]
    assert any(m.startswith("histograms") and all(n in m for n in names[6:]) and "v05" not in m for m in said)
    assert any(m.startswith("boxes") and "v08" in m and "v07" not in m for m in said)
    more = analyze(df, AnalysisConfig(histogram_columns=44, box_columns=43))
    assert more.charts["distribution"].select("name").distinct().count() == 44
    assert [r.message for r in more.tables["messages"].collect()] == ["boxes: not shown, beyond the first 43 columns: v43"]


def test_limits_of_groups_and_classes_are_told(spark):
    df = spark.createDataFrame([(float(i), f"c{i % 15}", "ab"[i % 2], f"d{i % 25}") for i in range(300)], "y double, c string, d string, e string")
    profile = profile_table(df)
    said = left_out(profile, "y", "regression", AnalysisConfig())
    assert any(m.startswith("means by group: the 12 largest of 15") for m in said) and any(m.endswith("columns: e") for m in said)
    assert left_out(profile, "e", "classification", AnalysisConfig()) == ["target: the 20 most frequent of 25 classes are shown"]
    assert left_out(profile, "e", "classification", AnalysisConfig(shown_classes=30)) == []


def test_only_unusable_data_becomes_an_exploration(spark, monkeypatch):
    df = spark.createDataFrame([(float(i % 23), float(i)) for i in range(60)], "x double, y double")

    def failing(error):
        def run(*_):
            raise error
        monkeypatch.setattr(jobs, "run_comparison", run)
        return analyze(df, AnalysisConfig(target="y", cv_folds=2, max_models=1))
    assert failing(RuntimeError("no candidate")).modeling is None
    with pytest.raises(OSError):
        failing(OSError("an executor is lost"))


def test_report_is_written_in_display_form_too(spark, tmp_path):
    df = spark.createDataFrame([(i % 7, "ab"[i % 2]) for i in range(60)], "x int, c string")
    result = analyze(df, AnalysisConfig(), output=str(tmp_path))
    shown = spark.read.parquet(f"{result.report_path}/display/table_summary")
    assert all(t == "string" for c, t in shown.dtypes if c != "truncated") and shown.count() == result.tables["table_summary"].count()
    assert set(result.display) == {n for n in result.tables if not n.startswith("chart_")}
