"""Text, CSV and log sources and the writers."""

import pytest

from riftline.sources import series, sinks


def test_text_scan_and_ground_truth(spark, tmp_path):
    (tmp_path / "sigma_0_transition_2.txt").write_text("1.5\n2\n\n3e1\n")
    (tmp_path / "sigma_0_transition_2_GroundTruth.txt").write_text("0\n10\n12\n20\n22\n30\n")
    (tmp_path / "sigma_5_transition_3.txt").write_text("1\n")
    found = series.discover(spark, str(tmp_path)).collect()
    assert [(r.sigma, r.transition_length) for r in found] == [(0, 2)]
    rows = series.text_series(spark, str(tmp_path / "sigma_0_transition_2.txt")).orderBy("t").collect()
    assert [(r.t, r.x, r.n) for r in rows] == [(0, 1.5, 3), (1, 2.0, 3), (2, 30.0, 3)]
    gt = series.text_series(spark, str(tmp_path / "sigma_0_transition_2_GroundTruth.txt"))
    assert [(r.start, r.end) for r in series.ramps(gt, 2, expected=2).orderBy("ramp").collect()] == [(10, 12), (20, 22)]
    with pytest.raises(Exception, match="ramp widths"):
        series.ramps(gt, 5, expected=2).collect()


def test_columns_and_optional(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 1.0 2.0\n1 3.0 4.0\n")
    rows = series.text_columns(spark, str(tmp_path / "a.txt"), drop_first=True).orderBy("t").collect()
    assert [list(r.x) for r in rows] == [[1.0, 2.0], [3.0, 4.0]]
    assert series.optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_progress_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"rows": [{"k": 1, "v": 2.0}], "curve": []}\n\n{"rows": [{"k": 1, "v": 9.0}, {"k": 2, "v": 3.0}]}\n{"rows": [{"k": 3')
    rows = series.progress_log(spark, str(tmp_path / "log.jsonl"), "struct<k: int, v: double>", ["k"]).collect()
    assert sorted((r.k, r.v) for r in rows) == [(1, 2.0), (2, 3.0)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "k int, v double")
    sinks.to_csv(df, str(tmp_path / "csv"), single=True)
    assert spark.read.csv(str(tmp_path / "csv"), header=True, schema="k int, v double").count() == 2
    sinks.to_jsonl(df, str(tmp_path / "log"))
    sinks.to_jsonl(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    assert sinks.markdown(df.orderBy("k")) == "| k | v |\n|---|---|\n| 1 | 0.500 |\n| 2 |  |\n"
    new = spark.createDataFrame([(2, 7.0), (3, 8.0)], "k int, v double")
    assert sorted((r.k, r.v) for r in sinks.merged(df, new, ["k"]).collect()) == [(1, 0.5), (2, None), (3, 8.0)]
    assert [r.k for r in sinks.remaining(new, df, ["k"]).collect()] == [3]
    sinks.to_text(df, str(tmp_path / "text"), "v", "k", decimals=4)
    sinks.to_report({"mean": 0.25, "n": 3}, str(tmp_path / "report" / "lines.txt"), spark)
    assert [r.value for r in spark.read.text(str(tmp_path / "report")).collect()] == ["mean: 0.2500", "n: 3"]
