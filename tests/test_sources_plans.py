import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans import charts, profile, report
from plumbline.sources import csv, results
from plumbline.streaming import profile as streaming


def test_delimiters():
    assert [csv.detect_delimiter(f"a{d}b\n1{d}2") for d in ",;\t|"] == [",", ";", "\t", "|"]
    assert csv.detect_delimiter('name;note\n"a,b";"c,d"') == ";"


def test_parse():
    assert csv.parse('x,y\n"x, y","say ""hi"""\r\n1,"line1\nline2"')[1] == [["x, y", 'say "hi"'], ["1", "line1\nline2"]]
    assert csv.parse("a,,c\n1,,x\n\n\n") == (["a", "col_2", "c"], [["1", "", "x"]])
    assert csv.parse("x,x,x\n1,2,3")[0] == ["x", "x_2", "x_3"]
    assert csv.parse("a\n1\n\n3\n\n")[1] == [["1"], [""], ["3"]]
    for bad, line in (("a,b\n1,2\n1,2,3", 3), ("", 1)):
        with pytest.raises(csv.SourceError) as e:
            csv.parse(bad)
        assert e.value.code == "PARSE_FAILED" and e.value.line == line


def test_decode():
    assert csv.decode(b"\xc0\xcc\xb8\xa7") == ("이름", "euc-kr")
    assert csv.decode("﻿a,b".encode()) == ("a,b", "utf-8")
    with pytest.raises(csv.SourceError):
        csv.decode(b"\xff\xff")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a, b", 1.0, "x\ny"), ('say "hi"', 2.5, ""), ("  s ", None, "z")], "t string, n double, u string")
    csv.write_csv(df, str(tmp_path / "out"))
    back, about = csv.read_csv(spark, str(tmp_path / "out" / "part-*"), delimiter=",")
    rows = [tuple(r)[1:] for r in back.orderBy("row_id").collect()]
    assert rows == [("a, b", "1", "x\ny"), ('say "hi"', "2.5", ""), ("  s ", "", "z")] and about["encoding"] == "utf-8"
    text = csv.serialize(["t", "n"], [["a, b", 1.0], [None, float("nan")]])
    assert csv.parse(text)[1] == [["a, b", "1"], ["", ""]]


def people(spark):
    rows = [(k, f"U{k:03d}", f"2023-01-{k % 28 + 1:02d}", "" if k % 25 == 0 else str(20 + k % 50), "ABC"[k % 3], f"0{6000 + k}") for k in range(300)]
    rows.append((300, *rows[-1][1:]))
    return spark.createDataFrame(rows, "row int, id string, joined string, age string, grade string, zip string")


def test_profile_and_recipe(spark):
    df = people(spark)
    stages = []
    r = profile.profile(df, order_column="row", on_progress=lambda s, x: stages.append(s))
    assert {c["name"]: c["type"] for c in r["columns"]} == {"id": "id", "joined": "datetime", "age": "numeric", "grade": "categorical", "zip": "id"}
    assert r["dataset"]["duplicateRowCount"] == 1 and stages == [s for s, _ in profile.STAGES]
    assert profile.profile(df, order_column="row", is_cancelled=lambda: True) is None
    back = results.loads(results.dumps(r))
    assert back["health"] == r["health"]
    assert "Quality" in report.render(r)
    for c in r["columns"]:
        for spec in charts.for_column(c):
            assert charts.render(spec).startswith("<svg")
    _, log, after = profile.preprocess(df, [{"op": "drop-duplicates"}, {"op": "impute", "column": "age"}], "row")
    diff = profile.compare(r, after)
    assert after["dataset"]["rowCount"] == 300 and diff["health"][1] >= diff["health"][0] and report.changes(diff)


def test_overrides(spark):
    df = spark.createDataFrame([("11",), ("22",), ("11",), ("33",)], "x string")
    c = profile.profile(df, type_overrides={"x": "categorical"})["columns"][0]
    assert (c["type"], c["typeOverridden"], c["invalidCount"]) == ("categorical", True, 0)


def test_result_store(spark, tmp_path):
    r = {"schemaVersion": "1.2", "columns": [{"name": "a", "stats": {"mean": 1, "histogram": {"counts": [1] * 100}}}], "correlations": [{"left": "a", "right": "b", "pearson": 0.1, "vif": None, "points": [[0, 0]] * 200}]}
    assert results.save(spark, r, str(tmp_path / "r"))["degraded"] is False and results.load(spark, str(tmp_path / "r")) == r
    assert results.fit(r, len(results.dumps(r)) - 10) == (results.dumps(results.without_histograms(r)), True)
    assert results.fit(r, 10) == (None, True)
    with pytest.raises(csv.SourceError):
        results.loads(json.dumps({"schemaVersion": "2.0"}))


def test_charts():
    assert charts.linear((0, 10), (0, 100))(5) == 50
    cells = charts.heatmap([{"left": "a", "right": "b", "pearson": 0.5}], [{"name": "a"}, {"name": "b"}])
    assert cells["data"]["cells"] == [{"row": 0, "col": 1, "value": 0.5}] and "<rect" in charts.render(cells)
    assert "<circle" in charts.render({"kind": "scatter", "data": {"points": [[0, 0], [1, 1]]}, "axis": {"x": "a", "y": "b"}})


def test_stream(spark, tmp_path):
    for k in range(2):
        spark.range(k * 10, k * 10 + 10).select(F.col("id").cast("double").alias("x")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    streaming.run(stream, ["x"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    r = streaming.merge(spark.read.parquet(str(tmp_path / "out"))).first()
    assert (r["n"], r["mean"], r["min"], r["max"]) == (20, 9.5, 0, 19) and r["std"] == pytest.approx(5.916079783)
