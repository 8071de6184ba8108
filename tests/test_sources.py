import math

import pytest
from pyspark.sql import functions as F

from cumulus.functions import columns as C
from cumulus.sources import points as SP
from cumulus.sources import runs as SR


def test_delimited_points(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" 47, 100,  0\n  5,   7, 9\n")
    rows = SP.read_delimited_points(spark, str(tmp_path), 2, split="train").orderBy("label").collect()
    assert [(r["x"], r["label"], r["split"]) for r in rows] == [([47.0, 100.0], 1, "train"), ([5.0, 7.0], 10, "train")]
    assert len({r["id"] for r in rows}) == 2


@pytest.mark.parametrize("line", ["1, 2\n", "1, x, 3\n", "1, , 3\n"])
def test_bad_lines_fail(spark, tmp_path, line):
    (tmp_path / "a.txt").write_text("47, 100, 0\n" + line)
    with pytest.raises(Exception):
        SP.read_delimited_points(spark, str(tmp_path), 2).collect()


def test_folders_never_match(spark, tmp_path):
    path = str(tmp_path / "x-sweep" / "docs")
    doc = spark.createDataFrame([("m1", 10, {"k": "20"}, None)], SR.DATASET_RUN)
    SR.save_runs(doc, path, "x-compare")
    assert SR.run_parameters(spark, path, "x-sweep").isEmpty() and SR.run_parameters(spark, path, "x-comp").count() == 1


def test_dataset_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    doc = spark.createDataFrame(
        [("m1", 10, {"k": "20"}, [("A", [0.5, math.nan], [3, 0], None)]), ("m2", 11, {"k": "30"}, [("B", [0.1], [1], None)])],
        SR.DATASET_RUN,
    )
    SR.save_runs(doc, path, "x-compare")
    SR.save_runs(doc.withColumn("time", F.lit(99).cast("bigint")), path, "x-sweep")
    rows = SR.read_dataset_runs(spark, path, "A", "RelDom", "x-compare").collect()
    assert [(r["method"], r["value"]) for r in rows] == [("m1", [0.5, None])]
    assert SR.read_dataset_runs(spark, path, "A", "Clusters").isEmpty()
    assert SR.read_dataset_runs(spark, path, "A", "Cells").count() == 2
    assert {r["parameters"]["k"] for r in SR.run_parameters(spark, path, "x-sweep").collect()} == {"20", "30"}


def test_keyed_documents(spark, tmp_path):
    rows = spark.createDataFrame(
        [("r1", 1, "NMI", "a", 0.1), ("r1", 1, "NMI", "b", 0.2), ("r1", 2, "NMI", "a", 0.3), ("r2", 1, "EPS", None, 0.5)],
        "run string, iter int, name string, key string, value double",
    )
    got = {(r["run"], r["name"]): r["maps"] for r in SR.accumulate(rows).collect()}
    assert got["r1", "NMI"] == [{"a": 0.1, "b": 0.2}, {"a": 0.3}] and got["r2", "EPS"] == [{"": 0.5}]
    path = tmp_path / "keyed"
    path.mkdir()
    (path / "run2-d3-1.json").write_text('{\n "method": "Moons2-D3", "time": 5, "parameters": {"c": "2"},\n "results": {"NMI": [{"a": 0.5}], "DATA": [[[1.0]], [[2.0]]]}}')
    (path / "run2-d3-2.json").write_text('{"method": "Other", "time": 6, "parameters": {}, "results": {"EPS": [0.1]}}')
    read = lambda prefix, names: SR.read_keyed_runs(spark, str(path), prefix, names, r"run\d-d\d+", multi_line=True).collect()
    assert len(read("Moons", ["NMI"])) == 1 and not read("Moons", ["EPS"]) and len(read("", ["EPS"])) == 1
    found = {r["method"]: r["stored"] for r in SR.run_catalogue(spark, str(path), multi_line=True).collect()}
    assert found == {"Moons2-D3": 2, "Other": 0}


def test_traces_and_names(spark):
    df = spark.createDataFrame([("a", [5.0, 4.0, 3.0])], "m string, t array<double>")
    assert df.select(C.pad_trace("t", 5)).first()[0] == [5, 4, 3, 3, 3]
    assert [(r["score"], r["clusters"]) for r in C.trim_trace(df, "t", 2).orderBy("pos").collect()] == [(4.0, 2), (3.0, 1)]
    names = spark.createDataFrame([("cover+x:top",), ("x",), ("top",)], "n string")
    assert [r[0] for r in names.select(C.rename_suffix("n", [(":top", ":t"), ("x", "yy")])).collect()] == ["cover+x:t", "yy", "top"]
    c, d = C.run_components(F.lit("Moons12-D14"))
    assert names.select(c, d, C.run_components("n")[0]).first()[:3] == (12, 14, None)
    assert names.select(C.drop_head("n", 5)).collect()[1][0] == ""


@pytest.mark.parametrize("v,want", [(0.25, 0.2), (0.35, 0.4), (-0.25, -0.2)])
def test_half_even(spark, v, want):
    assert spark.createDataFrame([(v,)], "v double").select(C.round_half_even("v", 1)).first()[0] == want
