from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arborweave.sources import edges, reports

G0 = """% header
# comment
1 2
2,3
1,3
3 4 0.5
4 4
5 6
2 1
x y
6 7
5 7
8 5
10 1
"""


def pairs(df):
    return sorted(map(tuple, df.select("src", "dst").collect()))


@pytest.fixture()
def g0(tmp_path):
    path = tmp_path / "g0.edges"
    path.write_text(G0)
    return str(path)


def test_golden_lines(spark, g0):
    read = edges.read_edges(spark, g0)
    assert pairs(read) == sorted([(1, 2), (2, 3), (1, 3), (3, 4), (5, 6), (2, 1), (6, 7), (5, 7), (8, 5), (10, 1)])
    assert edges.adjacency(read).count() == 18
    assert edges.adjacency(read, directed=True).count() == 10
    assert edges.vertices(edges.adjacency(read)).count() == 11
    kinds = {r["line_kind"]: r["n_lines"] for r in edges.reject_count(spark.read.text(g0)).collect()}
    assert kinds == {"comment": 2, "edge": 10, "self_loop": 1, "rejected": 1}


def test_odd_lines(spark, tmp_path):
    path = tmp_path / "odd.edges"
    path.write_text("  1\t2\n3,4,0.5\n1 2abc\n5.5 3\n-1 2\n4294967295 0\n4294967296 0\n99999999999999999999 1\n\n7\n , 8 , 9\n")
    assert pairs(edges.read_edges(spark, str(path))) == [(1, 2), (1, 2), (3, 4), (8, 9), (4294967295, 0)]


def test_matrix_size_line(spark, tmp_path):
    path = tmp_path / "m.mtx"
    path.write_text("%%MatrixMarket matrix coordinate\n% more\n5 9 2\n1 2\n3 4\n")
    assert pairs(edges.read_edges(spark, str(path))) == [(1, 2), (3, 4), (5, 9)]
    assert pairs(edges.read_edges(spark, str(path), fmt="mtx")) == [(1, 2), (3, 4)]


def test_empty_and_self_loops(spark, tmp_path):
    for text in ("", "# only\n", "3 3\n4 4\n"):
        path = tmp_path / "e.edges"
        path.write_text(text)
        adj = edges.adjacency(edges.read_edges(spark, str(path)))
        assert adj.isEmpty() and edges.vertices(adj).isEmpty()


def test_many_datasets_and_names(spark, tmp_path):
    for name in ("a.b.edges", "c.txt"):
        (tmp_path / name).write_text("1 2\n")
    got = edges.read_datasets(spark, [str(tmp_path / "a.b.edges"), str(tmp_path / "c.txt")])
    assert sorted(r["dataset"] for r in got.collect()) == ["a.b", "c"]


def test_missing_file(spark):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        edges.read_edges(spark, "/nowhere/at/all.edges")


def test_benchmark_reader_repairs(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("Dataset,Algorithm,Data_MB,BPE,Correct\ng,Algo,1,234.5,8.0,1\nh,Algo,2.5,x,1\ni,Algo,2.5,7.5,\nshort,1\n\n")
    got = {r["Dataset"]: (r["Data_MB"], r["BPE"], r["Correct"]) for r in reports.read_benchmark(spark, str(path)).collect()}
    assert got == {"g": (1234.5, 8.0, 1.0), "i": (2.5, 7.5, None)}
    assert reports.malformed_rows(spark, str(path)) == 2
    path.write_text("Dataset,Algorithm,Data_MB,BPE,MEPS,Correct\ng,Algo,1,234.5,8.0,300.1,1\n")
    assert [r.asDict() for r in reports.read_benchmark(spark, str(path)).collect()] == [{"Dataset": "g", "Algorithm": "Algo", "Data_MB": 1234.5, "BPE": 8.0, "MEPS": 300.1, "Correct": 1.0}]
    path.write_text("")
    assert reports.read_benchmark(spark, str(path)).isEmpty()


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dataset,BPE\na,3.5\nb,bad\n", {"a": 3.5}),
        (" Dataset , Ratio_% \na,50\n", {"a": 16.0}),
        ("Dataset,Algorithm,Data_MB,BPE,Correct\na,my sota,1,4.0,1\nb,Other,1,5.0,1\na,SOTA,1,4.5,1\n", {"a": 4.5}),
        ("Name,Value\na,1\n", {}),
        ("", {}),
    ],
)
def test_external_forms(spark, tmp_path, text, want):
    path = tmp_path / "x.csv"
    path.write_text(text)
    rows = reports.read_external(spark, str(path)).collect()
    assert {r["Dataset"]: r["BPE"] for r in rows} == want
    assert all(r["Algorithm"] == "SOTA" for r in rows)


def test_report_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.23456, True), ("b", None, None)], "d string, x double, ok boolean")
    reports.write_report(df, str(tmp_path / "out"), digits=4)
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text.splitlines()[0] == "d,x,ok" and "a,1.2346,true" in text and "b,," in text
    shown = {r["d"]: (r["x"], r["ok"]) for r in reports.console_table(df).collect()}
    assert shown == {"a": ("1.2346", "YES"), "b": ("", "")}


def test_dataset_name(spark):
    df = spark.createDataFrame([("/a/b.c/web-x.edges",), ("plain",), ("C:\\d\\e.mtx",)], "p string")
    assert [r[0] for r in df.select(edges.dataset_name(F.col("p"))).collect()] == ["web-x", "plain", "e"]


def test_datasets_of_matrix_files(spark, tmp_path):
    """Every file's own size line is left out, and only that."""
    for name in ("one", "two"):
        (tmp_path / f"{name}.mtx").write_text("%%MatrixMarket\n% note\n9 4 3\n1 2\n9 4\n3 1\n")
    paths = [str(tmp_path / f"{name}.mtx") for name in ("one", "two")]
    got = sorted(map(tuple, edges.read_datasets(spark, paths, "mtx").collect()))
    assert got == [(d, a, b) for d in ("one", "two") for a, b in ((1, 2), (3, 1), (9, 4))]
    assert edges.read_datasets(spark, paths).count() == 8
    with pytest.raises(ValueError, match="unknown edge format"):
        edges.read_datasets(spark, paths, "csv")


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from arborweave.session import shared_dir

    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda _: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context))
