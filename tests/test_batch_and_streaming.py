from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from arborweave.plans import batch
from arborweave.streaming import degrees
from tests.test_sources import G0

ROOT = Path(__file__).resolve().parents[1]


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "g0.edges").write_text(G0)
    (tmp_path / "none.edges").write_text("# nothing\n")
    found = batch.benchmark(spark, [str(tmp_path / "g0.edges"), "/no/such.edges", str(tmp_path / "none.edges")])
    assert found.failures == {"/no/such.edges": "PATH_NOT_FOUND"}
    rows = {(r["dataset"], r["codec"]): r for r in found.rows.collect()}
    assert {k[1]: v["bytes"] for k, v in rows.items() if k[0] == "g0"}["tree_vbyte"] == 16
    assert all(r["correct"] for r in rows.values()) and rows["none", "raw32"]["bpe"] is None and rows["none", "raw32"]["meps"] == 0
    checks = {r["what"]: (r["plain"], r["encoded"]) for r in batch.cross_checks(spark, [str(tmp_path / "g0.edges")]).rows.collect()}
    assert checks == {"components": (4, 4), "triangles": (2, 2), "bfs": (5, 5)}
    empty = {r["what"]: (r["plain"], r["encoded"]) for r in batch.cross_checks(spark, [str(tmp_path / "none.edges")]).rows.collect()}
    assert empty == {"components": (0, 0), "triangles": (0, 0), "bfs": (0, 0)}


def test_degree_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("1 2\n2 3\n# c\n")
    query = degrees.degree_stream(degrees.edge_stream(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("deg").start()
    try:
        query.processAllAvailable()
        (folder / "b.txt").write_text("2,1\n3 1\n3 3\n")
        query.processAllAvailable()
        assert {r["id"]: r["degree"] for r in spark.table("deg").collect()} == {1: 2, 2: 2, 3: 2}
    finally:
        query.stop()


def test_adjacency_sink_and_windows(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("1 2\n2 1\n")
    query = degrees.append_adjacency(degrees.edge_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "ck"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).distinct().collect())) == [(1, 2), (2, 1)]
    timed = spark.createDataFrame([("2024-01-01 00:00:10", 1), ("2024-01-01 00:00:50", 1), ("2024-01-01 00:02:00", 2)], "t string, src long").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r["n_edges"] for r in degrees.windowed_edges(timed).collect()) == [1, 2]


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    got = entry.entry(spark)
    assert got.count() == 4 and "bpe" in got.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_pipeline(tmp_path):
    """The entry imports when the pipeline's module and subpackage are gone."""
    for name in ("arborweave", "__spark_entry__.py"):
        os.symlink(ROOT / name, tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "arborweave").mkdir()
    for p in (ROOT / "arborweave").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "arborweave" / p.name)
    code = "import __spark_entry__ as e, json; print(json.dumps(sorted(e.queries())))"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    names = json.loads(out.stdout)
    assert "codec_metrics" in names and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
