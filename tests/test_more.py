"""Document structure, layers, exports, sinks and fusion: what the queries with known answers don't show."""

import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from terrasift.functions import coords
from terrasift.operators import exports, fusion, spatial
from terrasift.plans import case_queries
from terrasift.sources import documents, sinks, structure


def test_readers_by_ending(spark, tmp_path):
    assert structure.reader_of("/a/b.CSV") == "delimited" and structure.reader_of("x.odt") == "cells" and structure.reader_of("x.txt") == "text"
    for path in ("noending", "a.pdf", "/dir.d/none"):
        with pytest.raises(ValueError):
            structure.reader_of(path)
    (tmp_path / "t.csv").write_text("nombre,x\nCentro,504750\n")
    assert documents.read(spark, f"file://{tmp_path}/t.csv").count() == 1
    (tmp_path / "e.csv").write_text("nombre,x\n")
    with pytest.raises(ValueError):
        documents.read(spark, f"file://{tmp_path}/e.csv")


def test_records_of_an_odt_file(spark, tmp_path):
    rows = "".join("<table:table-row>" + "".join(f"<table:table-cell><text:p>{c}</text:p></table:table-cell>" for c in r) + "</table:table-row>" for r in [("Nombre", "Dirección", "X", "Y"), ("Consultorio Baza", "C/ Real 3", "504 750", "4.077.153"), ("Centro vacío", "C/ Sol 2", "", "")])
    xml = f'<office:d xmlns:office="o" xmlns:table="urn:t" xmlns:text="urn:x"><table:table table:name="T">{rows}</table:table></office:d>'
    with zipfile.ZipFile(tmp_path / "d.odt", "w") as z:
        z.writestr("content.xml", xml)
    found = {(r.name, r.x_text, r.has_coordinates, r.status) for r in documents.read(spark, f"file://{tmp_path}/d.odt").collect()}
    assert found == {("Consultorio Baza", "504750", True, "original"), ("Centro vacío", "", False, "pending")}


def test_workbooks_and_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a;"b"', "S1"), (2, None, "S2"), (3, "c", "S1")], "id long, name string, sheet string").coalesce(1)
    (written,) = exports.write_workbooks(rows, f"file://{tmp_path}/w", "sheet").collect()
    assert written.rows == 3
    cells = {(s, r, c, v) for s, r, c, v in documents.xlsx_cells((tmp_path / "w" / written.file).read_bytes())}
    assert {("S1", 1, 0, "1"), ("S1", 1, 1, 'a;"b"'), ("S1", 2, 0, "3"), ("S2", 1, 0, "2")} <= cells
    sinks.write_lines(rows.drop("sheet"), f"file://{tmp_path}/l")
    text = "".join(p.read_text() for p in sorted((tmp_path / "l").glob("part-*")))
    assert text == '﻿id;name\n1;"a;""b"""\n2;\n3;c\n'
    assert exports.output_name("/a/b.c.odt", "csv", "20240101") == "b.c_UTM30_20240101.csv"


def brute(points):
    """Huber's centroid by its definition."""

    def median(v):
        v = sorted(v)
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    c, w = (sum(x for x, _ in points) / len(points), sum(y for _, y in points) / len(points)), [1.0] * len(points)
    for _ in range(20 if len(points) > 2 else 0):
        d = [math.hypot(x - c[0], y - c[1]) for x, y in points]
        scale = 1.4826 * median([abs(v - median(d)) for v in d])
        if scale < 10 and max(d) < 10:
            return c, [1.0] * len(points)
        scale = max(scale, 10)
        w = [1.0 if v <= 1.345 * scale else 1.345 * scale / v for v in d]
        new = tuple(sum(p[k] * q for p, q in zip(points, w, strict=True)) / sum(w) for k in (0, 1))
        moved, c = math.hypot(new[0] - c[0], new[1] - c[1]), new
        if moved < 0.1:
            break
    return c, w


def test_clusters_against_brute_force(spark):
    import random

    rng = random.Random(4)
    groups = {q: [(100000 + rng.gauss(0, 40) + 3000 * (rng.random() < 0.2), 4000000 + rng.gauss(0, 40)) for _ in range(rng.randint(1, 9))] for q in range(60)}
    rows = [(q, f"s{i}", x, y, 0.5 + 0.05 * i) for q, p in groups.items() for i, (x, y) in enumerate(p)]
    got = {r.q: r for r in fusion.clusters(spark.createDataFrame(rows, "q int, source string, x double, y double, authority double"), "q").collect()}
    assert len(got) == 60
    for q, p in groups.items():
        c, w = brute(p)
        d = [math.hypot(x - c[0], y - c[1]) for x, y in p]
        out = [i for i in range(len(p)) if len(p) > 1 and (w[i] < 0.5 or d[i] > 100)]
        total = sum(0.5 + 0.05 * i for i in range(len(p)))
        assert math.hypot(got[q].x - c[0], got[q].y - c[1]) < 1e-6 and got[q].outliers == [f"s{i}" for i in out]
        assert abs(got[q].concordance - (1.0 if len(p) == 1 else 1 - sum(0.5 + 0.05 * i for i in out) / total)) < 1e-9
        assert abs(got[q].radius - max([v for v, k in zip(d, w, strict=True) if k >= 0.5], default=0.0)) < 1e-6


def test_no_polygon_and_no_point(spark):
    ring = [[{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0}, {"x": 0.0, "y": 0.0}]]
    polygons = spark.createDataFrame([("a", ring, 0.0, 0.0, 10.0, 10.0)], "code string, rings array<array<struct<x:double,y:double>>>, min_x double, min_y double, max_x double, max_y double")
    points = spark.createDataFrame([(1, "a", 5.0, 5.0), (2, "a", 15.0, 5.0), (3, "b", 5.0, 5.0), (4, "a", 500.0, 5.0), (5, None, 5.0, 5.0)], "id int, code string, x double, y double")
    assert {(r.id, r.state, r.found) for r in spatial.placed_in(points, polygons, "id", "code").collect()} == {(1, "INSIDE", "a"), (2, "AT_BORDER", "a"), (3, "UNKNOWN", None), (4, "OUTSIDE", None), (5, "UNKNOWN", None)}


def test_parsing_names_its_notation_once(spark):
    plan = spark.createDataFrame([("1",)], "v string").select(coords.pair(coords.parse(F.col("v")), coords.parse(F.col("v")))).groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 120



def test_isolation_without_the_packages():
    """The library and its entry work without the optional operators or any package that only they need."""
    import subprocess
    import sys

    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n def find_spec(self, name, path=None, target=None):\n  if name.split('.')[:len(B)] == B: raise ImportError(name)\nB = {}.split('.')\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\nassert len(q) > 150 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q, len(q)\nassert set(e.oracle_sql()) <= set(q)"
    for name in ("terrasift.llm", "xxhash", "public_tokenizers", "tiktoken", "sentencepiece", "corpus_pipeline"):
        subprocess.run([sys.executable, "-c", code.format(repr(name))], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_zip_bytes_are_a_workbook():
    data = sinks.workbook({"a": (["x"], [(1.5,), ("t",)])})
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None


def test_cache_of_a_stream(spark, tmp_path):
    """Hits within the entry's life, misses after it, over two batches."""
    from terrasift.streaming import state

    schema = "k string, ts timestamp, answer string"
    rows = [[("a", "2024-01-01 00:00:00", "one"), ("a", "2024-01-01 00:00:30", "two"), ("b", "2024-01-01 00:00:10", "three")], [("a", "2024-01-01 00:00:50", "four"), ("a", "2024-01-01 00:01:10", "five"), ("a", "2024-01-01 00:01:20", "six")]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "k string, ts string, answer string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = state.answered(stream, "k", "ts", "answer", 60).writeStream.format("memory").queryName("cached").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.k, str(r.ts)[11:], r.answer, r.hit) for r in spark.table("cached").collect()}
    assert got == {("a", "00:00:00", "one", False), ("a", "00:00:30", "one", True), ("b", "00:00:10", "three", False), ("a", "00:00:50", "one", True), ("a", "00:01:10", "five", False), ("a", "00:01:20", "five", True)}
