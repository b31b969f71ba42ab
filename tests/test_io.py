"""Sources, sinks and streams, there and back."""

import json
from xml.etree import ElementTree

from pyspark.sql import functions as F

from terrasift.sources import documents, sinks
from terrasift.streaming import state


def test_workbook_round_trip(spark, tmp_path):
    rows = [("Centro & Salud", 504750.92, None), ("Colegio <1>", 4, "x")]
    (tmp_path / "a.xlsx").write_bytes(sinks.workbook({"General": (["nombre", "x", "nota"], rows), "Otros": (["a"], [("b",)])}))
    found = documents.cells(spark, f"file://{tmp_path}/a.xlsx")
    assert {(r.sheet, r.row, r.col): r.value for r in found.collect()} == {
        ("General", 0, 0): "nombre", ("General", 0, 1): "x", ("General", 0, 2): "nota", ("General", 1, 0): "Centro & Salud", ("General", 1, 1): "504750.92",
        ("General", 2, 0): "Colegio <1>", ("General", 2, 1): "4", ("General", 2, 2): "x", ("Otros", 0, 0): "a", ("Otros", 1, 0): "b",
    }
    got = {r.row: r.fields for r in documents.records(found).where("sheet = 'General'").collect()}
    assert got == {1: {"nombre": "Centro & Salud", "x": "504750.92"}, 2: {"nombre": "Colegio <1>", "x": "4", "nota": "x"}}


def test_odf_cells():
    import io
    import zipfile

    ns = 'xmlns:t="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:x="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
    body = f'<c {ns}><t:table t:name="T"><t:table-row><t:table-cell t:number-columns-repeated="3"><x:p>a</x:p></t:table-cell><t:table-cell t:number-columns-repeated="900"/><t:table-cell><x:p>b</x:p></t:table-cell></t:table-row></t:table></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", body)
    assert list(documents.odf_cells(out.getvalue())) == [("T", 0, 0, "a"), ("T", 0, 1, "a"), ("T", 0, 2, "a"), ("T", 0, 5, "b")]


def test_text_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a & b", 1.5, 2.5), (2, None, 3.0, 4.0), (3, "out", None, 1.0)], "id long, name string, x double, y double").coalesce(1)
    sinks.write_geojson(rows, f"file://{tmp_path}/g")
    (part,) = (tmp_path / "g").glob("part-*")
    assert [f["geometry"]["coordinates"] for f in json.loads(part.read_text())["features"]] == [[1.5, 2.5], [3.0, 4.0]]
    assert {(r.x, r.y) for r in documents.geojson(spark, f"file://{tmp_path}/g").collect()} == {(1.5, 2.5), (3.0, 4.0)}
    sinks.write_kml(rows, f"file://{tmp_path}/k", "name", "x", "y")
    (part,) = (tmp_path / "k").glob("part-*")
    assert len(ElementTree.fromstring(part.read_text()).findall(".//{*}Placemark")) == 2
    sinks.write_csv(rows, f"file://{tmp_path}/c")
    assert spark.read.option("header", True).option("sep", ";").csv(f"file://{tmp_path}/c").select("X_UTM30", "Y_UTM30", "id").collect()[0] == ("1.50", "2.50", "1")


def test_delimited(spark, tmp_path):
    (tmp_path / "a.txt").write_text("n|x|y\nA|1|2\n")
    (tmp_path / "b.txt").write_text("n;x\nB;3\n")
    assert {tuple(r["values"]) for r in documents.delimited(spark, f"file://{tmp_path}/*.txt").collect()} == {("n", "x", "y"), ("A", "1", "2"), ("n", "x"), ("B", "3")}


def test_streams(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    for name, df, mode in (("counters", state.rule_counters(stream, "user_id", F.col("event_type") != "error"), "complete"), ("firsts", state.first_within(stream, "user_id", "ts", "7 days"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
        q.awaitTermination(120)
    want = {r.user_id: r["count"] for r in events.groupBy("user_id").count().collect()}
    assert {r.user_id: r.uses for r in spark.table("counters").collect()} == want
    assert spark.table("firsts").select("user_id").distinct().count() == len(want)
