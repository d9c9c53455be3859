import sys

from pyspark.sql import functions as F

from floorwise.sources import convert, dxf
from tests.test_geometry import DXF

PROGRAM = "import sys,time; s=open(sys.argv[1],'rb').read(); time.sleep(9) if s==b'slow' else None; sys.exit('bad file') if s==b'bad' else None; open(sys.argv[2],'wb').write(s.upper() if s!=b'none' else b'')"


def test_files_through_a_converter(spark):
    files = spark.createDataFrame([(s, s.encode()) for s in ("good", "bad", "none", "slow")], "file_id string, content binary")
    rows = {r.file_id: r for r in convert.converted(files, [sys.executable, "-c", PROGRAM, "{input}", "{output}"], "dwg", "dxf", 4).collect()}
    assert bytes(rows["good"].content) == b"GOOD" and rows["good"].error is None
    assert "bad file" in rows["bad"].error and "no output" in rows["none"].error and "seconds" in rows["slow"].error
    assert {r.error is None for r in convert.converted(files.limit(1), ["/no/such/program"], "a", "b").collect()} == {False}


def test_drawings_are_written_as_they_were_read(spark):
    text = DXF.replace("0\nTEXT", "0\nATTRIB\n8\nT\n2\nNO\n1\nR7\n10\n1\n20\n2\n0\nARC\n8\nX\n10\n0\n20\n0\n40\n3\n50\n10\n51\n90\n0\nPOLYLINE\n8\nX\n70\n1\n0\nVERTEX\n10\n0\n20\n0\n0\nVERTEX\n10\n2\n20\n0\n0\nSEQEND\n0\nTEXT")
    found = dxf.read(spark.createDataFrame([("f", text.encode()), ("g", DXF.encode())], "file_id string, content binary")).cache()
    again = dxf.read(dxf.to_dxf(found).select("file_id", F.col("dxf").cast("binary").alias("content")))
    plain = lambda df: sorted(map(repr, df.drop("eid").collect()))
    assert plain(again) == plain(found)
    walls = dxf.filtered(found, spark.createDataFrame([("f", "A-WALL")], "file_id string, raw_name string"))
    assert {r.layer for r in walls.where("kind = 'entity'").collect()} == {"A-WALL"} and walls.where("file_id = 'g'").count() == 0
    assert dxf.to_dxf(walls).first().dxf.count("LAYER\n2\nA-WALL") == 1
