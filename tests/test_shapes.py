"""Shapefiles against their layout, and round trips over several files and splits."""

import glob
import struct

import pytest

from fathomix.sources import readers, shapes

FEATURE = "parts array<array<struct<x:double,y:double,z:double>>>, ID bigint, NAME string, V double"
ROWS = [
    ([[(0.0, 1.0, 5.0), (2.0, 3.0, 6.0)], [(-4.5, 4.0, 7.0)]], 1, "été", 1.5),
    ([[(9.0, 9.0, None)]], 2, None, None),
    (None, 3, "no shape", 0.0),
    ([], None, "empty", -2.25),
    ([[(1.0, 1.0, 1.0)], [], [(2.0, 2.0, 2.0)]], -7, "a part without vertices", 1e-3),
]


def stored(spark, tmp_path, rows, shape, most=65_536, parts=1):
    df = spark.createDataFrame(rows, FEATURE).coalesce(parts)
    return shapes.write(df, shape, f"file://{tmp_path}", most).collect()


def test_layout(spark, tmp_path):
    files = stored(spark, tmp_path, ROWS, shapes.LINE)
    assert [(r.file, r.records) for r in files] == [("part-00000-0000.shp", 5)]
    shp, shx, dbf = (open(f"{tmp_path}/part-00000-0000.{k}", "rb").read() for k in ("shp", "shx", "dbf"))
    for raw in (shp, shx):
        assert struct.unpack_from(">i", raw)[0] == 9994 and struct.unpack_from(">i", raw, 24)[0] * 2 == len(raw)
        assert struct.unpack_from("<2i4d", raw, 28) == (1000, 3, -4.5, 1.0, 9.0, 9.0)
    at, kinds = 100, []
    for i in range(5):  # records one after the other, where the index says
        assert struct.unpack_from(">2i", shx, 100 + 8 * i) == (at // 2, struct.unpack_from(">i", shp, at + 4)[0])
        assert struct.unpack_from(">i", shp, at)[0] == i + 1
        kinds.append(struct.unpack_from("<i", shp, at + 8)[0])
        at += 8 + 2 * struct.unpack_from(">i", shp, at + 4)[0]
    assert at == len(shp) and kinds == [3, 3, 0, 0, 3]
    assert struct.unpack_from("<4d2i2i", shp, 112) == (-4.5, 1.0, 2.0, 4.0, 2, 3, 0, 2)
    n, start, width = struct.unpack_from("<IHH", dbf, 4)
    assert (n, len(dbf)) == (5, start + n * width + 1) and dbf[32:34] == b"ID" and dbf[start - 1] == 13


@pytest.mark.parametrize("most, records, parts", [(65_536, 16_384, 1), (3, 2, 2), (1, 1, 3)])
def test_round_trip(spark, tmp_path, most, records, parts):
    files = stored(spark, tmp_path, ROWS * 3, shapes.LINE_Z, most, parts)
    assert sum(r.records for r in files) == 15 and (most > 9 or len(files) > 3)
    got = shapes.read(spark, f"file://{tmp_path}", records=records)
    assert got.columns[7:] == ["ID", "NAME", "V"]
    want = []
    for parts_, i, name, v in ROWS * 3:
        for p, part in enumerate([q for q in parts_ or [] if q]):
            want += [(p, k, x, y, z or 0.0, i, name, v) for k, (x, y, z) in enumerate(part)]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[2:]) for r in got.collect()), key=key) == sorted(want, key=key)
    some = shapes.read(spark, f"file://{tmp_path}", [("V", "double"), ("LACKS", "string")])
    assert some.columns[7:] == ["V", "LACKS"] and some.filter("LACKS is not null").isEmpty()


def test_points_and_navigation(spark, tmp_path):
    one = "array(array(named_struct('x', {}, 'y', {}, 'z', {}))) AS parts"
    rows = [(-4.5, 48.0, 12.0, "28/11/2025", "07:08:09", 90.5, 3.0), (1.0, 2.0, 0.0, "31/31/2025", "07:08:09", None, None), (3.0, 4.0, 0.0, None, None, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "lon double, lat double, z double, DATE string, HEURE string, CAP double, IMMERSION double").coalesce(1)
    df = df.selectExpr(one.format("lon", "lat", "z"), "DATE", "HEURE", "CAP", "IMMERSION")
    shapes.write(df, shapes.POINT_Z, f"file://{tmp_path}").collect()
    assert readers.read(spark, f"file://{tmp_path}/part-00000-0000.shp").count() == 3  # by its extension
    nav = shapes.navigation(shapes.read(spark, f"file://{tmp_path}")).orderBy("record").collect()
    assert [tuple(r)[4:] for r in nav] == [(1764313689000000, -4.5, 48.0, 90.5, -3.0), (None, 1.0, 2.0, None, None), (None, 3.0, 4.0, 1.0, -0.0)]


def test_defined_cases(spark, tmp_path):
    assert stored(spark, tmp_path, [], shapes.LINE) == [] and not glob.glob(f"{tmp_path}/*.shp")
    with pytest.raises(Exception, match="needs 300 bytes"):
        stored(spark, tmp_path / "long", [([[(0.0, 0.0, 0.0)]], 1, "x" * 300, 0.0)], shapes.LINE)
    with pytest.raises(Exception, match="a point has one vertex"):
        stored(spark, tmp_path / "two", [([[(0.0, 0.0, 0.0), (1.0, 1.0, 0.0)]], 1, "x", 0.0)], shapes.POINT)
    with pytest.raises(ValueError, match="ten bytes"):
        shapes.write(spark.range(1).selectExpr("cast(null as array<array<struct<x:double,y:double,z:double>>>) as parts", "id as much_too_long"), shapes.LINE, f"file://{tmp_path}")
    with pytest.raises(ValueError, match="kind 5"):
        shapes.vertices(struct.pack("<i", 5) + bytes(60))
