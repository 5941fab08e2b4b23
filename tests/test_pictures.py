from tessera.sources import pictures


def _picture(width, height, body=b"\x11\x22"):
    table = b"\xff\xdb\x00\x04\x01\x02"
    header = b"\xff\xc0\x00\x0b\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return b"\xff\xd8" + table + header + b"\xff\xda\x00\x02" + body + b"\xff\xd9"


def test_pictures_in_any_chunks(spark):
    shown = [_picture(640, 360), _picture(1920, 1080, b"\x00" * 50)]
    data = b"junk\xff" + shown[0] + b"between" + shown[1] + _picture(1, 1)[:9]
    for step in (1, 7, len(data)):
        rows = [(s, k, data[k : k + step]) for s in ("a", "b") for k in range(0, len(data), step)] + [("c", 0, None)]
        found = pictures.framed_pictures(spark.createDataFrame(rows, "stream string, seq int, data binary"))
        got = sorted((r.stream, r.number, bytes(r.picture)) for r in found.collect())
        assert got == [(s, k, shown[k]) for s in ("a", "b") for k in (0, 1)]
    sizes = found.select("number", pictures.picture_size("picture").alias("s")).distinct().collect()
    assert {(r.number, r.s.width, r.s.height) for r in sizes} == {(0, 640, 360), (1, 1920, 1080)}


def test_broken_and_large_pictures():
    assert pictures.size(None) == pictures.size(b"") == pictures.size(b"\xff\xd8\x00\x00\x00\x00") == pictures.size(_picture(3, 4)[:12]) == (None, None)
    done, pending = pictures.cut(b"", _picture(9, 9, b"\x00" * 500) + _picture(5, 6), largest=100)
    assert [pictures.size(p) for p in done] == [(5, 6)] and pending == b""
