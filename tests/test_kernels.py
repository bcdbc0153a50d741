"""Kernels against independent writers and seeded damage."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitgate.operators import headers, html_fields, raster, sheets, wording


def picture(seed, w, h):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)


def png(rgba, depth=8, colour=6, filters=(0, 1, 2, 3, 4)):
    """A PNG writer that uses every filter in turn."""
    h, w = rgba.shape[:2]
    channels = {0: [0], 2: [0, 1, 2], 4: [0, 3], 6: [0, 1, 2, 3]}[colour]
    step, body = len(channels) * depth // 8, b""
    above = [0] * (w * step)
    for y in range(h):
        line = [int(v) for x in range(w) for c in channels for v in ([rgba[y, x, c]] if depth == 8 else [rgba[y, x, c], 7])]
        kind, out = filters[y % len(filters)], []
        for i, v in enumerate(line):
            a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        body += bytes([kind, *out])
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("depth", [8, 16])
@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_png(depth, colour):
    rgba = picture(1, 13, 11)
    if colour in (0, 4):
        rgba[:, :, 1:3] = rgba[:, :, :1]
    if colour in (0, 2):
        rgba[:, :, 3] = 255
    assert (raster.read_png(png(rgba, depth, colour)) == rgba).all()
    assert (raster.read_png(raster.write_png(rgba)) == rgba).all()


def test_bmp_and_ico():
    rgba = picture(2, 7, 5)
    rgba[:, :, 3] = 255
    assert (raster.read_bmp(raster.write_bmp(rgba)) == rgba).all()
    ico = raster.write_ico(rgba)
    assert headers.read_header("ico", ico)["width"] == 7 and (raster.read_png(ico[22:]) == rgba).all()
    assert raster.write_ico(picture(1, 300, 2)) is None


def test_scale_orient_and_similarity():
    rgba = picture(3, 12, 8)
    small = raster.box_downscale(rgba, 4, 2)
    for y in range(2):
        for x in range(4):
            block = rgba[4 * y : 4 * y + 4, 3 * x : 3 * x + 3].reshape(-1, 4).astype(float)
            assert abs(small[y, x, 0] - (block[:, 0] * block[:, 3]).sum() / block[:, 3].sum()) <= 0.51
    assert [raster.orient(rgba, o).shape[:2] for o in (1, 6)] == [(8, 12), (12, 8)]
    assert (raster.orient(raster.orient(rgba, 6), 8) == rgba).all()
    plane = rgba[:, :, 0]
    assert raster.ssim_blocks(plane, plane) == pytest.approx(1)
    assert raster.ssim_blocks(plane, 255 - plane) < raster.ssim_blocks(plane, plane // 2 * 2) < 1


def test_headers_never_raise():
    rng = random.Random(1)
    gif = b"GIF89a" + struct.pack("<HHBBB", 20, 10, 0, 0, 0) + b"\x21\xf9\x04\x01\0\0\0\0" + b"\x2c" + bytes(8) + b"\0\x02\x02\x4c\x01\0" + b"\x2c" + bytes(9) + b"\x02\0\x3b"
    jpeg = b"\xff\xd8\xff\xe0\0\x10JFIF\0\1\1\1\1\x2c\1\x2c\0\0" + b"\xff\xc0\0\x11\x08\0\x30\0\x40\3" + bytes(9)
    samples = {"png": png(picture(1, 9, 4)), "gif": gif, "jpeg": jpeg, "bmp": raster.write_bmp(picture(1, 9, 4)), "ico": raster.write_ico(picture(1, 9, 4))}
    facts = {f: headers.read_header(f, d, whole=True) for f, d in samples.items()}
    assert facts["gif"] == {"width": 20, "height": 10, "animated": True, "alpha": True}
    assert (facts["jpeg"]["width"], facts["jpeg"]["height"], facts["jpeg"]["dpi"]) == (64, 48, 300)
    assert all(facts[f]["width"] == 9 and facts[f]["height"] == 4 for f in ("png", "bmp", "ico"))
    for fmt, data in samples.items():
        for _ in range(300):
            broken = bytearray(data)
            for _ in range(rng.choice([1, 3, 20])):
                broken[rng.randrange(len(broken))] = rng.randrange(256)
            headers.read_header(fmt, bytes(broken[: rng.randrange(1, len(broken) + 1)]), rng.random() < 0.5)


def test_padding():
    data = png(picture(1, 9, 4))
    grown = headers.pad_to(data, "png", len(data) + 500)
    assert len(grown) >= len(data) + 500 and (raster.read_png(grown) == raster.read_png(data)).all()
    assert headers.pad_to(data, "gif", 10**6) is None


def test_sheets(spark):
    rows = [["Name", "Code", 1.5], ["Ä & <b>", "007", None], [None, "x", -3]]
    data = sheets.write_xlsx(rows)
    out = sheets.cells(spark.createDataFrame([(1, data), (2, b"PK\3\4junk")], "file_id long, content binary"))
    got = {(r.row, r.col): (r.kind, r.value) for r in out.where("file_id = 1").collect()}
    assert got[1, 0] == ("text", "Ä & <b>") and got[1, 1] == ("text", "007") and float(got[2, 2][1]) == -3 and (1, 2) not in got
    assert out.where("file_id = 2").first().error == "damaged"
    texts = spark.createDataFrame([(b"a,\xc3\xa9",), (b"\xef\xbb\xbfx",), (b"caf\xe9 \x80 \x81",)], "c binary")
    assert [r.t for r in texts.select(sheets.csv_text(texts.c).alias("t")).collect()] == ["a,é", "x", "café € \x81"]


CLAUSES = [
    ("Maximum size 1,500 KB", {"max_bytes": 1_500_000}), ("files larger than 2 MB will be rejected", {"max_bytes": 2_000_000}), ("300-500 KB", {"min_bytes": 300_000, "max_bytes": 500_000}),
    ("total size of all files: 20 MB", {}), ("3.5 x 4.5 cm at 300 dpi", {"print_width": 35, "print_height": 45, "dpi": 300}), ("a square photo", {"aspect_ratio": 1}),
    ("at least 600 x 600 px", {"min_width": 600, "min_height": 600}), ("We open at 10:30", {}), ("max 1 MiB", {"max_bytes": 2**20}), (None, {}),
]


def test_clauses(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CLAUSES)], "i int, clause string")
    got = {r.i: {f.rule: f.num for f in r.found if f["items"] is None} for r in wording.read_clauses(rows, "clause").select("i", F.col("__findings").alias("found")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CLAUSES)}


def test_fields_of_a_page(spark):
    html = "<div><p>Max 2 MB</p><div><input type=file title='PNG'></div></div><div>Other <input type=file></div>"
    rows = html_fields.html_fields(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).collect()
    assert {r.page_id for r in rows} == {1}
    assert {(r.field_no, r.source) for r in rows} >= {(0, "title"), (0, "parent"), (1, "parent")}
    assert all("Other" not in (r.text or "") for r in rows if r.field_no == 0)
