"""Files from a folder, and the check by header."""

import struct
import zlib

from pyspark.sql import functions as F

from fitgate.functions.registry import taken_formats
from fitgate.sources import files


def png(w, h):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"\0" * 40)


RULES = "accepted_mimes array<string>, accepted_exts array<string>, min_bytes long, max_bytes long, min_width long, min_height long, max_width long, max_height long, exact_width long, exact_height long, aspect_ratio double, dpi long"


def test_files_and_headers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    written = {"a.png": png(800, 600), "b.PNG": png(300, 100), "sub/c.png": png(800, 600)[:20], "d.gif": b"GIF89a" + struct.pack("<HH", 5, 6) + bytes(3) + b"\x3b", "e.pdf": b"%PDF-1.7", "f.png": b"", "big.png": png(800, 600) + bytes(5000)}
    for name, data in written.items():
        (tmp_path / name).write_bytes(data)
    every = files.read_files(spark, str(tmp_path))
    assert {r.name: r.bytes for r in every.drop("content").collect()} == {n.split("/")[-1]: len(d) for n, d in written.items() if d}
    small = files.read_files(spark, str(tmp_path), most=1000, pattern="*.png")
    assert {r.name for r in small.collect()} == {"a.png", "c.png"}
    assert "LessThanOrEqual(length,1000)" in small._jdf.queryExecution().executedPlan().toString()
    rules = spark.createDataFrame([(["image/png"], [], None, 4000, 400, None, None, None, None, None, None, None)], RULES)
    rules = rules.withColumn("taken", taken_formats(F.col("accepted_mimes"), F.col("accepted_exts")))
    found = files.with_headers(every).withColumn("mime", F.lit("")).crossJoin(rules)
    got = {r.name: (r.format, r.width, r.height, r.ok) for r in found.withColumn("ok", files.compatible_by_header(F.col)).collect()}
    assert got["a.png"] == ("png", 800, 600, True)
    assert got["b.PNG"] == ("png", 300, 100, False)
    assert got["big.png"] == ("png", 800, 600, False)
    assert got["d.gif"][:3] == ("gif", 5, 6) and not got["d.gif"][3]
    assert not any(got[n][3] for n in ("c.png", "e.pdf")) and "f.png" not in got
