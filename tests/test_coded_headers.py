"""Sizes of HEIF and JPEG XL files from bytes put together by hand."""

import struct

from fitgate.operators import coded_headers


def codestream(*fields):
    """Fields as (value, bits), least significant bit first."""
    number = at = 0
    for value, n in fields:
        number |= value << at
        at += n
    return b"\xff\x0a" + number.to_bytes((at + 7) // 8, "little")


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def ispe(w, h):
    return box(b"ispe", struct.pack(">III", 0, w, h))


def test_sizes(spark):
    wide = codestream((0, 1), (3, 2), (99_999, 30), (0, 3), (3, 2), (999_999_999, 30))
    jxl = {
        1: (codestream((1, 1), (9, 5), (0, 3), (19, 5)), (160, 80)),
        2: (codestream((1, 1), (9, 5), (5, 3)), (142, 80)),
        3: (codestream((0, 1), (0, 2), (479, 9), (0, 3), (1, 2), (639, 13)), (640, 480)),
        4: (wide, (10**9, 10**5)),
        5: (box(b"JXL ", b"\r\n\x87\n") + box(b"ftyp", b"jxl ") + box(b"jxlp", b"\0\0\0\0" + codestream((0, 1), (2, 2), (199_999, 18), (7, 3))), (400_000, 200_000)),
        6: (b"\xff\x0b\x00", (None, None)),
        7: (b"", (None, None)),
        8: (None, (None, None)),
    }
    df = spark.createDataFrame([(k, v) for k, (v, _) in jxl.items()], "k int, b binary")
    got = {r.k: (r.f.width, r.f.height) for r in df.select("k", coded_headers.jxl_facts(df.b).alias("f")).collect()}
    assert got == {k: size for k, (_, size) in jxl.items()}
    meta = box(b"meta", b"\0\0\0\0" + box(b"iprp", box(b"ipco", ispe(512, 512) + ispe(4032, 3024) + ispe(320, 240))))
    sized = lambda *inner: box(b"meta", b"\0\0\0\0" + box(b"hdlr", b"pict") + box(b"iprp", box(b"ipco", b"".join(inner)) + box(b"ipma", b"ispe" * 5)))
    plain = box(b"ftyp", b"heic\0\0\0\0mif1")
    iso = {
        1: (box(b"ftyp", b"heic\0\0\0\0mif1heic") + meta + box(b"mdat", b"ispe" + b"\xff" * 12), (4032, 3024, False)),
        2: (box(b"ftyp", b"avif\0\0\0\0avis") + meta, (4032, 3024, True)),
        3: (box(b"ftyp", b"mif1\0\0\0\0heif") + box(b"moov", b"") + sized(ispe(0x80818283, 0x0A0D0A0D)), (0x80818283, 0x0A0D0A0D, True)),
        4: (box(b"ftyp", b"heic\0\0\0\0"), (None, None, False)),
        # pictures whose data look like boxes, boxes in another order, long frames, boxes that only look like those asked for
        5: (plain + sized(ispe(640, 480)) + box(b"mdat", b"..moov....ispe" + b"\xff" * 30), (640, 480, False)),
        6: (plain + box(b"mdat", b"ispe" + b"\x01" * 30) + sized(ispe(640, 480)), (640, 480, False)),
        7: (plain + box(b"free", b"mdat") + sized(ispe(640, 480)), (640, 480, False)),
        8: (plain + box(b"uuid", b"x" * 16 + ispe(9000, 9000)) + sized(ispe(640, 480)), (640, 480, False)),
        9: (plain + struct.pack(">I4sQ", 1, b"free", 16 + 5) + b"12345" + sized(ispe(640, 480)), (640, 480, False)),
        10: (plain + sized(box(b"ispe", b"\0" * 11) + ispe(6, 4)) + struct.pack(">I4s", 0, b"mdat") + b"ispe" * 9, (6, 4, False)),
        11: (plain + box(b"meta", b"\0\0\0\0" + ispe(5, 5)) + box(b"moov", b""), (None, None, True)),
        12: (plain + sized(ispe(640, 480)) + struct.pack(">I4s", 10**6, b"mdat") + b"cut off", (640, 480, False)),
        13: (plain + struct.pack(">I4s", 4, b"free") + sized(ispe(640, 480)), (None, None, False)),
        14: (plain + box(b"free", b"") * 100 + sized(*[box(b"pixi", b"")] * 50, ispe(3, 2), ispe(2, 3)), (3, 2, False)),
        15: (b"", (None, None, False)),
        16: (None, (None, None, None)),
    }
    df = spark.createDataFrame([(k, v) for k, (v, _) in iso.items()], "k int, b binary")
    got = {r.k: (r.f.width, r.f.height, r.f.animated) for r in df.select("k", coded_headers.iso_facts(df.b).alias("f")).collect()}
    assert got == {k: v for k, (_, v) in iso.items()}
