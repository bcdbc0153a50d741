"""Sizes of HEIF, AVIF and JPEG XL files from their first bytes, with column expressions only.

The files of an ISO base media container are boxes that follow one another, some with boxes inside. Sizes
are in the ``ispe`` boxes of meta / iprp / ipco; the largest is the picture, the others are tiles and previews. Only
the frames of boxes are read, so what a picture's data happen to look like does not matter. A JPEG XL
codestream begins with its size in bits, least significant first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Brands of sequences, widths of the size fields of JPEG XL, and its ratios of width to height.
SEQUENCES = ("avis", "hevc", "hevx", "msf1", "hevm", "hevs")
SIDE_BITS = (9, 13, 18, 30)
RATIOS = {1: (1, 1), 2: (12, 10), 3: (4, 3), 4: (3, 2), 5: (16, 9), 6: (5, 4), 7: (2, 1)}


def _unsigned(hexed: Column) -> Column:
    return F.conv(hexed, 16, 10).cast("long")


#: Fixed value: boxes of one file, at most. Most files have no more at the top than FEW.
MOST_BOXES, FEW = 4096, 64


def _number(data: Column, at: Column) -> Column:
    """The 32 bits at a byte (from 1), most significant first; NULL beyond the end."""
    part = F.substring(data, at, F.lit(4))
    return F.when(F.length(part) == 4, _unsigned(F.hex(part)))


def boxes(data: Column, start: Column, end: Column, most: int = MOST_BOXES) -> Column:
    """struct(at, found, bad) of the boxes between two bytes (from 1, end not included): found as (kind, body, next), bad if a frame is
    broken or a box runs past the end. A box of length 0 reaches to the end."""
    start, end = start.cast("long"), end.cast("long")
    box = "struct<kind: string, body: bigint, next: bigint>"
    first = F.struct(start.alias("at"), F.array().cast(f"array<{box}>").alias("found"), F.lit(False).alias("bad"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        short = _number(data, at)
        wide = short == 1
        length = F.when(wide, F.when(_number(data, at + 8) == 0, _number(data, at + 12))).when(short == 0, end - at).otherwise(short)
        body = at + F.when(wide, F.lit(16)).otherwise(F.lit(8))
        ok = F.coalesce((length >= body - at) & (at + length <= end), F.lit(False))
        one = F.struct(F.decode(F.substring(data, at + 4, F.lit(4)), "ISO-8859-1").alias("kind"), body.cast("long").alias("body"), (at + length).cast("long").alias("next"))
        taken = F.struct((at + length).cast("long").alias("at"), F.concat(s["found"], F.array(one)).alias("found"), F.lit(False).alias("bad"))
        broken = F.struct(s["at"].alias("at"), s["found"].alias("found"), F.lit(True).alias("bad"))
        return F.when(s["bad"] | (at + 8 > end), s).when(ok, taken).otherwise(broken)

    # as many steps as there can be boxes
    steps = F.greatest(F.lit(1), F.least(F.lit(most).cast("long"), F.floor((end - start) / 8)))
    return F.when(end >= start, F.aggregate(F.sequence(F.lit(1).cast("long"), steps), first, step)).otherwise(first)


def _inside(data: Column, outer: Column, kind: str, skip: int = 0) -> Column:
    """The boxes within all boxes of a kind in an array of boxes."""
    held = F.filter(outer, lambda b: b["kind"] == kind)
    return F.flatten(F.transform(held, lambda b: boxes(data, b["body"] + skip, b["next"])["found"]))


def iso_facts(head: Column) -> Column:
    """struct(width, height, animated) of a HEIF or AVIF file; NULL sizes if no size box lies in these bytes."""

    def facts(data: Column) -> Column:
        end = (F.length(data) + 1).cast("long")
        top = _let(boxes(data, F.lit(1), end, FEW), lambda few: F.when(few["bad"] | (few["at"] + 8 > end), few).otherwise(boxes(data, F.lit(1), end)))
        return _let(top["found"], lambda found: _of_boxes(data, found))

    return _let(head, facts)


def _of_boxes(data: Column, top: Column) -> Column:
    properties = _inside(data, _inside(data, _inside(data, top, "meta", 4), "iprp"), "ipco")
    stated = F.filter(properties, lambda b: (b["kind"] == "ispe") & (b["next"] - b["body"] >= 12))
    sizes = F.transform(stated, lambda b: F.struct(_number(data, b["body"] + 4).alias("width"), _number(data, b["body"] + 8).alias("height")))
    # of equally large ones the first
    largest = F.aggregate(
        sizes, F.struct(F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height")),
        lambda best, s: F.when(s["width"].cast("double") * s["height"] > F.coalesce(best["width"].cast("double") * best["height"], F.lit(0.0)), s).otherwise(best),
    )
    brands = F.decode(F.substring(data, 9, 120), "ISO-8859-1")
    moving = brands.rlike("^(?s)(?:.{4})*(?:" + "|".join(SEQUENCES) + ")") | F.exists(top, lambda b: b["kind"] == "moov")
    return _let(largest, lambda size: F.struct(size["width"].alias("width"), size["height"].alias("height"), moving.alias("animated")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _bits(data: Column, at: Column, n: Column | int) -> Column:
    """``n`` bits (30 at most) from bit ``at`` on of an array of bytes, least significant first."""
    first = F.floor(at / 8).cast("int")
    value = F.lit(0).cast("long")
    for k in range(5):
        value = value + F.shiftleft(F.coalesce(F.get(data, first + k), F.lit(0).cast("long")), 8 * k)
    power = lambda e: F.pow(F.lit(2.0), e if isinstance(e, Column) else F.lit(e)).cast("long")
    return F.floor(value / power(at % 8)).cast("long") % power(n)


def _side(data: Column, at: Column, small: Column) -> Column:
    """struct(side, end): the side whose field begins at a bit, and the bit behind it."""

    def large(n: Column) -> Column:
        return F.struct((_bits(data, at + 2, n) + 1).alias("side"), (at + 2 + n).cast("long").alias("end"))

    width = F.element_at(F.array(*[F.lit(b) for b in SIDE_BITS]), (_bits(data, at, 2) + 1).cast("int"))
    tiny = F.struct(((_bits(data, at, 5) + 1) * 8).alias("side"), (at + 5).cast("long").alias("end"))
    return F.when(small, tiny).otherwise(_let(width, large))


def _jxl_size(data: Column) -> Column:
    """struct(width, height) that the bytes of a codestream behind its mark state."""
    small = _bits(data, F.lit(0), 1) == 1

    def with_height(h: Column) -> Column:
        ratio = _bits(data, h["end"], 3)
        stated = F.lit(None).cast("long")
        for k, (a, b) in RATIOS.items():
            stated = F.when(ratio == k, F.floor(h["side"] * a / b)).otherwise(stated)
        return F.struct(F.coalesce(stated, _side(data, h["end"] + 3, small)["side"]).alias("width"), h["side"].alias("height"))

    return _let(_side(data, F.lit(1), small), with_height)


def jxl_facts(head: Column) -> Column:
    """struct(width, height, animated) of a JPEG XL file, bare or in a container; NULL sizes where the codestream does not begin in these bytes."""
    text = F.decode(head, "ISO-8859-1")
    boxed = F.when(F.locate("jxlc", text) > 0, F.locate("jxlc", text) + 4).when(F.locate("jxlp", text) > 0, F.locate("jxlp", text) + 8)
    start = F.when(F.hex(F.substring(head, 1, 2)) == "FF0A", F.lit(1)).otherwise(boxed)
    stream = F.hex(F.substring(head, start, F.lit(11)))
    data = F.transform(F.sequence(F.lit(2), F.lit(10)), lambda k: _unsigned(F.substring(stream, 2 * k + 1, F.lit(2))))
    size = F.when(stream.startswith("FF0A"), _let(data, _jxl_size))
    return F.struct(size["width"].alias("width"), size["height"].alias("height"), F.lit(False).alias("animated"))


def coded_facts(fmt: Column, head: Column) -> Column:
    """struct(width, height, animated) by the format; NULL for other formats. What these files hold may be transparent."""
    return F.when(fmt.isin("heic", "heif", "avif"), iso_facts(head)).when(fmt == "jxl", jxl_facts(head))
