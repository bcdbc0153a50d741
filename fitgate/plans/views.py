"""The conformance tables derived from the star schema, by integer arithmetic, so that any engine makes the same rows.

files: one upload candidate per document. fields: one upload field per part, as rules and as a
sentence. picks: which file was chosen on which field. outcomes: what became of uploads, from events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgate.functions.formatting import CHANGES, ERROR_CODES
from fitgate.functions.registry import FORMATS, mime_of, taken_formats

NAMES = [*(f.name for f in FORMATS), "unknown"]


def _pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_id"), "n_chars")
    i = F.col("file_id")
    fmt = _pick(NAMES, i % 17)
    exts = [*(f.exts[-1] for f in FORMATS), ".bin"]
    name = F.concat(F.lit("file_"), i.cast("string"), F.when(i % 7 == 0, F.upper(_pick(exts, i % 17))).otherwise(_pick(exts, i % 17)))
    return d.select(
        "file_id", name.alias("name"),
        F.when(i % 5 == 0, "").when(i % 5 == 1, F.coalesce(F.upper(mime_of(fmt)), F.lit("application/octet-stream"))).otherwise(F.coalesce(mime_of(fmt), F.lit("application/octet-stream"))).alias("mime"),
        fmt.alias("format"), (F.col("n_chars") * 997).alias("bytes"),
        (16 + (i * 7919) % 6000).alias("width"), (16 + (i * 104729) % 6000).alias("height"),
        (i % 11 == 0).alias("transparent"), (i % 13 == 0).alias("animated"), F.when(i % 17 == 12, 1 + i % 3).alias("pages"),
        _pick([None, 72, 200, 300], i % 4).cast("long").alias("dpi"),
    )


def _rules(p: Column, size: Column) -> dict[str, Column]:
    k = p % 8
    none = F.lit(None).cast("long")
    when = lambda *pairs: F.coalesce(*[F.when(k == n, v).cast("long") for n, v in pairs], none)
    mimes = [["image/jpeg", "image/png"], ["image/*"], ["image/jpeg"], ["application/pdf"], ["image/png", "image/webp"], ["image/jpeg"], [], []]
    exts = [[], [], [".jpg"], [], [".heif"], [], [".csv", ".xlsx"], []]
    array = lambda lists: F.get(F.array(*[F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in lists]), k.cast("int"))
    return {
        "accepted_mimes": array(mimes),
        "accepted_exts": array(exts),
        "max_bytes": when((0, size * 100_000), (1, size * 1_000_000), (3, size * 50_000), (5, size * 2_000_000)),
        "min_bytes": when((5, size * 1_000), (4, F.lit(20_000))),
        "min_width": when((1, 100 + size * 10), (5, F.lit(200))),
        "min_height": when((1, 100 + size * 5)),
        "max_width": when((1, 3000 + size), (7, 1000 + size * 10)),
        "max_height": when((7, 800 + size * 10)),
        "exact_width": when((2, F.lit(600))),
        "exact_height": when((2, F.lit(400) + size)),
        "aspect_ratio": F.when(k == 4, F.lit(1.0)).when((k == 7) & (p % 3 == 0), F.lit(1.5)),
        "dpi": when((5, F.lit(300))),
    }


def _sentence(p: Column, r: dict[str, Column], size: Column) -> Column:
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    return (
        F.when(p % 8 == 0, text("Please upload a JPG or PNG file. Maximum size: ", size * 100, " KB."))
        .when(p % 8 == 1, text("Max file size ", size, " MB; at least ", r["min_width"], " x ", r["min_height"], " pixels"))
        .when(p % 8 == 2, text("Photo must be exactly ", r["exact_width"], " × ", r["exact_height"], " px, JPEG only"))
        .when(p % 8 == 3, text("PDF format, up to ", size * 50, " kB"))
        .when(p % 8 == 4, text("Minimum 20 KB. Aspect ratio 1:1."))
        .when(p % 8 == 5, text("Between ", size, " KB and ", size * 2, " MB, JPEG, 300 dpi"))
        .when(p % 8 == 6, text("Spreadsheets (CSV, XLSX) are welcome"))
        .otherwise(text("No larger than ", r["max_width"], " by ", r["max_height"], " pixels"))
    )


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    p, size = F.col("p_partkey"), F.col("p_size").cast("long")
    r = _rules(p, size)
    taken = taken_formats(r["accepted_mimes"], r["accepted_exts"]).alias("taken")
    return part.select(p.alias("field_id"), *[c.alias(n) for n, c in r.items()], taken, _sentence(p, r, size).alias("sentence"))


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files joined to the field they were chosen on: an equi-join on field_id."""
    fs = fields(spark, sf_dir)
    bounds = fs.agg(F.count(F.lit(1)).alias("n_fields"))
    chosen = files(spark, sf_dir).crossJoin(F.broadcast(bounds))  # one row: the number of fields
    chosen = chosen.withColumn("field_id", (F.col("file_id") * 31) % F.col("n_fields")).drop("n_fields")
    facts = chosen.withColumnRenamed("dpi", "file_dpi")
    return facts.join(fs, "field_id")


def facts(name: str) -> Column:
    """Getter for the file's side of a pick."""
    return F.col("file_dpi") if name == "dpi" else F.col(name)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return outcomes_of(e)


def outcomes_of(e: DataFrame) -> DataFrame:
    """Outcome rows of an events frame, batch or streaming."""
    i = F.col("event_id")
    changes = F.array_compact(F.array(*[F.when(F.shiftright(i, k) % 2 == 1, F.lit(c)) for k, c in enumerate(CHANGES[:8])]))
    return e.select(
        "event_id", "ts", F.col("user_id").alias("owner"), F.col("event_type"),
        changes.alias("changes"), _pick(list(ERROR_CODES), i % 16).alias("code"), (F.col("value") * 1_000_000).cast("long").alias("bytes"),
    )


def field_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with a form put before the end of the body; its kind goes by page_id % 6, its limit by page_id % 900."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    n = (100 + F.col("page_id") % 900).cast("string")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    forms = [
        text("<form><div><label for='f'>Your CV</label><input type='file' id='f' accept='.pdf,application/pdf'><p>Maximum size: ", n, " KB</p></div></form>"),
        text("<form><input type=file aria-describedby=hint accept='image/*'></form><span id=hint>JPG or PNG files only, max ", n, " KB</span>"),
        text("<form><input type='file' data-max-size='", n, "000'></form>"),
        text("<form><input type='FILE' accept='' title='Maximum size: ", n, " KB'></form>"),
        text("<form><div><p>Up to ", n, " KB</p><input type='file' name='a'></div><div><p>Up to 7 MB</p><input type='file' name='b'></div></form>"),
        F.lit("<form><input type='text'></form>"),
    ]
    form = F.get(F.array(*forms), (F.col("page_id") % 6).cast("int"))
    return p.select("page_id", F.concat(F.regexp_replace("html", "(?i)</body>.*$", ""), form, F.lit("</body></html>")).alias("html"))


def header_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): the first bytes of a PNG, GIF, BMP or WebP file of the size of ``files``, made with hex arithmetic."""
    big = lambda c, size: F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    little = lambda c, size: F.concat(*[F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)])
    f = files(spark, sf_dir)
    w, h, i = F.col("width"), F.col("height"), F.col("file_id")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.when(i % 8 == 0, "0806").otherwise("0802"), F.lit("00000000000000" + "00000000" + b"IDAT".hex()))
    gif = F.concat(F.lit(b"GIF89a".hex()), little(w, 2), little(h, 2), F.lit("0000003B"))
    bmp = F.concat(F.lit("424D" + "00" * 12 + "28000000"), little(w, 4), little(h, 4), F.lit("01001800" + "00" * 24))
    webp = F.concat(F.lit("5249464600000000" + b"WEBPVP8X".hex() + "0A000000" + "10000000"), little(w - 1, 3), little(h - 1, 3))
    return f.select("file_id", F.unhex(F.when(i % 4 == 0, png).when(i % 4 == 1, gif).when(i % 4 == 2, bmp).otherwise(webp)).alias("content"))


def _big(c: Column, size: int) -> Column:
    return F.lpad(F.hex(c.cast("long")), 2 * size, "0")


def coded_header_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content): the first bytes of a HEIC, AVIF or JPEG XL file of the size of ``files``, made with hex arithmetic."""
    f = files(spark, sf_dir)
    w, h, i = F.col("width"), F.col("height"), F.col("file_id")
    text = lambda t: F.lit(t.encode().hex().upper())
    box = lambda kind, *body: F.concat(_big(F.length(F.concat(*body)) / 2 + 8, 4), text(kind), *body)
    ispe = lambda a, b: box("ispe", F.lit("00000000"), _big(a, 4), _big(b, 4))
    iso = lambda brand: F.concat(
        box("ftyp", text(brand), F.lit("00000000"), text("mif1")),
        box("meta", F.lit("00000000"), box("iprp", box("ipco", ispe(F.lit(8), F.lit(6)), ispe(w, h)))), box("mdat", text("ispe"), F.lit("F" * 24)),
    )
    # a codestream: not small, 30 bits of height, no ratio, 30 bits of width
    bits = F.lit(3 << 1).cast("long") + F.shiftleft((h - 1).cast("long"), 3) + F.shiftleft(F.lit(3).cast("long"), 36) + F.shiftleft((w - 1).cast("long"), 38)
    stream = F.concat(F.lit("FF0A"), *[F.lpad(F.hex(F.shiftright(bits, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(8)], F.lit("00000000"))
    contained = F.concat(F.lit("0000000C4A584C200D0A870A"), box("ftyp", text("jxl ")), box("jxlc", stream))
    content = F.when(i % 4 == 0, iso("heic")).when(i % 4 == 1, iso("avis")).when(i % 4 == 2, stream).otherwise(contained)
    return f.select("file_id", F.unhex(content).alias("content"))
