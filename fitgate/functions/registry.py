"""The file formats: one small table, and what follows from it as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    name: str
    label: str
    mimes: tuple[str, ...]  # the canonical one first
    exts: tuple[str, ...]
    kind: str = "image"
    alpha: bool | None = None  # of formats that can be written
    lossy: bool | None = None
    family: tuple[str, ...] = ()


# Names, media types and extensions that files and upload fields use.
FORMATS = (
    Format("jpeg", "JPG", ("image/jpeg", "image/jpg", "image/pjpeg"), (".jpg", ".jpeg", ".jpe", ".jfif"), alpha=False, lossy=True),
    Format("png", "PNG", ("image/png", "image/x-png", "image/apng"), (".png", ".apng"), alpha=True, lossy=False),
    Format("webp", "WebP", ("image/webp",), (".webp",), alpha=True, lossy=True),
    Format("avif", "AVIF", ("image/avif", "image/avif-sequence"), (".avif",), alpha=True, lossy=True),
    Format("gif", "GIF", ("image/gif",), (".gif",), alpha=True, lossy=False),
    Format("tiff", "TIFF", ("image/tiff", "image/tif", "image/x-tiff"), (".tif", ".tiff"), alpha=True, lossy=False),
    Format("bmp", "BMP", ("image/bmp", "image/x-bmp", "image/x-ms-bmp"), (".bmp", ".dib"), alpha=False, lossy=False),
    Format("ico", "ICO", ("image/x-icon", "image/vnd.microsoft.icon", "image/ico", "image/icon"), (".ico", ".cur"), alpha=True, lossy=False),
    Format("heic", "HEIC", ("image/heic", "image/heic-sequence"), (".heic",), family=("heif",)),
    Format("heif", "HEIF", ("image/heif", "image/heif-sequence"), (".heif", ".hif"), family=("heic",)),
    Format("svg", "SVG", ("image/svg+xml",), (".svg",)),
    Format("jxl", "JPEG XL", ("image/jxl",), (".jxl",)),
    Format("pdf", "PDF", ("application/pdf", "application/x-pdf", "application/acrobat"), (".pdf",), kind="document"),
    Format("csv", "CSV", ("text/csv", "application/csv", "text/comma-separated-values", "text/x-csv"), (".csv",), kind="sheet"),
    Format("xlsx", "XLSX", ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), (".xlsx",), kind="sheet"),
    Format("xls", "XLS", ("application/vnd.ms-excel", "application/msexcel", "application/x-msexcel", "application/x-excel"), (".xls",), kind="sheet"),
)
# Orders of preference.
OUTPUTS = ("jpeg", "png", "webp", "avif", "gif", "tiff", "bmp", "ico")
PHOTO_ORDER = ("jpeg", "webp", "avif", "png", "tiff", "bmp", "gif", "ico")
TRANSPARENT_ORDER = ("png", "webp", "avif", "tiff", "gif", "ico", "jpeg", "bmp")
SHEET_OUTPUTS = ("xlsx", "csv")

BY_NAME = {f.name: f for f in FORMATS}


def family(f: Format) -> list[Format]:
    return [f, *(BY_NAME[n] for n in f.family)]


def dim_format(spark: SparkSession) -> DataFrame:
    """One row per format; small enough to broadcast always."""
    rows = [
        (i, f.name, f.label, list(f.mimes), list(f.exts), f.kind, f.alpha is not None, f.alpha, f.lossy, f.name in ("jpeg", "png"),
         [m for g in family(f) for m in g.mimes], [e for g in family(f) for e in g.exts])
        for i, f in enumerate(FORMATS)
    ]
    return spark.createDataFrame(
        rows,
        "ord int, format string, label string, mimes array<string>, exts array<string>, kind string, writable boolean, alpha boolean, lossy boolean, "
        "has_dpi boolean, family_mimes array<string>, family_exts array<string>",
    )


def _map(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs for x in p])


def _mime_map(canonical: bool) -> Column:
    return _map([(m, f.mimes[0] if canonical else f.name) for f in FORMATS for m in f.mimes])


def normalize_mime(mime: Column) -> Column:
    """Lower case, without parameters, aliases made canonical; unknown types stay."""
    plain = F.trim(F.split(F.lower(mime), ";")[0])
    return F.coalesce(F.try_element_at(_mime_map(True), plain), plain)


def format_from_mime(mime: Column) -> Column:
    return F.try_element_at(_mime_map(False), normalize_mime(mime))


def format_from_extension(ext: Column) -> Column:
    return F.try_element_at(_map([(e, f.name) for f in FORMATS for e in f.exts]), F.lower(ext))


def mime_of(fmt: Column) -> Column:
    return F.try_element_at(_map([(f.name, f.mimes[0]) for f in FORMATS]), fmt)


def label_of(fmt: Column) -> Column:
    return F.try_element_at(_map([(f.name, f.label) for f in FORMATS]), fmt)


def is_in(fmt: Column, *tests) -> Column:
    """Whether a format fulfils a test on the registry's rows."""
    return fmt.isin(*[f.name for f in FORMATS if all(t(f) for t in tests)])


def is_sheet(fmt: Column) -> Column:
    return is_in(fmt, lambda f: f.kind == "sheet")


def is_image(fmt: Column) -> Column:
    return is_in(fmt, lambda f: f.kind == "image")


def is_output(fmt: Column) -> Column:
    return is_in(fmt, lambda f: f.alpha is not None)


def keeps_alpha(fmt: Column) -> Column:
    return is_in(fmt, lambda f: bool(f.alpha))


def is_lossy(fmt: Column) -> Column:
    return is_in(fmt, lambda f: bool(f.lossy))


def carries_dpi(fmt: Column) -> Column:
    return fmt.isin("jpeg", "png")


def guess_format(name: Column, mime: Column) -> Column:
    """From the name's last extension and the type: a .csv name first, then the type, then the extension."""
    by_ext = format_from_extension(F.regexp_extract(name, r"\.[^.]+$", 0))
    return F.when(by_ext == "csv", F.lit("csv")).otherwise(F.coalesce(format_from_mime(mime), by_ext, F.lit("unknown")))


def _literal(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


BITS = {f.name: 1 << i for i, f in enumerate(FORMATS)}
#: The bit of whatever is no known format: only a field without lists takes it.
OTHER_BIT = 1 << len(FORMATS)
ALL_BITS = OTHER_BIT - 1


def _listed_bits(names: Callable[[Format], tuple[str, ...]], wild: dict[str, int]) -> Column:
    """Map from what a list may name to the bits of the formats that it stands for, families included."""
    bits = dict(wild)
    for f in FORMATS:
        for g in family(f):
            for name in names(g):
                bits[name] = bits.get(name, 0) | BITS[f.name]
    return F.create_map(*[F.lit(x) for pair in bits.items() for x in (pair[0], pair[1])])


def taken_formats(mimes: Column, exts: Column) -> Column:
    """A long whose bit i says that a field's lists take format i; empty lists take all. Worked out once for each
    field, so that every later test of a file on it is one bit test."""
    images = sum(BITS[f.name] for f in FORMATS if f.kind == "image")
    by_mime = _listed_bits(lambda f: f.mimes, {"*/*": ALL_BITS, "image/*": images})
    by_ext = _listed_bits(lambda f: f.exts, {})
    add = lambda table: lambda n, x: n.bitwiseOR(F.coalesce(F.try_element_at(table, x), F.lit(0)))
    bits = F.aggregate(exts, F.aggregate(mimes, F.lit(0), add(by_mime)), add(by_ext))
    return F.when(F.size(mimes) + F.size(exts) == 0, F.lit(ALL_BITS | OTHER_BIT)).otherwise(bits).cast("long")


def _any_of(taken: Column, bits: int) -> Column:
    return taken.bitwiseAND(F.lit(bits).cast("long")) != 0


def format_allowed(fmt: Column | str, taken: Column) -> Column:
    """Whether a field takes a format (a name, or a column of names)."""
    if isinstance(fmt, str):
        return _any_of(taken, BITS[fmt])
    bit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in BITS.items() for x in pair]), fmt), F.lit(OTHER_BIT))
    return taken.bitwiseAND(bit.cast("long")) != 0


def _kept(order, taken: Column) -> Column:
    return F.array_compact(F.array(*[F.when(format_allowed(n, taken), F.lit(n)) for n in order]))


def first_output(taken: Column, order=OUTPUTS) -> Column:
    """The first format of an order that a field takes."""
    return F.coalesce(*[F.when(format_allowed(n, taken), F.lit(n)) for n in order])


def takes_output(taken: Column) -> Column:
    """Whether a field takes any format that can be written."""
    return _any_of(taken, sum(BITS[n] for n in OUTPUTS))


def allowed_outputs(taken: Column, order=OUTPUTS) -> Column:
    """The formats that can be written and are taken, in order of preference."""
    return _kept(order, taken)


def conversion_targets(fmt: Column, taken: Column) -> Column:
    """What a file of a format can become, best first."""
    sheets = F.filter(_kept(SHEET_OUTPUTS, taken), lambda s: s != fmt)
    none = F.array().cast("array<string>")
    return (
        F.when(fmt == "unknown", none).when(is_sheet(fmt), sheets)
        .otherwise(F.when(fmt == "pdf", _kept(("pdf", *OUTPUTS), taken)).otherwise(_kept((*OUTPUTS, "pdf"), taken)))
    )


def can_become(fmt: Column, taken: Column) -> Column:
    """Whether there is any conversion target, by bits alone."""
    sheets = F.lit(False)
    for n in SHEET_OUTPUTS:
        sheets = sheets | ((fmt != n) & format_allowed(n, taken))
    return F.when(fmt == "unknown", False).when(is_sheet(fmt), sheets).otherwise(takes_output(taken) | format_allowed("pdf", taken))


def is_specific(mimes: Column, exts: Column) -> Column:
    return (F.size(exts) > 0) | F.exists(mimes, lambda m: ~m.endswith("/*"))


def widened_accept(accept: Column, mimes: Column, exts: Column, taken: Column) -> Column:
    """The accept text with everything added that the field does not take but could be made to fit; NULL if nothing is added."""
    none = F.array().cast("array<string>")
    parts = [F.when(~format_allowed(f.name, taken) & can_become(F.lit(f.name), taken), _literal([*f.exts, f.mimes[0]])).otherwise(none) for f in FORMATS]
    extra = F.flatten(F.array(*parts))
    specific = is_specific(mimes, exts) & ~F.exists(mimes, lambda m: m.endswith("/*"))
    return F.when(specific & (F.size(extra) > 0), F.concat_ws(",", accept, F.array_join(extra, ",")))
