"""What is done to a file once it is decided, and what is said about it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitgate.functions import registry as reg
from fitgate.functions.decide import LOOKS_THE_SAME, Get, safe_minimum

# Limits and names that results must equal.
ICON_SIDE, MESSAGE_BYTES, NAME_CHARS, TYPE_CHARS, RATE_AFTER = 256, 40 * 1024**2, 1024, 128, 10
SETTLED_BY_DECODER, STREAMED = ("heic", "heif", "avif", "jxl", "svg"), ("jpeg", "png", "tiff", "bmp")


def display_size(w: Column, h: Column, orientation: Column) -> Column:
    """struct(width, height) as a person sees them: orientations from 5 on lie on their side."""
    turned = F.coalesce(orientation >= 5, F.lit(False))
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def with_icon_limit(r: Get, output: Column) -> Get:
    """The rules, with the greatest side of an icon where the output is one."""
    most = F.lit(ICON_SIDE).cast("long")
    limited = {n: F.when(output == "ico", F.least(F.coalesce(r(n).cast("long"), most), most)).otherwise(r(n).cast("long")) for n in ("max_width", "max_height")}
    return lambda name: limited[name] if name in limited else r(name)


def within_room(w: Column, h: Column, source_w: Column, source_h: Column, scale: Column, exact: Column) -> Column:
    """struct(width, height): a target size, no larger than the working size that an image was decoded at, unless an exact size is asked for."""
    room = F.least(source_w.cast("double") / w, source_h.cast("double") / h)
    small = (scale < 1) & (room < 1) & ~exact
    cut = lambda x: F.when(small, F.greatest(F.lit(1).cast("long"), F.floor(x * room))).otherwise(x.cast("long"))
    return F.struct(cut(w).alias("width"), cut(h).alias("height"))


def explicit_route(fmt: Column, output: Column, has_page: Column) -> Column:
    """Which branch a file takes when its output is given: a page of a PDF has to be drawn by the caller."""
    return (
        F.when(reg.is_sheet(fmt), "sheet").when((fmt == "pdf") & (output == "pdf"), "pdf-shrink")
        .when((fmt == "pdf") & ~has_page, "unsupported-format").when(fmt == "pdf", "pdf-page")
        .when(output == "pdf", "image-pdf").otherwise("image")
    )


def transform_options(output: Column, consents: Column) -> Column:
    """struct(output, allow_transparency_loss, allow_animation_loss, allow_upscale) that a decision permits."""
    return F.struct(
        F.coalesce(output, F.lit("jpeg")).alias("output"), F.array_contains(consents, "transparency").alias("allow_transparency_loss"),
        F.array_contains(consents, "animation").alias("allow_animation_loss"), F.lit(True).alias("allow_upscale"),
    )


def changes(i: Get, r: Get, output: Column, cropped: Column, resized: Column) -> Column:
    """The names of what was done, in fixed order. ``i`` also has orientation."""
    tests = (
        ("converted", i("format") != output), ("cropped", cropped), ("resized", resized), ("compressed", i("bytes") > r("max_bytes")),
        ("raised-to-minimum", i("bytes") < safe_minimum(r("min_bytes"))), ("background-added", i("transparent") & ~reg.keeps_alpha(output)), ("first-frame", i("animated")),
        ("first-page", i("pages") > 1), ("orientation-applied", i("orientation") != 1), ("dpi-set", (r("dpi") > 0) & ~i("dpi").eqNullSafe(r("dpi"))),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests]))


def is_active_on(enabled: Column, paused: Column, hosts: Column) -> Column:
    """Whether a page is served: switched on, and neither its own host nor that of a page around it is paused."""
    return enabled & ~F.arrays_overlap(paused, F.transform(hosts, lambda h: F.lower(h)))


def noun(fmt: Column) -> Column:
    return F.when(fmt == "pdf", "PDF").when(reg.is_image(fmt), "image").otherwise("file")


def noun_of_all(fmt: Column) -> Column:
    """An aggregate: what files are called together."""
    return F.when(F.min(noun(fmt)) == F.max(noun(fmt)), F.min(noun(fmt))).otherwise("file")


def quality_range(fmt: Column, quality: Column) -> dict[str, Column]:
    """Aggregates over prepared files: the least and greatest quality of all but sheets, what they are called, and whether the loss can be seen."""
    kept = F.when(~reg.is_sheet(fmt), quality)
    return {
        "low": F.min(kept), "high": F.max(kept), "noun": F.when(F.bool_or(reg.is_sheet(fmt)), "files").otherwise("images"),
        "noticeable": F.coalesce(F.min(kept) < LOOKS_THE_SAME, F.lit(False)),
    }


def sendable(name: Column, kind: Column, data: Column) -> Column:
    """Whether a file in base64 has the shape of a message: bounded name and type, and no more data than a message may hold."""
    most = -(-MESSAGE_BYTES // 3) * 4
    return F.coalesce((F.length(name) <= NAME_CHARS) & (F.length(kind) <= TYPE_CHARS) & (F.length(data) <= most), F.lit(False))


def flag(stored: Column, name: str, default: bool) -> Column:
    """A setting of a variant that counts only if it is a boolean, not a text or a number that looks like one."""
    value = F.try_variant_get(stored, f"$.{name}", "boolean")
    kind = F.schema_of_variant(F.try_variant_get(stored, f"$.{name}", "variant"))
    return F.coalesce(F.when(kind == "BOOLEAN", value), F.lit(default))


def suggest_rating(fixes: Column, answered: Column) -> Column:
    return (fixes >= RATE_AFTER) & ~answered
