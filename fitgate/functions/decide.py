"""Compatibility, geometry and decisions as column expressions.

``r`` and ``i`` are column getters (``F.col`` or a struct's): rules have accepted_mimes, accepted_exts, taken
(registry.taken_formats of both lists), min_bytes, max_bytes, min_width, min_height, max_width, max_height, exact_width, exact_height, aspect_ratio, dpi;
facts have format, width, height, bytes, transparent, animated, pages, dpi. NULL means absent; a zero
dimension counts as absent too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitgate.functions import registry as reg

Get = Callable[[str], Column]
DIMENSIONS = ("min_width", "min_height", "max_width", "max_height", "exact_width", "exact_height", "aspect_ratio")
# Thresholds and orders that results must equal.
CONSENTS = ("crop", "page", "sheet", "transparency", "animation", "palette", "upscale", "shrink", "quality")
LOOKS_THE_SAME, SILENT_UPSCALE = 97, 1.1
MAX_DECODE_SIDE, MAX_DECODE_PIXELS, MAX_STREAM_SIDE, MAX_STREAM_PIXELS = 32_767, 250_000_000, 1_000_000, 20_000_000_000
MAX_INPUT_BYTES = 5 * 1024**3

def _infinity() -> Column:
    return F.lit(float("inf"))


def _present(c: Column) -> Column:
    """NULL for zero, so that comparisons with an absent dimension are never true."""
    return F.nullif(c.cast("double"), F.lit(0.0))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _list(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(_true(c), F.lit(name)) for c, name in pairs]))


def safe_minimum(min_bytes: Column) -> Column:
    return F.ceil(min_bytes.cast("double") * F.when(min_bytes < 1_000_000, F.lit(1.024)).otherwise(F.lit(1.024**2)))


def same_ratio(width: Column, height: Column, ratio: Column) -> Column:
    return F.abs(width - height * ratio) <= F.greatest(F.lit(1.0), ratio)


def target_ratio(r: Get) -> Column:
    return F.coalesce(r("aspect_ratio"), _present(r("exact_width")) / _present(r("exact_height")))


def has_dimension_rules(r: Get) -> Column:
    return F.coalesce(*[r(d).cast("double") for d in DIMENSIONS]).isNotNull()


def allowed(fmt: Column, r: Get) -> Column:
    return reg.format_allowed(fmt, r("taken"))


def might_need_work(fmt: Column, size: Column, r: Get) -> Column:
    """The test on metadata alone, in its fixed order; ``fmt`` is registry.guess_format(), better a column of its own as it is used often."""
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, False)
        .when(fmt == "unknown", False)
        .when(~allowed(fmt, r), reg.can_become(fmt, r("taken")))
        .when(reg.is_sheet(fmt), False)
        .when(size > r("max_bytes"), True)
        .when(fmt == "pdf", False)
        .when(size < safe_minimum(r("min_bytes")), True)
        .when((F.coalesce(r("dpi"), F.lit(0)) > 0) & reg.carries_dpi(fmt), True)
        .otherwise(reg.takes_output(r("taken")) & has_dimension_rules(r))
    )


def issues(i: Get, r: Get) -> Column:
    """All ways in which a file fails the rules, in fixed order."""
    w, h, ratio = i("width").cast("double"), i("height").cast("double"), target_ratio(r)
    base = _list(
        (~allowed(i("format"), r), "unsupported-format"),
        ((r("dpi") > 0) & reg.carries_dpi(i("format")) & ~i("dpi").eqNullSafe(r("dpi")), "wrong-dpi"),
        (i("bytes") > r("max_bytes"), "too-large"),
        (i("bytes") < safe_minimum(r("min_bytes")), "too-small-file"),
    )
    shape = _list(
        (_true(w < _present(r("min_width"))) | _true(h < _present(r("min_height"))), "too-small-dimensions"),
        (_true(w > _present(r("max_width"))) | _true(h > _present(r("max_height"))), "too-large-dimensions"),
        (_true(w != _present(r("exact_width"))) | _true(h != _present(r("exact_height"))), "exact-dimensions-required"),
        (~same_ratio(w, h, F.nullif(ratio, F.lit(0.0))), "wrong-aspect-ratio"),
    )
    sized = _true((w > 0) & (h > 0))
    return (
        F.when((i("format") == "unknown") | ~_true(i("bytes") > 0), F.array(F.lit("unknown")))
        .when(~has_dimension_rules(r), base)
        .when(~sized, F.concat(base, F.array(F.lit("unknown"))))
        .otherwise(F.concat(base, shape))
    )


def conflicting(r: Get) -> Column:
    """Whether rules contradict each other."""
    tests = [r("min_bytes") > r("max_bytes")]
    for axis in ("width", "height"):
        low, high, exact = (_present(r(f"{k}_{axis}")) for k in ("min", "max", "exact"))
        tests += [low > high, exact < low, exact > high]
    tests.append(~same_ratio(_present(r("exact_width")), _present(r("exact_height")), F.nullif(r("aspect_ratio"), F.lit(0.0))))
    out = F.lit(False)
    for t in tests:
        out = out | _true(t)
    return out


def states_pixel_size(r: Get) -> Column:
    both = F.concat(r("accepted_mimes"), r("accepted_exts"))
    icons = (F.size(both) > 0) & F.forall(both, lambda t: t.rlike(r"(?i)icon|\.ico$|\.cur$"))
    stated = F.coalesce(*[_present(r(d)) for d in ("max_width", "max_height", "exact_width", "exact_height")]).isNotNull()
    return stated | icons


def choose_output(i: Get, r: Get) -> Column:
    """The format to write, NULL if the field takes none that can be written."""
    photo = reg.first_output(r("taken"), reg.PHOTO_ORDER)
    lossy = reg.first_output(r("taken"), [n for n in reg.PHOTO_ORDER if reg.BY_NAME[n].lossy])
    clear = reg.first_output(r("taken"), reg.TRANSPARENT_ORDER)
    keeps = reg.is_output(i("format")) & allowed(i("format"), r)
    heavy = _true(i("bytes") > r("max_bytes"))
    return (
        F.when(keeps & heavy & ~reg.is_lossy(i("format")) & ~i("transparent"), F.coalesce(lossy, i("format")))
        .when(keeps, i("format")).when(i("transparent"), clear).otherwise(photo)
    )


def default_crop(w: Column, h: Column, ratio: Column) -> Column:
    """The largest centred region of a shape."""
    width = F.least(w.cast("double"), h * ratio)
    height = width / ratio
    return F.struct(((w - width) / 2).alias("x"), ((h - height) / 2).alias("y"), width.alias("width"), height.alias("height"))


def required_scale(w: Column, h: Column, r: Get) -> Column:
    w, h = w.cast("double"), h.cast("double")
    grow = F.greatest(F.lit(1.0), F.coalesce(r("min_width"), F.lit(0)) / w, F.coalesce(r("min_height"), F.lit(0)) / h)
    shrink = F.least(F.lit(1.0), F.coalesce(r("max_width").cast("double"), _infinity()) / w, F.coalesce(r("max_height").cast("double"), _infinity()) / h)
    return F.coalesce(_present(r("exact_width")) / w, _present(r("exact_height")) / h, F.when(grow > 1, grow).otherwise(shrink))


def decision(i: Get, r: Get, found: Column | None = None, output: Column | None = None) -> Column:
    """struct(action, issues, output_format, consents). ``found`` and ``output`` are issues() and choose_output(), if they
    are columns already: each is used several times."""
    found = issues(i, r) if found is None else found
    output = choose_output(i, r) if output is None else output
    ratio = target_ratio(r)
    w, h = i("width").cast("double"), i("height").cast("double")
    crop = _true(~same_ratio(w, h, F.nullif(ratio, F.lit(0.0))))
    box = default_crop(w, h, ratio)
    scale = required_scale(F.when(crop, box["width"]).otherwise(w), F.when(crop, box["height"]).otherwise(h), r)
    asked = _list(
        (crop, "crop"),
        (F.coalesce(i("pages"), F.lit(1)) > 1, "page"),
        (i("transparent") & ~reg.keeps_alpha(output), "transparency"),
        (i("animated"), "animation"),
        ((output == "gif") & (i("format") != "gif"), "palette"),
        (scale > SILENT_UPSCALE, "upscale"),
    )
    none = F.array().cast("array<string>")
    unsafe = F.array_contains(found, "unknown") | conflicting(r) | output.isNull()
    action = (
        F.when(F.size(found) == 0, "PASS_THROUGH").when(unsafe, "UNSAFE_TO_FIX")
        .when(F.size(asked) > 0, "USER_CONFIRMATION").otherwise("AUTO_FIX")
    )
    fixes = action.isin("USER_CONFIRMATION", "AUTO_FIX")
    return F.struct(action.alias("action"), found.alias("issues"), F.when(fixes, output).alias("output_format"), F.when(fixes, asked).otherwise(none).alias("consents"))


def result_consent(quality_kept: Column, size_limited: Column, resized_to_fit: Column, ask: Column) -> Column:
    """What to ask about a prepared file: fewer pixels before lower quality; NULL for nothing."""
    return F.when(resized_to_fit, "shrink").when(ask & size_limited & (quality_kept < LOOKS_THE_SAME), "quality")


def _round(x: Column) -> Column:
    return F.floor(x + 0.5)


def dimension_error(w: Column, h: Column, side: int = MAX_STREAM_SIDE, pixels: int = MAX_STREAM_PIXELS) -> Column:
    return F.when(~_true((w >= 1) & (h >= 1)), "damaged").when((w > side) | (h > side) | (w.cast("double") * h > pixels), "too-large-to-process")


def target_dimensions(w: Column, h: Column, r: Get, allow_upscale: bool) -> Column:
    """struct(width, height, error): the largest size within all rules that keeps the shape."""
    dw, dh, ratio = w.cast("double"), h.cast("double"), target_ratio(r)
    ew, eh = _present(r("exact_width")), _present(r("exact_height"))
    fit = F.least(F.lit(1.0), F.coalesce(r("max_width").cast("double"), _infinity()) / dw, F.coalesce(r("max_height").cast("double"), _infinity()) / dh)
    scale = F.greatest(F.coalesce(ew / dw, eh / dh, fit), F.coalesce(r("min_width"), F.lit(0)) / dw, F.coalesce(r("min_height"), F.lit(0)) / dh)
    fw = F.coalesce(r("exact_width").cast("double"), F.greatest(F.lit(1.0), _round(dw * scale).cast("double")))
    fh = F.coalesce(r("exact_height").cast("double"), F.greatest(F.lit(1.0), _round(dh * scale).cast("double")))
    outside = F.lit(False)
    for size, axis in ((fw, "width"), (fh, "height")):
        outside = outside | _true(size > _present(r(f"max_{axis}"))) | _true(size < _present(r(f"min_{axis}")))
    error = (
        F.when(dimension_error(w, h).isNotNull(), dimension_error(w, h))
        .when(~same_ratio(dw, dh, F.nullif(ratio, F.lit(0.0))), "needs-crop")
        .when((scale > 1.0001) & F.lit(not allow_upscale), "needs-upscale")
        .when(dimension_error(fw, fh).isNotNull(), dimension_error(fw, fh))
        .when(outside, "rules-conflict")
    )
    return F.struct(F.when(error.isNull(), fw.cast("long")).alias("width"), F.when(error.isNull(), fh.cast("long")).alias("height"), error.alias("error"))


def output_name(name: Column, fmt: Column) -> Column:
    """The name with the extension of its new format; unchanged if it says that format already."""
    base = F.trim(F.regexp_replace(name, r"\.[^.]*$", ""))
    base = F.when(base != "", base).otherwise(F.when(reg.is_output(fmt), F.lit("image")).otherwise(F.lit("file")))
    ext = F.try_element_at(reg._map([(f.name, f.exts[0]) for f in reg.FORMATS]), fmt)
    return F.when(reg.guess_format(name, F.lit("")) == fmt, name).otherwise(F.concat(base, ext))


def svg_size(w: Column, h: Column, r: Get, long_side: int = 1024, most: int = 4096) -> Column:
    w, h = w.cast("double"), h.cast("double")
    longest = F.greatest(w, h)
    need = lambda axis: F.coalesce(r(f"exact_{axis}"), r(f"min_{axis}"), F.lit(0)).cast("double")
    scale = F.greatest(F.lit(1.0), F.lit(float(long_side)) / longest, need("width") / w, need("height") / h)
    scale = F.least(scale, F.coalesce(r("max_width").cast("double"), _infinity()) / w, F.coalesce(r("max_height").cast("double"), _infinity()) / h, F.lit(float(most)) / longest)
    side = lambda x: F.greatest(F.lit(1.0), _round(x * scale).cast("double")).cast("long")
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def working_size(w: Column, h: Column, pixels: int = 64_000_000, side: int = 16_384) -> Column:
    w, h = w.cast("double"), h.cast("double")
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(pixels)) / (w * h)), F.lit(float(side)) / F.greatest(w, h))
    cut = lambda x: F.greatest(F.lit(1), F.floor(x * scale)).cast("long")
    return F.struct(cut(w).alias("width"), cut(h).alias("height"))


def a4_box(w: Column, h: Column, margin: float = 28.0, most: float = 0.75) -> Column:
    """Where an image lies on an A4 page, in points: landscape if wider than high, centred, never over 3/4 pt a pixel."""
    w, h = w.cast("double"), h.cast("double")
    wide = w > h
    pw, ph = F.when(wide, 841.89).otherwise(595.28), F.when(wide, 595.28).otherwise(841.89)
    scale = F.least(F.lit(most), (pw - 2 * margin) / w, (ph - 2 * margin) / h)
    return F.struct(((pw - w * scale) / 2).alias("x"), ((ph - h * scale) / 2).alias("y"), (w * scale).alias("width"), (h * scale).alias("height"))


def processing_ms(size: Column) -> Column:
    return F.lit(30_000) + F.ceil(size.cast("double") / 1024**3 * 60_000)


def file_size_error(size: Column, limit: int = MAX_INPUT_BYTES) -> Column:
    return F.when(~_true(size > 0), "empty-file").when(size > limit, "too-large-to-process")


def route(fmt: Column, size: Column, r: Get) -> Column:
    """Which branch a file takes: sheet, pdf-pass, pdf-shrink, pdf-page, image-pdf or image."""
    outputs, pdf = reg.takes_output(r("taken")), reg.format_allowed("pdf", r("taken"))
    return (
        F.when(reg.is_sheet(fmt), "sheet")
        .when((fmt == "pdf") & pdf & _true(size > r("max_bytes")), "pdf-shrink")
        .when((fmt == "pdf") & pdf, "pdf-pass")
        .when((fmt == "pdf") & outputs, "pdf-page")
        .when(fmt == "pdf", "pdf-pass")
        .when(pdf & ~outputs, "image-pdf")
        .otherwise("image")
    )


def normalize_crop(x: Column, y: Column, cw: Column, ch: Column, w: Column, h: Column) -> Column:
    """struct(x, y, width, height, error): a crop in whole pixels inside the image; an empty one or one that is no number needs a new crop."""
    bad = F.lit(False)
    for c in (x, y, cw, ch):
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == _infinity())
    left, top = F.greatest(F.lit(0.0), _round(x).cast("double")), F.greatest(F.lit(0.0), _round(y).cast("double"))
    width, height = F.least(w - left, _round(cw).cast("double")), F.least(h - top, _round(ch).cast("double"))
    error = F.when(bad | (width < 1) | (height < 1), "needs-crop")
    ok = lambda c: F.when(error.isNull(), c.cast("long"))
    return F.struct(ok(left).alias("x"), ok(top).alias("y"), ok(width).alias("width"), ok(height).alias("height"), error.alias("error"))


def zoom_crop(box: Column, full_w: Column, full_h: Column, zoom: Column, base: Column) -> Column:
    """A crop zoomed 1 to 4 times about its centre (``base`` is the unzoomed crop), moved back inside the image."""
    z = F.greatest(F.lit(1.0), F.least(F.lit(4.0), zoom))
    w, h = base["width"] / z, base["height"] / z
    cx, cy = box["x"] + box["width"] / 2, box["y"] + box["height"] / 2
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    return F.struct(inside(cx - w / 2, full_w - w).alias("x"), inside(cy - h / 2, full_h - h).alias("y"), w.alias("width"), h.alias("height"))


def sanitized_options(output: Column, sheet: Column, flag: Column) -> Column:
    """struct(output, sheet, allow): unknown outputs become jpeg, a sheet is an integer from 1 to 999, a flag only counts if it is true."""
    known = output.isin(*[f.name for f in reg.FORMATS if f.alpha is not None], "pdf", "csv", "xlsx")
    whole = (sheet == F.floor(sheet)) & sheet.between(1, 999)
    return F.struct(F.when(_true(known), output).otherwise(F.lit("jpeg")).alias("output"), F.when(whole, sheet.cast("long")).alias("sheet"), (_true(flag == "true")).alias("allow"))


def prepare_outcome(action: Column, found: Column) -> Column:
    """struct(kind, code) of a file once its decision is known; only files that cannot be helped have a code."""
    kind = F.when(action == "PASS_THROUGH", "pass").when(action == "UNSAFE_TO_FIX", "unsafe").when(action == "AUTO_FIX", "fixed").otherwise("confirm")
    code = F.when(action == "UNSAFE_TO_FIX", F.when(F.array_contains(found, "unknown"), "damaged").otherwise("rules-conflict"))
    return F.struct(kind.alias("kind"), code.alias("code"))
