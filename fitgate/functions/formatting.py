"""Text forms and the checks of untrusted records, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitgate.functions import registry as reg

# Names that stored records may hold.
ERROR_CODES = (
    "empty-file", "damaged", "unsupported-format", "too-large-to-process", "needs-crop", "needs-upscale", "needs-transparency-consent",
    "needs-animation-consent", "target-unreachable", "rules-conflict", "uncalculated-formulas", "encode-unsupported", "timeout", "busy", "cancelled", "failed",
)
CHANGES = (
    "converted", "cropped", "resized", "compressed", "raised-to-minimum", "background-added", "first-frame", "first-page",
    "orientation-applied", "dpi-set", "one-sheet",
)
COUNTED_CHANGES = ("converted", "resized", "compressed", "cropped", "background-added", "first-frame", "orientation-applied", "dpi-set")
MAX_PROBLEMS, MAX_RULES, MAX_SITES = 20, 160, 500


def _tenths(n: Column, unit: int) -> Column:
    """``n`` in units with one decimal, none if it is 0. Rounded by the exact value of the quotient in floating point, ties
    up: 1,150,000 is a little less than 1.15 million, so 1.1. The parts of a sum show on which side of the tie it lies."""
    n = n.cast("long")
    down = (n - n % (unit // 10)) / (unit // 10)
    x = n.cast("double") / unit
    y = (x - F.floor(x)) * 4
    total, tie = y * 4 + y, (down % 10) * 2 + 1
    lost = y - (total - y * 4)
    up = (total > tie) | ((total == tie) & (lost >= 0))
    tenths = F.when(up, down + 1).otherwise(down).cast("long")
    whole, rest = ((tenths - tenths % 10) / 10).cast("long").cast("string"), (tenths % 10).cast("string")
    return F.when(tenths % 10 == 0, whole).otherwise(F.concat(whole, F.lit("."), rest))


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1_000, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 999_500, F.concat(F.floor(n.cast("double") / 1_000 + 0.5).cast("string"), F.lit(" KB")))
        .when(n < 999_950_000, F.concat(_tenths(n, 10**6), F.lit(" MB")))
        .otherwise(F.concat(_tenths(n, 10**9), F.lit(" GB")))
    )


def round_bytes(n: Column) -> Column:
    """Two significant figures; 0 for what is no size. Digits are counted in the text of the number: no logarithm can be off by one."""
    whole = n.cast("long")
    step = F.pow(F.lit(10.0), F.greatest(F.length(whole.cast("string")) - 2, F.lit(0)))
    return F.when(whole > 0, (F.floor(whole / step + 0.5) * step).cast("long")).otherwise(F.lit(0).cast("long"))


def _two(x: Column) -> Column:
    cents = F.floor(x * 100 + 0.5)
    text = F.format_string("%.2f", cents / 100)
    return F.regexp_replace(F.regexp_replace(text, "0$", ""), r"\.0$", "")


def print_size(w_mm: Column, h_mm: Column) -> Column:
    quarter = lambda x: F.abs(x / 25.4 * 4 - F.floor(x / 25.4 * 4 + 0.5)) < 0.01
    inches = F.concat(_two(w_mm / 25.4), F.lit(" × "), _two(h_mm / 25.4), F.lit(" in"))
    return F.when(quarter(w_mm) & quarter(h_mm), inches).otherwise(F.concat(_two(w_mm / 10), F.lit(" × "), _two(h_mm / 10), F.lit(" cm")))


def rules_summary(r: Callable[[str], Column]) -> Column:
    """One line: formats, bytes, exact, least and greatest size, shape, DPI."""
    formats = F.concat(
        F.transform(r("accepted_mimes"), lambda m: F.coalesce(reg.label_of(reg.format_from_mime(m)), F.lit(""))),
        F.transform(r("accepted_exts"), lambda e: F.coalesce(reg.label_of(reg.format_from_extension(e)), F.lit(""))),
    )
    labels = F.array_distinct(F.filter(formats, lambda x: x != ""))
    either = lambda a, b: (F.coalesce(r(a), F.lit(0)) > 0) | (F.coalesce(r(b), F.lit(0)) > 0)
    side = lambda x: F.coalesce(r(x).cast("long").cast("string"), F.lit("any"))
    size = lambda a, b: F.concat(side(a), F.lit(" × "), side(b))
    has = lambda x: F.coalesce(r(x), F.lit(0)) > 0
    ratio = F.regexp_replace(F.regexp_replace(F.format_string("%.3f", r("aspect_ratio")), "0+$", ""), r"\.$", "")
    parts = F.array_compact(F.array(
        F.when(F.size(labels) > 0, F.array_join(labels, ", ")).when(F.array_contains(r("accepted_mimes"), "image/*"), "any image"),
        F.when(has("min_bytes") & has("max_bytes"), F.concat(format_bytes(r("min_bytes")), F.lit("–"), format_bytes(r("max_bytes"))))
        .when(has("max_bytes"), F.concat(F.lit("max "), format_bytes(r("max_bytes"))))
        .when(has("min_bytes"), F.concat(F.lit("at least "), format_bytes(r("min_bytes")))),
        F.when(either("exact_width", "exact_height"), size("exact_width", "exact_height")),
        F.when(either("min_width", "min_height"), F.concat(F.lit("at least "), size("min_width", "min_height"))),
        F.when(either("max_width", "max_height"), F.concat(F.lit("at most "), size("max_width", "max_height"))),
        F.when(has("aspect_ratio") & ~has("exact_width"), F.concat(F.lit("shape "), ratio, F.lit(" : 1"))),
        F.when(has("dpi"), F.concat(r("dpi").cast("string"), F.lit(" DPI"))),
    ))
    return F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise(F.lit("no rules found"))


def printable(text: Column, most: int = MAX_RULES) -> Column:
    return F.substring(F.regexp_replace(text, r"[\x00-\x1f\x7f]", " "), 1, most)


def error_code(code: Column) -> Column:
    """A known code, 'cancelled' for an abort, else 'failed'."""
    return F.when(code.isin(*ERROR_CODES), code).when(code == "AbortError", "cancelled").otherwise("failed")


def valid_change_list(changes: Column) -> Column:
    """At most 32 lists, all of names that are counted."""
    return (F.size(changes) <= 32) & F.forall(changes, lambda one: F.forall(one, lambda c: c.isin(*COUNTED_CHANGES)))


def sanitized_number(x: Column) -> Column:
    return F.when((x > 0) & (x < 1e12), x)


def normalized_hosts(hosts: Column) -> Column:
    """Lower-case host names, each once, 500 at most (the limit of the setting)."""
    ok = F.filter(F.transform(hosts, lambda h: F.lower(h)), lambda h: h.rlike(r"^[a-z0-9.-]{1,253}$"))
    return F.slice(F.array_distinct(ok), 1, MAX_SITES)
