"""The search for a picture's quality and size under a limit of bytes, as column expressions.

What an encode would give is a function of columns, ``measure(width, height, quality)``: a model of file sizes,
or a look-up in a measured table. A search is a fold over its bounded number of steps that carries a bracket; the
row keeps its place, so there is no shuffle, no Python and no loop on the driver, and rows that have
converged pass through the remaining steps unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitgate.functions.decide import safe_minimum

# Qualities, margins and steps of the search.
USUAL, HIGHEST, FLOOR, SHRUNK = 0.92, 1.0, 0.4, 0.6
MARGIN, QUALITY_STEPS, SHRINK_STEPS, FINER_STEPS, PRECISION = 0.96, 4, 7, 3, 0.02
FIRST_EXPONENT, LEAST_EXPONENT, MOST_EXPONENT = 1.8, 1.0, 2.5

Measure = Callable[[Column, Column, Column], Column]

FOUND = "struct<width:bigint,height:bigint,quality:double,bytes:bigint,filler:bigint,encodes:int,error:string>"
_BRACKET = "struct<low:double,low_bytes:bigint,high:double,high_bytes:bigint,n:int>"
_FINER = "struct<low:double,high:double,bytes:bigint>"
_SHRINK = "struct<fit:double,fit_bytes:bigint,big:double,last:double,last_bytes:double,exponent:double,scale:double,open:boolean,n:int>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _record(schema: str, *values: Column) -> Column:
    return F.struct(*[v.alias(f"c{i}") for i, v in enumerate(values)]).cast(schema)


def _fold(steps: int, start: Column, step: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda state, _: step(state))


def byte_target(max_bytes: Column) -> Column:
    """What a file may have: a little under the limit; NULL without one."""
    return F.floor(max_bytes * MARGIN)


def scaled(side: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(side * scale + 0.5)).cast("long")


def best_quality(measure: Measure, width: Column, height: Column, target: Column, low_bytes: Column, high_bytes: Column) -> Column:
    """The bracket (low, low_bytes, high, high_bytes, n) after the search between the lowest quality, which fits, and the usual one, which does not.

    File size is taken to be exponential in quality between the two ends, and each probe replaces an end; the search stays strictly
    inside and ends early when the ends are within 0.01. ``low`` is the best quality found, ``n`` counts probes.
    """

    def probe(s: Column) -> Column:
        span = F.log(s["high_bytes"]) - F.log(s["low_bytes"])
        share = F.when(span > 0, (F.log(target * 0.995) - F.log(s["low_bytes"])) / span).otherwise(0.5)
        width_left = s["high"] - s["low"]
        edge = F.least(F.lit(0.01), width_left / 4)
        aim = s["low"] + F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * width_left
        return F.least(s["high"] - edge, F.greatest(s["low"] + edge, aim))

    def replaced(s: Column, quality: Column, size: Column) -> Column:
        low, high = _record(_BRACKET, quality, size, s["high"], s["high_bytes"], s["n"] + 1), _record(_BRACKET, s["low"], s["low_bytes"], quality, size, s["n"] + 1)
        return F.when(size <= target, low).otherwise(high)

    def step(s: Column) -> Column:
        moved = _let(probe(s), lambda q: _let(measure(width, height, q), lambda size: replaced(s, q, size)))
        return F.when(s["high"] - s["low"] > 0.01, moved).otherwise(s)

    return _fold(QUALITY_STEPS, _record(_BRACKET, F.lit(FLOOR), low_bytes, F.lit(USUAL), high_bytes, F.lit(0)), step)


def largest_scale(measure: Measure, width: Column, height: Column, quality: Column, target: Column, full_bytes: Column, least: Column) -> Column:
    """The state after the search for the largest scale below 1 that fits: ``fit`` (NULL if none does), ``fit_bytes``, ``n`` probes.

    Size is taken to be a power of the scale, first 1.8, then the slope of the last two probes, between 1 and 2.5. A probe that would
    leave the bracket of the largest scale that fits and the smallest that does not is put at their geometric mean. No scale is under ``least``.
    """

    def after(s: Column, scale: Column, size: Column) -> Column:
        fits = size <= target
        fit = F.when(fits & (s["fit"].isNull() | (scale > s["fit"])), scale).otherwise(s["fit"])
        fit_bytes = F.when(fits & (s["fit"].isNull() | (scale > s["fit"])), size).otherwise(s["fit_bytes"])
        big = F.when(~fits & (scale < s["big"]), scale).otherwise(s["big"])
        slope = F.log(size / s["last_bytes"]) / F.log(scale / s["last"])
        learnt = F.least(F.lit(MOST_EXPONENT), F.greatest(F.lit(LEAST_EXPONENT), slope))
        exponent = F.when((scale != s["last"]) & (size != s["last_bytes"]) & slope.isNotNull(), learnt).otherwise(s["exponent"])

        def onward(v: Column) -> Column:
            aim = scale * F.pow(target * 0.985 / size, 1 / v["exponent"])
            return _let(aim, lambda to: F.struct(
                v["fit"].alias("fit"), v["fit_bytes"].alias("fit_bytes"), v["big"].alias("big"), scale.alias("last"), size.cast("double").alias("last_bytes"), v["exponent"].alias("exponent"),
                F.when(to >= v["big"], F.sqrt(F.coalesce(v["fit"], least) * v["big"])).when(to <= v["fit"], F.sqrt(v["fit"] * v["big"])).otherwise(to).alias("scale"),
                (~(~fits & (scale <= least)) & ~F.coalesce(v["big"] / v["fit"] - 1 <= PRECISION, F.lit(False)) & ~(fits & (to / scale - 1 <= PRECISION))).alias("open"),
                (s["n"] + 1).alias("n"),
            ).cast(_SHRINK))

        return _let(F.struct(fit.alias("fit"), fit_bytes.alias("fit_bytes"), big.alias("big"), exponent.alias("exponent")), onward)

    def step(s: Column) -> Column:
        moved = _let(F.greatest(least, s["scale"]), lambda scale: _let(measure(scaled(width, scale), scaled(height, scale), quality), lambda size: after(s, scale, size)))
        return F.when(s["open"], moved).otherwise(s)

    first = F.least(F.lit(0.98), F.pow(target * 0.97 / full_bytes, F.lit(1 / FIRST_EXPONENT)))
    none = F.lit(None)
    start = _record(_SHRINK, none, none, F.lit(1.0), F.lit(1.0), full_bytes, F.lit(FIRST_EXPONENT), first, F.lit(True), F.lit(0))
    return _fold(SHRINK_STEPS, start, step)


def finer_quality(measure: Measure, width: Column, height: Column, limit: Column) -> Column:
    """struct(quality, bytes): the finest save above the usual quality that fits the limit, by halving; NULL where none does."""

    def halved(s: Column, quality: Column, size: Column) -> Column:
        return F.when(size <= limit, _record(_FINER, quality, s["high"], size)).otherwise(_record(_FINER, s["low"], quality, s["bytes"]))

    def step(s: Column) -> Column:
        return _let((s["low"] + s["high"]) / 2, lambda q: _let(measure(width, height, q), lambda size: halved(s, q, size)))

    end = _fold(FINER_STEPS, _record(_FINER, F.lit(USUAL), F.lit(HIGHEST), F.lit(None)), step)
    return _let(end, lambda s: F.when(s["bytes"].isNotNull(), F.struct(s["low"].alias("quality"), s["bytes"].alias("bytes"))))


def fit_to_bytes(
    measure: Measure, width: Column, height: Column, max_bytes: Column, min_bytes: Column, lossy: Column, may_shrink: Column, min_width: Column, min_height: Column
) -> Column:
    """struct(FOUND): the finest save within the limits of bytes, or an error code.

    At the usual quality first. If that fits but is under the minimum, a lossy format is saved at the highest quality if that still fits,
    and ``filler`` bytes make up the rest. If it is too large, a lossy format's quality is searched down to a floor; below that, or
    for a lossless format, the picture is shrunk, where that is allowed, but not under the field's own least sides. NULL limits are none; a limit
    that leaves no byte is a conflict of rules; NULL measures give NULL. ``encodes`` counts the probes.
    """
    target = byte_target(max_bytes)
    room = F.coalesce(target, F.lit(2**62))
    usual, lowest, highest = (measure(width, height, F.lit(q)) for q in (USUAL, FLOOR, HIGHEST))

    def found(w: Column, h: Column, quality: Column, size: Column, filler: Column, encodes: Column) -> Column:
        return _record(FOUND, w, h, quality, size, filler, encodes, F.lit(None))

    def failed(code: str, encodes: Column) -> Column:
        none = F.lit(None)
        return _record(FOUND, none, none, none, none, none, encodes, F.lit(code))

    def raised(size: Column, quality: Column, minimum: Column, encodes: Column) -> Column:
        return found(width, height, quality, F.greatest(size, minimum), F.greatest(F.lit(0), minimum - size), encodes)

    def within(size: Column) -> Column:
        minimum = F.when(min_bytes.isNotNull(), F.least(safe_minimum(min_bytes), room)).otherwise(0).cast("long")
        finest = _let(highest, lambda top: F.when(top <= room, raised(top, F.lit(HIGHEST), minimum, F.lit(2))).otherwise(raised(size, F.lit(USUAL), minimum, F.lit(2))))
        return (
            F.when(size >= minimum, found(width, height, F.lit(USUAL), size, F.lit(0), F.lit(1)))
            .when(minimum < min_bytes, failed("target-unreachable", F.lit(1)))
            .when(lossy, finest)
            .otherwise(raised(size, F.lit(USUAL), minimum, F.lit(1)))
        )

    def shrunk(quality: Column, full_bytes: Column, before: int) -> Column:
        least_side = F.greatest(1 / F.least(width, height), F.coalesce(min_width, F.lit(0)) / width, F.coalesce(min_height, F.lit(0)) / height)
        end = _let(F.least(F.lit(1.0), least_side), lambda least: largest_scale(measure, width, height, quality, room, full_bytes, least))
        result = _let(end, lambda s: F.when(s["fit"].isNull(), failed("target-unreachable", s["n"] + before)).otherwise(
            found(scaled(width, s["fit"]), scaled(height, s["fit"]), quality, s["fit_bytes"], F.lit(0), s["n"] + before)
        ))
        return F.when(may_shrink, result).otherwise(failed("target-unreachable", F.lit(before)))

    def searched(size: Column, low: Column) -> Column:
        between = F.exp(F.log(low) + (SHRUNK - FLOOR) / (USUAL - FLOOR) * (F.log(size) - F.log(low)))
        bracket = best_quality(measure, width, height, room, low, size)
        within_floor = _let(bracket, lambda s: found(width, height, s["low"], s["low_bytes"], F.lit(0), s["n"] + 2))
        return F.when(low > room, shrunk(F.lit(SHRUNK), between, 2)).otherwise(within_floor)

    def tried(size: Column) -> Column:
        return (
            F.when(size <= room, within(size))
            .when(~lossy, shrunk(F.lit(USUAL), size.cast("double"), 1))
            .when(size.isNotNull(), _let(lowest, lambda low: searched(size, low)))
        )

    return F.when(target <= 0, failed("rules-conflict", F.lit(0))).otherwise(_let(usual, tried))
