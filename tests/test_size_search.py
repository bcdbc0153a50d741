"""The search for a size: every way it can end, against plain loops over all qualities."""

import pytest
from pyspark.sql import functions as F

from fitgate.operators import size_search

SCHEMA = "id int, width long, height long, max_bytes long, min_bytes long, lossy boolean, may_shrink boolean, min_width long, min_height long, per_pixel double"


def size(width, height, quality, lossy, per_pixel):
    return int(width * height * per_pixel * (quality**3 if lossy else 1)) + 1


def measure(width, height, quality):
    return (F.floor(width * height * F.col("per_pixel") * F.when(F.col("lossy"), F.pow(quality, F.lit(3.0))).otherwise(1.0)) + 1).cast("long")


@pytest.fixture(scope="module")
def found(spark):
    base = (900, 700, None, None, True, True, None, None, 0.4)
    cases = [{}, {2: 10**7}, {2: 150_000}, {2: 60_000}, {2: 5_000}, {2: 1}, {2: 0}, {2: 5_000, 5: False}, {2: 5_000, 6: 400}, {3: 500_000}, {3: 500_000, 4: False},
             {2: 210_000, 3: 209_000}, {2: 400_000, 3: 300_000}, {2: 60_000, 4: False}, {2: 100, 0: 1, 1: 1}, {0: None}]
    rows = [(i, *[case.get(k, v) for k, v in enumerate(base)]) for i, case in enumerate(cases)]
    names = ["width", "height", "max_bytes", "min_bytes", "lossy", "may_shrink", "min_width", "min_height"]
    made = size_search.fit_to_bytes(measure, *[F.col(n) for n in names])
    return {r.id: r for r in spark.createDataFrame(rows, SCHEMA).select("*", made.alias("f"), size_search.finer_quality(measure, F.col("width"), F.col("height"), F.col("max_bytes")).alias("finer")).collect()}


def test_every_result_is_what_it_says(found):
    for r in found.values():
        f = r.f
        if f is None or f.error:
            continue
        assert f.bytes - f.filler == size(f.width, f.height, f.quality, r.lossy, r.per_pixel)
        assert f.encodes <= 9
        assert r.max_bytes is None or f.bytes <= r.max_bytes * size_search.MARGIN
        assert (f.width, f.height) == (r.width, r.height) or f.quality == (size_search.SHRUNK if r.lossy else size_search.USUAL)


def test_how_searches_end(found):
    f = {k: r.f for k, r in found.items()}
    assert (f[0].quality, f[0].encodes, f[1].quality, f[1].encodes) == (0.92, 1, 0.92, 1)
    assert f[2].width == 900 and 0.4 < f[2].quality < 0.92
    assert f[4].width < 900 and f[4].quality == 0.6
    assert [f[k].error for k in (6, 7, 8)] == ["rules-conflict", "target-unreachable", "target-unreachable"]
    assert f[5].error == "rules-conflict"  # a byte less its margin is none
    assert f[9].quality == 1.0 and f[9].bytes >= 500_000 and f[9].filler > 0
    assert f[10].quality == 0.92 and f[10].filler > 0 and f[10].encodes == 1
    assert f[11].error == "target-unreachable"  # the least bytes do not fit under the most
    assert f[13].quality == 0.92 and f[13].width < 900
    assert f[14].error is None and f[15] is None


def test_close_to_the_best(found):
    for k in (2, 3):
        r = found[k]
        best = max(q / 1000 for q in range(400, 921) if size(900, 700, q / 1000, True, 0.4) <= r.max_bytes * size_search.MARGIN)
        assert best - 0.02 <= r.f.quality <= best + 0.001
    for k in (4, 13):
        r = found[k]
        best = max(w for w in range(1, 901) if size(w, round(w * 7 / 9), r.f.quality, r.lossy, 0.4) <= r.max_bytes * size_search.MARGIN)
        assert best * 0.97 <= r.f.width <= best + 1


def test_finer(found):
    assert found[1].finer.quality == pytest.approx(0.99)  # three halvings of 0.92 to 1
    assert found[4].finer is None
    limit = 210_000
    assert found[11].finer.quality == max(q for q in (0.93, 0.94, 0.95, 0.96, 0.97, 0.98, 0.99) if size(900, 700, q, True, 0.4) <= limit)


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).selectExpr("id as width", "id as height", "true as lossy", "0.4D as per_pixel").select(size_search.finer_quality(measure, F.col("width"), F.col("height"), F.lit(5)))
    assert "Python" not in plan._jdf.queryExecution().toString()
