"""Text forms against plain arithmetic."""

from decimal import ROUND_HALF_UP, Decimal

from fitgate.functions.formatting import format_bytes


def test_bytes_round_by_the_exact_quotient(spark):
    sizes = [n * 50_000 for n in range(20, 4_000)] + [10**9 + n * 50_000_000 for n in range(400)] + [0, 999, 999_499, 999_500, 999_949_999, 999_950_000, 1_234_567]

    def want(n):
        if n < 999_500:
            return f"{n} B" if n < 1_000 else f"{int(n / 1_000 + 0.5)} KB"
        value, unit = (n / 1e6, "MB") if n < 999_950_000 else (n / 1e9, "GB")
        return f"{str(Decimal(value).quantize(Decimal('0.1'), ROUND_HALF_UP)).removesuffix('.0')} {unit}"

    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert {r.n: r.t for r in df.select("n", format_bytes(df.n).alias("t")).collect()} == {n: want(n) for n in sizes}
    assert want(1_150_000) == "1.1 MB" and want(1_250_000) == "1.3 MB"
