"""HyperMinHash: its registers and estimates against plain sets, and groups against brute force."""

import random

import numpy as np
import pytest

from fitgate.llm import hyperminhash as hm
from fitgate.llm.common import Stages, mix
from tests.llm.test_pairs import brute_components, near_copies, one_group


def hashes(numbers):
    return np.sort(mix(np.array(sorted(numbers), np.uint64) + np.uint64(77)))


def plain_register(s, bucket):
    """Leading zeros and ten bits behind the first one of the smallest hash of a bucket, or None."""
    mine = [int(v) & (2**57 - 1) for v in s if int(v) >> 57 == bucket]
    if not mine:
        return None
    v = min(mine) >> 4
    zeros = 53 - v.bit_length()
    return zeros << 10 | (((v << 10) >> max(0, v.bit_length() - 1)) & 1023)


def test_registers():
    rng = random.Random(1)
    sets = [hashes(rng.sample(range(10**6), n)) for n in (1, 2, 7, 60, 400, 5000)]
    rows = hm.registers(sets)
    for s, row in zip(sets, rows):
        for b in range(hm.BUCKETS):
            want = plain_register(s, b)
            if want is None:  # borrowed, in the order of this bucket
                want = next(w for x in hm._LENDERS[b] if (w := plain_register(s, x)) is not None)
            assert int(row[b]) == want
    assert all((rows[0] == rows[0][0]).all() for _ in "x")


@pytest.mark.parametrize("n", [7, 20, 100, 2000])
def test_similar_sets_share_bands_and_estimates_are_near(n):
    """300 pairs of similarity 0.85 or a little more: each shares a band and none is ruled out by its estimate."""
    rng = random.Random(n)
    gaps, shared_bands = [], []
    for _ in range(300):
        x = rng.sample(range(10**7), n)
        y = x[: max(1, int(n * 0.851 + 0.999))]
        a, b = hm.registers([hashes(x), hashes(y)])
        j = len(y) / n
        e = hm.estimated(a[None], b[None], np.array([n]), np.array([len(y)]))[0]
        gaps.append(e - j)
        shared_bands.append((a.reshape(-1, hm.BAND) == b.reshape(-1, hm.BAND)).all(1).sum())
        assert e >= 0.85 - hm.MARGIN
    assert min(shared_bands) > 0 and abs(np.mean(gaps)) < 0.02
    apart = [hm.registers([hashes(rng.sample(range(10**7), n)), hashes(rng.sample(range(10**7, 2 * 10**7), n))]) for _ in range(60)]
    estimates = [hm.estimated(a[None], b[None], np.array([n]), np.array([n]))[0] for a, b in apart]
    assert abs(np.mean(estimates)) < 0.01 and max(estimates) < 0.1


def test_collisions_by_chance():
    """The correction is the share of equal registers of disjoint sets, within its error."""
    rng = np.random.default_rng(2)
    for n, m in ((2000, 2000), (3000, 500)):
        same = [np.mean([np.equal(*hm.registers([hashes(rng.integers(0, 2**40, n)), hashes(rng.integers(2**40, 2**41, m))])).mean()]) for _ in range(200)]
        assert abs(np.mean(same) - hm.chance(np.array([n]), np.array([m]))[0]) < 3e-4


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows] + [(10**6, None, 1), (None, "no id", 2), (rows[0][0], rows[0][1], 8)], "doc_id long, text string, n long").repartition(4)
    got = [tuple(r) for r in hm.near_duplicates(docs).collect()]
    want = brute_components([*rows, (10**6, None)], 3, 85)
    assert len(got) == len(want) and {r[:3] for r in got} == want
    assert all(kept == (d == c) for d, _, c, kept in got)


def test_one_group_of_near_copies(spark, monkeypatch):
    """A hot group: what is compared follows its rows, not their square."""
    counts, write = {}, Stages.write

    def counted(self, df, name, **options):
        out = write(self, df, name, **options)
        if name in ("banded", "stars0", "by_chief", "by_deviation", "candidates"):
            counts[name] = out.count()
        return out

    monkeypatch.setattr(Stages, "write", counted)
    rows = one_group(500, 4, 3, 85) + [(1000 + i, "the same text again and again " * 3) for i in range(300)]
    got = {tuple(r)[:3] for r in hm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows, 3, 85)
    assert len({c for _, _, c in got}) > 5
    assert counts["by_deviation"] + counts["candidates"] <= 2 * len(rows) and counts["by_chief"] <= 20 * len(rows)


def test_texts_that_clash_on_an_id_and_empty_tables(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (2, a), (3, b), (4, b), (3, a), (3, "")]
    out = set()
    for k in (1, 3):
        docs = spark.createDataFrame(rows[::-1] if k > 1 else rows, "doc_id long, text string").repartition(k)
        out.add(frozenset(tuple(r)[:3] for r in hm.near_duplicates(docs).collect()))
    assert out == {frozenset({(1, 28, 1), (2, 28, 1), (3, 0, 3), (4, 28, 4)})}
    assert hm.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in hm.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 1, True)]
