"""Versioned tables, the as-of join and file heads."""

import random

import pytest
from pyspark.sql import functions as F

from fitgate.operators import asof
from fitgate.sources import heads, store
from fitgate.streaming import feeds


def counts(spark, **n):
    return spark.createDataFrame(list(n.items()), store.COUNTS)


def test_a_batch_counts_once(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"), store.COUNTS)
    assert table.read().collect() == [] and table.latest()[0] == 0
    assert store.add_counts(table, "s", 0, counts(spark, a=2, b=1))
    assert store.add_counts(table, "s", 1, counts(spark, a=5))
    assert not store.add_counts(table, "s", 1, counts(spark, a=5))
    assert not store.add_counts(table, "s", 0, counts(spark, a=5))
    assert store.add_counts(table, "another", 0, counts(spark, c=1))
    assert {tuple(r) for r in table.read().collect()} == {("a", 7), ("b", 1), ("c", 1)}
    assert {tuple(r) for r in table.read(1).collect()} == {("a", 2), ("b", 1)}
    assert table.done("s", 1) and not table.done("s", 2) and not table.done("new", 0)


def test_a_lost_job_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = store.VersionedTable(spark, str(tmp_path / "t"), store.COUNTS)
    store.add_counts(table, "s", 0, counts(spark, a=1))
    with monkeypatch.context() as m:
        m.setattr(store.VersionedTable, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            store.add_counts(table, "s", 1, counts(spark, a=1))
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]
    assert store.add_counts(table, "s", 1, counts(spark, a=1))
    assert [tuple(r) for r in table.read().collect()] == [("a", 2)]


def test_two_writers_cannot_make_one_version(spark, tmp_path):
    one, two = (store.VersionedTable(spark, str(tmp_path / "t"), store.COUNTS) for _ in range(2))
    store.add_counts(one, "x", 0, counts(spark, a=1))

    def slow(now):
        store.add_counts(two, "y", 0, counts(spark, a=10))  # comes first
        return now.unionByName(counts(spark, a=100))

    with pytest.raises(store.Conflict):
        one.change("x", 1, slow)
    assert [tuple(r) for r in one.read().collect()] == [("a", 11)]


def test_reset_and_sweep(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"), store.COUNTS)
    for k in range(3):
        store.add_counts(table, "s", k, counts(spark, a=1))
    assert table.reset("s", 3) and table.read().collect() == []
    table.sweep(keep=2)
    assert table.commits() == [3, 4] and [tuple(r) for r in table.read(3).collect()] == [("a", 3)]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("files-")]) == 2
    assert not store.add_counts(table, "s", 2, counts(spark, a=1))
    assert store.add_counts(table, "s", 4, counts(spark, a=1))


def test_problem_log(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"), store.PROBLEMS)
    rows = lambda *us: spark.createDataFrame([(u, u, 1, "damaged") for u in us], store.PROBLEMS)
    for k, batch in enumerate([(5, 1, 3), (2, 9), (), (4, 7)]):
        store.append_problems(table, "s", k, rows(*batch), 3)
    assert sorted(r.us for r in table.read().collect()) == [5, 7, 9]


def test_a_stream_batch_that_runs_twice(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"), store.COUNTS)

    def twice(rows, batch):
        for _ in range(2):
            store.add_counts(table, "stream", batch, rows.groupBy("change").agg(F.count(F.lit(1)).alias("n")))

    parts = [spark.createDataFrame([(c,) for c in word], "change string") for word in ("aab", "ac", "")]
    feeds.fed(parts, lambda s: s, sink=twice)
    assert {tuple(r) for r in table.read().collect()} == {("a", 3), ("b", 1), ("c", 1)}


@pytest.mark.parametrize("rows_per_range", [10**6, 40])
def test_as_of(spark, rows_per_range):
    """One key has most of the rows; with small ranges it lies in many of them."""
    rng = random.Random(4)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, 4, None])
    events = [(k, key(), rng.choice([None, *range(300)])) for k in range(400)] + [(900, 9, 5), (901, 1, -1)]
    versions = [(key(), rng.choice([None, *range(0, 300, 7)]), rng.randrange(50)) for _ in range(60)] + [(4, 299, None), (None, 3, 1)]
    got = asof.as_of(spark.createDataFrame(events, "e long, host long, us long"), spark.createDataFrame(versions, "host long, us long, setting long"), "host", "us", ["setting"], rows_per_range)
    assert got.columns == ["e", "host", "us", "setting"]

    def brute(host, us):
        if host is None or us is None:
            return None
        known = [(v_us, -1 if s is None else s) for h, v_us, s in versions if h == host and v_us is not None and v_us <= us]
        return None if not known or max(known)[1] < 0 else max(known)[1]

    assert sorted(((r.e, r.host, r.us, r.setting) for r in got.collect()), key=repr) == sorted(((e, h, u, brute(h, u)) for e, h, u in events), key=repr)


def test_as_of_empty_sides(spark):
    events, versions = spark.createDataFrame([(1, 5)], "host long, us long"), spark.createDataFrame([(1, 3, True)], "host long, us long, on boolean")
    of = lambda e, v: [tuple(r) for r in asof.as_of(e, v, "host", "us", ["on"]).collect()]
    assert of(events, versions) == [(1, 5, True)]
    assert of(events, versions.limit(0)) == [(1, 5, None)]
    assert of(events.limit(0), versions) == []


def test_heads(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.png").write_bytes(b"\x89PNG" + bytes(5000))
    (tmp_path / "sub/empty.png").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"text")
    with (tmp_path / "huge.bin").open("wb") as f:
        f.write(b"begin")
        f.truncate(1 << 30)
    found = heads.read_heads(spark, str(tmp_path), 1000)
    rows = {r.name: (r.size, len(r.head), bytes(r.head[:5]), r.error) for r in found.collect()}
    assert rows == {"a.png": (5004, 1000, b"\x89PNG\0", None), "empty.png": (0, 0, b"", None), "c.txt": (4, 4, b"text", None), "huge.bin": (1 << 30, 1000, b"begin", None)}
    assert {r.name for r in heads.read_heads(spark, f"file://{tmp_path}", glob="*.png").collect()} == {"a.png", "empty.png"}
    small = found.where((F.col("size") > 0) & (F.col("size") <= 5004) & F.col("name").isin("a.png", "c.txt", "huge.bin") & ~F.col("name").endswith("txt"))
    assert [r.name for r in small.collect()] == ["a.png"]


def test_filters_are_answered_from_the_listing(tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.x").write_bytes(bytes(k * 100))
    reader = heads.HeadsReader({"path": str(tmp_path)})
    kept = list(reader.pushFilters([heads.GreaterThan(("size",), 150), heads.LessThanOrEqual(("size",), 300), heads.EqualTo(("head",), b""), heads.StringStartsWith(("name",), "f")]))
    assert [type(f) for f in kept] == [heads.EqualTo]
    assert [f[1] for p in reader.partitions() for f in p.files] == ["f2.x", "f3.x"]


def test_partitions_weigh_what_is_read(tmp_path, monkeypatch):
    monkeypatch.setattr(heads, "PARTITION_BYTES", 3 * (heads.OPEN_BYTES + 1000))
    for k in range(7):
        (tmp_path / f"f{k}").write_bytes(bytes(1000 if k else 500_000))
    reader = heads.HeadsReader({"path": str(tmp_path), "bytes": "1000"})
    assert [len(p.files) for p in reader.partitions()] == [3, 3, 1]
    (tmp_path / "f3").unlink()
    rows = [r for p in [heads.Heads([(str(tmp_path / "f3"), "f3", 9, 0), (str(tmp_path / "f1"), "f1", 1000, 0)])] for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["head"], r["error"]) for r in rows] == [(None, "FileNotFoundError"), (bytes(1000), None)]
