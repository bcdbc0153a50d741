"""Queries give the whole result: no cap on long rows."""

import pytest

from fitgate import catalog
from fitgate.operators.bookkeeping import fix_counts
from fitgate.plans import views
from fitgate.streaming import feeds


def test_rules_after_the_first_characters_of_a_document(spark, tmp_path):
    plain = "word " * 3000
    texts = [(1, plain + "end. Maximum size: 5 MB. " + plain), (2, "nothing. " * 500), (3, None), (4, "Some text.\n" * 300 + "The photo must be at least 300 dpi."), (5, plain)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.no_rules_in_prose(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "max_bytes", 5e6), (4, "dpi", 300.0)]


@pytest.mark.parametrize("files", [0, 3])
def test_drained_rows_are_read_from_the_shared_folder(spark, sf, tmp_path, files):
    events = spark.read.parquet(f"{sf}/events.parquet").limit(300 if files else 0)
    for _ in range(files or 1):
        events.repartition(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = lambda: feeds.events_stream(spark, str(tmp_path), files_per_trigger=1)
    newest = feeds.drain(feeds.newest_selection(stream()), "update", spark)
    counts = feeds.drain(feeds.running_counts(stream()), "complete", spark)
    written = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, fix_counts(views.outcomes_of(written)).collect()))
    assert newest.select("owner").distinct().count() == written.select("user_id").distinct().count()
    if files:
        assert newest.inputFiles() and counts.inputFiles()
        assert all("/drained-" in f for f in newest.inputFiles() + counts.inputFiles())
