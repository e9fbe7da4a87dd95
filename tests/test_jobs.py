"""How the queries read their tables; what they return is compared with DuckDB's SQL in test_entry."""

import pytest

from palimpsest.jobs import feeds, queries


def test_a_task_sorts_a_bounded_part_of_the_feed(spark, sf_dir, monkeypatch):
    whole = sorted(map(tuple, feeds.feed(spark, sf_dir).collect()), key=str)
    monkeypatch.setattr(feeds, "TASK_ROWS", 100)
    dealt = feeds.feed(spark, sf_dir)
    assert dealt.rdd.getNumPartitions() == 10 and sorted(map(tuple, dealt.collect()), key=str) == whole


@pytest.mark.parametrize("name", ["archive_audit", "apply_scd2_batches"])
def test_what_is_read_several_times_is_built_once(spark, sf_dir, name):
    assert not [f for f in queries.QUERIES[name](spark, sf_dir).inputFiles() if "events" in f]
