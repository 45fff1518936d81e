"""Every registered query at the smallest scale: equal to its SQL, or at least non-empty."""

import pytest

import __spark_entry__ as entry
from tests import oracle

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Nothing of these stands on the smallest tables.
MAY_BE_EMPTY = {"alignment_unmatched"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    rows = QUERIES[name](spark, FOLDER).limit(1).collect()
    assert rows or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [
    "frame_numbers", "pause_detection", "edge_trim", "ranked_boundaries", "segment_table", "greedy_merge",
    "word_assignment", "silence_metrics", "best_epoch", "label_shift",
])
def test_chunk_borders(spark, con, monkeypatch, name):
    """The same answers when every clip is cut into chunks of five frames."""
    from lexiloom.plans import segment_queries

    monkeypatch.setattr(segment_queries, "CHUNK", 5)
    assert oracle.compare(QUERIES[name](spark, FOLDER), con, SQL[name]) is None
