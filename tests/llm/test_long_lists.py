"""Index lists longer than a task's Arrow batches, one after another."""

import numpy as np
import pytest

from wicker.llm import linking

#: Sizes of all nodes, and what an entry of them says.
SIZE, REST = 10, 10
BLOCK, BATCH = 3, 40


@pytest.fixture
def batched(spark):
    """Arrow batches of BATCH rows, and all entries in one task."""
    batch, parts = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k) for k in (batch, parts)}
    spark.conf.set(batch, str(BATCH))
    spark.conf.set(parts, "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def lists_of(spark, rows):
    place = int(linking.place_of(np.array([SIZE]), np.array([REST]))[0])
    entries = spark.createDataFrame([(token, node, place) for token, node in rows], "token bigint, node bigint, place bigint")
    return linking.index_lists(entries, lambda n, m: np.ones_like(n), 0.9, BLOCK).collect()


@pytest.mark.parametrize("counts", [(60, 60), (60, 60, 1), (60, 20, 60), (45, 35, 1), (100, 100, 100)])
def test_long_lists_that_follow_each_other(spark, batched, counts):
    """A batch that holds the end of one long list and the begin of another, and nothing between."""
    found = lists_of(spark, [(token, 1000 * token + k) for token, n in enumerate(counts) for k in range(n)])
    for token, n in enumerate(counts):
        want = {1000 * token + k for k in range(n)} if n > 1 else set()
        assert {k for r in found for k in r["nodes"] if k // 1000 == token} == want
    assert all(r["part"] > 0 for r in found if len(r["nodes"]) > 2 * BLOCK)


def test_repeated_entries_make_no_long_list(spark, batched):
    """Five nodes, each from fifty slices, are one short list, which need not be opened."""
    found = lists_of(spark, [(7, k % 5) for k in range(250)])
    assert [(r["part"], sorted(r["nodes"])) for r in found] == [(0, [0, 1, 2, 3, 4])]
