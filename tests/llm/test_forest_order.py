"""Problem 2 where rec_ids do not follow the batches, and where a batch brings nothing but copies."""

import pytest

from tamarack.llm import forest

A, B, C = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
SCHEMA = "rec_id bigint, batch_id int, text string"


@pytest.mark.parametrize("find", [forest.repeats, forest.batch_by_batch])
def test_tables_one_after_another(spark, find):
    """A table of batches 0 to 2 three times over: history of the second copy arrives after the first one's batches."""
    one = [(0, A), (None, B), (1, A + " more"), (1, C), (2, C), (2, None)]
    rows = [(i, *r) for i, r in enumerate(one * 3)]
    want = {(0, 2), (3, 4)} | {(a, b + k) for k in (6, 12) for a, b in ((0, 2), (3, 3), (3, 4))}
    got = find(spark.createDataFrame([*rows, (None, 1, A)], SCHEMA))
    assert got.columns == ["rec_id_a", "rec_id_b"] and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("find", [forest.repeats, forest.batch_by_batch])
def test_history_after_a_batch(spark, find):
    """Late history is no result, but a new record may repeat it, and what it repeats itself is no original."""
    rows = [(1, 1, A), (2, 0, A + " more"), (3, 0, B), (4, 2, B), (5, 2, A + " other"), (6, 1, C)]
    assert sorted(map(tuple, find(spark.createDataFrame(rows, SCHEMA)).collect())) == [(1, 5), (3, 4)]
    assert find(spark.createDataFrame([r for r in rows if not r[1]], SCHEMA)).count() == 0


def test_batch_of_copies(spark, tmp_path):
    """No entry of such a batch goes into the trees; later batches and a merge read its empty run."""
    folder, got = str(tmp_path / "forest"), []
    for k, rows in enumerate([[(1, 0, A)], [(2, 1, A), (3, 1, A)], [(4, 2, A + " more"), (5, 2, B)], [(6, 3, B)]]):
        f = forest.Forest(spark, folder)
        got += map(tuple, f.add(spark.createDataFrame(rows, SCHEMA)).collect())
        if k == 2:
            f.merge_runs()
    assert sorted(got) == [(1, 2), (1, 3), (1, 4), (5, 6)]
