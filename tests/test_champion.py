"""The stored baseline: what differs is found, equal buckets stay closed, a promotion swaps at once."""

import random

import pytest

from folium.operators import champion

SCHEMA = "case long, out string"


def found(spark, rows, folder):
    return {(r["key"], r["change"]) for r in champion.changes(spark.createDataFrame(rows, SCHEMA), folder, "case", "out").collect()}


def test_changes_by_hand(spark, tmp_path):
    r = random.Random(9)
    folder = str(tmp_path / "base")
    was = {i: r.choice(["", None, "x", f"text {i}"]) for i in range(400)}
    version = champion.store(spark.createDataFrame(list(was.items()), SCHEMA), folder, "case", "out", buckets=16)
    assert champion.current(spark, folder) is None
    with pytest.raises(FileNotFoundError):
        found(spark, list(was.items()), folder)
    champion.promote(spark, folder, version)
    assert found(spark, list(was.items()), folder) == set()
    assert champion.unequal_buckets(spark.createDataFrame(list(was.items())[::-1], SCHEMA).repartition(7), folder, "case", "out") == []
    for edits in (1, 5, 200):
        now = dict(was)
        for i in r.sample(range(400), edits):
            action = r.randrange(3)
            if action == 0:
                now.pop(i, None)
            elif action == 1:
                now[i] = r.choice(["", None, "new"])
            else:
                now[1000 + i] = None
        want = {(str(k), "missing") for k in was.keys() - now.keys()} | {(str(k), "added") for k in now.keys() - was.keys()}
        want |= {(str(k), "changed") for k in was.keys() & now.keys() if was[k] != now[k]}
        assert found(spark, list(now.items()), folder) == want
        open_ = champion.unequal_buckets(spark.createDataFrame(list(now.items()), SCHEMA), folder, "case", "out")
        assert (len(open_) <= edits) and (edits > 1 or len(open_) == len(want))


def test_promotion_swaps_and_empty_tables(spark, tmp_path):
    folder = str(tmp_path / "base")
    first = champion.store(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), folder, "case", "out")
    champion.promote(spark, folder, first)
    second = champion.store(spark.createDataFrame([(2, "c")], SCHEMA), folder, "case", "out")
    assert champion.current(spark, folder).endswith(first)
    champion.promote(spark, folder, second)
    assert champion.current(spark, folder).endswith(second)
    assert found(spark, [(1, "a"), (2, "b")], folder) == {("1", "added"), ("2", "changed")}
    assert found(spark, [], folder) == {("2", "missing")}
    champion.promote(spark, folder, champion.store(spark.createDataFrame([], SCHEMA), folder, "case", "out"))
    assert found(spark, [(7, None)], folder) == {("7", "added")} and found(spark, [], folder) == set()
