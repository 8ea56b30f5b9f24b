from datetime import date
from unittest import mock

import pytest

from cardlake.sinks import loads
from cardlake.sinks.days import write_by_situation_date

SCHEMA = "id bigint, n int, situation_date string"


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def source(spark, low, last):
    """Two days of every id, an id with two rows, and one without a date."""
    rows = [(i, n, f"2025-05-{day}") for i in range(40) for day in (29, 30) for n in range(2 if i == 3 else 1)]
    rows += [(5, 9, None), (12, 9, "?")]
    return frame(spark, *[row for row in rows if low <= row[0] <= last])


def held(spark, root):
    return sorted(((str(r.day), r.low, r.last) for r in loads.held_ranges(loads.entries(spark, root)).collect()))


def test_windows_can_be_loaded_again_and_may_overlap(spark, tmp_path, rows):
    root = str(tmp_path / "t")
    first = loads.load_window(source(spark, 0, 9), root, (0, 9))
    assert first == {"n_rows": 23, "n_undated": 1, "n_held": 0}
    assert loads.load_window(source(spark, 0, 9), root, (0, 9)) == {"n_rows": 0, "n_undated": 0, "n_held": 23}
    assert loads.load_window(source(spark, 5, 24), root, (5, 24)) == {"n_rows": 31, "n_undated": 1, "n_held": 11}
    assert loads.load_window(source(spark, 25, 39), root, (25, 39))["n_rows"] == 30
    whole = [(r.id, r.n) for r in source(spark, 0, 39).collect()]
    assert rows(spark.read.parquet(root), "id", "n") == sorted(whole, key=repr)
    assert held(spark, root) == [("2025-05-29", 0, 39), ("2025-05-30", 0, 39), ("None", 0, 24)]
    assert not list((tmp_path / "t_loads").glob("staging*"))


def test_a_later_day_of_a_loaded_window_is_loaded(spark, tmp_path, rows):
    root = str(tmp_path / "t")
    loads.load_window(frame(spark, (1, 0, "2025-05-29")), root, (0, 9))
    assert loads.load_window(frame(spark, (1, 0, "2025-05-29"), (1, 1, "2025-05-30")), root, (0, 9))["n_rows"] == 1
    assert rows(spark.read.parquet(root), "id", "n", "day") == [(1, 0, 29), (1, 1, 30)]


@pytest.mark.parametrize("step", ["record", "_publish", "rename"])
def test_a_load_that_dies_leaves_nothing_behind(spark, tmp_path, rows, step):
    root = str(tmp_path / "t")
    loads.load_window(source(spark, 0, 9), root, (0, 9))
    real, calls = getattr(loads, "record"), []

    def dies(*arguments):
        calls.append(arguments)
        if step != "record" or len(calls) == 2:
            raise RuntimeError("killed")
        real(*arguments)

    if step == "rename":
        # Only a part of the files arrives: the load dies when it has moved them, and one is taken away again.
        with mock.patch.object(loads, "record", lambda *a: dies(*a) if calls else (calls.append(a), real(*a))):
            with pytest.raises(RuntimeError):
                loads.load_window(source(spark, 5, 24), root, (5, 24))
        name = calls[0][0].first()["load"]
        moved = sorted((tmp_path / "t").rglob(f"load-{name}-*"))
        assert moved
        moved[0].unlink()
    else:
        with mock.patch.object(loads, step, dies), pytest.raises(RuntimeError):
            loads.load_window(source(spark, 5, 24), root, (5, 24))
    assert loads.interrupted(loads.entries(spark, root)).count() == 1
    assert loads.load_window(source(spark, 5, 24), root, (5, 24))["n_rows"] == 31
    whole = [(r.id, r.n) for r in source(spark, 0, 24).collect()]
    assert rows(spark.read.parquet(root), "id", "n") == sorted(whole, key=repr)
    assert loads.interrupted(loads.entries(spark, root)).isEmpty()


def test_whole_days_are_held(spark, tmp_path, rows):
    root = str(tmp_path / "t")
    write_by_situation_date(frame(spark, (1, 0, "2025-05-29"), (None, 0, None)), root)
    loads.record_whole_days(spark, root, [date(2025, 5, 29), None])
    more = frame(spark, (1, 0, "2025-05-29"), (2**62, 0, "2025-05-29"), (None, 0, None), (None, 1, "2025-05-30"))
    assert loads.load_window(more, root) == {"n_rows": 1, "n_undated": 0, "n_held": 3}
    assert loads.load_window(more, root)["n_rows"] == 0
    assert rows(spark.read.parquet(root), "n", "day") == [(0, 29), (0, None), (1, 30)]


def test_rows_outside_the_window_end_the_load(spark, tmp_path):
    for row in ((10, 0, "2025-05-29"), (None, 0, "2025-05-29")):
        with pytest.raises(Exception, match="outside the window"):
            loads.load_window(frame(spark, row), str(tmp_path / "t"), (0, 9))
    assert loads.load_window(frame(spark, (9, 0, "2025-05-29")), str(tmp_path / "t"), (0, 9))["n_rows"] == 1


def test_ranges_that_overlap_or_touch_are_one(spark):
    low, last = loads.EVERY_ID
    day = date(2025, 5, 29)
    parts = [(0, 9), (10, 19), (15, 17), (21, 30), (25, 40), (low, -5), (2**62, last), (last, last)]
    ledger = spark.createDataFrame([("a", loads.COMMITTED, day, *part, 1) for part in parts] + [("b", loads.STARTED, None, 20, 20, None)], loads.LEDGER)
    found = sorted((r.low, r.last) for r in loads.held_ranges(ledger).collect())
    assert found == [(low, -5), (0, 19), (21, 40), (2**62, last)]


def test_an_empty_window(spark, tmp_path):
    assert loads.load_window(frame(spark, (1, 0, None)).limit(0), str(tmp_path / "t"), (0, 9)) == {"n_rows": 0, "n_undated": 0, "n_held": 0}
    assert loads.interrupted(loads.entries(spark, str(tmp_path / "t"))).isEmpty()
