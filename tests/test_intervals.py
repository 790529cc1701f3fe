"""Interval algebra against membership second by second, and its rules at the edges."""

import random

import pytest

from loadgrid.operators import intervals as iv, running as rn, windows as wn
from loadgrid.operators.tables import written

SPAN = 120


def frame(spark, rows):
    return spark.createDataFrame(rows, "location_id long, start long, stop long")


def seconds(rows):
    return {(loc, t) for loc, a, b in rows for t in range(a, b)}


def ranges(points):
    """Maximal runs of points per location."""
    out = []
    for loc, t in sorted(points):
        if out and out[-1][0] == loc and out[-1][2] == t:
            out[-1][2] = t + 1
        else:
            out.append([loc, t, t + 1])
    return sorted(map(tuple, out))


def got(df):
    return sorted(tuple(r) for r in df.select("location_id", "start", "stop").collect())


def draw(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(3), a := rng.randrange(SPAN), a + rng.randrange(-3, 15)) for _ in range(n)]


@pytest.mark.parametrize(("n", "seed"), [(0, 1), (1, 2), (10, 3), (80, 4)])
def test_set_operations(spark, n, seed):
    a, b = draw(seed, n), draw(seed + 100, n)
    x, y = frame(spark, a), frame(spark, b)
    p, q = seconds(a), seconds(b)
    assert got(iv.clean(x)) == ranges(p)
    assert got(iv.union(x, y)) == ranges(p | q)
    assert got(iv.subtract(x, y)) == ranges(p - q)
    assert got(iv.intersect(x, y)) == ranges(p & q)
    assert got(iv.intersect(x, y)) == got(iv.subtract(x, iv.subtract(x, y)))
    assert got(iv.subtract(iv.clip(x, 20, 60), y)) == ranges({s for s in p - q if 20 <= s[1] < 60})


def test_inverse_has_open_ends(spark):
    found = got(iv.invert(frame(spark, [(1, 5, 10), (1, 10, 12), (1, 20, 30)])))
    assert found == [(1, -iv.FAR, 5), (1, 12, 20), (1, 30, iv.FAR)]


def test_nested_and_adjacent_merge(spark):
    rows = [(1, 0, 10), (1, 1, 2), (1, 3, 4), (1, 5, 6), (1, 10, 12), (1, 14, 14), (1, 20, 15)]
    assert got(iv.clean(frame(spark, rows))) == [(1, 0, 12)]


def test_window_starts_leave_the_stop_out(spark):
    a = frame(spark, [(1, 3, 20), (2, 1, 10)])
    assert sorted(tuple(r) for r in iv.window_starts(a, 5).collect()) == [(1, 5), (1, 10), (1, 15), (2, 5)]
    assert sorted(tuple(r) for r in iv.all_points(a, 5).collect()) == [(1, 5), (1, 10), (1, 15), (1, 20), (2, 5), (2, 10)]
    assert {tuple(r) for r in iv.count_starts(a, 5).collect()} == {(1, 3), (2, 1)}


def test_coverage_is_near_the_exact_one(spark):
    rows = [(1, 0, 400), (1, 500, 900), (1, 1400, 2000)]
    data = seconds(rows)
    length, least, res = 500, 300, 10
    inside = seconds(got(iv.with_coverage(frame(spark, rows), length, least, res)))
    for t in range(-500, 2000):
        n = sum((1, t + k) in data for k in range(length))
        if n >= least + 2 * res:
            assert (1, t) in inside
        if n < least - 3 * res and (1, t) not in seconds([(a, b, c - least) for a, b, c in rows]):
            assert (1, t) not in inside


def test_locate_matches_a_scan(spark):
    a = [(1, 0, 10), (1, 15, 20), (2, 5, 6)]
    points = [(loc, t) for loc in (1, 2, 3) for t in range(-2, 25)]
    df = iv.locate(spark.createDataFrame(points, "location_id long, t long"), frame(spark, a))
    found = {(r.location_id, r.t): r.hit_start for r in df.collect()}
    assert found == {(loc, t): next((s for x, s, e in a if x == loc and s <= t < e), None) for loc, t in points}


def test_draws_are_inside_and_independent_of_partitions(spark):
    a = frame(spark, [(1, 0, 1000), (2, 300, 400), (2, 500, 4000)])
    rows = sorted(tuple(r) for r in iv.sample_points(a, 500, 10, 3).collect())
    assert len(rows) == 500
    data = seconds(got(a))
    assert all((loc, t) in data and t % 10 == 0 for _, loc, t in rows)
    assert rows == sorted(tuple(r) for r in iv.sample_points(a.repartition(7), 500, 10, 3).collect())
    assert 0.6 < sum(loc == 2 for _, loc, _ in rows) / 500 < 0.95


def test_overlap_guard_names_the_location(spark):
    with pytest.raises(Exception, match="location 7"):
        iv.checked_disjoint(frame(spark, [(7, 0, 10), (7, 5, 6)])).collect()
    assert iv.overlaps(frame(spark, [(7, 0, 10), (7, 2, 3), (7, 9, 12)])).count() == 2


def plain_coverage(data, length, least, low, high):
    """Points of [low, high) from which `length` seconds hold at least `least` of data, by location."""
    return {(loc, x) for loc in {d[0] for d in data} for x in range(low, high) if sum((loc, x + k) in data for k in range(length)) >= least}


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize(("length", "least"), [(20, 9), (50, 50), (7, 1), (90, 30)])
def test_exact_coverage(spark, monkeypatch, split, length, least):
    if split:
        monkeypatch.setattr(rn, "ONE_TASK", 0)
        monkeypatch.setattr(iv, "BUCKET", 11)
    rows = draw(length, 25)
    a = frame(spark, rows)
    want = plain_coverage(seconds(rows), length, least, -length - 5, SPAN + 20)
    assert got(iv.covered_starts(a, length, least)) == ranges(want)


def test_stepped_coverage_is_within_its_resolution_of_the_exact_one(spark):
    rows = [(1, 0, 400), (1, 500, 900), (1, 1400, 2000), (2, 100, 130)]
    a = frame(spark, rows)
    exact, near = (seconds(got(x)) for x in (iv.covered_starts(a, 500, 300), iv.with_coverage(a, 500, 300, 10)))
    sure = plain_coverage(seconds(rows), 500, 320, -500, 2000)
    assert sure <= exact and sure <= near
    assert near - exact <= plain_coverage(seconds(rows), 500, 275, -500, 2020)


@pytest.mark.parametrize("split", [False, True])
def test_one_sweep_for_many_sets_and_parts(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(rn, "ONE_TASK", 0)
        monkeypatch.setattr(iv, "BUCKET", 13)
    sets = [draw(k, 40) for k in range(3)]
    frames = [frame(spark, x) for x in sets]
    p, q, r = map(seconds, sets)
    assert got(iv.sweep(frames, lambda x, y, z: ((x > 0) | (y > 0)) & (z == 0))) == ranges((p | q) - r)
    parts = iv.sweep_parts(frames, {"some": lambda x, y, z: (x > 0) & (y > 0), "two": lambda x, y, z: x + y + z >= 2, "none": lambda x, y, z: x < 0})
    for part, want in (("some", p & q), ("two", None), ("none", set())):
        if want is None:
            want = {(loc, t) for loc in range(3) for t in range(SPAN + 20) if sum(sum(a <= t < b for i, a, b in x if i == loc) for x in sets) >= 2}
        assert got(parts.where(f"part = '{part}'")) == ranges(want)
    assert got(iv.common([[frames[0], frames[1]], [frames[2]]])) == ranges((p | q) & r)
    assert got(iv.bridged(frames[0], 4)) == got(iv.union(frames[0], iv.invert(frames[0]).where("stop - start <= 4")))
    clean = iv.clean(frames[0])
    for tidy, whole in ((iv.add_duration(clean, -3, tidy=True), iv.add_duration(clean, -3)), (iv.align(clean, 5, tidy=True), iv.align(clean, 5)), (iv.align_start(clean, 6, 2, tidy=True), iv.align_start(clean, 6, 2)), (iv.from_date(clean, 40, tidy=True), iv.from_date(clean, 40))):
        assert got(tidy) == got(whole)
    readable = {(loc, t) for loc, t in p if all((loc, t + k) in p for k in range(8))}
    assert seconds(got(iv.indexable(frames[0], frame(spark, []), 5, 3))) <= {(loc, t) for loc, t in p if (loc, t + 7) in p}
    assert readable <= {(loc, t) for loc, t in p}


def test_dated_split_is_the_general_one_within_eight_shuffles(spark, monkeypatch):
    a = written(frame(spark, draw(5, 60)))
    held = spark.createDataFrame([(1,)], "location_id long")
    for size in (0, rn.ONE_TASK):
        monkeypatch.setattr(rn, "ONE_TASK", size)
        found = wn.dated_split_windows(a, held, 30, 4, 60, 90, 3)
        benchmark, rest = wn.benchmark_split(a, held, 30, 4)
        want = wn.split_windows(rest, iv.clip(rest, 60, 90), benchmark, 3)
        rows = lambda df: sorted(tuple(r) for r in df.select("part", "location_id", "t").collect())
        assert rows(found) == rows(want) and {r[0] for r in rows(found)} == {"train", "validation", "benchmark"}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= (8 if not size else 4)
