import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import retention as R

H = R.HOUR
KEPT = [127, 255, 352, 383, 415, 447, 448, 455, 463, 471, 472, 473, 474, 475, 476, 477, 478, 479, 480]


def history(spark, times):
    return spark.createDataFrame(list(enumerate(times)), "snapshot_id long, time_ms long")


def expected(times, now):
    best = {}
    for i, t in enumerate(times):
        age = max(now - t, 0)
        tier = next((k for k, x in enumerate(R.GRID) if age < x.max_age_ms), len(R.GRID) - 1)
        cell = (tier, t // R.GRID[tier].cell_ms)
        if cell not in best or (t, i) > best[cell]:
            best[cell] = (t, i)
    return sorted(i for _, i in best.values())


def test_sixty_days_of_three_hours(spark):
    rows = history(spark, [k * 3 * H for k in range(481)])
    plan = R.plan(rows, F.lit(480 * 3 * H))
    assert sorted(r.snapshot_id for r in plan.filter("keep").collect()) == KEPT
    assert plan.count() == 481


def test_survivors_agree_and_plan_is_idempotent(spark):
    rows = history(spark, [k * 3 * H for k in range(481)])
    now = F.lit(480 * 3 * H)
    kept = R.survivors(rows, now).select("snapshot_id", "time_ms")
    assert sorted(r.snapshot_id for r in kept.collect()) == KEPT
    assert R.plan(kept, now).filter("NOT keep").count() == 0


def test_future_and_ties(spark):
    now = 10**12
    rows = history(spark, [now + R.DAY, now, now])
    kept = sorted(r.snapshot_id for r in R.plan(rows, F.lit(now)).filter("keep").collect())
    assert kept == [0, 2]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5 * R.DAY, 70 * R.DAY), max_size=40))
def test_against_a_walk(spark, times):
    now = 60 * R.DAY
    rows = history(spark, times)
    assert sorted(r.snapshot_id for r in R.plan(rows, F.lit(now)).filter("keep").collect()) == expected(times, now)


def test_occupancy(spark):
    days = spark.createDataFrame([(1,), (60,), (365,)], "days long")
    assert [r.snapshots for r in R.occupancy(days).orderBy("days").collect()] == [8, 17, 36]


def test_bad_policies():
    for bad in ((), (R.Tier(10, 0),), (R.Tier(10, 1), R.Tier(5, 1))):
        with pytest.raises(ValueError):
            R.check(bad)
