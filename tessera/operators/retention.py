"""Which snapshots an age-tiered grid keeps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000
FOREVER = 2**63 - 1


@dataclass(frozen=True)
class Tier:
    """Snapshots younger than max_age_ms keep one for each cell of cell_ms."""

    max_age_ms: int
    cell_ms: int


GRID = (Tier(DAY, 3 * HOUR), Tier(4 * DAY, DAY), Tier(16 * DAY, 4 * DAY), Tier(FOREVER, 16 * DAY))


def check(policy: tuple[Tier, ...]) -> None:
    """A policy has tiers, no empty cells and ages that don't fall."""
    if not policy:
        raise ValueError("a retention policy needs a tier")
    if any(t.cell_ms <= 0 for t in policy):
        raise ValueError("a cell must last")
    if any(a.max_age_ms > b.max_age_ms for a, b in zip(policy, policy[1:], strict=False)):
        raise ValueError("tiers must be ordered by age")


def tiers(spark: SparkSession, policy: tuple[Tier, ...] = GRID) -> DataFrame:
    """The policy as rows: tier, max_age_ms, cell_ms."""
    return spark.createDataFrame([(i, t.max_age_ms, t.cell_ms) for i, t in enumerate(policy)], "tier int, max_age_ms long, cell_ms long")


def _cased(tier: Column, policy: tuple[Tier, ...], value) -> Column:
    out = F.when(tier == 0, value(policy[0]))
    for i, t in enumerate(policy[1:], 1):
        out = out.when(tier == i, value(t))
    return out


def tier_of(age_ms: Column, policy: tuple[Tier, ...] = GRID) -> Column:
    """The first tier whose age is above the snapshot's, else the last."""
    out = None
    for i, t in enumerate(policy[:-1]):
        test = age_ms < F.lit(t.max_age_ms)
        out = F.when(test, i) if out is None else out.when(test, i)
    last = F.lit(len(policy) - 1)
    return last if out is None else out.otherwise(last)


def with_cells(snapshots: DataFrame, now_ms: Column, policy: tuple[Tier, ...] = GRID) -> DataFrame:
    """Adds tier and cell. A future snapshot has age 0 but the cell of its own time; cells align to the epoch."""
    check(policy)
    placed = snapshots.withColumn("tier", tier_of(F.greatest(now_ms - F.col("time_ms"), F.lit(0)), policy).cast("int"))
    width = F.greatest(_cased(F.col("tier"), policy, lambda t: F.lit(t.cell_ms)), F.lit(1))
    return placed.withColumn("cell", ((F.col("time_ms") - F.pmod("time_ms", width)) / width).cast("long"))


def plan(snapshots: DataFrame, now_ms: Column, policy: tuple[Tier, ...] = GRID, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds tier, cell and keep: the newest of each cell, of equal times the largest id. snapshots: snapshot_id, time_ms, ..."""
    newest = W.partitionBy(*by, "tier", "cell").orderBy(F.desc("time_ms"), F.desc("snapshot_id"))
    return with_cells(snapshots, now_ms, policy).withColumn("keep", F.row_number().over(newest) == 1)


def survivors(snapshots: DataFrame, now_ms: Column, policy: tuple[Tier, ...] = GRID) -> DataFrame:
    """Only the kept snapshots, by an aggregation that combines before it shuffles."""
    best = F.max(F.struct("time_ms", "snapshot_id")).alias("best")
    return with_cells(snapshots, now_ms, policy).groupBy("tier", "cell").agg(best).select("tier", "cell", "best.snapshot_id", "best.time_ms")


def occupancy(horizons: DataFrame, policy: tuple[Tier, ...] = GRID) -> DataFrame:
    """How many snapshots the grid holds after so many days. horizons: days."""
    start, total = 0, F.lit(0).cast("long")
    end_of = F.col("days") * 24
    for t in policy:
        stop = F.least(F.lit(min(t.max_age_ms // HOUR, 2**40)), end_of)
        total = total + F.when(stop > start, F.ceil((stop - start) / F.lit(t.cell_ms // HOUR))).otherwise(0)
        start = t.max_age_ms // HOUR
    return horizons.withColumn("snapshots", total.cast("long"))
