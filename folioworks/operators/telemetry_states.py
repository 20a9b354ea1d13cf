"""Telemetry aggregated by hour into states that merge: what a window of any length needs is read from a row for each
hour, not from the requests.

Counts and sums are exact. Percentiles come from KLL sketches and distinct counts from HLL sketches, both of fixed size
whatever the hour holds, made and merged by Spark's own aggregates: a KLL sketch of KLL_K gives ranks to within RANK_ERROR
of the window's rows (at 99 %), an HLL sketch of 2 ** HLL_K registers counts to within some COUNT_ERROR of the distinct values.
The exact overviews of operators.telemetry stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.operators.telemetry import tally, when_ok

KLL_K, HLL_K = 400, 12
RANK_ERROR, COUNT_ERROR = 0.01, 0.05
STATUSES = ("ok", "error", "in_progress")


def hourly_states(rows: DataFrame, ts: str, *, durations: Sequence[str] = (), sums: Sequence[str] = (), distinct: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """rows (ts, status, ...) -> a row for each hour (and value of by): rows, a count for each status, the sum and the sketch of
    ok durations with their number, the sum over all rows and over ok ones of each of sums, a sketch of each of distinct. Rows without a time are
    left out."""
    aggregates = [F.count(F.lit(1)).alias("rows"), *(tally(F.col("status") == s).alias(s) for s in STATUSES)]
    for c in durations:
        own = when_ok(c).cast("double")
        aggregates += [F.count(own).alias(f"{c}_n"), F.sum(own).alias(f"{c}_sum"), F.kll_sketch_agg_double(own, KLL_K).alias(f"{c}_kll")]
    for c in sums:
        aggregates += [F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum"), F.coalesce(F.sum(when_ok(c)), F.lit(0)).alias(f"{c}_ok_sum")]
    aggregates += [F.hll_sketch_agg(c, HLL_K).alias(f"{c}_hll") for c in distinct]
    return rows.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("hour", ts).alias("hour"), *by).agg(*aggregates)


def write_states(states: DataFrame, path: str) -> None:
    """Write states by month; months that are written again replace their old rows only."""
    months = states.withColumn("month", F.to_date(F.date_trunc("month", "hour"))).repartition("month")
    months.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def merged_states(states: DataFrame, since: Column, until: Column, *, by: Sequence[str] = (), shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """The states of the hours from since to before until, merged: counts, sums, means and percentiles (p50_..., p95_...) of
    ok durations, distinct counts."""
    names = states.columns
    durations = [c[:-4] for c in names if c.endswith("_kll")]
    distinct = [c[:-4] for c in names if c.endswith("_hll")]
    plain = ["rows", *STATUSES, *(c for c in names if c.endswith(("_sum", "_n")))]
    some = states.where((F.col("hour") >= F.date_trunc("hour", since)) & (F.col("hour") < F.date_trunc("hour", until)))
    x = some.groupBy(*by).agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in plain), *(F.kll_merge_agg_double(f"{c}_kll").alias(f"{c}_kll") for c in durations), *(F.hll_union_agg(f"{c}_hll").alias(f"{c}_hll") for c in distinct)
    )
    means = {f"{c}_avg": F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sum") / F.col(f"{c}_n")) for c in durations}
    # a sketch of nothing has no quantiles
    ranks = {f"{c}_p{round(100 * s)}": F.when(F.col(f"{c}_n") > 0, F.kll_sketch_get_quantile_double(f"{c}_kll", F.lit(s))) for c in durations for s in shares}
    counts = {f"{c}_distinct": F.coalesce(F.hll_sketch_estimate(f"{c}_hll"), F.lit(0)) for c in distinct}
    return x.withColumns(means | ranks | counts).drop(*(f"{c}_kll" for c in durations), *(f"{c}_hll" for c in distinct))
