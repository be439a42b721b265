"""Run counters, latency, elapsed time and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.schemas import COUNTERS
from orbweave.session import durable

#: Latency samples kept per counter.
SAMPLES = 256


def run_counters(events: DataFrame, outcome: str = "outcome", by: tuple[str, ...] = ("catalog_id", "version")) -> DataFrame:
    """One column per counter from rows tagged with an outcome (a counter's name)."""
    return events.groupBy(*by).agg(*(F.count_if(F.col(outcome) == name).alias(name.lower()) for name in COUNTERS))


def mean_latency(samples: DataFrame, kind: str, order: list, value: str) -> DataFrame:
    """Mean of the positive ones among the last 256 samples per kind; 0 where there is none."""
    last = samples.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).filter(F.col("_n") <= SAMPLES)
    return last.groupBy(kind).agg(F.coalesce(F.avg(F.when(F.col(value) > 0, F.col(value))), F.lit(0.0)).alias("mean_latency"))


def elapsed_ms(start: Column, end: Column, now: Column, completed: Column) -> Column:
    """0 before a start; up to now while running; up to `end` once completed."""
    return F.when(start.isNull() | (start <= 0), F.lit(0).cast("bigint")).when(completed, end - start).otherwise(now - start)


def elapsed_text(ms: Column) -> Column:
    """Hours, minutes and seconds as text."""
    s = F.expr("0") if ms is None else F.floor(ms / 1000).cast("bigint")
    hours, minutes = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.format_string("%dH %dm %ds", hours, minutes, F.pmod(s, F.lit(60)))


def idle(last: Column, now: Column, delay_ms: int) -> Column:
    """Whether nothing happened for longer than a delay."""
    return (now - last) > delay_ms


def over_budget(counter: Column, most: Column) -> Column:
    """A budget is exceeded strictly above its maximum."""
    return counter > most


def first_over_budget(events: DataFrame, order: list[str], most: int, where: Column | None = None) -> DataFrame:
    """The event at which a running count first exceeds a budget, over a total order.

    The planner keeps the first `most` + 1 events of each task and merges those, so nothing is sorted as a whole.
    """
    chosen = events if where is None else events.filter(where)
    return chosen.orderBy(*order).offset(most).limit(1)


def running_total(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str, name: str = "total") -> DataFrame:
    """`rows` with the sum of `value` up to and including each row in its group's order.

    Rows are cut into ranges of (by, order) and written, ranges are summed, and only inside a range rows are counted one by one; so
    one large group is many tasks.
    """
    ranged = durable(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.lit(True)
    for c in (*by, "_range"):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    joined = ranged.withColumn("_inside", F.sum(value).over(inside)).alias("r").join(offsets.alias("o"), same)
    return joined.select("r.*", (F.col("_inside") + F.col("_before")).alias(name)).drop("_range", "_inside")
