"""Running statistics: functions that may be plugged in, their publication and the writer."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

PREFIX = "stats"
#: name -> aggregate of a value column
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda v: F.coalesce(F.sum(v), F.lit(0)).cast("bigint"),
    "count": lambda v: F.count(F.lit(1)),
    "average": lambda v: F.coalesce(F.avg(v), F.lit(0.0)),
}


def register(name: str, aggregate: Callable[[Column], Column]) -> None:
    """Adds a statistic: any aggregate expression, or a grouped-aggregate Pandas UDF."""
    FUNCTIONS[name] = aggregate


def interval(ts_ms: Column) -> Column:
    """Mean gap in ms between updates that follow each other: (last - first) / (number - 1); 0 for fewer than two."""
    return F.coalesce(F.try_divide((F.max(ts_ms) - F.min(ts_ms)).cast("double"), F.count(ts_ms) - 1), F.lit(0.0))


FUNCTIONS["interval"] = interval


def by_group(updates: DataFrame, function: str, value: str = "value", group: str = "group", stat: str = "stat") -> DataFrame:
    """(group, stat, value) of updates; a null or empty group is ``default``."""
    named = F.when(F.coalesce(F.col(group), F.lit("")) == "", "default").otherwise(F.col(group))
    return updates.groupBy(named.alias("group"), F.col(stat).alias("stat")).agg(FUNCTIONS[function](F.col(value)).cast("double").alias("value"))


def running(updates: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Every update with the sum, the mean and the number of updates that its key has had so far."""
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return updates.withColumns({"running_sum": F.sum(value).over(so_far), "running_average": F.avg(value).over(so_far), "running_count": F.count(F.lit(1)).over(so_far)})


def key(group: str | None, stat: str) -> str:
    return f"{PREFIX}.{group or 'default'}.{stat}"


class Stats:
    """Publishes metrics of a DataFrame's rows while they pass: ``stats.<group>.<name>`` in a context (a dict)."""

    def __init__(self, context: dict, group: str | None = None):
        self.context, self.group, self.waiting = context, group or "default", []

    def watch(self, df: DataFrame, **metrics: Column) -> DataFrame:
        """df, whose metrics appear in the context at collect() once an action has run."""
        seen = Observation(f"{self.group}-{len(self.waiting)}")
        self.waiting.append((seen, list(metrics)))
        return df.observe(seen, *[m.alias(n) for n, m in metrics.items()])

    def collect(self) -> dict:
        for seen, _ in self.waiting:
            for name, value in seen.get.items():
                self.context[key(self.group, name)] = value
        self.waiting.clear()
        return self.context


class StatsReader:
    """Published values by full name or by (group, stat); None where there is no number."""

    def __init__(self, context: dict):
        self.context = context

    def _value(self, name: str, stat: str | None):
        value = self.context.get(name if stat is None else key(name, stat))
        return value if isinstance(value, int | float) and not isinstance(value, bool) else None

    def get_double(self, name: str, stat: str | None = None) -> float | None:
        value = self._value(name, stat)
        return None if value is None else float(value)

    def get_long(self, name: str, stat: str | None = None) -> int | None:
        value = self._value(name, stat)
        return None if value is None else int(value)


def lines(context: dict, prefixes: list[str] = ()) -> list[str]:
    """``key=value``, sorted, for keys with one of the prefixes (all without any)."""
    return [f"{k}={v}" for k, v in sorted(context.items()) if not prefixes or k.startswith(tuple(prefixes))]


def write(context: dict, target: str = "stdout", prefixes: list[str] = ()) -> None:
    """The lines to a file, or to ``stdout`` or ``stderr``."""
    text = "".join(line + "\n" for line in lines(context, prefixes))
    if target in ("stdout", "stderr"):
        getattr(sys, target).write(text)
    else:
        with open(target, "w", encoding="utf-8") as out:
            out.write(text)


def frame(spark: SparkSession, context: dict) -> DataFrame:
    """(group, stat, value) of the published numbers."""
    rows = [(*k.split(".", 2)[1:], float(v)) for k, v in context.items() if k.startswith(PREFIX + ".") and isinstance(v, int | float)]
    return spark.createDataFrame(rows, "`group` string, stat string, value double")
