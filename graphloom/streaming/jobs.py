"""The unbounded forms of the operators, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import terms as t
from ..operators.frontier import LOWEST
from ..operators.stats import key as stat_key
from ..sources.store import ParquetStore


def scores(log: DataFrame, key: str = "urlid", order: str = "ts", ok: str = "ok") -> DataFrame:
    """(key, score, working) after each batch of a visit log, for the keys in it.

    State is one small number for each key.  Within a batch visits are taken in their order; batches follow
    each other as they come."""

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        score = state.get[0] if state.exists else 0
        for good in pd.concat(list(batches)).sort_values([order, "__tie"], kind="stable")["__ok"]:
            score = min(0, score + 1) if good else max(score - 1, LOWEST)
        state.update((score,))
        yield pd.DataFrame({key: [name[0]], "score": [score], "working": [score > LOWEST]})

    kind = dict(log.dtypes)[key]
    tie = F.col("event_id") if "event_id" in log.columns else F.lit(0)
    rows = log.select(key, order, F.col(ok).alias("__ok"), tie.alias("__tie"))
    return rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, score int, working boolean", "score int", "update", GroupStateTimeout.NoTimeout)


def into_store(statements: DataFrame, store: ParquetStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Adds each batch's statements to the store, those that it has already left out.  With ``once`` it stops
    when all that is there has been read (the graceful end of a pipe)."""
    writer = statements.writeStream.foreachBatch(lambda batch, _: store.add(batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by event-time windows, with rows later than the watermark left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("number"))


def distinct_statements(statements: DataFrame) -> DataFrame:
    """Each statement once over the whole stream."""
    return statements.dropDuplicates(t.KEY)


class StatsListener(StreamingQueryListener):
    """Publishes observed metrics and row counts of running queries in a context, and calls back after each."""

    def __init__(self, context: dict, group: str = "stream", then: Callable[[dict], None] | None = None):
        self.context, self.group, self.then = context, group, then

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        progress = event.progress
        name = stat_key(self.group, "rows")
        self.context[name] = self.context.get(name, 0) + progress.numInputRows
        for metrics in progress.observedMetrics.values():
            for k, v in metrics.asDict().items():
                self.context[stat_key(self.group, k)] = v
        if self.then:
            self.then(self.context)


def status(query: StreamingQuery | None) -> str:
    """NOT_STARTED, RUNNING or STOPPED (stop() returns only when what has arrived is worked off)."""
    if query is None:
        return "NOT_STARTED"
    if not query.isActive:
        return "STOPPED"
    return "RUNNING"


def stop(query: StreamingQuery) -> None:
    """Works off what has arrived, then ends."""
    query.processAllAvailable()
    query.stop()


def kill(query: StreamingQuery) -> None:
    query.stop()
