"""The close rule as a stream: what a source's runs no longer show is closed.

Input are sightings (source, external id, run time) and the ends of runs (source,
run time, status), in one stream.  A run that ended well counts: a posting that it
did not show is missed once more, and after ``threshold`` such runs in a row it is
closed.  Runs that failed freeze their source, as the batch rule does.

State is kept by source and shard, a shard being a part of the source's ids, so
that a source with many postings is spread.  It holds the open postings only: a
closed one leaves, and one that shows up again begins anew.  The end of a run sets
a timer; the timer fires once the watermark has passed it, when every sighting of
that run is in, and moves the counters of all postings of the shard.  Nobody has to
send a row for what is absent.  A source without a run for ``horizon`` loses its
state altogether.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.ingest import advances

CLOSE_OUTPUT = "source_id long, external_id string, run_ms long, missed_runs int, closed boolean"
SHARDS = 16
#: Misses of a posting that no counted run has shown yet.
NEW = -1
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _told(source_id: int, rows: list[tuple[str, int, int, bool]]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["external_id", "run_ms", "missed_runs", "closed"]).astype({"external_id": "object", "run_ms": "int64", "missed_runs": "int32", "closed": "bool"})
    out.insert(0, "source_id", source_id)
    return out.astype({"source_id": "int64"})


class CloseRule(StatefulProcessor):
    """State of one shard: open postings with their misses and the runs not yet counted that showed them."""

    def __init__(self, threshold: int, horizon_ms: int):
        self.threshold, self.horizon_ms = threshold, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "external_id string, missed int, seen array<bigint>")
        self.runs = handle.getListState("runs", "run bigint")

    def _postings(self) -> dict[str, tuple[int, list[int]]]:
        return {external_id: (missed, list(seen)) for external_id, missed, seen in self.open.get()}

    def _keep(self, postings: dict[str, tuple[int, list[int]]]) -> None:
        if postings:
            self.open.put([(external_id, missed, seen) for external_id, (missed, seen) in postings.items()])
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        postings, ended, known = self._postings(), [], {run for (run,) in self.runs.get()}
        for batch in rows:
            for external_id, run, end in zip(batch["external_id"], batch["run_ms"], batch["ends"]):
                if end:
                    if run not in known:
                        known.add(run)
                        ended.append(int(run))
                else:
                    missed, seen = postings.get(external_id, (NEW, []))
                    if run not in seen:
                        postings[external_id] = (missed, [*seen, int(run)])
        for run in ended:
            self.runs.appendValue((run,))
            self.handle.registerTimer(run)
            self.handle.registerTimer(run + self.horizon_ms)
        self._keep(postings)
        yield _told(key[0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, told = expiredTimerInfo.getExpiryTimeInMs(), []
        waiting = sorted(run for (run,) in self.runs.get())
        postings = self._postings()
        for run in [run for run in waiting if run <= now]:
            for external_id, (missed, seen) in list(postings.items()):
                if missed == NEW and min(seen) > run:
                    continue  # first shown by a later run
                after = 0 if run in seen else max(missed, 0) + 1
                rest, closed = [x for x in seen if x > run], after >= self.threshold
                told.append((external_id, run, after, closed))
                if closed and not rest:
                    del postings[external_id]
                else:
                    postings[external_id] = (NEW if closed else after, rest)
        later = [run for run in waiting if run > now]
        if not later and not any(run <= now for run in waiting):
            # no run since the one whose horizon this is
            postings = {}
        self.runs.clear()
        if later:
            self.runs.put([(run,) for run in later])
        self._keep(postings)
        yield _told(key[0], told)

    def close(self) -> None:
        pass


def close_stream(sightings: DataFrame, threshold: int = 2, shards: int = SHARDS, delay: str = "0 seconds", horizon_days: int = 60) -> DataFrame:
    """source_id, external_id, run, missed_runs, closed for each counted run that showed or missed an open posting.

    ``sightings``: source_id, external_id, run_at, status.  Rows with an external id are
    sightings; those without end a run, and count if the status is one that advances.
    ``delay`` is how long after a run's end its sightings may still come in.
    """
    spark = sightings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    ends = F.col("external_id").isNull()
    rows = sightings.filter(~ends | advances(F.col("status"))).select(F.col("source_id").cast("long").alias("source_id"), F.col("external_id").cast("string").alias("external_id"), F.col("run_at").cast("timestamp").alias("run_at"), ends.alias("ends"))
    own = F.pmod(F.xxhash64("external_id"), F.lit(shards)).cast("int")
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    dealt = rows.withColumn("shard", F.explode(F.when(F.col("ends"), every).otherwise(F.array(own)))).withColumn("run_ms", F.unix_millis("run_at"))
    grouped = dealt.withWatermark("run_at", delay).groupBy("source_id", "shard")
    told = grouped.transformWithStateInPandas(CloseRule(threshold, horizon_days * 86_400_000), CLOSE_OUTPUT, "update", "eventTime")
    return told.select("source_id", "external_id", F.timestamp_millis("run_ms").alias("run"), "missed_runs", "closed")
