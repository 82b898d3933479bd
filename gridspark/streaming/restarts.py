"""Overlapping restart segments on a stream: the later segment's records stay.

A restart repeats the last stretch of model time before it.  Which segment wins is decided on
one row per record, held per run until the run is past the overlap: model time differs by run,
so the state keeps each run's own clock, where a watermark would be that of the fastest run.
Decided records are then read from where their cells lie.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridspark.sources.shared import fresh_path
from gridspark.streaming.live import only_with_data

OVERLAP_SECONDS = 180.0  #: fixed value: model time that a restart repeats
IDLE_MS = 6 * 3600 * 1000

_OUT = "run string, iter bigint, segment int"


def winning_records(records: DataFrame, overlap: float = OVERLAP_SECONDS, idle_ms: int = IDLE_MS) -> DataFrame:
    """``run, iter, segment`` of each record, once, when no later segment can hold it any more.

    ``records`` is a stream of ``run, iter, time_s, segment``, a segment's rows in any order within
    a batch.  A record is held until its run reaches ``overlap`` seconds beyond it.  A row
    without ``iter`` says that the run has ended and releases what is held; so does a silence of
    ``idle_ms``.  Repeats of a decided record are dropped.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, newest, done = ({}, None, None) if not state.exists else (json.loads(state.get[0]), state.get[1], state.get[2])
        ended = state.hasTimedOut
        for rows in batches if not ended else ():
            ended |= bool(rows["iter"].isna().any())
            for r in rows.dropna(subset=["iter"]).itertuples():
                newest = r.time_s if newest is None else max(newest, r.time_s)
                old = held.get(str(int(r.iter)))
                if (done is None or r.time_s > done) and (old is None or r.segment > old[1]):
                    held[str(int(r.iter))] = [r.time_s, int(r.segment)]
        ready = sorted((int(i), t, s) for i, (t, s) in held.items() if ended or newest - t >= overlap)
        for i, t, _ in ready:
            del held[str(i)]
            done = t if done is None else max(done, t)
        state.update((json.dumps(held), newest, done))
        if held:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], i, s) for i, _, s in ready], columns=["run", "iter", "segment"])

    return records.select("run", "iter", "time_s", "segment").groupBy("run").applyInPandasWithState(
        step, _OUT, "held string, newest double, done double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def decided_cells(winners: DataFrame, cells: DataFrame, label: str) -> DataFrame:
    """Cells of all records that the stream ``winners`` decides, read once each.

    Each batch joins its few records with ``cells`` (``run, iter, segment`` and more) at rest, so
    only their files are read, and lands in a folder of its own, which a replay overwrites.
    """
    spark = winners.sparkSession
    path, checkpoint = fresh_path(spark, label), fresh_path(spark, f"{label}-checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        cells.join(batch, ["run", "iter", "segment"], "left_semi").write.mode("overwrite").parquet(f"{path}/batch={number}")

    with only_with_data(spark):
        query = winners.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(cells.schema.add("batch", "long")).parquet(path).drop("batch")
