"""Monitor blocks of a line stream, kept open from batch to batch.

A run's log is a sequence of blocks, each begun by a time-step number.  The state of a run is
its open block: the number and, per listed metric, the last value and its place.  Every batch
hands out the blocks that it closed and, as the block may stay open for long, what is known of
the open one; rows of a block that was cut over batches are one block for ``whole_blocks``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridspark.operators.monitor import BLOCK_METRIC

IDLE_MS = 6 * 3600 * 1000
OUT_ROWS = 10_000  #: rows put out at a time


def place(*parts) -> Column:
    """Text that sorts as the given parts do; numbers are padded."""
    return F.concat_ws("\u0001", *[F.lpad(F.col(p).cast("string"), 20, "0") if n else F.col(p).cast("string") for p, n in parts])


def _in_order(batches: Iterator[pd.DataFrame], kept: list[str]) -> pa.Table:
    """Rows of the kept metrics with a value, by place; metrics as their numbers, places as Arrow text: logs are long."""
    number = {m: n for n, m in enumerate(kept)}
    parts = [pa.table({"metric": pa.array([], pa.int64()), "value": pa.array([], pa.float64()), "ord": pa.array([], pa.large_string())})]
    for batch in batches:
        batch = batch[batch["metric"].isin(kept) & batch["value"].notna()]
        parts.append(pa.table({"metric": pa.array(batch["metric"].map(number).astype("int64")), "value": pa.array(batch["value"].astype("float64")),
                               "ord": pa.array(batch["ord"], pa.large_string())}, schema=parts[0].schema))
    rows = pa.concat_tables(parts).combine_chunks()
    return rows.take(pc.sort_indices(rows, [("ord", "ascending")])).combine_chunks()


def stream_blocks(metric_rows: DataFrame, names: list[str], idle_ms: int = IDLE_MS) -> DataFrame:
    """``run, block, metric, value, ord`` of closed and open blocks, for update output.

    ``metric_rows`` is a stream of ``run, metric, value`` and ``ord``, a text that sorts by place in
    the run's log; a run's lines arrive in that order over batches, in any order within one.  A
    block's number gives a row too (metric ``BLOCK_METRIC``), so blocks without listed metrics are
    known.  A run that is silent for ``idle_ms`` loses its state: its last block was handed out
    before, and lines that follow have no block until the next number.
    """
    kept = sorted({*names, BLOCK_METRIC})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _in_order(batches, kept)  # a batch's lines of one run
        block, held = (None, {}) if not state.exists else (state.get[0], json.loads(state.get[1]))
        metric, value = rows["metric"].to_numpy(), rows["value"].to_numpy()
        begins = metric == kept.index(BLOCK_METRIC)
        nth, starts = np.cumsum(begins), np.flatnonzero(begins)
        last = len(nth) - 1 - np.unique((nth * len(kept) + metric)[::-1], return_index=True)[1]  # of each block and metric, by block
        there = lambda at: {kept[metric[n]]: [float(value[n]), rows["ord"][n].as_py()] for n in at}
        before, own = last[nth[last] == 0], last[nth[last] > 0]
        first = []
        if len(before):
            held |= there(before)
            first = [] if block is None else [(key[0], block, m, v, o) for m, (v, o) in held.items()]
        if len(starts):
            block, held = float(value[starts[-1]]), there(own[nth[own] == len(starts)])
        if block is not None:
            state.update((block, json.dumps(held)))
            state.setTimeoutDuration(idle_ms)
        if first:
            yield pd.DataFrame(first, columns=["run", "block", "metric", "value", "ord"])
        for a in range(0, len(own), OUT_ROWS):
            at = own[a : a + OUT_ROWS]
            yield pd.DataFrame({"run": key[0], "block": value[starts[nth[at] - 1]], "metric": np.array(kept, object)[metric[at]], "value": value[at],
                                "ord": rows["ord"].take(pa.array(at)).to_pandas()})

    return metric_rows.select("run", "metric", "value", "ord").groupBy("run").applyInPandasWithState(
        step, "run string, block double, metric string, value double, ord string", "block double, held string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def whole_blocks(updates: DataFrame, names: list[str]) -> DataFrame:
    """One row per block from the rows of all batches, listed metrics as columns."""
    return updates.groupBy("run", "block").agg(*[
        F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, F.col("ord"))).alias(m) for m in names])
