"""Live captures: the fold of each flow as keyed state of a streaming query, and deltas for readers.

The state of a flow is its pickled Flow; it ends when the flow was idle for `idle_ms` of processing time.  Without idle
flows, a finished stream gives the rows of the batch fold.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.packets import decode, with_flow
from ..operators.streams import INPUT, ROWS, Flow

IDLE_MS = 120_000
_COLUMNS = [x.split()[0] for x in ROWS.split(", ")]
_TEXT = [x.split()[0] for x in ROWS.split(", ") if x.split()[1] in ("string", "binary")]


def live_fold(packets: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Tagged rows of a stream of packets, as operators.streams.fold gives them for a table."""

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("packet_no")
        first = rows.iloc[0]
        flow = pickle.loads(state.get[0]) if state.exists else Flow(key[0], first.protocol, int(first.a_port), int(first.b_port))
        out = []
        for r in rows.itertuples(index=False):
            whole = lambda v: None if v is None or pd.isna(v) else int(v)
            out += flow.push(int(r.packet_no), r.direction == "b_to_a", whole(r.seq), whole(r.flags), r.payload)
        state.update((pickle.dumps(flow),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([[r.get(c) for c in _COLUMNS] for r in out], columns=_COLUMNS).astype({c: object for c in _TEXT})

    keyed = with_flow(decode(packets)).select(*[F.col(c) for c in INPUT[:-2]], F.col("a.port").alias("a_port"), F.col("b.port").alias("b_port"))
    return keyed.groupBy("stream_id_hex").applyInPandasWithState(run, ROWS.replace(", ", ","), "flow binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_deltas(rows: DataFrame, path: str, checkpoint: str):
    """Append rows to a table with a rising cursor: the batch's number and the place in it.  Returns the started query."""

    def write(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("cursor", F.lit(number << 48) + F.monotonically_increasing_id())
        numbered.write.mode("append").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
