"""The admission limiter on a live arrival stream: one list of admitted times per identity."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from cartonscope import constants as K
from cartonscope.operators.admission import MICROS, decide, identity
from cartonscope.session import ship

OUTPUT = "arrival_id bigint, identity string, admitted boolean, retry_after bigint"


class Gate(StatefulProcessor):
    """Keeps at most ``limit`` timestamps per identity, oldest first. A micro-batch's arrivals of one identity
    are taken in time order (two numbers each, bounded by the source's own limits); across batches, arrival
    order decides. An identity not seen for ``keep_ms`` is forgotten, where that is given."""

    def __init__(self, window_seconds: int, limit: int, keep_ms: int | None) -> None:
        self.span, self.limit, self.keep_ms = window_seconds * MICROS, limit, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", StructType([StructField("t", LongType())]), ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = deque(int(v[0]) for v in self.kept.get()) if self.kept.exists() else deque()
        pairs = [part[["t", "arrival_id"]].to_numpy() for part in rows]
        t, arrival = np.concatenate(pairs).T
        order = np.lexsort([arrival, t])
        admitted, retry = decide(t[order], kept, self.span, self.limit)
        self.kept.clear()
        if kept:
            self.kept.put([(int(x),) for x in sorted(kept)])
        yield pd.DataFrame({"arrival_id": arrival[order], "identity": key[0], "admitted": admitted, "retry_after": retry})

    def close(self) -> None:
        pass


def rate_limit_stream(arrivals: DataFrame, window_seconds: int = K.ARRIVAL_WINDOW_SECONDS,
                      limit: int = K.ARRIVAL_LIMIT, keep_ms: int | None = None) -> DataFrame:
    """Needs the RocksDB state store provider; bound a micro-batch with the source's own limits. ``keep_ms``, well
    over the window, lets the state of idle identities go; Spark then keeps running batches to look for them, so
    it is for streams that do not end, not for availableNow."""
    ship(arrivals.sparkSession)
    rows = arrivals.select(identity().alias("identity"), F.unix_micros("ts").alias("t"), "arrival_id")
    return rows.groupBy("identity").transformWithStateInPandas(
        statefulProcessor=Gate(window_seconds, limit, keep_ms), outputStructType=OUTPUT, outputMode="append",
        timeMode="ProcessingTime" if keep_ms else "none")
