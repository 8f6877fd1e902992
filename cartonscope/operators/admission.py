"""Admission limiter over an arrival log: at most ``limit`` admitted arrivals per identity in any
``window``; a rejected arrival leaves no trace.

The rule is a recurrence (whether an arrival counts depends on earlier decisions), so arrivals of one
busy stretch are walked in time order. Stretches are cut wherever an identity is idle for a whole
window, which empties its log; the cuts are found per time bucket plus a walk over bucket summaries,
never by gathering an identity. A stretch of at most ``limit`` arrivals is admitted as a whole; only longer
ones are walked. The walk streams sorted Arrow batches and keeps ``limit`` timestamps in memory, whatever
the length of the stretch, jumping over runs of rejections.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartonscope import constants as K
from cartonscope.session import ship

MICROS = 1_000_000
WINDOWS_PER_BUCKET = 64


def identity() -> Column:
    """user:<email>, else ip:<host>, else ip:unknown."""
    return F.when(F.col("email").isNotNull(), F.concat(F.lit("user:"), "email")).otherwise(
        F.concat(F.lit("ip:"), F.coalesce("host", F.lit("unknown"))))


def busy_stretches(arrivals: DataFrame, window_seconds: int) -> DataFrame:
    """Adds identity, t (microseconds) and ``stretch``: the time its busy stretch began."""
    span = window_seconds * MICROS
    rows = arrivals.withColumns({"identity": identity(), "t": F.unix_micros("ts")}).withColumn(
        "bucket", F.floor(F.col("t") / (span * WINDOWS_PER_BUCKET)))
    inside = Window.partitionBy("identity", "bucket").orderBy("t", "arrival_id")
    local = rows.withColumn("before", F.lag("t").over(inside)).withColumn(
        "cut", F.when(F.col("t") - F.col("before") >= span, F.col("t")))
    summary = local.groupBy("identity", "bucket").agg(
        F.min("t").alias("head"), F.max("t").alias("tail"), F.max("cut").alias("last_cut"))
    across = Window.partitionBy("identity").orderBy("bucket")
    linked = (summary.withColumn("carry", F.lag("tail").over(across))
              .withColumn("head_cut", F.when(F.col("carry").isNull() | (F.col("head") - F.col("carry") >= span), F.col("head")))
              .withColumn("closing", F.greatest("head_cut", "last_cut"))
              .withColumn("open_at", F.greatest("head_cut", F.max("closing").over(
                  across.rowsBetween(Window.unboundedPreceding, -1))))
              .select("identity", "bucket", "open_at"))
    so_far = F.max("cut").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (local.withColumn("local_cut", so_far).join(linked, ["identity", "bucket"])
            .withColumn("stretch", F.greatest("open_at", "local_cut")).drop("bucket", "before", "cut", "local_cut", "open_at"))


def decide(t: np.ndarray, kept: deque, window: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Decisions for one time-ordered run; ``kept`` carries admitted times over to the next run."""
    admitted = np.zeros(len(t), dtype=bool)
    retry = np.zeros(len(t), dtype=np.int64)
    i = 0
    while i < len(t):
        while kept and kept[0] <= t[i] - window:
            kept.popleft()
        if len(kept) < limit:
            admitted[i] = True
            kept.append(int(t[i]))
            i += 1
            continue
        free_at = kept[0] + window
        j = i + int(np.searchsorted(t[i:], free_at, side="left"))
        retry[i:j] = np.maximum(1, (free_at - t[i:j]) // MICROS)
        i = j
    return admitted, retry


def rate_limit(arrivals: DataFrame, window_seconds: int = K.ARRIVAL_WINDOW_SECONDS,
               limit: int = K.ARRIVAL_LIMIT) -> DataFrame:
    """(arrival_id, identity, admitted, retry_after) for a whole arrival log."""
    span = window_seconds * MICROS
    ship(arrivals.sparkSession)
    cut = busy_stretches(arrivals, window_seconds).select(
        "identity", F.xxhash64("identity", "stretch").alias("run"), "stretch", "t", "arrival_id")
    ordered = cut.repartition("identity", "stretch").sortWithinPartitions("identity", "stretch", "t", "arrival_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, kept = None, deque()
        for batch in batches:
            run, t = batch["run"].to_numpy(), batch["t"].to_numpy()
            if not len(run):
                continue
            starts = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1])
            ends = np.append(starts[1:], len(run))
            # The first stretch may have begun in the last batch, and the last one may go on in the next.
            long = ends - starts > limit
            long[0] |= run[0] == current
            long[-1] = True
            admitted, retry = np.ones(len(run), bool), np.zeros(len(run), np.int64)
            for a, b in zip(starts[long], ends[long]):
                if run[a] != current:
                    current, kept = run[a], deque()
                admitted[a:b], retry[a:b] = decide(t[a:b], kept, span, limit)
            yield pd.DataFrame({"arrival_id": batch["arrival_id"], "identity": batch["identity"],
                                "admitted": admitted, "retry_after": retry})

    return ordered.mapInPandas(walk, "arrival_id bigint, identity string, admitted boolean, retry_after bigint")
