"""Stuck sensors on a stream: per series only the run of equal values in progress is kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Arbitrary state needs the RocksDB state store, which spills to disk and is checkpointed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class StuckSensor(StatefulProcessor):
    """Flags 2 from the moment a value has not changed for longer than the limit, 4 for a time seen before.

    Rows of a series are taken in time order inside a micro-batch; the size of a batch is
    set by the source options. A row older than the state starts no run.
    """

    def __init__(self, minutes: float):
        self.limit_us = int(minutes * 60_000_000)

    def init(self, handle) -> None:
        state = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("since", T.LongType()), T.StructField("last", T.LongType())])
        self.run = handle.getValueState("run", state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", "tie"], kind="stable")
        us, v = pdf["us"].to_numpy(), pdf["value"].to_numpy(dtype=float)
        value, since, last = self.run.get() if self.run.exists() else (np.nan, us[0], np.iinfo("int64").min)
        prev_v, prev_us = np.r_[value, v[:-1]], np.r_[last, us[:-1]]
        starts = np.where(v == prev_v, -1, us)
        run = np.maximum.accumulate(np.r_[since, starts])[1:]
        flag = np.where(us <= prev_us, 4, np.where(us - run > self.limit_us, 2, 0))
        if us[-1] >= last:
            self.run.update((float(v[-1]), int(run[-1]), int(us[-1])))
        yield pd.DataFrame({"series": key[0], "us": us, "tie": pdf["tie"].to_numpy(), "value": v, "flag": flag})

    def close(self) -> None:
        pass


def stuck_flags(stream: DataFrame, key: str, ts: str, value: str, tie: str, minutes: float = 60.0) -> DataFrame:
    """series, ts, tie, value and the provisional flag of every row of the stream."""
    rows = stream.select(
        F.col(key).cast("string").alias("series"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"),
    )
    out = rows.groupBy("series").transformWithStateInPandas(
        statefulProcessor=StuckSensor(minutes),
        outputStructType="series string, us long, tie long, value double, flag int",
        outputMode="append",
        timeMode="None",
    )
    return out.select("series", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "tie", "value", "flag")
