"""Rows of a stream that come for the first time, with state that does not grow with them.

A stream that delivers points again (a file written twice, a restarted copy) is cleaned by
the numbers its points carry. The numbers seen under a key are kept as merged intervals
and cut into ranges of fixed length, so a chain without gaps is one interval a range,
whatever its length, and a hot key is many small states.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Numbers that share one state.
RANGE = 1 << 20


def unseen(starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which numbers lie in none of the sorted intervals [start, end] and come first among equals."""
    at = np.searchsorted(starts, numbers, "right") - 1
    inside = np.zeros(len(numbers), bool)
    some = at >= 0
    inside[some] = numbers[some] <= ends[at[some]]
    first = np.zeros(len(numbers), bool)
    first[np.unique(numbers, return_index=True)[1]] = True
    return first & ~inside


def merged(starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals with further numbers; intervals that touch become one."""
    low, high = np.concatenate([starts, numbers]), np.concatenate([ends, numbers])
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    opens = np.append(True, low[1:] > high[:-1] + 1)[: len(low)]
    closes = np.append(opens[1:], True)[: len(low)]
    return low[opens], high[closes]


class FirstTime(StatefulProcessor):
    """Passes the rows whose number was not seen under their key."""

    def __init__(self, number: str, columns: list[str]):
        self.number, self.columns = number, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "starts array<bigint>, ends array<bigint>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.seen.get() if self.seen.exists() else ([], [])
        starts, ends = (np.asarray(x, np.int64) for x in held)
        for batch in rows:
            numbers = batch[self.number].to_numpy(np.int64)
            new = unseen(starts, ends, numbers)
            starts, ends = merged(starts, ends, numbers[new])
            yield batch.loc[new, self.columns]
        self.seen.update((starts.tolist(), ends.tolist()))

    def close(self) -> None:
        pass


def first_time(stream: DataFrame, keys: list[str], number: str) -> DataFrame:
    """The rows of ``stream`` whose ``number`` comes for the first time under ``keys``."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    dealt = stream.withColumn("_range", F.floor(F.col(number) / RANGE)).groupBy(*keys, "_range")
    return dealt.transformWithStateInPandas(
        statefulProcessor=FirstTime(number, stream.columns), outputStructType=stream.schema, outputMode="Append", timeMode="None"
    )
