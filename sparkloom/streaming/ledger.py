"""A ledger of idempotent calls as keyed streaming state: reserve, complete, give up, expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: seq, op (reserve, complete, give_up), owner, fingerprint, result, at (microseconds) of a request.
REQUEST = ["seq", "op", "owner", "fingerprint", "result", "at"]
OUTCOME = "tool string, call_key string, seq long, outcome string, result string"
_STATE = "status string, owner string, fingerprint string, result string, updated long"


def needs_rocksdb(spark: SparkSession) -> None:
    """Keyed state of several variables lives in this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def step(state: tuple | None, op: str, owner: str, fingerprint: str, result: str | None, at: int, ttl: int) -> tuple[tuple | None, str, str | None]:
    """State after a request, its outcome and the result that it is given.

    The first to reserve a key owns it. Others are told conflict if their arguments differ; else what
    became of the call: its result, in_progress, or indeterminate, which a reservation also becomes once
    it is `ttl` old. Only the owner of what is in progress may complete it or give it up."""
    if op == "reserve":
        if state is None:
            return ("in_progress", owner, fingerprint, None, at), "reserved", None
        status, held_by, held, kept, updated = state
        if held != fingerprint:
            return state, "conflict", None
        if status == "in_progress" and at - updated >= ttl:
            return ("indeterminate", held_by, held, None, at), "indeterminate", None
        return state, status, kept
    if state is None or state[0] != "in_progress" or state[1] != owner:
        return state, "ownership_lost" if op == "complete" else "ignored", None
    if op == "complete":
        return ("completed", owner, state[2], result, at), "completed", result
    return ("indeterminate", owner, state[2], None, at), "indeterminate", None


class Ledger(StatefulProcessor):
    """One value a key, and a timer that reports a reservation when the watermark passes its time to live (a
    row without seq). The state turns at the next reservation, so outcomes don't depend on how requests
    fall into batches."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.entry.get()) if self.entry.exists() else None
        every = sorted((r for pdf in rows for r in pdf[REQUEST].itertuples(index=False, name=None)), key=lambda r: (r[5], r[0]))
        out = []
        for seq, op, owner, fingerprint, result, at in every:
            state, outcome, given = step(state, op, owner, fingerprint, result, at, self.ttl)
            out.append((*key, seq, outcome, given))
        if state is not None:
            self.entry.update(state)
            if state[0] == "in_progress":
                self.handle.registerTimer((state[4] + self.ttl) // 1000 + 1)
        yield pd.DataFrame(out, columns=["tool", "call_key", "seq", "outcome", "result"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.entry.get()) if self.entry.exists() else None
        if state is not None and state[0] == "in_progress" and state[4] + self.ttl <= 1000 * expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame([(*key, None, "expired", None)], columns=["tool", "call_key", "seq", "outcome", "result"])
        else:
            yield pd.DataFrame([], columns=["tool", "call_key", "seq", "outcome", "result"])

    def close(self) -> None:
        pass


def outcomes(requests: DataFrame, ttl_seconds: int, late: str = "1 second") -> DataFrame:
    """(tool, call_key, seq, outcome, result) of a stream requests(tool, call_key, ts, and REQUEST): what each
    was told, and a row `expired` for every reservation that outlived ttl_seconds. Batches come in the order
    of time; within one, requests of a key are taken by time, then seq."""
    needs_rocksdb(requests.sparkSession)
    keyed = requests.withWatermark("ts", late).groupBy("tool", "call_key")
    return keyed.transformWithStateInPandas(statefulProcessor=Ledger(ttl_seconds * 1_000_000), outputStructType=OUTCOME, outputMode="Append", timeMode="EventTime")
