"""Event-sourced workflow states, in batch and stream; at-most-once delivery; throttled live level."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "session_id string, seq long, event string, payload string"
STATE = ("stage", "access", "metadata", "frames", "outcome", "reason")
#: Import workflow: event -> (stage, fields that the payload sets, whether all else is cleared).
IMPORT_RULES = {
    "REQUEST_PICKER": ("PICKER_REQUESTED", None, True), "SELECTION_VALIDATED": ("VALIDATING", "access", True), "METADATA_VALIDATED": ("EXTRACTING", "metadata", False), "FRAMES_EXTRACTED": ("READY", "frames", False),
    "START_ESTIMATE": ("ESTIMATING", None, False), "ESTIMATE_COMPLETED": ("SUCCESS", "outcome", False), "IMPORT_FAILED": ("NO_READ", "reason", True), "CANCEL": ("CANCELLED", None, True), "RETRY": ("IDLE", None, True), "DELETE": ("IDLE", None, True),
}
PREREQUISITES = ("calibration", "colour", "source")
MEASURE = (*PREREQUISITES, "capture", "reason")


def reduce_import(state: dict, event: str, payload: str | None) -> dict:
    if event not in IMPORT_RULES:
        return state
    stage, field, clear = IMPORT_RULES[event]
    new = dict.fromkeys(STATE) if clear else dict(state)
    new["stage"] = stage
    if event in ("METADATA_VALIDATED", "FRAMES_EXTRACTED", "ESTIMATE_COMPLETED"):
        new["reason"] = None
    if field:
        new[field] = payload
    if event == "ESTIMATE_COMPLETED" and payload == "NO_READ":
        new["stage"] = "NO_READ"
    return new


def reduce_measurement(state: dict, event: str, payload: str | None) -> dict:
    new = dict(state)
    for p in PREREQUISITES:
        if event == f"{p.upper()}_READY":
            new[p] = "READY"
        elif event == f"{p.upper()}_CLEARED":
            new |= {p: None, "capture": "IDLE", "reason": f"{p.upper()}_MISSING"}
    if event in ("ARM", "START"):
        missing = next((p for p in PREREQUISITES if new.get(p) != "READY"), None)
        if missing:
            new |= {"capture": "NOT_READY", "reason": f"{missing.upper()}_MISSING"}
        else:
            new["capture"] = "ARMED" if event == "ARM" else "RUNNING"
    elif event == "COMPLETED":
        new |= {"capture": "COMPLETE", "reason": payload}
    return new


REDUCERS = {"import": (reduce_import, STATE), "measurement": (reduce_measurement, MEASURE)}


def fold(events: DataFrame, kind: str) -> DataFrame:
    """Final state of each session, events in order of seq."""
    step, fields = REDUCERS[kind]

    def run(k, pdf):
        state = dict.fromkeys(fields)
        for r in pdf.sort_values("seq").itertuples():
            state = step(state, r.event, r.payload)
        return pd.DataFrame([[k[0], len(pdf), *(state[f] for f in fields)]], columns=["session_id", "events", *fields])

    return events.groupBy("session_id").applyInPandas(run, f"session_id string, events long, {', '.join(f'{f} string' for f in fields)}")


def fold_stream(events: DataFrame, kind: str) -> DataFrame:
    """The state after each micro-batch of a session's events."""
    step, fields = REDUCERS[kind]

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, *values = state.get if state.exists else (0, *[None] * len(fields))
        now = dict(zip(fields, values))
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            now, n = step(now, r.event, r.payload), n + 1
        state.update((n, *(now[f] for f in fields)))
        yield pd.DataFrame([[key[0], n, *(now[f] for f in fields)]], columns=["session_id", "events", *fields])

    out = f"session_id string, events long, {', '.join(f'{f} string' for f in fields)}"
    return events.groupBy("session_id").applyInPandasWithState(run, out, f"n long, {', '.join(f'{f} string' for f in fields)}", "update", GroupStateTimeout.NoTimeout)


def accept_once(outcomes: DataFrame, run: str, generation: str, order: str) -> DataFrame:
    """The first outcome of each run's newest generation; late ones of older generations are refused."""
    w = W.partitionBy(run)
    o = outcomes.withColumn("__newest", F.max(generation).over(w)).where(F.col(generation) == F.col("__newest"))
    return o.withColumn("__rn", F.row_number().over(w.orderBy(order))).where("__rn = 1").drop("__newest", "__rn")


def throttle(df: DataFrame, key: str, order: str, at: str, interval: Column | int, warm: int = 30) -> DataFrame:
    """Rows that a live callback sees: after ``warm`` samples, the first in each interval since the session began."""
    w = W.partitionBy(key).orderBy(order)
    n = df.withColumns({"__n": F.row_number().over(w), "__slot": F.floor((F.col(at) - F.min(at).over(W.partitionBy(key))) / interval)}).where(F.col("__n") >= warm)
    return n.withColumn("__rn", F.row_number().over(W.partitionBy(key, "__slot").orderBy(order))).where("__rn = 1").drop("__n", "__slot", "__rn")
