"""Streaming impact detection: chunks and phase bounds in, one result per session out."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronotrack.operators.audio import COLUMNS, RESULT, UNSET, Detector, TriggerConfig

#: Stream rows: session_id, seq (0, 1, 2, … in each session), kind (samples, bounds or end), amps, ready, accept.
INPUT = "session_id string, seq long, kind string, amps array<short>, ready long, accept long"


def apply_rows(d: Detector, rows: pd.DataFrame, due: int):
    """Rows in order; (result or None, next seq). A gap or a step back is a failure, never reordered or dropped."""
    for r in rows.sort_values("seq").itertuples():
        if r.seq != due:
            d.result = d.result or d._row("OUT_OF_ORDER")
            return d.result, due
        due += 1
        if r.kind == "samples":
            d.feed(np.asarray(r.amps, np.int64))
        elif r.kind == "bounds":
            d.bounds(int(r.ready) if r.ready == r.ready and r.ready is not None else UNSET, int(r.accept) if r.accept == r.accept and r.accept is not None else UNSET)
        else:
            return d.finish(), due
        if d.result:
            return d.result, due
    return None, due


def detect_stream(rows: DataFrame, config: TriggerConfig) -> DataFrame:
    """session_id and the detector's result, once per session.

    The state of a session is the samples that unseen windows still need (baseline plus window, and what is held back until
    the acceptance bound is known, at most ``longest``), the cursor and the counters. After a result the session is done.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blob, due, done = state.get if state.exists else (None, 0, False)
        pdf = pd.concat(list(batches)) if not state.hasTimedOut else pd.DataFrame()
        if done:
            return
        d = pickle.loads(blob) if blob else Detector(config)
        got, due = apply_rows(d, pdf, due)
        state.update((b"" if got else pickle.dumps(d), due, got is not None))
        if got:
            yield pd.DataFrame([[key[0], *got]], columns=["session_id", *COLUMNS])

    return rows.groupBy("session_id").applyInPandasWithState(step, f"session_id string, {RESULT}", "detector binary, due long, done boolean", "append", GroupStateTimeout.NoTimeout)


def detect_batch(rows: DataFrame, config: TriggerConfig) -> DataFrame:
    """The same over a finished table of stream rows."""

    def run(k, pdf):
        d = Detector(config)
        got, _ = apply_rows(d, pdf, 0)
        return pd.DataFrame([[k[0], *(got or d.finish())]], columns=["session_id", *COLUMNS])

    return rows.groupBy("session_id").applyInPandas(run, f"session_id string, {RESULT}")
