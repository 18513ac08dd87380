"""Impact detection in sample streams: one kernel for batch and stream, and a window form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNSET = (1 << 63) - 1
RESULT = "status string, sample_index long, peak int, baseline double, ratio double, peak_delta double, scanned long, pre_ready int, blanked int, below int, strongest_delta double, strongest_ratio double"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]


@dataclass(frozen=True)
class TriggerConfig:
    """Sample counts and thresholds; the defaults are those of production."""

    rate: int = 48_000
    baseline: int = 960
    window: int = 96
    ratio: float = 2.5
    peak_delta: int = 100
    floor_rms: float = 25.0
    longest: int = 480_000
    actionable: int = 240_000
    ready: int = UNSET
    accept: int = UNSET

    def valid(self) -> bool:
        counts = min(self.rate, self.baseline, self.window, self.longest, self.actionable) > 0
        return counts and np.isfinite(self.ratio) and self.ratio > 1 and self.peak_delta >= 0 and np.isfinite(self.floor_rms) and self.floor_rms >= 0 and min(self.ready, self.accept) >= 0 and not (UNSET not in (self.ready, self.accept) and self.accept < self.ready)


class Detector:
    """Chunk-fed detector: each window is looked at once, when its samples and the acceptance bound are known; the first result stays.

    State between chunks: the samples that unseen windows still need, the cursor and the counters.
    """

    def __init__(self, config: TriggerConfig):
        self.config, self.written, self.next = config, 0, config.baseline
        self.held, self.offset = np.zeros(0, np.int64), 0
        self.counts, self.strongest = [0, 0, 0], [0.0, 0.0]
        self.result = None if config.valid() else self._row("RESOURCE_FAILURE")

    def _row(self, status, index=None, peak=None, baseline=None, ratio=None, delta=None, scanned=None):
        return (status, index, peak, baseline, ratio, delta, scanned, *self.counts, *self.strongest)

    def bounds(self, ready: int, accept: int):
        """Late-known phase bounds; windows held back until now are looked at."""
        if self.result:
            return self.result
        self.config = TriggerConfig(**{**self.config.__dict__, "ready": max(ready, 0), "accept": max(accept, 0)})
        if not self.config.valid():
            self.result = self._row("RESOURCE_FAILURE")
            return self.result
        return self._work()

    def feed(self, chunk):
        if self.result:
            return self.result
        chunk = np.asarray(chunk, np.int64)[: max(0, self.config.longest - self.written)]
        self.held = np.concatenate((self.held, chunk))
        self.written += len(chunk)
        return self._work()

    def finish(self):
        return self.result or self._work() or self._row("NO_IMPACT", scanned=self.written)

    def _work(self):
        c = self.config
        if self.result or c.accept == UNSET:
            return self.result
        last = min(self.written, c.longest) - c.window
        if last >= self.next:
            self._windows(last)
        if not self.result and min(self.written, c.longest) >= min(c.accept + c.actionable, c.longest) and self.written >= c.baseline + c.window:
            self.result = self._row("NO_IMPACT", scanned=min(self.written, c.longest))
        keep = max(0, self.next - c.baseline - self.offset)
        self.held, self.offset = self.held[keep:], self.offset + keep
        return self.result

    def _windows(self, last: int) -> None:
        """All windows whose samples are there, as arrays: whole-number sums, so chunking can't change a figure."""
        c = self.config
        total = np.concatenate(([0], np.cumsum(self.held**2)))
        at = np.arange(self.next, last + 1) - self.offset
        baseline = np.sqrt((total[at] - total[at - c.baseline]) / c.baseline)
        rms = np.sqrt((total[at + c.window] - total[at]) / c.window)
        view = np.lib.stride_tricks.sliding_window_view(np.abs(self.held), c.window)[at[0] : at[-1] + 1]
        where = view.argmax(axis=1)
        peak = view[np.arange(len(at)), where]
        base = np.maximum(baseline, c.floor_rms)
        ratio = np.divide(rms, base, out=np.zeros(len(at)), where=base > 0)
        delta, index = peak - baseline, at + self.offset + where
        loud = (ratio >= c.ratio) & (delta >= c.peak_delta)
        early = index < c.ready
        blank = ~early & ((index < c.accept) | (at + self.offset - c.baseline < c.accept))
        hits = np.nonzero(loud & ~early & ~blank)[0]
        seen = slice(0, hits[0] + 1 if len(hits) else len(at))
        after = index[seen] >= c.accept
        self.counts[0] += int((loud & early)[seen].sum())
        self.counts[1] += int((loud & blank)[seen].sum())
        self.counts[2] += int((~loud[seen] & after).sum())
        if after.any():
            self.strongest = [max(self.strongest[0], float(delta[seen][after].max())), max(self.strongest[1], float(ratio[seen][after].max()))]
        self.next = last + 1
        if len(hits):
            k = hits[0]
            self.next = int(at[k] + self.offset) + 1
            self.result = self._row("DETECTED", int(index[k]), int(peak[k]), float(baseline[k]), float(ratio[k]), float(delta[k]), self.written)


def detect(samples: DataFrame, key: str, order: str, amplitude: str, config: TriggerConfig) -> DataFrame:
    """One row per session: the first impact or the counters. A session is at most ``longest`` samples, which bounds the group."""
    rows = samples.where(F.col(order) < config.longest).select(key, order, amplitude)

    def run(k, pdf):
        d = Detector(config)
        d.feed(pdf.sort_values(order)[amplitude].to_numpy())
        return pd.DataFrame([[k[0], *d.finish()]], columns=[key, *COLUMNS])

    return rows.groupBy(key).applyInPandas(run, f"{key} {samples.schema[key].dataType.simpleString()}, {RESULT}")


def trigger_windows(samples: DataFrame, key: str, order: list[str], amplitude: str, baseline: int, window: int, ratio: float, delta: float, floor_rms: float) -> DataFrame:
    """The window form: at each sample the RMS of those before, RMS and peak of those from it on, and whether both gates hold."""
    w = W.partitionBy(key).orderBy(*order)
    a = F.col(amplitude)
    before, after = w.rowsBetween(-baseline, -1), w.rowsBetween(0, window - 1)
    out = samples.withColumns({
        "n_before": F.count(a).over(before), "n_after": F.count(a).over(after), "baseline_rms": F.sqrt(F.avg(a * a).over(before)), "window_rms": F.sqrt(F.avg(a * a).over(after)), "peak": F.max(F.abs(a)).over(after),
    }).where((F.col("n_before") == baseline) & (F.col("n_after") == window))
    base = F.greatest("baseline_rms", F.lit(floor_rms))
    out = out.withColumn("trigger_ratio", F.when(base > 0, F.try_divide(F.col("window_rms"), base)).otherwise(0.0))
    return out.withColumn("triggered", (F.col("trigger_ratio") >= ratio) & (F.col("peak") - F.col("baseline_rms") >= delta))
