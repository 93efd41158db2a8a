"""Live rates of streams: what each micro-batch has observed, and rates over the time between reports."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, engines: list[str], name: str = "frames", engine: str = "engine", latency: str = "latency", failed: str | None = None) -> DataFrame:
    """``df``, which tells the listener for each engine how many rows went through, their time in all and how many of them failed; no shuffle and no job more."""
    metrics = []
    for e in engines:
        mine = F.col(engine) == e
        bad = mine & F.col(failed) if failed else F.lit(False)
        metrics += [F.count_if(mine).alias(f"{e}.items"), F.coalesce(F.sum(F.when(mine, F.col(latency))), F.lit(0.0)).cast("double").alias(f"{e}.time"), F.count_if(bad).alias(f"{e}.failed")]
    return df.observe(name, *metrics)


class Rates:
    """Totals by engine, and rates between reports that are at least ``every`` seconds apart, by the clock of the reports."""

    def __init__(self, every: float = 5.0) -> None:
        self.every, self.totals, self.began, self.last = every, {}, None, None
        self.at_last: dict[str, float] = {}

    def add(self, when: float, metrics: dict[str, float]) -> list[dict]:
        """Takes in what a micro-batch that ended at ``when`` (seconds) observed; rows (when, engine, items, failed, mean_time, rate, overall_rate) if it is time for a report."""
        if self.began is None:
            self.began = self.last = when
        for k, v in metrics.items():
            self.totals[k] = self.totals.get(k, 0) + v
        if when - self.last < self.every:
            return []
        rows = []
        for e in sorted({k.rpartition(".")[0] for k in self.totals}):
            items, span, all_time = self.totals.get(f"{e}.items", 0), when - self.last, when - self.began
            rows.append({
                "when": when, "engine": e, "items": int(items), "failed": int(self.totals.get(f"{e}.failed", 0)), "mean_time": self.totals.get(f"{e}.time", 0.0) / items if items else 0.0,
                "rate": (items - self.at_last.get(e, 0)) / span, "overall_rate": items / all_time,
            })
            self.at_last[e] = items
        self.last = when
        return rows


class LiveMetrics(StreamingQueryListener):
    """Gives rows of Rates to ``sink`` while queries run, from the metrics of observed(). Reports of the stages themselves (input and processing rate) go to ``progress``."""

    def __init__(self, sink: Callable[[list[dict]], None], every: float = 5.0, name: str = "frames", clock: Callable[[], float] = time.time) -> None:
        self.sink, self.rates, self.name, self.clock, self.lock, self.progress = sink, Rates(every), name, clock, threading.Lock(), []

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.rates.add(self.clock(), {})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            self.progress.append({"batch": p.batchId, "rows": p.numInputRows, "input_rate": p.inputRowsPerSecond, "processing_rate": p.processedRowsPerSecond, "seconds": p.durationMs.get("triggerExecution", 0) / 1000})
            found = p.observedMetrics.get(self.name)
            if rows := self.rates.add(self.clock(), found.asDict() if found is not None else {}):
                self.sink(rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.rates.every = 0
            if rows := self.rates.add(max(self.clock(), (self.rates.last or 0) + 1e-3), {}):
                self.sink(rows)


def json_lines(path: str) -> Callable[[list[dict]], None]:
    """A sink that appends rows to a file."""

    def write(rows: list[dict]) -> None:
        with open(path, "a") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)

    return write


def replay(events: list[tuple[str, dict[str, float]]], every: float = 5.0) -> list[dict]:
    """The rates of recorded micro-batches (end as ISO text, observed metrics)."""
    rates, out = Rates(every), []
    for when, metrics in events:
        out += rates.add(datetime.fromisoformat(when).timestamp(), metrics)
    return out


def replay_frame(items: DataFrame, every: float = 5.0, ts: str = "ts", engine: str = "engine", latency: str = "latency") -> DataFrame:
    """Rates as LiveMetrics reports them, worked out afterwards for rows with the time of their processing: by window and engine, with running totals."""
    each = items.groupBy(F.floor(F.unix_micros(F.col(ts)) / int(every * 1e6)).alias("k"), engine).agg(F.count("*").alias("n"), F.sum(latency).alias("time"))
    so_far = W.partitionBy(engine).orderBy("k")
    return each.select("k", engine, F.sum("n").over(so_far).alias("items"), (F.sum("time").over(so_far) / F.sum("n").over(so_far)).alias("mean_time"), (F.col("n") / every).alias("rate"))
