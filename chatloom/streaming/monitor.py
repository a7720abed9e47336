"""The log of training as a stream: every so many steps, and what stops a run, with state kept for each run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "last long, best double, misses int, stopped boolean"
LOGGED = "run string, step long, value double, best double, misses int, stopped boolean"


class StepLog(StatefulProcessor):
    """Of each run: the last step, the best value so far, how many steps since, and whether ``patience`` of them have passed.

    Steps at or before the run's last one are repeats and don't count. Every ``every``-th
    step is logged, and the one that stops the run; a null value is no better than any.
    """

    def __init__(self, every: int, patience: int) -> None:
        self.every, self.patience = every, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, best, misses, stopped = self.state.get() if self.state.exists() else (None, None, 0, False)
        out = []
        steps = pd.concat(list(rows)).sort_values(["step", "value"]).drop_duplicates("step")
        for step, value in zip(steps["step"].tolist(), steps["value"].tolist(), strict=True):
            if last is not None and step <= last:
                continue
            value = None if value is None or value != value else value
            better = value is not None and (best is None or value < best)
            best, misses, was = (value, 0, stopped) if better else (best, misses + 1 if last is not None else 0, stopped)
            last, stopped = step, stopped or misses >= self.patience
            if step % self.every == 0 or stopped != was:
                out.append((key[0], step, value, best, misses, stopped))
        if last is not None:
            self.state.update((last, best, misses, stopped))
        yield pd.DataFrame(out, columns=["run", "step", "value", "best", "misses", "stopped"])

    def close(self) -> None:
        pass


def step_log(rows: DataFrame, every: int = 10, patience: int = 5) -> DataFrame:
    """run, step, value (a stream, or a table) -> LOGGED. On a stream, a run's state is a few numbers however long it gets."""
    return rows.select("run", "step", "value").groupBy("run").transformWithStateInPandas(StepLog(every, patience), LOGGED, "Append", "None")
