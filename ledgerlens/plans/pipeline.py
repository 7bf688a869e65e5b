"""Steps in order, each on its own: one that fails or can't run leaves a status and not an exception."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

Step = Callable[[dict[str, DataFrame]], DataFrame | dict[str, DataFrame]]


@dataclass
class Status:
    step: str
    state: str  # ok, skipped, failed
    detail: str = ""


class Pipeline:
    """Named steps over named frames: a step takes the frames so far and gives its own, under its name or several names, which later steps can read."""

    def __init__(self):
        self.steps: list[tuple[str, list[str], Step, bool]] = []

    def step(self, name: str, needs: list[str], run: Step, enabled: bool = True) -> Pipeline:
        self.steps.append((name, needs, run, enabled))
        return self

    def run(self, frames: dict[str, DataFrame], keep: Callable[[DataFrame, str], DataFrame]) -> tuple[dict[str, DataFrame], list[Status]]:
        """``keep`` writes a step's frames and gives them back, so that a failure shows in its own step. A step skips itself by a LookupError."""
        frames, report = dict(frames), []
        for name, needs, run, enabled in self.steps:
            missing = [n for n in needs if n not in frames]
            if not enabled or missing:
                report.append(Status(name, "skipped", f"needs {', '.join(missing)}" if enabled else "disabled"))
                continue
            try:
                got = run(frames)
                frames |= {n: keep(df, n) for n, df in (got if isinstance(got, dict) else {name: got}).items()}
                report.append(Status(name, "ok"))
            except LookupError as e:
                report.append(Status(name, "skipped", str(e)))
            except Exception as e:
                report.append(Status(name, "failed", str(e)[:2000]))
        return frames, report
