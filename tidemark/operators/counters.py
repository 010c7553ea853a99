"""Counts taken while rows are written, and guards that stop a run on them before anything is published."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation

from ..session import cut


class Stopped(RuntimeError):
    """A guard did not hold. Nothing of the run is published."""


@dataclass(frozen=True)
class Guard:
    """Stops a run after a stage, if the stage's counts are odd."""

    stage: str
    message: str
    odd: Callable[[dict[str, int]], bool]


def counted(df: DataFrame, what: str, measures: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """Write the rows to shared storage, read them again, and give the measures (aggregates that are whole numbers) of what was written,
    from the same pass. They are observed in the tasks that write, each of which counts once however often it is tried."""
    seen = Observation()
    rows = cut(df.observe(seen, *[c.alias(n) for n, c in measures.items()]), what)
    found = seen.get
    return rows, {n: int(found.get(n) or 0) for n in measures}


def check(stage: str, counts: dict[str, int], guards: Iterable[Guard]) -> None:
    for g in guards:
        if g.stage == stage and g.odd(counts):
            raise Stopped(f"{stage}: {g.message} ({', '.join(f'{k}={v}' for k, v in counts.items())})")


def too_few(stage: str, name: str, least: int) -> Guard:
    return Guard(stage, f"fewer than {least} rows", lambda n: n[name] < least)


def unusual(stage: str, name: str, usual: float, ratio: float = 3.0) -> Guard:
    """The count is `ratio` times more or fewer than usual; nothing is unusual where no volume is known."""
    return Guard(stage, f"far from the usual {usual:g} rows", lambda n: usual > 0 and max(n[name] / usual, usual / max(n[name], 1)) > ratio)


def failing(stage: str, failed: str, of: str, most: float = 0.5) -> Guard:
    """More than a share of the rows failed; of no rows none did."""
    return Guard(stage, f"more than {most:.0%} failed", lambda n: n[failed] > most * n[of])
