"""The sliding-log limiter and the subscription machine on the state API with timers, each equal to its batch form.

Hits and events of a key are taken in event-time order whatever micro-batch brings them: they wait in the key's state until the watermark has
passed them, and are decided then. So the order of arrival within the allowed lateness changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import GRACE_DAYS, step

WAITING = "at long, event string"
LOG = "at long"
HITS_OUT = "key string, event string, at timestamp, allowed boolean"
SUBSCRIPTION = "status string, since long, at long, last string, n long"
EVENTS = "at long, id string, status string"
SUBSCRIPTIONS_OUT = "customer string, status string, since timestamp, at timestamp, n long"


def micros(t: pd.Timestamp) -> int:
    return int(t.value // 1000) if t.tzinfo is None else int(t.tz_convert("UTC").value // 1000)


def moment(us: int | None) -> datetime | None:
    return None if us is None else datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(tzinfo=None, microsecond=us % 1_000_000)


class Limiter(StatefulProcessor):
    """At most `most` hits of a key in any span of `seconds`; refused hits don't count.

    State: the hits that wait for the watermark, and the times of at most `most` allowed ones, which a timer drops when the span has passed.
    """

    def __init__(self, most: int, seconds: int):
        self.most, self.span = most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.log = handle.getListState("log", LOG)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            self.waiting.appendList([(micros(t), e) for t, e in zip(pdf["at"], pdf["event"], strict=True)])
        yield from self._decide(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._decide(key, timerValues)

    def _decide(self, key, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() * 1000
        hits = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [h for h in hits if h[0] < now], [h for h in hits if h[0] >= now]
        log = [x[0] for x in self.log.get()] if self.log.exists() else []
        out = []
        for at, event in due:
            log = [t for t in log if at - t < self.span]
            allowed = len(log) < self.most
            if allowed:
                log.append(at)
            out.append((key[0], event, moment(at), allowed))
        log = [t for t in log if now - t < self.span]
        for state, values in ((self.waiting, later), (self.log, [(t,) for t in log])):
            state.put(values) if values else state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [later[0][0] + 1] if later else []
        times += [log[0] + self.span] if log else []
        if times:
            self.handle.registerTimer(max(min(times) // 1000 + 1, now // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=["key", "event", "at", "allowed"])


def limited(hits: DataFrame, most: int, seconds: int, late: str = "1 hour") -> DataFrame:
    """(key, event, at, allowed) of a stream of hits (key, event, at), each once the watermark has passed it; later ones are dropped by it.

    The same as operators.sales.limiter over all hits. The query needs the RocksDB state store.
    """
    grouped = hits.select("key", "event", "at").withWatermark("at", late).groupBy("key")
    return grouped.transformWithStateInPandas(Limiter(most, seconds), HITS_OUT, "append", "eventTime")


class Subscription(StatefulProcessor):
    """The status of a customer by the events in order of (ts, id); an overdue one is cancelled by a timer after the grace period.

    State: (status, since, at, last id, n), which may begin from a table, and the events that wait for the watermark.
    """

    def __init__(self, grace_days: int = GRACE_DAYS):
        self.grace = grace_days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", SUBSCRIPTION)
        self.waiting = handle.getListState("waiting", EVENTS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        at = lambda v: None if pd.isna(v) else micros(pd.Timestamp(v))
        word = lambda v: None if pd.isna(v) else str(v)
        self.state.update((word(row["status"]), at(row["since"]), at(row["at"]), word(row["last"]) or "", int(row["n"])))
        self._remind(timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            self.waiting.appendList([(micros(t), i, s) for t, i, s in zip(pdf["ts"], pdf["id"], pdf["status"], strict=True)])
        yield from self._decide(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._decide(key, timerValues)

    def _decide(self, key, timers) -> Iterator[pd.DataFrame]:
        now = timers.getCurrentWatermarkInMs() * 1000
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, later = [x for x in events if x[0] < now], [x for x in events if x[0] >= now]
        state = tuple(self.state.get()) if self.state.exists() else (None, None, None, None, 0)
        before = state
        for x in due:
            state = step(state, x)
        if state[0] == "PAST_DUE" and now > state[1] + self.grace and not any(x[0] <= state[1] + self.grace for x in later):
            state = ("CANCELLED", state[1] + self.grace, *state[2:])
        self.waiting.put(later) if later else self.waiting.clear()
        if state != before:
            self.state.update(state)
            status, since, at, _, n = state
            yield pd.DataFrame([(key[0], status, moment(since), moment(at), n)], columns=["customer", "status", "since", "at", "n"])
        self._remind(timers)

    def _remind(self, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        state = tuple(self.state.get()) if self.state.exists() else (None, None, None, None, 0)
        times = [waiting[0][0] + 1] if waiting else []
        times += [state[1] + self.grace + 1] if state[0] == "PAST_DUE" else []
        if times:
            self.handle.registerTimer(max(min(times) // 1000 + 1, timers.getCurrentWatermarkInMs() + 1))


def subscribed(events: DataFrame, late: str = "7 days", initial: DataFrame | None = None, grace_days: int = GRACE_DAYS) -> DataFrame:
    """(customer, status, since, at, n) whenever it changes, from events (customer, id, ts, status). initial: (customer, status, since, at, last, n) to begin from,
    one row a customer, as subscriptions_batch gives it with the last id. The query needs the RocksDB state store."""
    grouped = events.select("customer", "id", "ts", "status").withWatermark("ts", late).groupBy("customer")
    more = {"initialState": initial.select("customer", "status", "since", "at", "last", "n").groupBy("customer")} if initial is not None else {}
    return grouped.transformWithStateInPandas(Subscription(grace_days), SUBSCRIPTIONS_OUT, "update", "eventTime", **more)
