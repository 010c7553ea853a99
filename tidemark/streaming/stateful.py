"""The stateful behaviours as Structured Streaming, each equal to its batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sales import STATES
from ..sources.writers import insert_once

#: Days for which a payment may be overdue.
GRACE_DAYS = 14


def weekly(events: DataFrame, ts: str, *keys: str, late: str = "2 days", **more: Column) -> DataFrame:
    """Counts, and more aggregates by name, of each week that begins on a Friday; rows later than the watermark don't count any
    more. A table gives the same as a stream without late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "7 days", startTime="1 day").alias("week"), *keys).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in more.items()])


def once(events: DataFrame, keys: list[str], ts: str, late: str = "30 days") -> DataFrame:
    """Each key's first event within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def append_once(stream: DataFrame, path: str, checkpoint: str, keys: list[str], *order: str):
    """A query that appends each key once, whatever batch it comes in and however often a batch is tried."""
    return stream.writeStream.foreachBatch(lambda df, _: insert_once(df, path, keys, *order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "status string, since timestamp, at timestamp, last_id string, n long"
OUT = "customer string, status string, since timestamp, at timestamp, n long"


def step(state: tuple, event: tuple) -> tuple:
    """The next (status, since, at, last id, n) after (at, id, provider status); events come in order of (at, id), older or repeated ones change nothing."""
    status, since, at, last, n = state
    t, i, word = event
    if at is not None and (t, i) <= (at, last):
        return state
    new = STATES.get(word, status)
    return new, (t if new != status else since), t, i, n + 1


def subscriptions(events: DataFrame, late: str = "7 days") -> DataFrame:
    """(customer, status, since, at, n) as it stands after each micro-batch, from events (customer, id, ts, status).

    The state of one customer is kept by one task, which reads that customer's new events one after the other. An overdue customer is cancelled when event time passes the grace period.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (None, None, None, None, 0)
        now = tuple(None if v is pd.NaT else v for v in now)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"customer": [key[0]], "status": ["CANCELLED"], "since": [pd.Timestamp(state.getCurrentWatermarkMs(), unit="ms")], "at": [now[2]], "n": [now[4]]})
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        for t, i, word in zip(rows["ts"], rows["id"], rows["status"], strict=True):
            now = step(now, (t, i, word))
        state.update(now)
        if now[0] == "PAST_DUE":
            due = int((now[1] + pd.Timedelta(days=GRACE_DAYS)).timestamp() * 1000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"customer": [key[0]], "status": [now[0]], "since": [now[1]], "at": [now[2]], "n": [now[4]]})

    grouped = events.withWatermark("ts", late).groupBy("customer")
    return grouped.applyInPandasWithState(fold, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def subscriptions_batch(events: DataFrame) -> DataFrame:
    """The same from a table: the last known status by (ts, id), and since when it holds."""
    from pyspark.sql import Window as W

    order = W.partitionBy("customer").orderBy("ts", "id")
    known = F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])
    rows = events.dropDuplicates(["customer", "id"]).withColumn("s", F.last(F.try_element_at(known, F.col("status")), True).over(order))
    changed = rows.withColumn("changed", ~F.col("s").eqNullSafe(F.lag("s").over(order)))
    return changed.groupBy("customer").agg(F.max_by("s", F.struct("ts", "id")).alias("status"), F.max(F.when(F.col("changed"), F.col("ts"))).alias("since"), F.max("ts").alias("at"), F.count("*").alias("n"))


def availability(wanted: DataFrame, there: DataFrame, today, batch: str = "batch_id", due: str = "due") -> DataFrame:
    """Batches that are not there: not yet due ones can be tried again, older ones are missing for good."""
    gone = wanted.join(there.select(batch).distinct(), batch, "left_anti")
    return gone.withColumn("verdict", F.when(F.datediff(F.lit(today), due) <= 3, "retry").otherwise("missing"))


def keep_first_request(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """A request for each address; a repeated one is no error and changes nothing."""
    from ..operators.relational import insert_missing

    return insert_missing(requests.withColumn("email", F.lower(F.trim("email"))), stored, ["email"], "ts")


def opt_out(recipients: DataFrame, requests: DataFrame) -> DataFrame:
    """The recipients that remain."""
    return recipients.join(requests.select(F.lower(F.trim("email")).alias("_e")).distinct(), F.lower(F.trim("email")) == F.col("_e"), "left_anti")
