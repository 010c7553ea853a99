"""Prospects: states and what may follow them, what is due, the funnel, lists and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text

#: States in funnel order, and what may follow each beside itself (fixed values).
STATUSES = ("RESEARCHED", "READY", "EMAIL_1_SENT", "REPLIED_INTERESTED", "SAMPLE_REQUESTED", "SAMPLE_SENT", "OFFER_SENT", "SUBSCRIBED", "NOT_NOW", "NO_RESPONSE", "OPTED_OUT", "SUPPRESSED")
FOLLOWS = {
    "RESEARCHED": ("READY", "SUPPRESSED"),
    "READY": ("EMAIL_1_SENT", "RESEARCHED", "SUPPRESSED"),
    "EMAIL_1_SENT": ("REPLIED_INTERESTED", "SAMPLE_REQUESTED", "NOT_NOW", "NO_RESPONSE", "OPTED_OUT", "SUPPRESSED"),
    "REPLIED_INTERESTED": ("SAMPLE_REQUESTED", "SAMPLE_SENT", "NOT_NOW", "OPTED_OUT", "SUPPRESSED"),
    "SAMPLE_REQUESTED": ("SAMPLE_SENT", "NOT_NOW", "OPTED_OUT", "SUPPRESSED"),
    "SAMPLE_SENT": ("OFFER_SENT", "SUBSCRIBED", "NOT_NOW", "NO_RESPONSE", "OPTED_OUT", "SUPPRESSED"),
    "OFFER_SENT": ("SUBSCRIBED", "NOT_NOW", "NO_RESPONSE", "OPTED_OUT", "SUPPRESSED"),
    "SUBSCRIBED": ("SUPPRESSED", "OPTED_OUT"),
    "NOT_NOW": ("READY", "OPTED_OUT", "SUPPRESSED"),
    "NO_RESPONSE": ("READY", "OPTED_OUT", "SUPPRESSED"),
}
#: What can be due, the nearest to revenue first, and priorities in order (fixed values).
ACTIONS = ("SEND FULL SAMPLE", "SEND SUBSCRIPTION OFFER", "HANDLE REPLY", "SEND FOLLOW-UP", "SEND FIRST EMAIL", "FINISH RESEARCH")
PRIORITIES = ("A", "B", "C", "SUPPRESS")


def place_in(values: tuple[str, ...], c: Column) -> Column:
    """1, 2 ... by the order of the values; 0 for another one."""
    return F.array_position(F.array(*map(F.lit, values)), c)


def transition_ok(old: Column, new: Column) -> Column:
    """Whether a state may become another; it may stay what it is."""
    return F.coalesce(old == new, F.lit(False)) | F.coalesce(*[F.when(old == k, new.isin(*v)) for k, v in FOLLOWS.items()], F.lit(False))


def contactable(status: Column) -> Column:
    return ~status.isin("OPTED_OUT", "SUPPRESSED")


def due_action(status: Column, priority: Column, email_sent: Column, sample_sent: Column, reply: Column, today: Column, days: int = 7) -> Column:
    """What is to be done with a prospect now; null if nothing, or nobody may write to it."""
    waited = lambda since: F.datediff(today, since) >= days
    return (
        F.when((status == "RESEARCHED") & (priority != "SUPPRESS"), "FINISH RESEARCH")
        .when(status == "READY", "SEND FIRST EMAIL")
        .when((status == "EMAIL_1_SENT") & waited(email_sent), "SEND FOLLOW-UP")
        .when(status.isin("REPLIED_INTERESTED", "SAMPLE_REQUESTED"), "SEND FULL SAMPLE")
        .when((status == "SAMPLE_SENT") & waited(sample_sent), "SEND SUBSCRIPTION OFFER")
        .when((status == "OFFER_SENT") & (reply == "POSITIVE"), "HANDLE REPLY")
    )


def due_list(df: DataFrame, action: str, priority: str, name: str) -> DataFrame:
    """Rows with an action, by action, priority and name."""
    rank = place_in(PRIORITIES, F.col(priority))
    return df.where(F.col(action).isNotNull()).orderBy(place_in(ACTIONS, F.col(action)), F.when(rank == 0, 9).otherwise(rank), F.lower(name))


def funnel(df: DataFrame) -> DataFrame:
    """One row: how many prospects came how far, by the dates at which they did, whatever became of them later.

    df: status, priority, email_1_sent_date, sample_requested_date, sample_sent_date, offer_sent_date, converted_date, opted_out.
    """
    s, there = F.col("status"), lambda c: F.col(c).isNotNull()
    answered = (place_in(STATUSES, s) >= STATUSES.index("REPLIED_INTERESTED") + 1) & ~s.isin("NO_RESPONSE", "OPTED_OUT", "SUPPRESSED")
    counts = {
        "qualified": F.col("priority").isin("A", "B") & contactable(s), "email_1_sent": there("email_1_sent_date"), "replies": answered, "sample_requests": there("sample_requested_date"), "samples_sent": there("sample_sent_date"),
        "offers_sent": there("offer_sent_date"), "subscribed": there("converted_date") | (s == "SUBSCRIBED"), "opted_out": F.coalesce("opted_out", F.lit(False)), "suppressed": s == "SUPPRESSED",
    }
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()])


def spread(df: DataFrame) -> DataFrame:
    """(status, priority, n): counts by status, and by priority, in one pass; the other column is null."""
    return df.groupingSets([[F.col("status")], [F.col("priority")]], F.col("status"), F.col("priority")).agg(F.count("*").alias("n"))


def listing(df: DataFrame, *, priority: str | None = None, status: str | None = None, category: str | None = None) -> DataFrame:
    """The prospects that are asked for, by priority, fit from the top, and name."""
    for column, wanted in (("priority", priority), ("status", status), ("supplier_category", category)):
        df = df.where(F.col(column) == wanted) if wanted else df
    return df.orderBy("priority", F.desc("fit"), "company_name")


def audit(df: DataFrame) -> DataFrame:
    """One row: prospects without a website, with one that must be verified, and whom nobody can reach."""
    unreachable = contactable(F.col("status")) & ~F.coalesce("verified_email", F.lit(False)) & (F.col("contact_route") == "unknown")
    return df.agg(F.count_if(F.trim(text("website")) == "").alias("no_website"), F.count_if(F.contains(F.lower(text("notes")), F.lit("verify"))).alias("to_verify"), F.count_if(unreachable).alias("no_route"))


def product_metrics(stored: DataFrame) -> DataFrame:
    """One row: deliverable opportunities, those of each band, batches, and deliverable ones a batch, two places."""
    good = ~F.col("suppressed") & F.col("band").isin("HIGH", "MEDIUM")
    n = stored.agg(F.count_if(good).alias("deliverable"), F.count_if(good & (F.col("band") == "HIGH")).alias("high"), F.count_if(good & (F.col("band") == "MEDIUM")).alias("medium"), F.count_distinct("batch_id").alias("batches"))
    return n.withColumn("per_batch", F.coalesce(F.bround(F.try_divide("deliverable", "batches"), 2), F.lit(0.0)))


def domain_of(website: Column) -> Column:
    """What tells websites apart; '' means it can't be told."""
    return F.trim(F.split(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text(website))), "^https?://", ""), r"^www\.", ""), "/")[0])


def company_of(name: Column) -> Column:
    """What tells companies apart: plain letters and digits, without legal forms and common words anywhere in the name."""
    plain = F.regexp_replace(F.lower(F.trim(text(name))), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(limited|ltd|llp|plc|group|holdings|uk|co|company|the)\b", " "), r"\s+", " "))


def latest_notes(feedback: DataFrame, at: str = "created_at", most: int = 12) -> DataFrame:
    """The newest feedback that says something; the limit is the report's."""
    return feedback.where(F.trim(text("note")) != "").orderBy(F.desc(at), "note").limit(most)


def with_opportunity(feedback: DataFrame, stored: DataFrame, order: str) -> DataFrame:
    """Feedback (dedupe_key or number) with brand, number, key and batch of the first stored opportunity of its key, else of its number.

    Feedback on what is not stored keeps what it came with.
    """
    first = lambda k, p: stored.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"{p}_id")).agg(F.min_by(F.struct("dedupe_key", "number", "brand", "batch_id"), order).alias(p))
    has_key = F.col("dedupe_key").isNotNull() & (F.col("dedupe_key") != "")
    rows = feedback.join(first("dedupe_key", "_a"), has_key & (F.col("dedupe_key") == F.col("_a_id")), "left").join(first("number", "_b"), ~F.coalesce(has_key, F.lit(False)) & (F.col("number") == F.col("_b_id")), "left")
    row = F.coalesce("_a", "_b")
    return rows.withColumns({"dedupe_key": F.coalesce(F.nullif("dedupe_key", F.lit("")), row["dedupe_key"]), "number": F.coalesce("number", row["number"]), "brand": row["brand"], "batch_id": row["batch_id"]}).drop("_a", "_b", "_a_id", "_b_id")
