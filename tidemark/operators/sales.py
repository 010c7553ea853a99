"""Prospects, customers, feedback and costs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import ceil_div, rank_of

#: Subscription states by the provider's event (fixed values).
STATES = {"active": "ACTIVE", "trialing": "ACTIVE", "past_due": "PAST_DUE", "unpaid": "PAST_DUE", "canceled": "CANCELLED", "incomplete_expired": "CANCELLED"}


def rate(a: Column, b: Column, least: int = 5) -> tuple[Column, Column]:
    """a / b (null if b is 0) and whether b is large enough to mean something."""
    return F.bround(F.try_divide(a, b), 3), b >= least


def stamped(first: Column, status: Column, wanted: str, today: Column) -> Column:
    """The date a status was first reached stays."""
    return F.coalesce(first, F.when(status == wanted, today))


def fit_score(intent_rank: Column, points: int, weight: int, bonus: Column, score: Column) -> Column:
    """Points by relevance, a bonus, and a small share of the score, two places half to even."""
    return F.bround(F.coalesce(intent_rank, F.lit(0)) * (points * weight / 10) + bonus + score * 0.035, 2)


def fit_band(fit: Column) -> Column:
    return F.when(fit >= 55, "A").when(fit >= 38, "B").when(fit >= 15, "C").otherwise("D")


def preferred(items: DataFrame, preferences: DataFrame, band: str, category: str, region: str, spread: int = 64) -> DataFrame:
    """Items by recipients whose least band, categories and regions allow them; an empty set allows all.

    Joined on category, each preference exploded to its categories. Recipients who take all categories are joined under `spread`
    keys among which the items are dealt, so that no key has all items.
    """
    all_ = F.transform(F.sequence(F.lit(0), F.lit(spread - 1)), lambda i: F.concat(F.lit("*"), i.cast("string")))
    wants = preferences.withColumn("_c", F.explode(F.when(F.size("categories") > 0, F.col("categories")).otherwise(all_)))
    dealt = F.concat(F.lit("*"), F.pmod(F.xxhash64(*items.columns), F.lit(spread)).cast("string"))
    offers = items.withColumn("_c", F.explode(F.array(F.col(category), dealt)))
    ok = (rank_of(F.col(band)) >= rank_of(F.col("least_band"))) & ((F.size("regions") == 0) | F.array_contains("regions", F.col(region)))
    return offers.join(wants, "_c").where(ok).drop("_c")


def delivery_allowed(enabled: Column, status: Column, past_due_since: Column, now: Column, grace_days: int = 14) -> Column:
    late = F.coalesce(now > past_due_since + F.make_dt_interval(days=F.lit(grace_days)), F.lit(False))
    return F.coalesce(enabled & status.isin("ACTIVE", "PAST_DUE") & ~((status == "PAST_DUE") & late), F.lit(False))


def block_reason(enabled: Column, status: Column, allowed: Column) -> Column:
    return F.when(allowed, F.lit(None)).when(~enabled, "disabled").when(status == "PAST_DUE", "payment overdue").otherwise(F.concat(F.lit("subscription "), F.lower(status)))


def feedback_sets(df: DataFrame, state: str, customer: str, category: str) -> DataFrame:
    """Counts by state, by customer and state, and by category and state, in one pass."""
    rows = df.withColumns({customer: F.coalesce(customer, F.lit("unattributed")), category: F.coalesce(category, F.lit("uncategorised"))})
    sets = [[F.col(state)], [F.col(customer), F.col(state)], [F.col(category), F.col(state)]]
    return rows.groupingSets(sets, F.col(state), F.col(customer), F.col(category)).agg(F.grouping_id().alias("of"), F.count("*").alias("n"))


def costs(usage: DataFrame, rules: list[tuple[str, float, str]]) -> DataFrame:
    """(line, pence) for each rule (line, price, fixed | run | customer) over usage (runs, customers), and the price to break even at."""
    lines = [F.struct(F.lit(n).alias("line"), (F.lit(p) * (F.lit(1) if by == "fixed" else F.col("runs") if by == "run" else F.col("customers"))).cast("double").alias("pence")) for n, p, by in rules]
    return usage.select(*usage.columns, F.explode(F.array(*lines)).alias("x")).select(*usage.columns, "x.*")


def break_even(fixed: Column, price: Column, variable: Column) -> Column:
    """Customers needed: at least 1, null if a customer costs more than it pays."""
    return F.when(price > variable, F.greatest(F.lit(1), ceil_div(fixed, price - variable)))


def diversified(df: DataFrame, group: str, company: str, category: str, order: list[str], k: int) -> DataFrame:
    """For each group a greedy choice of k rows in order: first new companies with new categories, then new companies.

    The choice depends on what was chosen before, so it is a fold over a group; windows cut a group of any size to what the fold
    can choose, which leaves at most 2 k k + 2 k rows. In the first pass fewer than k categories and companies are taken
    before the last choice, so of a company only its first k categories count, of a category only its first k of these, and of
    all the first 2 k k; in the second pass only each company's first row, of the first 2 k companies.
    """
    from .relational import top_k

    by = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    rows = top_k(df, [group, company, category], 1, *by)
    fresh = top_k(top_k(top_k(rows, [group, company], k, *by), [group, category], k, *by), [group], 2 * k * k, *by)
    rest = top_k(top_k(rows, [group, company], 1, *by), [group], 2 * k, *by)
    both = fresh.withColumn("_pass", F.lit(1)).unionByName(rest.withColumn("_pass", F.lit(2)))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        names, ascending = ["_pass", *[c.strip("-") for c in order]], [True, *[not c.startswith("-") for c in order]]
        pdf = pdf.sort_values(names, ascending=ascending, kind="stable").reset_index(drop=True)
        taken, companies, categories = [], set(), set()
        for i, (n, c, g) in enumerate(zip(pdf["_pass"], pdf[company], pdf[category], strict=True)):
            if len(taken) < k and c not in companies and (n == 2 or g not in categories):
                taken.append(i)
                companies.add(c)
                categories.add(g)
        return pdf.loc[taken].drop(columns="_pass").assign(choice=range(1, len(taken) + 1))

    return both.groupBy(group).applyInPandas(choose, T.StructType([*rows.schema.fields, T.StructField("choice", T.LongType())]))


def limiter(df: DataFrame, key: str, at: str, most: int, seconds: int, event: str) -> DataFrame:
    """(key, event, allowed): at most so many hits of a key in any span of seconds; refused hits don't count.

    Depends on the decisions before it, so it is a fold over a key's hits in time order, fed in batches: the hits of one key are
    read by one task, which holds `most` of them at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, log = object(), []
        for pdf in batches:
            allowed = []
            for k, t in zip(pdf[key], pdf[at], strict=True):
                if k != last:
                    last, log = k, []
                while log and (t - log[0]).total_seconds() >= seconds:
                    log.pop(0)
                allowed.append(len(log) < most)
                if allowed[-1]:
                    log.append(t)
            yield pdf[[key, event]].assign(allowed=allowed)

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {event} {df.schema[event].dataType.simpleString()}, allowed boolean"
    return df.select(key, at, event).repartition(key).sortWithinPartitions(key, at, event).mapInPandas(run, schema)


def sample_rules(band: Column, goods: Column, website: Column, incorporated: Column) -> list[tuple[str, Column]]:
    """Why a lead is not shown as a sample, in order."""
    return [("low_band", ~F.coalesce(band.isin("HIGH", "MEDIUM"), F.lit(False))), ("no_goods", F.trim(F.coalesce(goods, F.lit(""))) == ""), ("no_company", incorporated.isNull()), ("conflicting_website", F.coalesce(website == "CONFLICTING", F.lit(False)))]


def preview_rules(newest: Column, filed: Column, relevance: Column, least: Column, band: Column, category: Column, wanted: Column, contacted: Column, max_days: int = 400) -> list[tuple[str, Column]]:
    """Why a lead is not in a prospect's preview, in order. `newest` is the latest filing date over all leads."""
    return [
        ("already_contacted", F.coalesce(contacted, F.lit(False))),
        ("low_band", ~F.coalesce(band.isin("HIGH", "MEDIUM"), F.lit(False))),
        ("no_date", filed.isNull()),
        ("too_old", F.datediff(newest, filed) > max_days),
        ("not_relevant", ~F.coalesce(rank_of(relevance) >= rank_of(least), F.lit(False))),
        ("other_category", (F.size(wanted) > 0) & ~F.coalesce(F.array_contains(wanted, category), F.lit(False))),
    ]


def rescored(before: DataFrame, after: DataFrame, key: str, band: str) -> DataFrame:
    """How many rows went from each band to each other; rows on one side only have a null."""
    a, b = before.select(key, F.col(band).alias("was")), after.select(key, F.col(band).alias("is"))
    return a.join(b, key, "full").groupBy("was", "is").agg(F.count("*").alias("n"))


def recurring_revenue(customers: DataFrame, prices: DataFrame) -> DataFrame:
    """Active customers and their monthly pence; a plan without a price counts 0."""
    rows = customers.where("status = 'ACTIVE'").join(prices, "plan", "left")
    return rows.agg(F.count("*").alias("paying"), F.coalesce(F.sum(F.coalesce("pence", F.lit(0))), F.lit(0)).cast("long").alias("monthly_pence"))


def operations(runs: DataFrame, deliveries: DataFrame) -> DataFrame:
    """One row: runs of each status, the latest run, deliveries of each status."""
    r = runs.agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "BLOCKED").alias("blocked"), F.max_by("run_id", "started_at").alias("latest"))
    d = deliveries.agg(F.count_if(F.col("status") == "SENT").alias("sent"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    return r.crossJoin(F.broadcast(d))  # one row by one row


def attributed_events(events: DataFrame, customers: DataFrame) -> DataFrame:
    """The customer of each event: by the provider's id, else by address."""
    by_id = customers.select(F.col("provider_id"), F.col("customer_id").alias("_a")).where("provider_id is not null").dropDuplicates(["provider_id"])
    by_mail = customers.select(F.lower("email").alias("_m"), F.col("customer_id").alias("_b")).where("email is not null").dropDuplicates(["_m"])
    rows = events.join(by_id, "provider_id", "left").join(by_mail, F.lower("email") == F.col("_m"), "left")
    return rows.withColumn("customer_id", F.coalesce("_a", "_b")).drop("_a", "_b", "_m")


def unrated(delivered: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    """Delivered rows that nobody has rated."""
    return delivered.join(feedback.select(key).distinct(), key, "left_anti")


def false_positives(feedback: DataFrame, states: tuple[str, ...] = ("BAD_FIT", "TOO_LATE", "WRONG_COMPANY")) -> DataFrame:
    """How many of the ratings say that a lead should not have been shown."""
    return feedback.agg(F.count("*").alias("ratings"), F.count_if(F.col("state").isin(*states)).alias("should_not_have_been_shown"))


#: What speaks for a prospect: (mark in its text, points), the first mark of each kind counts; and marks that rule one out.
PROSPECT_CATEGORY = {"packaging": 30, "ingredients": 28, "design": 22, "logistics": 18}
PROSPECT_SIGNALS = ((("start-up", "emerging brand", "small batch"), 20), (("food", "drink"), 12), (("low minimum", "short run"), 10), (("uk", "england", "scotland"), 6), (("large accounts only", "enterprise"), -15))
RULED_OUT = ("recruitment", "gambling", "tobacco")


def prospect_fit(category: Column, words: Column) -> Column:
    """Points for the category and for the first mark of each kind of signal, 0 to 100; a mark that rules out gives 0."""
    from ..functions.text import first_of

    total = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROSPECT_CATEGORY.items() for x in kv]), category), F.lit(0))
    for marks, points in PROSPECT_SIGNALS:
        total = total + F.when(first_of(marks, words).isNotNull(), points).otherwise(0)
    return F.when(first_of(RULED_OUT, words).isNotNull(), 0).when(total < 0, 0).when(total > 100, 100).otherwise(total)


def supplier_line(supplier: Column, band: Column, category: Column) -> Column:
    """One line on why a lead suits a supplier."""
    need = F.when(band == "HIGH", "is likely to need").when(band == "MEDIUM", "may need")
    return F.when(need.isNotNull(), F.concat(F.lit("A "), F.coalesce(category, F.lit("food")), F.lit(" brand that "), need, F.lit(" "), supplier))


def margin(revenue: Column, cost: Column) -> Column:
    """Per cent of the revenue, one place; null without revenue."""
    return F.bround(F.try_divide((revenue - cost) * 100.0, revenue), 1)


def overlaid(seed: DataFrame, state: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Seed rows with the live state of their key, and defaults where there is none. State without a seed row is left out."""
    rows = seed.join(state, key, "left")
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def patterns(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Combinations that occur `least` times or more, and their share of all that do."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.bround(F.col("n") / F.col("_all"), 3)).drop("_all")  # one row


def supplier_fit(leads: DataFrame, wants: DataFrame, key: str, bonus: Column, stage: Column, score: Column) -> DataFrame:
    """(key, supplier, fit): points by relevance times the weight of each intent that a supplier wants, a tenth of them, with the
    lead's bonus, its stage's points and a small share of its score, two places half to even.

    leads: key and intents (a map from intent to band); wants: (supplier, intent, weight). An equi-join on the intent.
    """
    rows = leads.select(key, bonus.alias("_bonus"), stage.alias("_stage"), score.alias("_score"), F.explode("intents").alias("intent", "_band"))
    points = F.coalesce(rank_of(F.col("_band")), F.lit(0)) * F.col("weight") / 10
    each = rows.join(wants, "intent").groupBy(key, "supplier").agg(F.sum(points).alias("_p"), F.first("_bonus").alias("_bonus"), F.first("_stage").alias("_stage"), F.first("_score").alias("_score"))
    return each.select(key, "supplier", F.bround(F.col("_p") + F.col("_bonus") + F.col("_stage") + F.col("_score") * 0.035, 2).alias("fit"))


def best_fits(fits: DataFrame, key: str) -> DataFrame:
    """By fit and then score from the top."""
    return fits.orderBy(F.desc("fit"), F.desc("score"), key)
