"""Consumption-tier marts. Facts are aggregated to the grain of the mart before they are joined."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tierflow.functions.money import exact_sum
from tierflow.operators.history import surrogate_key
from tierflow.operators.ordered import ntiles
from tierflow.workspace import durable


def priced_owners(df: DataFrame, owner: str, price: Column) -> DataFrame:
    """Listings, those with a price, and the sum of prices of each owner: one row for a join."""
    return df.groupBy(owner).agg(F.count("*").alias("n"), F.count(price).alias("n_priced"), F.sum(price).alias("prices"))


def average_price(owners: DataFrame, district: str) -> DataFrame:
    """Listings and mean price per district, from :func:`priced_owners`."""
    mean = F.try_divide(F.sum("prices").cast("double"), F.sum("n_priced").cast("double"))
    return owners.groupBy(district).agg(F.sum("n").alias("n"), mean.alias("avg_price"))


def type_shares(df: DataFrame, kind: str) -> DataFrame:
    """Count and share per type, and whether no type is more frequent."""
    counts = df.groupBy(kind).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    largest = counts.agg(F.max("n")).scalar()
    return counts.select(
        kind,
        "n",
        (F.col("n").cast("double") / total.cast("double")).alias("share"),
        (F.col("n") == largest).alias("is_dominant"),
    )


def top_owners(df: DataFrame, owner: str, k: int) -> DataFrame:
    """The ``k`` owners with most rows; ties go to the smaller owner."""
    counts = df.groupBy(owner).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), owner).limit(k)


def segment_counts(df: DataFrame, measure: str, limits: Sequence[tuple[str, float]], otherwise: str) -> DataFrame:
    """Rows per segment: the first ``(label, upper bound)`` whose bound the measure is below."""
    segment = F.when(F.col(measure).isNull(), F.lit(None))
    for label, upper in limits:
        segment = segment.when(F.col(measure) < upper, label)
    return df.groupBy(segment.otherwise(otherwise).alias("segment")).agg(F.count("*").alias("n"))


def active_owners(df: DataFrame, owner: str, active: Column) -> DataFrame:
    """Active rows of each owner."""
    return df.where(active).groupBy(owner).agg(F.count("*").alias("n_active"))


def active_density(owners: DataFrame, area: str, k: int) -> DataFrame:
    """The ``k`` areas with most active rows, from :func:`active_owners`."""
    counts = owners.groupBy(area).agg(F.sum("n_active").alias("n_active"))
    return counts.orderBy(F.desc("n_active"), area).limit(k)


def rfm(
    orders: DataFrame, customer: str, order: str, date: str, amount: Column, today: Column, buckets: int = 5
) -> DataFrame:
    """Recency, frequency, monetary value and days since the first purchase per customer, with
    a quantile score each (higher is better)."""
    base = orders.groupBy(customer).agg(
        F.datediff(today, F.max(date)).alias("recency"),
        F.count(order).alias("frequency"),
        F.sum(amount).alias("monetary"),
        F.datediff(today, F.min(date)).alias("days_since_first"),
    )
    orders_of = {"r_score": ("recency", True), "f_score": ("frequency", False), "m_score": ("monetary", False)}
    scored = ntiles(durable(base), buckets, {score: [by, (customer, False)] for score, by in orders_of.items()})
    return scored.withColumn("monetary", F.col("monetary").cast("double")).withColumn(
        "segment", F.concat("r_score", "f_score", "m_score")
    )


def monthly_sales(df: DataFrame, date: str, keys: Sequence[str], order: str, amount: Column) -> DataFrame:
    """Revenue, lines, orders and average order value per month and key."""
    month = F.to_date(F.date_trunc("month", date)).alias("month")
    return (
        df.groupBy(month, *keys)
        .agg(
            exact_sum(amount).alias("revenue"),
            F.count("*").alias("n_lines"),
            F.count_distinct(order).alias("n_orders"),
        )
        .withColumn("aov", F.col("revenue") / F.col("n_orders").cast("double"))
    )


def monthly_rollup(df: DataFrame, date: str, key: str, amount: Column) -> DataFrame:
    """Revenue per month and key with subtotals. The roll-up runs on the monthly sums, so its
    copies of rows are few."""
    month = F.to_date(F.date_trunc("month", date)).alias("month")
    fine = df.groupBy(month, key).agg(F.sum(amount).alias("_sum"), F.count("*").alias("_n"))
    return fine.rollup("month", key).agg(
        F.sum("_sum").cast("double").alias("revenue"),
        F.sum("_n").alias("n_lines"),
        F.grouping_id().cast("int").alias("level"),
    )


def lifetime_value(orders: DataFrame, customer: str, order: str, amount: Column) -> DataFrame:
    """Orders, total revenue and average order value per customer."""
    return orders.groupBy(customer).agg(
        F.count_distinct(order).alias("n_orders"),
        exact_sum(amount).alias("ltv"),
        (F.sum(amount).cast("double") / F.count_distinct(order).cast("double")).alias("aov"),
    )


def rolling_sums(df: DataFrame, key: str, timestamp: str, amount: Column, days: Sequence[int]) -> DataFrame:
    """Trailing calendar-day sums including the current day, on one total per key and day."""
    daily = df.groupBy(key, F.to_date(timestamp).alias("day")).agg(
        F.sum(amount).alias("_sum"), F.count("*").alias("n")
    )
    by_day = Window.partitionBy(key).orderBy(F.unix_date("day"))
    columns = [
        F.sum("_sum").over(by_day.rangeBetween(-(d - 1), 0)).cast("double").alias(f"sum_{d}d")
        for d in days
    ]
    return daily.select(key, "day", "n", F.col("_sum").cast("double").alias("total"), *columns)


def yearly_growth(df: DataFrame, key: str, date: str, amount: Column) -> DataFrame:
    """Revenue per key and year, and its growth over the year before; null without one."""
    yearly = df.groupBy(key, F.year(date).alias("year")).agg(exact_sum(amount).alias("revenue"))
    by_year = Window.partitionBy(key).orderBy("year")
    previous = F.when(F.lag("year").over(by_year) == F.col("year") - 1, F.lag("revenue").over(by_year))
    return yearly.select(
        key,
        "year",
        "revenue",
        F.try_divide(F.col("revenue") - previous, previous).alias("growth"),
    )


def cohort_retention(orders: DataFrame, customer: str, date: str) -> DataFrame:
    """Customers per first-order month who ordered again n months later, and their share."""
    month = F.to_date(F.date_trunc("month", date)).alias("month")
    # One row per customer and month: a customer has no more rows than there are months.
    active = orders.groupBy(customer, month).agg(F.count("*").alias("_n"))
    first = F.min("month").over(Window.partitionBy(customer))
    counts = (
        active.withColumn("cohort", first)
        .groupBy(
            "cohort",
            F.months_between("month", "cohort").cast("int").alias("months_later"),
        )
        .agg(F.count("*").alias("n_customers"))
    )
    size = F.max(F.when(F.col("months_later") == 0, F.col("n_customers"))).over(
        Window.partitionBy("cohort")
    )
    return counts.withColumn(
        "retention", F.col("n_customers").cast("double") / size.cast("double")
    )


def churn(orders: DataFrame, customer: str, date: str, today: Column, idle_days: int) -> DataFrame:
    """Customers, churned ones and churn rate per first-order month. A customer without orders
    for more than ``idle_days`` days has churned."""
    spans = orders.groupBy(customer).agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    return (
        spans.groupBy(F.to_date(F.date_trunc("month", "_first")).alias("cohort"))
        .agg(
            F.count("*").alias("n_customers"),
            F.count_if(F.datediff(today, "_last") > idle_days).alias("n_churned"),
        )
        .withColumn(
            "churn_rate", F.col("n_churned").cast("double") / F.col("n_customers").cast("double")
        )
    )


def funnel(events: DataFrame, user: str, kind: str, timestamp: str, steps: Sequence[str]) -> DataFrame:
    """Users reaching each step strictly after the step before it, and the share of the first
    step's users. Each step keeps one row per user: the earliest time it was reached."""
    # Events are scanned once; what each step needs of them, and each step's users, are tables.
    wanted = durable(events.where(F.col(user).isNotNull() & F.col(kind).isin(*steps)).select(user, kind, timestamp))
    reached = durable(wanted.where(F.col(kind) == steps[0]).groupBy(user).agg(F.min(timestamp).alias("_at")))
    levels = [reached]
    for step in steps[1:]:
        # A busy user's events are partly summed before the shuffle where the join is broadcast, and
        # adaptive execution splits them otherwise.
        later = wanted.where(F.col(kind) == step).join(reached, user)
        reached = durable(later.where(F.col(timestamp) > F.col("_at")).groupBy(user).agg(F.min(timestamp).alias("_at")))
        levels.append(reached)
    counted = [
        level.agg(F.count("*").alias("n")).select(
            F.lit(number).alias("step"), F.lit(step).alias("event"), "n"
        )
        for number, (step, level) in enumerate(zip(steps, levels), start=1)
    ]
    counts = reduce(DataFrame.unionByName, counted)
    first = F.max("n").over(Window.partitionBy())  # one row per step
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), first.cast("double")))


def gross_margin(df: DataFrame, keys: Sequence[str], revenue: Column, cogs: Column, shipping: Column) -> DataFrame:
    """``(revenue - cogs - shipping) / revenue`` per key; null for no revenue. Lines may come summed per
    product, since their costs are linear."""
    totals = df.groupBy(*keys).agg(
        exact_sum(revenue).alias("revenue"),
        exact_sum(cogs).alias("cogs"),
        exact_sum(shipping).alias("shipping"),
    )
    profit = F.col("revenue") - F.col("cogs") - F.col("shipping")
    return totals.withColumn("gross_margin", F.try_divide(profit, F.nullif("revenue", F.lit(0.0))))


def price_index(
    own: DataFrame, competitors: DataFrame, key: str, other_key: str, price: str, other_price: Column, digits: int = 6
) -> DataFrame:
    """Own price over the mean competitor price of the matched product."""
    means = competitors.groupBy(F.col(other_key).alias(key)).agg(
        F.avg(other_price).alias("avg_competitor_price"), F.count("*").alias("n_prices")
    )
    return own.select(key, price).join(means, key).select(
        key,
        price,
        "n_prices",
        F.round("avg_competitor_price", digits).alias("avg_competitor_price"),
        F.round(F.try_divide(F.col(price), F.col("avg_competitor_price")), digits).alias("price_index"),
    )


def lead_time(df: DataFrame, keys: Sequence[str], ordered: str, shipped: str) -> DataFrame:
    """Days from order to shipment per group: count, mean, extremes, and shipments before the
    order."""
    days = F.datediff(shipped, ordered)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.sum(days).cast("double") / F.count(days).cast("double")).alias("avg_days"),
        F.min(days).alias("min_days"),
        F.max(days).alias("max_days"),
        F.count_if(days < 0).alias("n_negative"),
    )


def efficiency(shipped: Column, labor_hours: Column, downtime_penalty: Column) -> Column:
    """Orders shipped per labour hour plus downtime penalty; null for a zero denominator."""
    return F.try_divide(shipped.cast("double"), F.nullif(labor_hours + downtime_penalty, F.lit(0.0)))


def customer_360(
    customers: DataFrame, key: str, facts: Sequence[tuple[DataFrame, str]], zero_filled: Sequence[str]
) -> DataFrame:
    """One row per customer over several facts, each already one row per customer."""
    view = customers
    for fact, fact_key in facts:
        view = view.join(fact.withColumnRenamed(fact_key, key), key, "left")
    return view.fillna(0, subset=list(zero_filled))


UNKNOWN = "unknown"


def with_member_key(facts: DataFrame, members: DataFrame, column: str, name: str, unknown: str = UNKNOWN) -> DataFrame:
    """Facts with the surrogate key of a dimension in ``name``: a hash of the business key in ``column``,
    or the unknown member where the dimension, which has that column, lacks it. No fact is dropped.

    Only the members' keys are joined. Do this on the table that carries the key with the fewest rows.
    """
    known = members.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_member", F.lit(True))
    key = F.when(F.col("_member"), surrogate_key(column)).otherwise(unknown)
    return facts.join(known, column, "left").withColumn(name, key).drop("_member")


def star_fact(lines: DataFrame, dimensions: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Facts with the surrogate key of each dimension, given as (dimension, fact column, name)."""
    for dimension, column, name in dimensions:
        lines = with_member_key(lines, dimension, column, name)
    return lines


def session_kpis(events: DataFrame, user: str, timestamp: str, gap_minutes: int) -> DataFrame:
    """Sessions per user that end after ``gap_minutes`` without an event: start, end (last
    event plus the gap) and events.

    Events of one user within a clock interval as wide as the gap always share a
    session. Folding them first leaves at most one row per user and interval for the
    window, however many events there are.
    """
    width = gap_minutes * 60_000_000
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col(timestamp))
    folded = (
        events.where(F.col(user).isNotNull() & F.col(timestamp).isNotNull())
        .groupBy(user, (micros - F.pmod(micros, F.lit(width))).alias("_slot"))
        .agg(
            F.min(timestamp).alias("_from"),
            F.max(timestamp).alias("_to"),
            F.count("*").alias("_n"),
        )
    )
    by_time = Window.partitionBy(user).orderBy("_slot")
    gap = F.make_dt_interval(mins=F.lit(gap_minutes))
    previous = F.lag("_to").over(by_time)
    opens = (previous.isNull() | (F.col("_from") >= previous + gap)).cast("int")
    marked = folded.withColumn("_opens", opens)
    number = F.sum("_opens").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("_session", number)
        .groupBy(user, "_session")
        .agg(
            F.min("_from").alias("session_start"),
            (F.max("_to") + gap).alias("session_end"),
            F.sum("_n").alias("n_events"),
        )
        .drop("_session")
    )
