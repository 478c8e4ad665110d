"""Integration tier: joins, keys, histories, conformance and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tierflow.catalog.registry import query, table
from tierflow.functions.money import money
from tierflow.operators import components, core, history, joins, marts

NTZ = "timestamp_ntz"


@query(
    """
    SELECT o_orderkey, o_custkey, c_name, n_name, o_totalprice
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def integrate_sources(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey")
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    orders = joins.integrate(table(spark, sf_dir, "orders"), customer, "o_custkey", "left")
    merged = joins.integrate(orders, nation, "c_nationkey", "left")
    return merged.select("o_orderkey", "o_custkey", "c_name", "n_name", "o_totalprice")


@query(
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"""
)
def unmatched_keys(spark, sf_dir):
    pending = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return joins.unmatched(customer, pending.select("c_custkey"), "c_custkey")


@query("SELECT c_custkey, sha256(length(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey || coalesce(length(nullif(c_name, 'Customer#000000007')) || ':' || c_name, '-')) AS customer_key FROM customer")
def surrogate_key(spark, sf_dir):
    """Of the number and the name, one of which is missing."""
    name = F.nullif(F.col("c_name"), F.lit("Customer#000000007"))
    key = history.surrogate_key("c_custkey", name).alias("customer_key")
    return table(spark, sf_dir, "customer").select("c_custkey", key)


@query(
    """
    SELECT l_orderkey || '-' || l_linenumber AS transaction_id,
           CASE WHEN c_custkey IS NULL THEN 'unknown' ELSE sha256(length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey) END AS customer_key,
           CASE WHEN p_partkey IS NULL THEN 'unknown' ELSE sha256(length(CAST(l_partkey AS VARCHAR)) || ':' || l_partkey) END AS product_key,
           CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, l_quantity AS quantity,
           l_extendedprice AS amount, l_discount AS discount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey
    LEFT JOIN (SELECT * FROM part WHERE p_size > 5) ON l_partkey = p_partkey"""
)
def star_fact(spark, sf_dir):
    """Lines of insolvent customers and of small parts, which the dimensions lack, keep an unknown member."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    parts = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    # Customers are looked up for orders, of which there are fewer than lines.
    orders = marts.with_member_key(table(spark, sf_dir, "orders"), customers, "o_custkey", "customer_key")
    orders = orders.select(F.col("o_orderkey").alias("l_orderkey"), "customer_key", "o_orderdate")
    facts = marts.star_fact(table(spark, sf_dir, "lineitem").join(orders, "l_orderkey"), [(parts, "l_partkey", "product_key")])
    return facts.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        "customer_key",
        "product_key",
        F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_key"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
        F.col("l_discount").alias("discount"),
    )


_HISTORY = """
    WITH m AS (
      SELECT *, lag(event_type) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    h AS (
      SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to
      FROM m WHERE p IS NULL OR p <> event_type)"""


def _history(events):
    return history.scd2_build(events, "user_id", "event_type", "ts", "event_id")


@query(_HISTORY + " SELECT *, valid_to IS NULL AS is_current FROM h")
def scd2_build(spark, sf_dir):
    """Event types as a user's changing state."""
    return _history(table(spark, sf_dir, "events"))


@query(_HISTORY + " SELECT *, valid_to IS NULL AS is_current FROM h")
def scd2_merge(spark, sf_dir):
    """The history up to a date, then the later events as one batch: the same as a history of all."""
    events = table(spark, sf_dir, "events")
    border = F.lit("2024-01-20 00:00:00").cast(NTZ)
    known = _history(events.where(F.col("ts") < border))
    batch = events.where(F.col("ts") >= border)
    return history.scd2_merge(known, batch, "user_id", ["event_type"], "ts", "event_id")


@query(
    """
    WITH e AS (SELECT * FROM events WHERE event_type IN ('signup', 'purchase')),
    m AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM e),
    h AS (
      SELECT user_id, event_type AS state, ts AS valid_from,
             lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to
      FROM m WHERE p IS NULL OR p <> event_type)
    SELECT event_id, events.user_id, ts, state FROM events LEFT JOIN h
      ON events.user_id = h.user_id AND ts >= valid_from AND (ts < valid_to OR valid_to IS NULL)
    WHERE event_type IN ('view', 'click', 'error')"""
)
def scd2_asof_join(spark, sf_dir):
    """Each view, click and error with the user's last signup or purchase state."""
    events = table(spark, sf_dir, "events")
    stateful = F.col("event_type").isin("signup", "purchase")
    states = _history(events.where(stateful)).withColumnRenamed("event_type", "state")
    facts = events.where(~stateful).select("event_id", "user_id", "ts")
    return history.scd2_asof(facts, states, "user_id", "ts", "event_id", ["state"])


@query(
    """
    WITH d AS (
      SELECT CAST(unnest(generate_series(date_trunc('year', min(o_orderdate)),
             date_trunc('year', min(o_orderdate)) + INTERVAL 10 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date
      FROM orders),
    n AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n_orders FROM orders GROUP BY 1)
    SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, date, CAST(year(date) AS INTEGER) AS year,
           CAST(quarter(date) AS INTEGER) AS quarter, CAST(month(date) AS INTEGER) AS month,
           CAST(day(date) AS INTEGER) AS day, CAST(dayofweek(date) + 1 AS INTEGER) AS day_of_week,
           CAST(weekofyear(date) AS INTEGER) AS week, dayofweek(date) IN (0, 6) AS is_weekend,
           coalesce(n_orders, 0) AS n_orders
    FROM d LEFT JOIN n USING (date)"""
)
def dim_date(spark, sf_dir):
    """Ten years from the year of the first order, with the orders of each day."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    days = core.date_dimension(orders.agg(F.min("date").alias("first")), "first")
    per_day = orders.groupBy("date").agg(F.count("*").alias("n_orders"))
    return days.join(per_day, "date", "left").fillna(0, subset=["n_orders"])


@query(
    r"""
    SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents
    GROUP BY trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"""
)
def semantic_dedup(spark, sf_dir):
    return core.semantic_dedup(table(spark, sf_dir, "documents"), ["text"], "doc_id")


# Two spellings are left out so that the default is used.
_PRIORITIES = {"1-URGENT": "URGENT", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM"}
_CONFORMED = """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'URGENT' WHEN '2-HIGH' THEN 'HIGH'
             WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'OTHER' END AS priority,
           o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS priority_unmapped
    FROM orders"""


def _coded_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("code")
    )


@query(_CONFORMED)
def conform_codes(spark, sf_dir):
    orders = _coded_orders(spark, sf_dir).drop("o_orderpriority")
    return core.conform(orders, "code", _PRIORITIES, "OTHER", "priority").drop("code")


@query(_CONFORMED)
def conform_table(spark, sf_dir):
    """The mapping is a table, taken from the codes in use, with every code repeated."""
    orders = _coded_orders(spark, sf_dir)
    codes = orders.where(F.col("o_orderpriority").isin(*_PRIORITIES)).select(
        F.col("o_orderpriority").alias("code"), F.substring("o_orderpriority", 3, 10).alias("standard")
    )
    return core.conform(orders.drop("o_orderpriority"), "code", codes, "OTHER", "priority").drop("code")


@query(
    """
    WITH g AS (
      SELECT c_mktsegment, round(CAST(sum(CAST(c_acctbal AS DECIMAL(18, 4))) AS DOUBLE) / count(*), 4) AS m
      FROM customer WHERE c_acctbal > 0 GROUP BY 1)
    SELECT c_custkey, c_mktsegment, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE m END AS c_acctbal,
           c_acctbal <= 0 AS c_acctbal_imputed, least(greatest(c_acctbal, 0), 5000) AS clamped
    FROM customer LEFT JOIN g USING (c_mktsegment)"""
)
def impute_group_mean(spark, sf_dir):
    """Balances of zero or less repaired by the segment's mean, and all balances clamped."""
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_acctbal", core.clamp(F.col("c_acctbal"), 0.0, 5000.0).alias("clamped")
    )
    return core.impute_group_mean(customer, ["c_mktsegment"], "c_acctbal", F.col("c_acctbal") > 0)


@query(
    """
    WITH n AS (SELECT p_brand AS block, p_name AS name, count(*) AS n FROM part GROUP BY ALL)
    SELECT a.block, a.name AS name_a, a.n AS n_a, b.name AS name_b, b.n AS n_b,
           CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance,
           round(1 - CAST(levenshtein(a.name, b.name) AS DOUBLE) / greatest(length(a.name), length(b.name)), 6) AS similarity
    FROM n a JOIN n b ON a.block = b.block AND a.name < b.name AND levenshtein(a.name, b.name) <= 2"""
)
def fuzzy_match(spark, sf_dir):
    """Product names of a brand that are up to two edits apart."""
    part = table(spark, sf_dir, "part")
    return core.fuzzy_match(part, part, "p_brand", "p_name", max_edits=2, self_match=True)


@query(
    """
    WITH e AS (
      SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN user_id END AS uid,
             CASE WHEN event_type <> 'error' THEN user_id % 40 || '@example.com' END AS mail
      FROM events),
    p AS (
      SELECT CASE WHEN c_acctbal > 0 THEN c_custkey END AS solvent, c_custkey, c_custkey % 60 || '@example.com' AS mail
      FROM customer UNION ALL SELECT c_custkey, c_custkey + 1000000, NULL FROM customer WHERE c_custkey % 10 = 1),
    i AS (SELECT solvent, min(c_custkey) AS k, count(DISTINCT c_custkey) > 1 AS a FROM p GROUP BY 1),
    m AS (SELECT mail, min(c_custkey) AS k, count(DISTINCT c_custkey) > 1 AS a FROM p GROUP BY 1)
    SELECT event_id, coalesce(i.k, m.k) AS person,
           CASE WHEN i.k IS NOT NULL THEN 'id' WHEN m.k IS NOT NULL THEN 'email' ELSE 'none' END AS matched_by,
           coalesce(i.a, m.a, false) AS ambiguous
    FROM e LEFT JOIN i ON uid = i.solvent LEFT JOIN m ON i.k IS NULL AND e.mail = m.mail"""
)
def resolve_identity(spark, sf_dir):
    """Views and clicks come without an id and are found by an e-mail that several customers share;
    insolvent customers are not found by id, and some ids belong to two."""
    kind = F.col("event_type")
    mail = lambda key, n: F.concat((F.col(key) % n).cast("string"), F.lit("@example.com"))
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind.isin("signup", "purchase"), F.col("user_id")).alias("uid"),
        F.when(kind != "error", mail("user_id", 40)).alias("own_mail"),
    )
    customer = table(spark, sf_dir, "customer")
    people = customer.select(
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("solvent"), "c_custkey", mail("c_custkey", 60).alias("mail")
    )
    twins = customer.where("c_custkey % 10 = 1").select(
        F.col("c_custkey").alias("solvent"), (F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit(None).cast("string").alias("mail")
    )
    found = core.resolve_identity(
        events, people.unionByName(twins), "event_id", ("uid", "solvent", "c_custkey"), ("own_mail", "mail")
    )
    return found.select("event_id", "person", "matched_by", "ambiguous")


@query(
    """
    WITH d AS (
      SELECT user_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(12, 2))) AS DOUBLE) AS value
      FROM events WHERE event_type = 'view' GROUP BY ALL),
    g AS (SELECT user_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1),
    p AS (
      SELECT g.user_id, g.day, d.value AS v,
        last_value(d.value IGNORE NULLS) OVER w AS v0,
        last_value(CASE WHEN d.value IS NOT NULL THEN g.day END IGNORE NULLS) OVER w AS d0,
        first_value(d.value IGNORE NULLS) OVER x AS v1,
        first_value(CASE WHEN d.value IS NOT NULL THEN g.day END IGNORE NULLS) OVER x AS d1
      FROM g LEFT JOIN d ON g.user_id = d.user_id AND g.day = d.day
      WINDOW w AS (PARTITION BY g.user_id ORDER BY g.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             x AS (PARTITION BY g.user_id ORDER BY g.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT user_id, day, round(coalesce(v, v0 + (v1 - v0) * date_diff('day', d0, day) / date_diff('day', d0, d1)), 6) AS value,
           v IS NULL AS interpolated
    FROM p"""
)
def interpolate_gaps(spark, sf_dir):
    """Daily view values per user on an unbroken run of days."""
    daily = (
        table(spark, sf_dir, "events")
        .where("event_type = 'view'")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.sum(money(F.col("value"))).cast("double").alias("value"))
    )
    filled = core.interpolate_days(daily, "user_id", "day", "value")
    return filled.withColumn("value", F.round("value", 6))


@query(
    """
    SELECT event_id, ts AT TIME ZONE z AT TIME ZONE 'UTC' AS utc FROM (
      SELECT *, CASE event_type WHEN 'view' THEN 'America/New_York' WHEN 'click' THEN 'Asia/Kolkata'
                WHEN 'error' THEN 'Europe/Madrid' ELSE 'UTC' END AS z FROM events)"""
)
def normalize_timezone(spark, sf_dir):
    kind = F.col("event_type")
    zone = (
        F.when(kind == "view", "America/New_York")
        .when(kind == "click", "Asia/Kolkata")
        .when(kind == "error", "Europe/Madrid")
        .otherwise("UTC")
    )
    return table(spark, sf_dir, "events").select("event_id", core.to_utc(F.col("ts"), zone).alias("utc"))


@query(
    """
    WITH RECURSIVE r AS (
      SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN c_custkey // 5 END AS phone,
        CASE WHEN c_custkey % 3 = 0 THEN 'm' || (c_custkey * 7 % 1000) // 4 || '@x' END AS mail FROM customer),
    l AS (
      SELECT a.c_custkey AS a, b.c_custkey AS b FROM r a JOIN r b ON a.phone = b.phone
      UNION SELECT a.c_custkey, b.c_custkey FROM r a JOIN r b ON a.mail = b.mail),
    p AS (SELECT c_custkey AS v, c_custkey AS reached FROM r UNION SELECT p.v, l.b FROM p JOIN l ON p.reached = l.a)
    SELECT c_custkey, phone, mail, person_id FROM r JOIN (SELECT v AS c_custkey, min(reached) AS person_id FROM p GROUP BY 1) USING (c_custkey)"""
)
def resolve_records(spark, sf_dir):
    """Customers that share a phone or a mail address, over any number of steps, are one person."""
    key = F.col("c_custkey")
    records = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key % 5 < 2, F.floor(key / 5)).alias("phone"),
        F.when(key % 3 == 0, F.concat(F.lit("m"), F.floor(key * 7 % 1000 / 4), F.lit("@x"))).alias("mail"),
    )
    return components.resolve_records(records, "c_custkey", ["phone", "mail"])
