"""Business questions and marts."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tierflow.catalog.registry import query, table
from tierflow.functions.money import exact_sum, money
from tierflow.operators import joins, maintenance, marts
from tierflow.plans.bronze import to_bronze
from tierflow.sources.files import scan_parquet
from tierflow.specs import EntitySpec
from tierflow.workspace import staging_path

TODAY = "2002-01-01"


def _districts(spark, sf_dir):
    """Customer key to region name."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return customer.select("c_custkey", "n_name", F.col("r_name").alias("district"))


@query(
    """
    SELECT r_name AS district, count(*) AS n,
           CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) / count(*) AS avg_price
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 0 GROUP BY 1"""
)
def avg_price_by_district(spark, sf_dir):
    """Orders through a bronze pass, then their mean price per region."""
    raw = scan_parquet(spark, f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("ID"), F.col("o_custkey").alias("Host-Id"), F.col("o_totalprice").alias("Price"), "_source_file"
    )
    spec = EntitySpec("orders", casts={"id": T.LongType(), "price": T.DecimalType(12, 2)}, positives=("price",), order=("price",))
    bronze = to_bronze(raw, spec, "20240131")
    hosts = marts.priced_owners(bronze, "host_id", F.col("price"))
    placed = hosts.join(_districts(spark, sf_dir), F.col("host_id") == F.col("c_custkey"))
    return marts.average_price(placed, "district")


@query(
    """
    WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1)
    SELECT p_type, n, n / (SELECT sum(n) FROM c) AS share, n = (SELECT max(n) FROM c) AS is_dominant FROM c"""
)
def dominant_type(spark, sf_dir):
    return marts.type_shares(table(spark, sf_dir, "part"), "p_type")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def top_hosts(spark, sf_dir):
    return marts.top_owners(table(spark, sf_dir, "orders"), "o_custkey", 10)


@query(
    """
    SELECT CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 30 THEN 'medium' ELSE 'high' END AS segment, count(*) AS n
    FROM lineitem GROUP BY 1"""
)
def occupancy_segments(spark, sf_dir):
    return marts.segment_counts(table(spark, sf_dir, "lineitem"), "l_quantity", [("low", 10), ("medium", 30)], "high")


@query(
    """
    SELECT n_name, count(*) AS n_active FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY n_active DESC, n_name LIMIT 5"""
)
def active_density(spark, sf_dir):
    owners = marts.active_owners(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "O")
    return marts.active_density(owners.join(_districts(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")), "n_name", 5)


@query(
    f"""
    WITH b AS (
      SELECT o_custkey, CAST(date_diff('day', max(o_orderdate), TIMESTAMP '{TODAY}') AS INTEGER) AS recency,
             count(*) AS frequency, sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS m,
             CAST(date_diff('day', min(o_orderdate), TIMESTAMP '{TODAY}') AS INTEGER) AS days_since_first
      FROM orders GROUP BY 1),
    s AS (
      SELECT o_custkey, recency, frequency, CAST(m AS DOUBLE) AS monetary, days_since_first,
             CAST(ntile(5) OVER (ORDER BY recency DESC, o_custkey) AS INTEGER) AS r_score,
             CAST(ntile(5) OVER (ORDER BY frequency, o_custkey) AS INTEGER) AS f_score,
             CAST(ntile(5) OVER (ORDER BY m, o_custkey) AS INTEGER) AS m_score FROM b)
    SELECT *, concat(r_score, f_score, m_score) AS segment FROM s"""
)
def rfm_segments(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    today = F.lit(TODAY).cast("date")
    return marts.rfm(orders, "o_custkey", "o_orderkey", "o_orderdate", money(F.col("o_totalprice")), today)


def _sales(spark, sf_dir):
    """Order lines with product type, region, order date and net amount."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # Orders get their region first: they are shuffled by customer, the lines only by order.
    placed = orders.join(_districts(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    priced = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    priced, placed = joins.dealt([(priced, "l_orderkey"), (placed, "o_orderkey")], lines.count())
    return priced.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))


def _net():
    return money(F.col("l_extendedprice")) * (1 - F.col("l_discount").cast("decimal(4,2)"))


_NET = "CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))"


@query(
    f"""
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, p_type, r_name AS district,
           CAST(sum({_NET}) AS DOUBLE) AS revenue, count(*) AS n_lines, count(DISTINCT o_orderkey) AS n_orders,
           CAST(sum({_NET}) AS DOUBLE) / count(DISTINCT o_orderkey) AS aov
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def monthly_sales(spark, sf_dir):
    return marts.monthly_sales(_sales(spark, sf_dir), "o_orderdate", ["p_type", "district"], "o_orderkey", _net())


@query(
    f"""
    SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag, CAST(sum({_NET}) AS DOUBLE) AS revenue,
           count(*) AS n_lines, CAST(grouping(month, l_returnflag) AS INTEGER) AS level
    FROM lineitem GROUP BY ROLLUP (month, l_returnflag)"""
)
def monthly_sales_rollup(spark, sf_dir):
    return marts.monthly_rollup(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_returnflag", _net())


@query(
    """
    SELECT o_custkey, count(DISTINCT o_orderkey) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS ltv,
           CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) / count(DISTINCT o_orderkey) AS aov
    FROM orders GROUP BY 1"""
)
def customer_ltv_aov(spark, sf_dir):
    return marts.lifetime_value(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", money(F.col("o_totalprice")))


def _rolling(days):
    return (
        f"CAST(sum(s) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL {days - 1} DAY PRECEDING "
        f"AND CURRENT ROW) AS DOUBLE) AS sum_{days}d"
    )


@query(
    f"""
    WITH d AS (
      SELECT event_type, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(12, 2))) AS s, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, day, n, CAST(s AS DOUBLE) AS total, {_rolling(7)}, {_rolling(30)}, {_rolling(90)} FROM d"""
)
def rolling_7_30_90(spark, sf_dir):
    return marts.rolling_sums(table(spark, sf_dir, "events"), "event_type", "ts", money(F.col("value")), (7, 30, 90))


@query(
    """
    WITH y AS (
      SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year,
             CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS revenue FROM orders GROUP BY ALL),
    l AS (
      SELECT *, CASE WHEN lag(year) OVER w = year - 1 THEN lag(revenue) OVER w END AS p FROM y
      WINDOW w AS (PARTITION BY o_orderpriority ORDER BY year))
    SELECT o_orderpriority, year, revenue, (revenue - p) / p AS growth FROM l"""
)
def yoy_growth(spark, sf_dir):
    return marts.yearly_growth(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", money(F.col("o_totalprice")))


@query(
    """
    WITH a AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
    f AS (SELECT o_custkey, min(m) AS cohort FROM a GROUP BY 1),
    c AS (
      SELECT cohort, CAST(date_diff('month', cohort, m) AS INTEGER) AS months_later, count(*) AS n_customers
      FROM a JOIN f USING (o_custkey) GROUP BY ALL)
    SELECT *, n_customers / max(n_customers) FILTER (months_later = 0) OVER (PARTITION BY cohort) AS retention FROM c"""
)
def cohort_retention(spark, sf_dir):
    return marts.cohort_retention(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query(
    f"""
    WITH s AS (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l FROM orders GROUP BY 1)
    SELECT CAST(date_trunc('month', f) AS DATE) AS cohort, count(*) AS n_customers,
           count(*) FILTER (date_diff('day', l, TIMESTAMP '{TODAY}') > 365) AS n_churned,
           count(*) FILTER (date_diff('day', l, TIMESTAMP '{TODAY}') > 365) / count(*) AS churn_rate
    FROM s GROUP BY 1"""
)
def churn_rate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return marts.churn(orders, "o_custkey", "o_orderdate", F.lit(TODAY).cast("date"), 365)


FUNNEL = ("view", "click", "signup", "purchase")


@query(
    """
    WITH a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1),
    b AS (SELECT user_id, min(ts) AS t FROM events JOIN a USING (user_id) WHERE event_type = 'click' AND ts > a.t GROUP BY 1),
    c AS (SELECT user_id, min(ts) AS t FROM events JOIN b USING (user_id) WHERE event_type = 'signup' AND ts > b.t GROUP BY 1),
    d AS (SELECT user_id, min(ts) AS t FROM events JOIN c USING (user_id) WHERE event_type = 'purchase' AND ts > c.t GROUP BY 1),
    u AS (
      SELECT 1 AS step, 'view' AS event, count(*) AS n FROM a UNION ALL SELECT 2, 'click', count(*) FROM b
      UNION ALL SELECT 3, 'signup', count(*) FROM c UNION ALL SELECT 4, 'purchase', count(*) FROM d)
    SELECT *, n / max(n) OVER () AS share FROM u"""
)
def conversion_funnel(spark, sf_dir):
    return marts.funnel(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", FUNNEL)


@query(
    """
    WITH t AS (
      SELECT p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS DOUBLE) AS revenue,
             CAST(sum(CAST(p_retailprice AS DECIMAL(12, 2)) * CAST(l_quantity AS INTEGER)) AS DOUBLE) AS cogs,
             CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_tax AS DECIMAL(4, 2))) AS DOUBLE) AS shipping
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT *, (revenue - cogs - shipping) / nullif(revenue, 0) AS gross_margin FROM t"""
)
def gross_margin(spark, sf_dir):
    shipping = money(F.col("l_extendedprice")) * F.col("l_tax").cast("decimal(4,2)")
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum(_net()).alias("net"), F.sum(shipping).alias("shipping"), F.sum(F.col("l_quantity").cast("int")).alias("quantity")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    cogs = money(F.col("p_retailprice")) * F.col("quantity")
    lines = sold.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return marts.gross_margin(lines, ["p_brand"], F.col("net"), cogs, F.col("shipping"))


@query(
    """
    WITH c AS (
      SELECT l_partkey AS p_partkey, count(*) AS n_prices, avg(l_extendedprice / l_quantity) AS a FROM lineitem GROUP BY 1)
    SELECT p_partkey, p_retailprice, n_prices, round(a, 4) AS avg_competitor_price, round(p_retailprice / a, 4) AS price_index
    FROM part JOIN c USING (p_partkey)"""
)
def price_index(spark, sf_dir):
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    return marts.price_index(
        table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem"), "p_partkey", "l_partkey", "p_retailprice", unit_price, digits=4
    )


@query(
    """
    SELECT o_orderpriority, count(*) AS n, sum(date_diff('day', o_orderdate, l_shipdate)) / count(*) AS avg_days,
           CAST(min(date_diff('day', o_orderdate, l_shipdate)) AS INTEGER) AS min_days,
           CAST(max(date_diff('day', o_orderdate, l_shipdate)) AS INTEGER) AS max_days,
           count(*) FILTER (l_shipdate < o_orderdate) AS n_negative
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""
)
def fulfilment_lead_time(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return marts.lead_time(both, ["o_orderpriority"], "o_orderdate", "l_shipdate")


@query(
    """
    WITH o AS (
      SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS ltv,
             max(o_orderdate) AS last_order FROM orders GROUP BY 1),
    e AS (SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1)
    SELECT c_custkey, c_name, c_mktsegment, coalesce(n_orders, 0) AS n_orders, coalesce(ltv, 0) AS ltv, last_order,
           coalesce(n_events, 0) AS n_events, coalesce(n_errors, 0) AS n_errors
    FROM customer LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN e ON c_custkey = user_id"""
)
def customer_360(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n_orders"), exact_sum(money(F.col("o_totalprice"))).alias("ltv"), F.max("o_orderdate").alias("last_order")
    )
    events = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors")
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    zero = ["n_orders", "ltv", "n_events", "n_errors"]
    return marts.customer_360(customers, "c_custkey", [(orders, "o_custkey"), (events, "user_id")], zero)


@query(
    """
    WITH f AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 2 THEN o_custkey % 100 + 1 ELSE o_custkey END AS customer,
        CAST(o_totalprice AS DECIMAL(18, 2)) + CASE WHEN o_orderkey % 7 = 2 THEN 10 ELSE 0 END AS amount, o_orderdate AS day
      FROM orders WHERE o_orderkey % 13 <> 4)
    SELECT customer, count(*) AS n_rows, CAST(sum(amount) AS DOUBLE) AS revenue, count(DISTINCT day) AS n_days, min(day) AS first_day, max(day) AS last_day
    FROM f GROUP BY customer"""
)
def mart_maintained(spark, sf_dir):
    """Customers' orders kept up to date: pending orders come, some orders change customer and price, others are deleted, and one
    batch is applied twice."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", F.col("o_custkey").alias("customer"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), F.col("o_orderdate").alias("day"),
    )
    moved = orders.where(key % 7 == 2)
    after = moved.withColumns({"customer": F.col("customer") % 100 + 1, "amount": (F.col("amount") + 10).cast("decimal(18,2)")})
    gone = orders.where(key % 13 == 4)
    changed = F.when(key % 7 == 2, F.col("customer") % 100 + 1).otherwise(F.col("customer"))
    price = F.when(key % 7 == 2, F.col("amount") + 10).otherwise(F.col("amount")).cast("decimal(18,2)")
    mart = maintenance.Mart(("customer",), {"revenue": "amount"}, {"n_days": "day"}, {"first_day": ("min", "day"), "last_day": ("max", "day")})
    batches = [
        maintenance.images(None, orders.where("o_orderstatus <> 'P'")),
        maintenance.images(None, orders.where("o_orderstatus = 'P'")),
        maintenance.images(moved, after),
        maintenance.images(gone.withColumns({"customer": changed, "amount": price}), None),
    ]
    path = staging_path(spark, "mart")
    for version, batch in [*enumerate(batches, start=1), (3, batches[2])]:
        maintenance.maintain(batch, mart, path, version, buckets=8)
    return maintenance.read_mart(spark, mart, path, orders.schema).withColumn("revenue", F.col("revenue").cast("double"))
